"""What the operators share: text rules, order over partitions, components, and workers' memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import gathered, scratch, settle, shared_dir, stored, tasks  # noqa: F401

#: ASCII white space as the contracts name it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run over a task's batches. Python workers outlive their tasks, so what is free at the end goes back to the system."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return wrapped


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name of the caller's meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def number_rows(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Add the position (from 0) of each row in the given total order.

    Rows are range-partitioned and each partition counts its own; only one count a partition meets on the
    driver. Rows equal in the whole order get neighbouring positions in no set order. An empty table stays empty.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(tasks(spark), *order).withColumn("__part", F.spark_partition_id())
    dealt = settle(dealt)
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "__part int, __before long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        dealt.join(F.broadcast(starts), "__part")  # one row a partition
        .withColumn(into, within + F.col("__before") - F.lit(1))
        .drop("__part", "__before")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (a, b) with b the smallest id reachable, for each a that isn't it.

    Alternating large-star and small-star steps; every step is a pair of aggregations and equi-joins, so a
    hub's edges are summed before the shuffle and split by adaptive skew joins after it. Few edges stay in few tasks. Loops and
    repeated edges are allowed.
    """
    edges = settle(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    n = edges.count()
    few = lambda df: settle(gathered(df.distinct(), n))
    now = few(gathered(edges, n))
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = few(large.where("a != b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        small = small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = few(small)
