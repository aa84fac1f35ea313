"""Running totals and exact percentiles that no single task has to see whole."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import forget, sent, settle, tasks

BUCKETS = 1024  # of a round's histogram
FEW = 100_000  # values that are ranked as they are


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, into: str) -> DataFrame:
    """df with the total of `value` over the rows of its `by` group up to it in the order, itself included. Null values count 0.

    Rows are dealt by ranges of group and order, so a group of any size lies in as many parts as it needs. Each part sums its own rows, and
    what comes before a part in its group is carried over: one row a group and part. Rows that are equal in the whole order follow one
    another in no set order, in one part.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in by]
    dealt = settle(df.repartitionByRange(tasks(spark), *keys, *order).withColumn("__part", F.spark_partition_id()))
    amount = F.coalesce(F.col(value), F.lit(0))
    sums = dealt.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = dealt.alias("l").join(sent(settle(carried)).alias("r"), (F.col("l.__part") == F.col("r.__part")) & same).select("l.*", "r.__before")
    up_to = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(into, F.sum(amount).over(up_to) + F.col("__before")).drop("__part", "__before")


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): nearest-rank percentiles, as doubles. Nulls and NaN are left out; a group of nothing else has no row.

    The value of a rank is found by descent: a histogram of each group's range tells the bucket that the rank is in, whose values' own
    least and greatest are the next range. Each round is one aggregation that combines before it shuffles, to BUCKETS rows for each group and
    share at most, and splits a range of two values or more. When few values are left in all ranges they are ranked as they are.
    """
    names, rows = [f"__{i}" for i in range(len(by))], df.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()])).alias("a")
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = groups.select(*names, asked, "n", "low", "high").select(*names, F.col("a.name").alias("name"), F.greatest(F.ceil(F.col("a.p") * F.col("n")), F.lit(1)).cast("long").alias("rank"), "n", "low", "high")
    state = settle(state)
    while True:
        left = state.where("low < high").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not left:
            break
        within = _met(rows, state.where("low < high"), names)
        if left <= FEW:
            order = Window.partitionBy(*names, "name").orderBy("v")
            found = within.withColumn("k", F.row_number().over(order)).where("k = rank").select(*names, "name", "v")
            done = state.where("low = high").select(*names, "name", F.col("low").alias("v")).unionByName(found)
            return _wide(done, by, names, shares)
        most = F.lit(sys.float_info.max)
        low, high = F.greatest("low", -most) / 2, F.least("high", most) / 2  # halves, as a range of doubles may be greater than a double
        share = F.least(F.floor((F.col("v") / 2 - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        ends = F.when(F.col("v") < -most, F.lit(-1)).when(F.col("v") > most, F.lit(BUCKETS))
        bucket = ends.when(high > low, share).otherwise((F.col("v") > F.col("low")).cast("long"))
        counts = within.groupBy(*names, "name", "rank", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        up_to = Window.partitionBy(*names, "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        chosen = counts.withColumn("before", F.sum("n").over(up_to) - F.col("n")).where("rank > before and rank <= before + n")
        chosen = chosen.select(*names, "name", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high")
        now = settle(state.where("low = high").unionByName(chosen))
        forget(state)
        state = now
    return _wide(state.select(*names, "name", F.col("low").alias("v")), by, names, shares)


def _met(rows: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    if not names:  # one group: a row for each share
        return rows.crossJoin(F.broadcast(state)).where(inside)
    return rows.alias("l").join(sent(state).alias("r"), same).where(inside).select("l.*", "r.name", "r.rank", "r.low", "r.high")


def _wide(found: DataFrame, by: Sequence[str], names: list[str], shares: dict[str, float]) -> DataFrame:
    columns = [F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares]
    return found.groupBy(*[F.col(a).alias(b) for a, b in zip(names, by)]).agg(*columns)
