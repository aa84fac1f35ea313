"""Exact dedup by content sort.

The normalised text is the sort key: Spark samples splitters, range-partitions by (start of the text, its hash, row salt) and sorts
each partition externally, so equal texts are neighbours, the one that stays first. A pass over each sorted partition compares
every text in full with the one before it; a run's first row, its size and its SHA-256 go to all rows of the run. The salt in the
range key lets the splitters cut through a large group of copies, so no partition holds more than its share. Only runs
at a partition's edges can go on in another: their parts, about two a partition, are summed and sent to all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, settle, tasks, whole_row


def normalised(text):
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def length_of(text):
    """Code points; null counts as empty."""
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


_RUN = "row_id long, none boolean, n long, text_sha256 string, size long, keep_row long, keep_none boolean, keep_n long, head boolean, edge boolean"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (start of the text, hash, text, longest, id) with what their run of equal texts has in this partition.

    `edge`: the run's hash is the partition's first or last, so that the run may go on in another. Texts are held one at a time, and the rows
    of one hash.
    """
    names = [c.split()[0] for c in _RUN.split(", ")]
    held: list[tuple[str, list[tuple]]] = []  # runs of the current hash: label and (row_id, none, n)
    last = now = None
    edge = True

    def given_out(edge: bool) -> list[tuple]:
        return [(*row, label, len(rows), rows[0][0], rows[0][1], rows[0][2], i == 0, edge) for label, rows in held for i, row in enumerate(rows)]

    for batch in batches:
        out: list[tuple] = []
        for key, text, row in zip(batch["h"], batch["norm"], zip(batch["row_id"], batch["none"], batch["n"])):
            if text != last:
                if held and key != now:
                    out += given_out(edge)
                    held, edge = [], False
                held.append((hashlib.sha256(text.encode()).hexdigest(), []))
                last, now = text, key
            held[-1][1].append(row)
        if out:
            yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame(given_out(True), columns=names)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal normalised texts the row with the most code points in its original text stays, then the smallest id.
    Nulls: a null text is empty; a null id comes after every other id and can only stay where no other id has as
    many code points. Rows repeated with one id: each is counted in group_size and each with the staying id and
    length is marked kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("row_id"),
        F.col(id_col).isNull().alias("none"),
        length_of(F.col(text_col)).alias("n"),
        normalised(F.col(text_col)).alias("norm"),
    ).withColumn("h", F.xxhash64("norm"))
    # splitters are sampled on the driver, so they are short: the text's first characters, then a hash of all of it, then salt
    start = F.substring("norm", 1, 24)
    dealt = rows.repartitionByRange(tasks(spark), start, "h", F.xxhash64("row_id")).sortWithinPartitions(start, "h", "norm", F.desc("n"), "none", "row_id")
    found = settle(dealt.mapInPandas(_runs, _RUN))
    stays = F.struct((-F.col("keep_n")).alias("m"), F.col("keep_none").alias("z"), F.col("keep_row").alias("i"))
    edges = found.where("head and edge").groupBy("text_sha256").agg(F.sum("size").alias("group_size"), F.min(stays).alias("best"))
    best = F.coalesce("best", stays)
    joined = found.join(F.broadcast(edges), "text_sha256", "left").select("*", best["m"].alias("m"), best["z"].alias("z"), best["i"].alias("i"))
    return joined.select(
        F.when(~F.col("none"), F.col("row_id")).alias("doc_id"),
        F.when(~F.col("z"), F.col("i")).alias("keep_id"),
        F.coalesce("group_size", "size").alias("group_size"),
        ((F.col("none") == F.col("z")) & (F.col("row_id") == F.col("i")) & (F.col("n") == -F.col("m"))).alias("kept"),
        "text_sha256",
        F.col("n").alias("n_chars"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of docs: one of each group of equal normalised texts (see duplicate_groups).

    Rows repeated with the staying id and length are one document and come back once.
    """
    own = F.col(id_col).cast("long")
    keys = ["sha", "n", "none", "own"]
    kept = duplicate_groups(docs, id_col, text_col).where("kept")
    stays = kept.select(F.col("text_sha256").alias("sha"), F.col("n_chars").alias("n"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("own"))
    marked = docs.select(whole_row(docs), F.sha2(normalised(F.col(text_col)), 256).alias("sha"), length_of(F.col(text_col)).alias("n"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("own"))
    # dealt by these keys already when repeated rows are taken out
    return marked.join(stays, keys, "left_semi").dropDuplicates(keys).select("row.*")
