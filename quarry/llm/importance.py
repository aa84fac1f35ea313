"""Importance resampling: documents drawn by how much more likely their hashed n-grams are in a target collection than in the corpus.

1. Chunks. A text of over CHUNK bytes is cut at word boundaries into chunks that go to all tasks. A chunk owns the words that it
   starts with and carries the n - 1 words after them, so that every run of words is counted once, where it starts.
2. Counts. Each task counts buckets of its chunks' features; corpus and target counts are sums over all of them, one row a bucket.
3. Weights. A chunk's gains are summed, and chunks by document; a document's weight is the floored mean.
4. Draw. Scores are weights with a Gumbel number from a hash of the id. Scores are whole numbers in a range that the counts bound, so
   counting them finds the least drawn one, and only those from it up are put in order, range-partitioned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import number_rows, settle, tasks, tidy

CHUNK = 1 << 16  # bytes of a chunk, about
_ROOM = 500_000  # features whose buckets a task keeps
#: Bytes of words as they are, A-Z lower-cased; all others are between words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Buckets(dict):
    """The bucket of each feature, worked out when it is first asked for."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _ROOM:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.size
        return bucket


def features(words: list[bytes], own: int, n: int, buckets: Buckets) -> np.ndarray:
    """Buckets of all runs of 1 to n words that start with one of the first `own` words."""
    runs = [words[:own]]
    for k in range(2, n + 1):
        starts = max(0, min(own, len(words) - k + 1))
        runs.append([b" ".join(words[i : i + k]) for i in range(starts)])
    total = sum(map(len, runs))
    return np.fromiter(map(buckets.__getitem__, chain.from_iterable(runs)), np.int64, total)


def split(text: bytes, n: int, size: int) -> list[tuple[bytes, int]]:
    """Chunks (words joined by spaces, number of own words) of about so many bytes; the carried words come after the own ones."""
    words = words_of(text)
    ends = np.cumsum([len(w) + 1 for w in words])
    cuts, at = [0], 0
    while at < len(words):
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        cuts.append(at)
    return [(b" ".join(words[a : b + n - 1]), b - a) for a, b in zip(cuts, cuts[1:])] or [(b"", 0)]


def chunks(docs: DataFrame, n: int, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, part, own, t): short texts whole (mark and own null), long ones as chunks, dealt to all tasks. mark tells texts of one id apart."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    over = F.octet_length("t") > size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, mark) in enumerate(zip(batch["t"], batch["mark"])):
                made = split(t.as_py(), n, size)
                row = pa.array([i] * len(made))
                columns = [batch["doc_id"].take(row), pa.array([mark.as_py()] * len(made), pa.string()), pa.array(range(len(made)), pa.int32()), pa.array([own for _, own in made], pa.int32()), pa.array([c for c, _ in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "part", "own", "t"])

    long = texts.where(over).withColumn("mark", F.hex(F.xxhash64("t"))).mapInArrow(tidy(cut), f"doc_id {kind}, mark string, part int, own int, t binary")
    long = long.repartition(tasks(docs.sparkSession), "mark", "part")
    short = texts.where(~over).select("doc_id", F.lit(None).cast("string").alias("mark"), F.lit(0).alias("part"), F.lit(None).cast("int").alias("own"), "t")
    return short.unionByName(long)


def _features(batch: pa.RecordBatch, n: int, known: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """The own words' number and the features' buckets of each chunk."""
    for own, t in zip(batch["own"].to_pylist(), batch["t"]):
        words = words_of(t.as_py())
        mine = len(words) if own is None else own
        yield mine, features(words, mine, n, known)


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = 10_000, **columns) -> np.ndarray:
    """How often each bucket is a feature of some text: one row a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _features(batch, n, known):
                np.add.at(total, found, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    found = chunks(docs, n, **columns).select("own", "t").mapInArrow(tidy(count), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket says for the target, in thousandths of a nat, floored. Every bucket is seen once more than it is."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((int(y) + 1) * (s + size)) / ((int(x) + 1) * (t + size)))) for x, y in zip(source, target)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 1, **columns) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row per input row. gain: one number a bucket, which tasks get as an array."""
    kind = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            made = [(mine, len(found), int(gain[found].sum())) for mine, found in _features(batch, n, known)]
            numbers = np.array(made, np.int64).reshape(-1, 3)
            first = pa.array(batch["part"].to_numpy() == 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], first, *map(pa.array, numbers.T)], ["doc_id", "mark", "first", "n_words", "n_features", "gain"])

    each = chunks(docs, n, **columns).mapInArrow(tidy(run), f"doc_id {kind}, mark string, first boolean, n_words long, n_features long, gain long")
    each = settle(each)
    # the chunks of one text; of a repeated row, of all its copies, which have the same
    sums = each.where("mark is not null").groupBy("doc_id", "mark").agg(F.count_if("first").alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    long = sums.select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "gain")], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    rows = each.where("mark is null").select("doc_id", "n_words", "n_features", "gain").unionByName(long)
    mean = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return rows.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from a hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): floor(percent N / 100) of the N rows with enough words, by score, ties to the smaller id; others' rank is null."""
    rows = settle(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    levels = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # scores lie in a fixed range
    wanted = percent * sum(n for _, n in levels) // 100
    taken, least = 0, None
    for score, n in levels:
        if taken >= wanted:
            break
        taken, least = taken + n, score
    names = ("doc_id", "n_features", "weight", "score")
    none = F.lit(None).cast("long")
    if least is None:
        return rows.select(*names, none.alias("rank"))
    high = able & (F.col("score") >= least)
    placed = number_rows(rows.where(high).select(*names), [F.desc("score"), F.col("doc_id").asc_nulls_last()], "rank")
    placed = placed.select(*names, F.when(F.col("rank") < wanted, F.col("rank") + 1).cast("long").alias("rank"))
    return placed.unionByName(rows.where(~high).select(*names, none.alias("rank")))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", size: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (from 1; null if not drawn).

    Nulls: a null text has no words, weight 0 and no rank; a null id draws as the empty one and comes last among equal scores. Repeated
    rows each get a row, with ranks of their own in no set order between them. Empty tables: no documents give no rows; an empty target
    leaves all to the corpus counts. Other columns are ignored.
    """
    if n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("n and buckets are positive, percent is from 0 to 100")
    mine = {"id_col": id_col, "text_col": text_col, "size": size}
    gain = gains(bucket_counts(docs, n, buckets, **mine), bucket_counts(target, n, buckets, id_col=target_id, text_col=text_col, size=size))
    return draw(weigh(docs, gain, n, **mine), percent, least_words, seed)
