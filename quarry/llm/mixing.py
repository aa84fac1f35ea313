"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's share of what is to be taken; sources over `epochs` times their size are
clamped there and their excess goes to the others by weight, until none is above. Sampling: a source taken r times
over gives floor(r) whole repetitions of each document and a seeded sample for the rest: documents in order of a
seeded hash, as far as the source's quota of words goes, and one more that fits best what is then left of it. The cut in that
order is found by descending prefixes of the hash, so a source of any size is summed in parallel and only a sliver of it is ever put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import number_rows, settle, whole_row

WEIGHTS = (3.0, 1.0, 2.0)  # of the first, second, third source, and so on again
SHARE = 1.5  # words to take, as a share of all words
EPOCHS = 2.0  # times that a source is repeated at most
SEED = 20
_FEW = 100_000  # sources up to which their table is broadcast
_DIGIT = 12  # bits of the hash told apart at each step of the descent


def words_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, wanted: float, epochs: float = EPOCHS) -> DataFrame:
    """sources (source_size, weight, ...) with `target` added. A round of clamping is one aggregation to four numbers."""
    cap = F.col("source_size") * F.lit(epochs)
    now = sources.withColumn("over", F.lit(False))
    while True:
        held, weight, n, over = now.agg(
            F.coalesce(F.sum(F.when(F.col("over"), cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~F.col("over"), F.col("weight"))), F.lit(0.0)),
            F.count(F.lit(1)),
            F.count_if("over"),
        ).first()
        if over == n:
            return now.withColumn("target", cap).drop("over")
        level = F.col("weight") * F.lit(max(0.0, wanted - held) / weight)
        new = now.withColumn("over", F.col("over") | (level > cap))
        if new.agg(F.count_if("over")).first()[0] == over:
            return now.withColumn("target", F.when(F.col("over"), cap).otherwise(level)).drop("over")
        now = settle(new)


def _cuts(rows: DataFrame, quotas: DataFrame, few: bool) -> DataFrame:
    """(key, low, cut, extra): rows with hash < low, or (hash, id) <= cut, are each source's first rows within its quota; (hash, id) = extra fits best what is left."""
    small = F.broadcast if few else (lambda t: t)
    whole = rows
    here, low = rows.join(small(quotas), "key").withColumn("low", F.lit(0).cast("long")), F.col("low")
    upward = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)  # over 2^_DIGIT rows a source
    for step in (1, 2):
        shift = 63 - _DIGIT * step
        keyed = here.withColumn("digit", F.shiftright("hash", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1)))
        sums = keyed.groupBy("key", "digit").agg(F.sum("size").alias("s"), F.first("left").alias("left"), F.first("low").alias("low"))
        sums = sums.withColumn("upto", F.sum("s").over(upward)).withColumn("before", F.col("upto") - F.col("s"))
        cell = sums.where("before < left and left <= upto")
        cell = settle(cell.select("key", "digit", (F.col("left") - F.col("before")).alias("left"), (low + F.shiftleft("digit", shift)).alias("low")))
        here = keyed.drop("left", "low").join(small(cell), ["key", "digit"]).drop("digit")
    alike = here.groupBy("key", "hash", "id").agg(F.sum("size").alias("size"), F.first("left").alias("left"), F.first("low").alias("low"))
    inside = Window.partitionBy("key").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, 0)  # 2^-24 of a source
    alike = alike.withColumn("upto", F.sum("size").over(inside))
    within = F.col("upto") <= F.col("left")
    cuts = alike.groupBy("key").agg(
        F.first("low").alias("low"),
        F.max(F.when(within, F.struct("hash", "id"))).alias("cut"),
        (F.first("left") - F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0))).alias("gap"),
    )
    cuts = settle(cuts)
    beyond = whole.join(small(cuts), "key").where((F.col("hash") >= F.col("low")) & F.coalesce(F.struct("hash", "id") > F.col("cut"), F.lit(True)))
    off = F.abs(F.col("size") - F.col("gap"))
    best = beyond.where(off < F.col("gap")).groupBy("key").agg(F.min(F.struct(off.alias("off"), "hash", "id")).alias("b"))
    best = best.select("key", F.struct(F.col("b.hash").alias("hash"), F.col("b.id").alias("id")).alias("extra"))
    return settle(cuts.drop("gap").join(best, "key", "left"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """id, source, key, size and hash, none of which changes between runs."""
    source = F.col(source_col).cast("string")
    return [
        F.col(id_col).alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        words_of(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 63) - 1)).alias("hash"),
    ]


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> tuple[DataFrame, bool]:
    """One row per source: key, source_size, target, whole, low, cut, extra; and whether they are few. rows: id, source, key, size, hash."""
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    # code point order is the order of UTF-8 bytes, as Spark compares strings
    sources = settle(number_rows(sources, [F.col("source").asc_nulls_last()], "place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    n, total = sources.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    few = n <= _FEW
    aimed = settle(water_fill(sources.select("key", "source_size", weight.alias("weight")), share * (total or 0), epochs))
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(epochs)))).otherwise(F.lit(0.0))
    aimed = aimed.withColumn("whole", F.floor(times).cast("long")).withColumn("left", F.least((times - F.floor(times)) * F.col("source_size"), F.col("source_size").cast("double")))
    cuts = _cuts(rows.select("key", "id", "size", "hash"), aimed.where("left > 0").select("key", "left"), few)
    return aimed.join(cuts, "key", "left").select("key", "source_size", "target", "whole", "low", "cut", "extra"), few


def _repeats() -> Column:
    place = F.struct("hash", "id")
    once = (F.col("hash") < F.col("low")) | F.coalesce(place <= F.col("cut"), F.lit(False)) | F.coalesce(place == F.col("extra"), F.lit(False))
    return F.col("whole") + F.coalesce(once, F.lit(False)).cast("long")


def mix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repetitions counted), repeats.

    Nulls: a null source is a source of its own, last in order; a null text has no words; rows with a null id or
    with one repeated id share a hash, and so are taken alike. Sources without words have target 0. An empty table gives
    no rows; other columns are ignored.
    """
    rows = settle(docs.select(*_keyed(docs, id_col, text_col, source_col, seed)))
    sources, few = plan(rows, **how)
    joined = rows.join(F.broadcast(sources) if few else sources, "key")
    repeats = _repeats()
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The rows of docs, all columns kept, each as often as the mix takes it. Cases as in mix_table."""
    made = _keyed(docs, id_col, text_col, source_col, seed)
    sources, few = plan(settle(docs.select(*made)), **how)
    joined = docs.select(whole_row(docs), *made).join(F.broadcast(sources) if few else sources, "key")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), _repeats().cast("int")))).select("row.*")
