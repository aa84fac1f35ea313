"""Evidence: verified passages, widened to neighbours or to a whole short source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.positions import placed
from quarry.storage import sent, settle

MOST_CHARACTERS = 16_000


def verified(text, start, end, content):
    """Whether the source's slice is the content, form feeds as spaces."""
    piece = F.translate(F.substring(text, start + 1, end - start), "\f", " ")
    return F.coalesce((end <= F.length(text)) & (piece == content), F.lit(False))


def expand(hits: DataFrame, passages: DataFrame, sources: DataFrame, radius: int = 1, whole: int = 0) -> DataFrame:
    """Widen hits (query_id, doc_id, n, rank) by `radius` passages on each side; sources of at most `whole` characters replace theirs, once, at the best rank.

    passages: doc_id, n, start_offset, end_offset, content; sources: doc_id, text. A hit whose passages don't match the
    source, or whose window is over MOST_CHARACTERS, stays as it is. Ranks don't change.
    """
    if not 0 <= radius <= 3 or whole < 0:
        raise ValueError("radius must be from 0 to 3 and whole not negative")
    asked = sent(settle(hits.select("doc_id").distinct()))  # only what was found is read and verified
    texts = sources.select("doc_id", "text").join(asked, "doc_id", "left_semi")
    mine = placed(passages.select("doc_id", "n", "start_offset", "end_offset", "content").join(asked, "doc_id", "left_semi"), texts)
    mine = mine.select("doc_id", "n", "start_offset", "end_offset", "ok").join(texts.select("doc_id", F.length("text").alias("length")), "doc_id")
    around = Window.partitionBy("doc_id").orderBy("start_offset", "end_offset").rowsBetween(-radius, radius)
    mine = mine.withColumn("from", F.min("start_offset").over(around)).withColumn("to", F.max("end_offset").over(around)).withColumn("all_ok", F.bool_and("ok").over(around))
    found = hits.join(mine, ["doc_id", "n"], "left")
    entire = F.coalesce(F.col("ok") & (F.col("length") <= whole), F.lit(False)) if whole else F.lit(False)
    found = found.withColumn("whole", entire)
    best = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    given = F.coalesce(F.max(F.col("whole").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("given", given).where("given = 0")
    wide = F.coalesce(F.col("all_ok") & (F.col("to") - F.col("from") <= MOST_CHARACTERS), F.lit(False)) if radius else F.lit(False)
    start = F.when(F.col("whole"), F.lit(0).cast("long")).when(wide, F.col("from")).otherwise(F.col("start_offset"))
    end = F.when(F.col("whole"), F.col("length").cast("long")).when(wide, F.col("to")).otherwise(F.col("end_offset"))
    return found.select("query_id", "doc_id", "n", "rank", start.alias("start_offset"), end.alias("end_offset"), F.col("whole").alias("whole_document"))


def source_context(passages: DataFrame, sources: DataFrame, whole: int = 12_000, first: int = 2, before: int = 2) -> DataFrame:
    """(doc_id, n, context): what a model is told about a passage's source: all of it, if it has at most `whole` characters, else its `first` passages and the `before` last ones, none twice.

    passages: doc_id, n, content; sources: doc_id, text. Blank passages are left out. A source's passages lie in one row and are looked up by place.
    """
    own = passages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("p"))
    own = own.join(sources.select("doc_id", F.when(F.length("text") <= whole, F.col("text")).alias("short")), "doc_id")

    def context(x: Column, i: Column) -> Column:
        last = F.slice("p", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)))
        chosen = F.filter(F.array_distinct(F.concat(F.slice("p", 1, first), last)), lambda y: F.trim(y["content"]) != "")
        joined = F.array_join(F.transform(chosen, lambda y: y["content"]), "\n\n")
        return F.struct(x["n"].alias("n"), F.coalesce("short", joined).alias("context"))

    return own.select("doc_id", F.explode(F.transform("p", context)).alias("x")).select("doc_id", "x.*")


def rendered(passages: DataFrame) -> DataFrame:
    """(query_id, answer): `[rank] name (location)` and the text of each passage, in order. For passages without an answer."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("name"), F.lit(" ("), F.col("location"), F.lit(")\n"), F.col("content"))
    each = passages.select("query_id", "rank", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "part")))
    return each.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("answer"))
