"""Page layout: text of a document from the spans that a PDF decoder gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import collapsed

# Where running headers and page numbers sit, how often one repeats, and what makes a heading.
MARGIN, REPEATED_SHARE, REPEATED_PAGES, HEADING_RATIO, HEADING_CHARS, BOLD_SHARE = 0.08, 0.3, 3, 1.25, 150, 0.9
ROMAN, CONTENTS_ENTRY = r"^[IVXLCDM]+\.?$", r"\s\d{1,4}$|^\d{1,4}\s*[–-]\s*\d{1,4}\s"
CAPTION, DROP_CAP_RATIO = r"^(?:Figure|Fig\.|Table)\s+\d+[.:]\s", 2
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ɵ": "ti", "Ʃ": "tt"}


def _join(lines: Column, captions: bool = False) -> Column:
    """Lines joined by spaces, hyphens closed before a small letter; with captions, a line that opens one begins a paragraph."""

    def add(out: Column, line: Column) -> Column:
        hyphen = out.endswith("-") & line.rlike(r"^\p{Ll}")
        more = F.when(hyphen, F.concat(F.substr(out, F.lit(1), F.length(out) - 1), line)).otherwise(F.concat(out, F.lit(" "), line))
        return F.when(out == "", line).otherwise(F.when(line.rlike(CAPTION), F.concat(out, F.lit("\n\n"), line)).otherwise(more) if captions else more)

    return F.aggregate(lines, F.lit(""), add)


def _carry_capitals(blocks: DataFrame) -> DataFrame:
    """Decorated initials go to the front of the next paragraph of their document, which opens a numbered chapter unless a heading stands before it.

    blocks: doc_id, page, block, kind (initial, heading or body), text. Headings between an initial and its paragraph don't take it, a later initial replaces it, and one
    that nothing follows is left out.
    """
    at = F.struct("page", "block")
    before = Window.partitionBy("doc_id").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, -1)
    on_page = Window.partitionBy("doc_id", "page").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    is_initial, is_body = F.col("kind") == "initial", F.col("kind") == "body"
    initial = F.max(F.when(is_initial, F.struct(at.alias("at"), "text"))).over(before)
    body_before = F.max(F.when(is_body, at)).over(before)
    blocks = blocks.withColumn("initial", initial).withColumn("body_before", body_before).withColumn("kind_before", F.last(F.when(~is_initial, F.col("kind")), True).over(on_page))
    takes = is_body & F.col("initial").isNotNull() & F.coalesce(F.col("initial.at") > F.col("body_before"), F.lit(True))
    blocks = blocks.withColumn("takes", takes).withColumn("opens", takes & (F.coalesce("kind_before", F.lit("")) != "heading"))
    chapter = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "block"))
    head = F.when(F.col("opens"), F.concat(F.lit("# Chapter "), chapter.cast("string"), F.lit("\n\n"))).otherwise("")
    text = F.when(F.col("takes"), F.concat(head, "initial.text", "text")).otherwise(F.col("text"))
    return blocks.withColumn("text", text).where("kind != 'initial'").drop("initial", "body_before", "kind_before", "takes", "opens")


def page_text(spans: DataFrame) -> DataFrame:
    """(doc_id, text) from spans (doc_id, page, block, line, text, top, bottom, size, bold), pages joined by form feeds.

    Lines in the margins go if they are page numbers or repeat, digits aside, on 30 % of the pages and at least three. A short
    block in type 1.25 times the body's, or in bold capitals that end without a stop, becomes a `# ` line, unless it is a number or an entry of a table of contents. Lines of a block are joined by spaces, hyphens at their ends closed.
    A caption begins a paragraph even inside a block. One or two letters in type twice the body's are a decorated initial: the next paragraph takes it, on a later page too. A heading at a page's start or end has its own line.
    """
    text = F.col("text")
    for a, b in _LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    lines = spans.withColumn("n", F.length(F.trim(text))).withColumn("text", collapsed(text)).where("text != ''")
    lines = lines.withColumn("margin", (F.col("top") < MARGIN) | (F.col("bottom") > 1 - MARGIN))
    lines = lines.withColumn("key", F.regexp_replace(F.lower(F.regexp_replace("text", r"\s+", " ")), r"\d+", "#"))
    pages = spans.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    repeated = lines.where("margin").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on")).join(pages, "doc_id")
    repeated = repeated.where((F.col("on") >= REPEATED_PAGES) & (F.col("on") >= REPEATED_SHARE * F.col("pages"))).select("doc_id", "key", F.lit(True).alias("gone"))
    number = F.col("text").rlike(r"(?i)^(?:page\s+)?(?:\d{1,4}|[ivxlcdm]{1,7})$")
    kept = lines.join(repeated, ["doc_id", "key"], "left").where(~(F.col("margin") & (F.coalesce("gone", F.lit(False)) | number)))
    weights = kept.groupBy("doc_id", "size").agg(F.sum("n").alias("n"))
    body = weights.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    bold = F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)) / F.sum("n")
    blocks = kept.groupBy("doc_id", "page", "block").agg(_join(ordered).alias("text"), _join(ordered, captions=True).alias("parts"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("size"), bold.alias("bold")).join(body, "doc_id")
    n = F.length("text")
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    capitals = (F.col("bold") >= BOLD_SHARE) & (letters == F.upper(letters)) & ~F.col("text").endswith(".")
    other = F.col("text").rlike(ROMAN) | F.col("text").rlike(CONTENTS_ENTRY)
    heading = ((F.col("size") >= HEADING_RATIO * F.col("body")) | capitals) & (n <= HEADING_CHARS) & (F.length(letters) >= 3) & ~other
    initial = F.col("text").rlike(r"^\p{L}{1,2}$") & (F.col("size") >= DROP_CAP_RATIO * F.col("body"))
    kind = F.when(initial, "initial").when(heading, "heading").otherwise("body")
    shown = F.when(initial, F.col("text")).when(heading, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("parts"))
    blocks = _carry_capitals(blocks.select("doc_id", "page", "block", kind.alias("kind"), shown.alias("text")))
    inner = F.array_sort(F.collect_list(F.struct("block", "text", "kind")))
    page = blocks.groupBy("doc_id", "page").agg(inner.alias("b")).select("doc_id", "page", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"), (F.element_at("b", -1)["kind"] == "heading").alias("ends"))
    page = page.withColumn("text", F.concat(F.when(F.col("text").startswith("# "), "\n").otherwise(""), "text", F.when(F.col("ends"), "\n").otherwise(""))).drop("ends")
    every = spans.select("doc_id", "page").distinct().join(page, ["doc_id", "page"], "left")
    every = every.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    return every.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\f").alias("text"))
