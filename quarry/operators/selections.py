"""Quotes that a model chose from passages, checked against them and shown: one row a question, all of its passages beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import collapsed
from quarry.operators.answers import ABSTENTION, INVALID

# The shape of an envelope, the quotes that count as the same, and how a selection is shown.
_KEYS = ("addresses_request", "anchor", "caveat", "paraphrase", "passage")
_ITEM = "OBJECT<addresses_request: BOOLEAN, anchor: STRING, caveat: STRING, paraphrase: STRING, passage: BIGINT>"
_QUOTES = ("’‘“”", "''\"\"")
_LINES, _PAGE, _RANGE = r"^L[1-9]\d*(?:-L?[1-9]\d*)?$", r"\[PDF page ([1-9]\d*)\]\n", r"PDF page range: ([0-9]+-[0-9]+)"


def _plain(text: Column) -> Column:
    return F.lower(F.translate(text, *_QUOTES))


def parsed(answer: Column, most: Column) -> Column:
    """The selections of an envelope as an array of structs; null for anything but the exact shape, or for more than `most`.

    A selection that doesn't address the request needs the keys alone; its other values aren't looked at.
    """
    body = F.try_parse_json(answer)
    keys = F.array_sort(F.map_keys(F.try_variant_get(body, "$", "map<string,variant>")))
    items = F.when(keys == F.array(F.lit("selections")), F.try_variant_get(body, "$.selections", "array<variant>"))

    def fine(v: Column) -> Column:
        named = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == F.array(*map(F.lit, _KEYS))
        skipped = (F.schema_of_variant(F.try_variant_get(v, "$.addresses_request", "variant")) == "BOOLEAN") & ~F.try_variant_get(v, "$.addresses_request", "boolean")
        words = [F.try_variant_get(v, f"$.{k}", "string").rlike(r"\S") for k in ("anchor", "paraphrase", "caveat")]
        whole = (F.schema_of_variant(v) == _ITEM) & words[0] & words[1] & words[2]
        return F.coalesce(named & (skipped | whole), F.lit(False))

    def read(v: Column) -> Column:
        text = {k: F.trim(F.try_variant_get(v, f"$.{k}", "string")).alias(k) for k in ("paraphrase", "caveat")}
        return F.struct(
            F.try_variant_get(v, "$.addresses_request", "boolean").alias("wanted"),
            F.try_variant_get(v, "$.passage", "bigint").alias("passage"),
            collapsed(F.try_variant_get(v, "$.anchor", "string")).alias("anchor"),
            *text.values(),
        )

    return F.when((F.size(items) <= most) & F.forall(items, fine), F.transform(items, read))


def _reference(p: Column, quote: Column) -> Column:
    """A source's name and, as far as they are known, the page or the lines of a quote."""
    name = F.element_at(F.split(p["name"], "/"), -1)
    pages = F.regexp_extract_all(p["evidence"], F.lit(_PAGE), F.lit(1))
    parts = F.slice(F.split(p["evidence"], _PAGE), 2, 1_000_000)
    on = F.array_distinct(F.transform(F.filter(F.arrays_zip(pages.alias("page"), parts.alias("part")), lambda z: F.contains(collapsed(z["part"]), quote)), lambda z: z["page"]))
    between = F.regexp_extract(p["evidence"], _RANGE, 1)
    unknown = F.concat(F.lit("Exact PDF page: unavailable"), F.when(between != "", F.concat(F.lit(" (source range "), between, F.lit(")"))).otherwise(""))
    page = F.when(F.size(on) == 1, F.concat(F.lit("PDF page "), on[0])).otherwise(unknown)
    lines = F.when(p["location"].rlike(_LINES), F.concat(F.lit("Source lines: "), p["location"])).otherwise("Source location: unavailable")
    place = F.when(F.lower(name).endswith(".pdf"), page).otherwise(lines)
    return F.when(name != "", F.concat(name, F.lit(". "), place)).otherwise(place)


def selections(answers: DataFrame, passages: DataFrame, most: int | Column = 2, words: int | Column = 10, cite: bool = False) -> DataFrame:
    """(query_id, answer, failed) from answers (query_id, answer: JSON) and passages (query_id, rank from 1 without gaps, content, name, location, evidence).

    An anchor stands word for word in the passage named, or else in just one other, white space, case and the form of quotes aside; it is shown as it stands there, cut to `words`
    words, and the first of equal quotes stays. An anchor that is nowhere, or in several others, is left out. Any other shape, a passage that isn't there, or no quote left
    but such anchors is a failure. Nothing selected is an abstention. most, words: numbers, or columns of `answers`.

    Nulls: a null answer fails; nulls in passages are empty texts. A question without passages fails if it selects any. A question's passages (the k that a search returned) meet
    in one row; other columns don't matter.
    """
    most, words = (F.lit(x) if isinstance(x, int) else x for x in (most, words))
    asked = answers.select("query_id", parsed(F.col("answer"), most).alias("items"), most.cast("int").alias("most"), words.cast("int").alias("words"))
    text = {k: F.coalesce(k, F.lit("")).alias(k) for k in ("content", "name", "location", "evidence")}
    flat = collapsed(text["content"])
    row = F.struct(F.col("rank").cast("long").alias("rank"), flat.alias("flat"), _plain(flat).alias("plain"), *(text[k] for k in ("name", "location", "evidence")))
    given = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("given"))
    both = asked.join(given, "query_id", "left").withColumn("given", F.coalesce("given", F.array().cast(given.schema["given"].dataType)))
    wanted = F.filter("items", lambda i: i["wanted"])

    def place(i: Column) -> Column:
        holding = F.filter("given", lambda p: F.contains(p["plain"], _plain(i["anchor"])))
        named = F.filter(holding, lambda p: p["rank"] == i["passage"])
        found = F.when(F.size(named) > 0, named[0]).when(F.size(holding) == 1, holding[0])
        quote = F.substr(found["flat"], F.position(_plain(i["anchor"]), found["plain"]), F.length(i["anchor"]))
        quote = F.array_join(F.slice(F.split(collapsed(quote), " "), F.lit(1), F.col("words")), " ")
        return F.struct(quote.alias("quote"), found.alias("at"), i["paraphrase"].alias("paraphrase"), i["caveat"].alias("caveat"))

    both = both.withColumn("out", F.exists(wanted, lambda i: (i["passage"] < 1) | (i["passage"] > F.size("given"))))
    both = both.withColumn("wanted", F.size(wanted)).withColumn("placed", F.filter(F.transform(wanted, place), lambda x: x["quote"].isNotNull()))
    quotes = F.transform("placed", lambda x: x["quote"])
    both = both.withColumn("shown", F.filter("placed", lambda x, i: F.array_position(F.transform("placed", lambda y: y["quote"]), x["quote"]) == i + 1)).withColumn("lost", F.size(quotes) < F.col("wanted"))

    def show(x: Column, i: Column) -> Column:
        mark = F.concat(F.lit(" ["), x["at"]["rank"].cast("string"), F.lit("]")) if cite else F.lit("")
        head = F.concat((i + 1).cast("string"), F.lit(". "), _reference(x["at"], x["quote"]), F.lit(".\nAnchor: “"), x["quote"], F.lit("”\nParaphrase: "))
        return F.concat(head, x["paraphrase"], mark, F.lit("\nContext: "), x["caveat"])

    n = F.size("shown")
    short = F.when(n < F.col("most"), F.concat(F.lit("\n\nThe supplied evidence supports only "), n.cast("string"), F.lit(" selection(s)."))).otherwise("")
    failed = F.col("items").isNull() | F.col("out") | ((n == 0) & F.col("lost"))
    failed = F.coalesce(failed, F.lit(True))
    shown = F.when(n == 0, ABSTENTION).otherwise(F.concat(F.array_join(F.transform("shown", show), "\n\n"), short))
    return both.select("query_id", F.when(failed, INVALID).otherwise(shown).alias("answer"), failed.alias("failed"))
