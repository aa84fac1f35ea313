"""Queries over what lies between sources and answers: cleaning, stamps, states, rerankers, what is shown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import lifecycle, positions
from quarry.plans.evaluation import arms
from quarry.plans.tables import PASSAGES, QUESTIONS, bm25_sql, documents, passages, questions, table, top_sql
from quarry.storage import sent

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CODE = "CASE WHEN doc_id % 3 = 0 THEN source || '/x.py' WHEN doc_id % 3 = 1 THEN source || '/x.txt' ELSE source || '/x.md' END"


@query(f"""WITH {PASSAGES}, p AS (SELECT passages.*, {_CODE} AS path FROM passages JOIN documents USING (doc_id))
    SELECT doc_id, n, content AS searchable FROM p WHERE path LIKE '%.py' AND trim(content) <> ''""")
def c11_cleaned_code(spark: SparkSession, d: str) -> DataFrame:
    """Passages that aren't prose are searched as they are."""
    return _cleaned(spark, d).where(F.col("path").endswith(".py")).select("doc_id", "n", "searchable")


@query()
def c11_cleaned_prose(spark: SparkSession, d: str) -> DataFrame:
    """Passages of prose without layout marks; empty ones gone."""
    return _cleaned(spark, d).where(~F.col("path").endswith(".py")).select("doc_id", "n", "searchable")


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 3
    path = F.concat("source", F.when(n == 0, "/x.py").when(n == 1, "/x.txt").otherwise("/x.md"))
    return lifecycle.cleaned(positions.lines(documents(spark, d).withColumn("path", path), "path"))


@query("""SELECT source AS scope, CASE WHEN count(*) % 4 = 0 THEN 'not_indexed' WHEN count(*) % 4 = 1 THEN 'unavailable' WHEN count(*) % 4 = 2 THEN 'stale' ELSE 'current' END AS state FROM documents GROUP BY source""")
def c17_states(spark: SparkSession, d: str) -> DataFrame:
    """Sources stand for scopes, of which some have no index, a broken or an old one."""
    scopes = documents(spark, d).groupBy(F.col("source").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    wanted = scopes.select("scope", F.concat(F.lit("v1:"), F.col("n").cast("string")).alias("stamp"))
    kind = F.col("n") % 4
    stamp = F.when(kind == 2, F.concat(F.lit("v0:"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("v1:"), F.col("n").cast("string")))
    published = scopes.where(kind != 0).select("scope", stamp.alias("stamp"), F.col("n").alias("rows_stored"), F.when(kind == 1, F.col("n") + 1).otherwise(F.col("n")).alias("rows_listed"))
    return lifecycle.index_states(wanted, published)


@query("SELECT count(*)::BIGINT AS rows, true AS same, true AS other FROM documents")
def i9_stamp(spark: SparkSession, d: str) -> DataFrame:
    """A stamp is the same whatever the order of the sources, and another when a setting changes."""
    sources = documents(spark, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    settings = {"size": 700, "overlap": 100, "model": None}
    one, two = lifecycle.source_stamp(settings, sources), lifecycle.source_stamp(dict(reversed(settings.items())), sources.orderBy(F.desc("path")))
    other = lifecycle.source_stamp(settings | {"size": 800}, sources)
    same = lifecycle.stamp_digest(one) == lifecycle.stamp_digest(two)
    return spark.createDataFrame([(one["sources"]["rows"], same, lifecycle.stamp_digest(one) != lifecycle.stamp_digest(other))], "rows long, same boolean, other boolean")


@query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS first, 1.0 AS second FROM documents")
def i4_embedded(spark: SparkSession, d: str) -> DataFrame:
    """An embedder that takes one text at a time."""

    def embed(item):
        if not isinstance(item, str):
            raise TypeError("one text at a time")
        return [float(len(item)), 1.0]

    rows = documents(spark, d).select("doc_id", lifecycle.embedded(F.col("text"), embed).alias("v"))
    return rows.select("doc_id", F.col("v")[0].cast("double").alias("first"), F.col("v")[1].cast("double").alias("second"))


_CANDIDATES = f"{QUESTIONS}, {bm25_sql()}, top AS {top_sql('bm25', 10)}"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    top = arms(spark, d).where("arm = 'score'").select("query_id", "doc_id", F.col("rank").alias("shortlist_rank"))
    return sent(top).join(documents(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id").join(sent(questions(spark, d)), "query_id")


@query(f"""WITH {_CANDIDATES}, s AS (SELECT t.query_id, t.doc_id, rank AS shortlist_rank, length(text) AS score, count(*) OVER (PARTITION BY t.query_id) AS n, contains(query, 'e') AND length(query) % 2 = 0 AS fails FROM top t JOIN documents USING (doc_id) JOIN q ON t.query_id = q.query_id)
    SELECT query_id, doc_id, n > 1 AND NOT fails AS reranked, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 1 AND NOT fails THEN score END DESC NULLS LAST, shortlist_rank) AS final_rank FROM s QUALIFY final_rank <= 3""")
def q12_rerank_or_keep(spark: SparkSession, d: str) -> DataFrame:
    """The scorer gives no number for some questions, which keep their order."""

    def scorer(queries: pd.Series, texts: pd.Series) -> pd.Series:
        fails = queries.str.contains("e", regex=False) & (queries.str.len() % 2 == 0)
        return texts.str.len().astype("float64").mask(fails)

    return lifecycle.rerank_or_keep(_candidates(spark, d), scorer, 3).select("query_id", "doc_id", "reranked", "final_rank")


@query(f"WITH {_CANDIDATES} SELECT query_id, rank - 1 AS place, round(1.0 / rank, 6) AS score FROM top")
def q14_checked_scores(spark: SparkSession, d: str) -> DataFrame:
    """What a hosted reranker gives back, checked to be whole."""
    found = _candidates(spark, d)
    results = found.select("query_id", (F.col("shortlist_rank") - 1).alias("place"), F.round(1 / F.col("shortlist_rank"), 6).alias("score"))
    return lifecycle.checked_scores(results, found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))


_SHOWN = "t.query_id, rank, t.doc_id AS source_id, source || '/' || t.doc_id AS name, 'file' AS source_type, CASE WHEN t.doc_id % 2 = 0 THEN 0::BIGINT END AS start_offset, CASE WHEN t.doc_id % 2 = 0 THEN length(text) END AS end_offset, t.doc_id % 2 = 0 AS location_verified"


def _shown(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    rows = _candidates(spark, d).join(documents(spark, d).select("doc_id", "source"), "doc_id")
    return rows.select(
        "query_id",
        F.col("shortlist_rank").alias("rank"),
        F.col("doc_id").alias("source_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("file").alias("source_type"),
        F.when(even, F.lit(0).cast("long")).alias("start_offset"),
        F.when(even, F.length("content")).alias("end_offset"),
        "content",
        F.col("shortlist_rank").alias("score"),
    )


@query(f"WITH {_CANDIDATES} SELECT {_SHOWN} FROM top t JOIN documents USING (doc_id)")
def q25_shown(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.shown(_shown(spark, d))


@query(f"WITH {_CANDIDATES} SELECT {_SHOWN}, text AS content, rank AS score FROM top t JOIN documents USING (doc_id)")
def q25_shown_content(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.shown(_shown(spark, d), True)


@query("""WITH p AS (SELECT doc_id, doc_id % 4 AS k, source || CASE WHEN doc_id % 4 < 2 THEN '/a.pdf' ELSE '/b.txt' END AS name, trim(text) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, 'Source document: ' || string_split(name, '/')[-1] || chr(10) || CASE k WHEN 0 THEN 'Printed page number: unavailable.' || chr(10) || '[PDF page 3]' || chr(10) || t
        WHEN 1 THEN 'Printed page number: unavailable.' || chr(10) || 'PDF page range: 3-5. Exact page within range: unavailable.' || chr(10) || t
        WHEN 2 THEN 'Source lines: L2-L4' || chr(10) || t ELSE 'Source location: unavailable' || chr(10) || t END AS evidence FROM p""")
def a3_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.concat("source", F.when(k < 2, "/a.pdf").otherwise("/b.txt"))
    place = F.when(k == 0, "p.3").when(k == 1, "p.3-5").when(k == 2, "L2-L4").otherwise("somewhere")
    return documents(spark, d).where("text is not null").select("doc_id", lifecycle.evidence(name, place, F.col("text")).alias("evidence"))


@query(r"""WITH p AS (SELECT doc_id, doc_id // 3 AS q, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY doc_id // 3) AS n, source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents),
    i AS (SELECT q, r AS no, n, CASE WHEN doc_id % 5 = 0 THEN r % 3 + 1 ELSE r END AS named, trim(flat[6:35]) AS anchor FROM p WHERE doc_id % 11 <> 1),
    h AS (SELECT i.q, no, named, list(r) FILTER (contains(lower(flat), lower(anchor))) AS found FROM i JOIN p USING (q) GROUP BY ALL),
    w AS (SELECT q, no, anchor, CASE WHEN list_contains(found, named) THEN named WHEN len(found) = 1 THEN found[1] END AS r FROM h JOIN i USING (q, no, named)),
    t AS (SELECT w.q, no, w.r, source, array_to_string(string_split(trim(flat[strpos(lower(flat), lower(anchor)):strpos(lower(flat), lower(anchor)) + length(anchor) - 1]), ' ')[1:4], ' ') AS quote FROM w JOIN p USING (q, r)),
    u AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY no) AS k FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY q, quote ORDER BY no) = 1)),
    s AS (SELECT q, count(*) AS shown, string_agg(k || '. ' || source || '.txt. Source lines: L' || r || '.' || chr(10) || 'Anchor: “' || quote || '”' || chr(10) || 'Paraphrase: so [' || r || ']' || chr(10) || 'Context: there', chr(10) || chr(10) ORDER BY no) AS body FROM u GROUP BY q),
    b AS (SELECT q, count(no) AS wanted, coalesce(bool_or(anchor = '' OR named > n), false) AS bad FROM (SELECT DISTINCT q FROM p) LEFT JOIN i USING (q) GROUP BY q),
    f AS (SELECT q, bad OR (shown IS NULL AND wanted > 0) AS failed, shown, body FROM b LEFT JOIN s USING (q))
    SELECT q AS query_id, failed, CASE WHEN failed THEN 'The answer could not be read.' WHEN shown IS NULL THEN 'I don''t have enough information to answer that question.'
        WHEN shown < 3 THEN body || chr(10) || chr(10) || 'The supplied evidence supports only ' || shown || ' selection(s).' ELSE body END AS answer FROM f""")
def a5_selections(spark: SparkSession, d: str) -> DataFrame:
    """Three documents at a time as a question's passages, with an envelope of quotes from them, some of which name another passage."""
    from quarry.functions.text import collapsed
    from quarry.operators.selections import selections

    asked = F.floor(F.col("doc_id") / 3).alias("query_id")
    order = Window.partitionBy("query_id").orderBy("doc_id")
    rows = documents(spark, d).select(asked, "doc_id", F.concat("source", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("content")).withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("location", F.concat(F.lit("L"), F.col("rank").cast("string"))).withColumn("evidence", F.lit(""))
    named = F.when(F.col("doc_id") % 5 == 0, F.col("rank") % 3 + 1).otherwise(F.col("rank"))
    anchor = F.substring(collapsed(F.col("content")), 6, 30)
    item = F.struct(F.col("rank").alias("no"), named.alias("passage"), anchor.alias("anchor"), F.lit("so").alias("paraphrase"), F.lit("there").alias("caveat"), (F.col("doc_id") % 11 != 1).alias("addresses_request"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("no"))
    made = rows.groupBy("query_id").agg(F.to_json(F.struct(items.alias("selections"))).alias("answer"))
    return selections(made, rows, 3, 4, cite=True).select("query_id", "failed", "answer")


@query(f"WITH {PASSAGES}, p AS (SELECT n AS ordinal, 'L' || (n + 1) AS location, start_offset, end_offset, content FROM passages WHERE doc_id = (SELECT max(doc_id) FROM documents)) SELECT * FROM p ORDER BY ordinal LIMIT 5 OFFSET 1")
def c17_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of one source's passages."""
    last = documents(spark, d).agg(F.max("doc_id")).first()[0]
    rows = passages(spark, d).withColumn("location", F.concat(F.lit("L"), (F.col("n") + 1).cast("string")))
    return lifecycle.published_passages(rows, documents(spark, d), last, 5, 1, True)


@query("SELECT event_id, 'file-' || sha256(event_type || '/' || user_id) AS id FROM events")
def w2_source_id(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.stores import source_id

    return table(spark, d, "events").select("event_id", source_id(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))).alias("id"))
