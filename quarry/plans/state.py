"""Queries over stores and traces. events stand for a trace log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import answers, stores
from quarry.plans.tables import documents, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH a AS (SELECT doc_id, n_chars + 1 AS n_chars, (SELECT max(doc_id) FROM documents WHERE doc_id % 4 <> 0) + row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents WHERE doc_id % 4 = 0)
    SELECT doc_id, n_chars + 1 AS n_chars, doc_id AS ordinal FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT * FROM a""")
def w2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as new rows over a store of three quarters of it."""
    rows = documents(spark, d).select("doc_id", "n_chars")
    stored = rows.where("doc_id % 4 <> 0").withColumn("ordinal", F.col("doc_id"))
    return stores.upsert(stored, rows.withColumn("n_chars", F.col("n_chars") + 1), "doc_id")


@query("""WITH d AS (SELECT source || '-' || (doc_id // 250) AS w, doc_id, text, doc_id % 7 = 0 AND (doc_id // 250) % 2 = 0 AS touched FROM documents)
    SELECT w AS workspace_id, count(*) AS documents, sum(octet_length(encode(text)) + CASE WHEN touched THEN 1 ELSE 0 END)::BIGINT AS bytes,
    CASE WHEN count(*) > 500 OR max(octet_length(encode(text)) + CASE WHEN touched THEN 1 ELSE 0 END) > 16777216 OR sum(octet_length(encode(text)) + CASE WHEN touched THEN 1 ELSE 0 END) > 67108864 OR count(*) <> count(text) THEN 'invalid'
    WHEN length(w) % 3 = 0 THEN 'conflict' WHEN NOT bool_or(touched) THEN 'unchanged' ELSE 'replaced' END AS state FROM d WHERE w IS NOT NULL GROUP BY w""")
def w1_replace(spark: SparkSession, d: str) -> DataFrame:
    """Every document again, in workspaces by source and 250 ids: some texts with a full stop more, some workspaces claimed by an old revision."""
    rows = documents(spark, d).where("source is not null").selectExpr("concat(source, '-', doc_id div 250) AS workspace_id", "doc_id AS place", "cast(doc_id AS string) AS id", "'' AS name", "text AS content")
    touched = (F.col("place") % 7 == 0) & F.expr("(place div 250) % 2 = 0")
    new = rows.withColumn("content", F.when(touched, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    claims = rows.select("workspace_id", F.when(F.length("workspace_id") % 3 == 0, "r0").otherwise("r1").alias("expected")).distinct()
    return stores.workspace_changes(rows.withColumn("revision", F.lit("r1")), new, claims)


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
    SELECT doc_id AS query_id, CASE WHEN n = 0 THEN 'I don''t have enough information to answer that question.' WHEN n <= 2800 THEN n::VARCHAR END AS answer,
    CASE WHEN n = 0 THEN 0 WHEN n <= 700 THEN 1 ELSE 2 END AS attempts, CASE WHEN n > 2800 THEN 'incomplete' END AS error FROM n""")
def a2_retry(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in model that counts words, and is cut off where a text has more words than it is given tokens."""

    def count(queries: pd.Series, passages: pd.Series, room: int) -> pd.DataFrame:
        n = passages.str.count(r"[^\x20\x09-\x0D]+")
        return pd.DataFrame({"text": n.astype(str), "finish": (n > room).map({True: "length", False: "stop"})})

    evidence = documents(spark, d).select(F.col("doc_id").alias("query_id"), F.lit("how many words").alias("query"), F.col("text").alias("answer"))
    return answers.answered_whole(evidence, count)


@query("SELECT source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS size_bytes FROM documents GROUP BY source ORDER BY lower(source), source LIMIT 10 OFFSET 2")
def w3_list(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("size_bytes"))
    return stores.page(rows, [F.lower("source"), F.col("source")], 10, 2)


@query("""WITH l AS (SELECT conv_id AS run_id, turn AS rank, CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 3 = 0 THEN 'irrelevant' ELSE role END AS label FROM conversations)
    SELECT * FROM l WHERE label IS NOT NULL""")
def w7_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of passages (run and rank): some set again, the last setting counting, and some cleared. Turns stand for passages."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("rank"), F.col("role").alias("label"))
    once = turns.where("rank % 3 = 0").select("run_id", "rank", F.lit("unclear").alias("label"), F.lit(1).alias("n"))
    again = once.withColumn("label", F.lit("irrelevant")).withColumn("n", F.lit(2))
    cleared = turns.where("rank % 5 = 0").select("run_id", "rank", F.lit(None).cast("string").alias("label"), F.lit(3).alias("n"))
    return stores.set_labels(turns.where("rank % 7 <> 3"), once.unionByName(again).unionByName(cleared).unionByName(turns.where("rank % 7 = 3 and rank % 5 <> 0 and rank % 3 <> 0").withColumn("n", F.lit(1))))


@query("SELECT event_type, count(CASE WHEN value >= 20 THEN value WHEN (props::JSON->>'k')::INT >= 5 THEN 1 END) AS valid, round(sum(CASE WHEN value >= 20 THEN value ELSE 0 END), 4) AS cost FROM events GROUP BY event_type")
def t2_usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    first = stores.first_valid(F.when(F.col("value") >= 20, F.col("value")), F.when(k >= 5, F.lit(1.0)))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(first).alias("valid"), F.round(F.sum(F.when(F.col("value") >= 20, F.col("value")).otherwise(0.0)), 4).alias("cost"))


@query("SELECT event_id, (props::JSON->>'k') AS k FROM events WHERE props IS NOT NULL")
def t3_projection(spark: SparkSession, d: str) -> DataFrame:
    """Span attributes through an allow list."""
    attributes = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("secret"), F.lit("x")))
    return table(spark, d, "events").where("props is not null").select("event_id", stores.allowed_attributes(attributes, ["k"])["k"].alias("k"))


@query("""SELECT event_id FROM (SELECT event_id, sum(user_id % 9 + 1) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM events) WHERE total <= 2000""")
def t4_retention(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "events").withColumn("modified", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("size", F.col("user_id") % 9 + 1)
    return stores.retained(items, F.lit(0), 0, 2000, by=["event_type"], id_col="event_id").select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, ts, sum(user_id % 9 + 1) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM events), (SELECT sum(user_id % 9 + 1) // 2 AS half FROM events) WHERE total + 500 <= half""")
def w9_budget(spark: SparkSession, d: str) -> DataFrame:
    """One store of all events, within half their size with a new item of 500."""
    items = table(spark, d, "events").withColumn("modified", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("size", F.col("user_id") % 9 + 1)
    half = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // 2
    return stores.retained(items, F.lit(0), 0, half, id_col="event_id", incoming=500).select("event_id")


@query("SELECT event_type AS section, count(*) AS requests, count(*) FILTER (value >= 10) AS successes, count(*) FILTER (value < 10) AS failures, round(avg(value), 6) AS latency FROM events GROUP BY event_type")
def t7_counters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("section")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(v >= 10).alias("successes"), F.count_if(v < 10).alias("failures"), F.round(F.avg(v), 6).alias("latency"))
