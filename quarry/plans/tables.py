"""The driver's tables as the engine's: documents, questions, vectors, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import lexical, positional, positions
from quarry.operators.lifecycle import source_stamp, stamp_digest
from quarry.operators.matches import holding
from quarry.storage import sent, settle, there


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_vectors(spark: SparkSession, sf_dir: str, every: int = 25) -> DataFrame:
    """A stated set of query vectors."""
    return vectors(spark, sf_dir).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_indexes: dict[tuple[str, str, str], lexical.Index | positional.BlockIndex | tuple[lexical.Index, lexical.Index]] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of the documents' texts; built when a session first asks for it, and again when the files change."""
    key = spark.sparkContext.applicationId, _stamp(spark, sf_dir), "text"
    if key not in _indexes or not there(spark, _indexes[key].path):  # a shared folder may be emptied between queries
        _indexes[key] = lexical.build_index(documents(spark, sf_dir).select("doc_id", "text"))
    return _indexes[key]


def field_indexes(spark: SparkSession, sf_dir: str) -> tuple[lexical.Index, lexical.Index]:
    """The stored indexes of the documents' texts and of their identifier words, in the same way."""
    key = spark.sparkContext.applicationId, _stamp(spark, sf_dir), "fields"
    if key not in _indexes or not there(spark, _indexes[key][0].path):
        _indexes[key] = lexical.build_fields(documents(spark, sf_dir).select("doc_id", "text"))
    return _indexes[key]


def block_index(spark: SparkSession, sf_dir: str) -> positional.BlockIndex:
    """The stored index of blocks of the documents' texts, in the same way."""
    key = spark.sparkContext.applicationId, _stamp(spark, sf_dir), "blocks"
    if key not in _indexes or not there(spark, _indexes[key].path):
        _indexes[key] = positional.build(documents(spark, sf_dir).select("doc_id", "text"))
    return _indexes[key]


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """What the documents' files are: paths, sizes and times of change. No content is read."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "length", "modificationTime")
    return stamp_digest(source_stamp({}, files))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that hold a question's text word for word."""
    return holding(documents(spark, sf_dir), questions(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines with their code point offsets: doc_id, n, start_offset, end_offset, content. Empty lines are left out."""
    return positions.lines(documents(spark, sf_dir))


#: The same in SQL.
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"
QUESTIONS = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
GOLD = "gold AS (SELECT query_id, doc_id FROM q JOIN documents ON contains(text, query) AND query <> '')"
PASSAGES = r"""lines AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(s)), lambda i: {'n': i - 1, 'content': s[i],
        'start_offset': coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT})) AS r
        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    passages AS (SELECT doc_id, r.n AS n, r.start_offset AS start_offset, r.start_offset + length(r.content) AS end_offset, r.content AS content FROM lines WHERE r.content <> '')"""


def bm25_sql(docs: str = "SELECT doc_id, text FROM documents", name: str = "bm25", queries: str = "q") -> str:
    """CTEs that end with {name}(query_id, doc_id, score)."""
    return rf"""{name}_t AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM ({docs})),
    {name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
    {name}_p AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
    {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
    {name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM {queries}) GROUP BY ALL),
    {name} AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl) + 1e-9)) AS score
        FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_d USING (term), {name}_s GROUP BY ALL HAVING score > 1e-9)"""


def top_sql(source: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k})"


def named(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of docs that hits name by doc_id: hits of stated queries are few and are sent, so that texts don't move."""
    return docs.join(sent(settle(hits.select("doc_id").distinct())), "doc_id", "left_semi")
