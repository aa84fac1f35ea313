"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import identifier_words, tokens
from quarry.operators import dense, fusion, lexical, positional
from quarry.operators.lexical import ranked
from quarry.operators.matches import relevant_files
from quarry.plans.tables import GOLD, QUESTIONS, TOKENS, block_index, bm25_sql, documents, field_indexes, gold, lexical_index, named, query_vectors, questions, table, top_sql, vectors
from quarry.storage import sent, settle

QUERIES, ORACLES = {}, {}
_VECTOR_QUERIES = "vq AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 25 = 0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {QUESTIONS}, {bm25_sql()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {top_sql('bm25', 5)}")
def q5_bm25_top5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.bm25(lexical_index(spark, d), questions(spark, d), 5).drop("distance"))


@query(f"WITH {QUESTIONS}, {bm25_sql()} SELECT query_id, doc_id, round(exp(-0.1 * score), 6) AS distance FROM {top_sql('bm25', 20)}")
def q5_bm25_distance(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(lexical_index(spark, d), questions(spark, d), 20).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


def _dense_sql(score: str, k: int = 10) -> str:
    return f"""WITH {_VECTOR_QUERIES}, s AS (SELECT query_id, vec_id AS doc_id, {score} AS score FROM embeddings, vq)
        SELECT query_id, doc_id, round(score, 5) AS score, rank FROM {top_sql("s", k)}"""


def _dense(spark: SparkSession, d: str, metric: str) -> DataFrame:
    return dense.search(vectors(spark, d), query_vectors(spark, d), 10, metric).withColumn("score", F.round("score", 5))


@query(_dense_sql("list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[])"))
def q1_dense_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, "cosine")


@query(_dense_sql("0.0 - (list_distance(embedding::DOUBLE[], vector::DOUBLE[]) ** 2)"))
def q1_dense_l2(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, "l2")


@query(_dense_sql("list_dot_product(embedding::DOUBLE[], vector::DOUBLE[])"))
def q1_dense_dot(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, "dot")


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AS ok FROM embeddings")
def q16_vector_valid(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", dense.valid(F.col("embedding"), 64).alias("ok"))


def _channels(spark: SparkSession, d: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical lists for the same questions: question i asks with vector i."""
    asked = vectors(spark, d).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(sent(questions(spark, d).select("query_id")), "query_id", "left_semi")
    near = dense.search(vectors(spark, d), asked, k)
    return settle(near), settle(lexical.bm25(lexical_index(spark, d), questions(spark, d), k))


_CHANNELS = f"""{QUESTIONS}, {bm25_sql()},
    vs AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]) AS score
        FROM embeddings, (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))),
    v AS (SELECT * FROM {top_sql("vs", 20)}), l AS (SELECT * FROM {top_sql("bm25", 20)})"""


def _rrf_sql(wv: float, wl: float) -> str:
    return f"""f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST) AS fused_rank FROM (
        SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.doc_id, l.doc_id) AS doc_id, v.rank AS vector_rank, l.rank AS bm25_rank,
            coalesce({wv} / (60 + v.rank), 0.0) + coalesce({wl} / (60 + l.rank), 0.0) AS rrf
        FROM v FULL JOIN l ON v.query_id = l.query_id AND v.doc_id = l.doc_id) WHERE rrf > 0)"""


_FUSED = "SELECT query_id, doc_id, coalesce(vector_rank, 0) AS vector_rank, coalesce(bm25_rank, 0) AS bm25_rank, round(rrf, 9) AS rrf, fused_rank FROM f"


@query(f"WITH {_CHANNELS}, {_rrf_sql(1.0, 1.0)} {_FUSED}")
def q8_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*_channels(spark, d)).withColumn("rrf", F.round("rrf", 9)).fillna(0, ["vector_rank", "bm25_rank"])


@query(f"WITH {_CHANNELS}, {_rrf_sql(0.0, 2.0)} {_FUSED}")
def q8_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*_channels(spark, d), weights=(0.0, 2.0)).withColumn("rrf", F.round("rrf", 9)).fillna(0, ["vector_rank", "bm25_rank"])


_BALANCED = """turns AS (SELECT query_id, doc_id, min((rank, channel)) AS turn FROM (SELECT query_id, doc_id, rank, 0 AS channel FROM v UNION ALL SELECT query_id, doc_id, rank, 1 FROM l) GROUP BY ALL),
    chosen AS (SELECT query_id, doc_id, fused_rank, rrf, row_number() OVER (PARTITION BY query_id ORDER BY turn NULLS LAST, fused_rank NULLS LAST) AS n FROM f FULL JOIN turns USING (query_id, doc_id)),
    shortlist AS (SELECT query_id, doc_id, fused_rank, rrf, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS shortlist_rank FROM chosen WHERE n <= 12 AND fused_rank IS NOT NULL)"""


@query(f"WITH {_CHANNELS}, {_rrf_sql(1.0, 1.0)}, {_BALANCED} SELECT query_id, doc_id, fused_rank, shortlist_rank FROM shortlist")
def q9_balanced(spark: SparkSession, d: str) -> DataFrame:
    channels = _channels(spark, d)
    return fusion.balanced(fusion.rrf(*channels), channels, 12).select("query_id", "doc_id", "fused_rank", "shortlist_rank")


def hybrid(spark: SparkSession, d: str, candidates: int = 12, top: int = 5) -> DataFrame:
    """Dense and lexical search, fusion, balanced shortlist, reranking by the stand-in scorer, final ranks."""
    channels = _channels(spark, d)
    shortlist = fusion.balanced(fusion.rrf(*channels), channels, candidates)
    shortlist = settle(shortlist)
    texts = settle(named(documents(spark, d), shortlist).select("doc_id", "source", F.col("text").alias("content")))
    full = shortlist.join(texts, "doc_id", "left").join(sent(questions(spark, d)), "query_id")
    full = full.withColumn("content", F.concat(F.lit("Source: "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    score = fusion.keyword_overlap(F.col("query"), F.col("content"), tokens)
    return fusion.rerank(full, score, top).select("query_id", "doc_id", F.round("rerank_score", 6).alias("score"), "shortlist_rank", "final_rank")


_OVERLAP = f"""pairs AS (SELECT s.query_id, s.doc_id, shortlist_rank, list_distinct({TOKENS.format("query")}) AS asked,
        {TOKENS.format("'Source: ' || coalesce(source, '') || chr(10) || coalesce(text, '')")} AS has
        FROM shortlist s JOIN q USING (query_id) LEFT JOIN documents d ON s.doc_id = d.doc_id),
    scored AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0.0 ELSE len(list_intersect(asked, has)) / len(asked) END AS score FROM pairs)"""


@query(f"""WITH {_CHANNELS}, {_rrf_sql(1.0, 1.0)}, {_BALANCED}, {_OVERLAP}
    SELECT query_id, doc_id, round(score, 6) AS score, shortlist_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, shortlist_rank) AS final_rank
    FROM scored QUALIFY final_rank <= 5""")
def q11_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d)


@query(f"WITH {_CHANNELS}, {_rrf_sql(1.0, 1.0)}, {_BALANCED}, {_OVERLAP} SELECT query_id, doc_id, round(score, 6) AS score FROM scored")
def q12_rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, top=12).select("query_id", "doc_id", "score")


_SYMBOLS = r"regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_:./\\-]+', ' ', 'g')"


@query(f"""WITH {QUESTIONS}, {bm25_sql(name="c")}, {bm25_sql(f"SELECT doc_id, {_SYMBOLS} AS text FROM documents", "s")},
    b AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 5) AS score FROM {top_sql("b", 5)}""")
def q3_two_fields(spark: SparkSession, d: str) -> DataFrame:
    return lexical.fields_search(field_indexes(spark, d), questions(spark, d), 5).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH ph AS (SELECT item_id AS query_id, {TOKENS.format("text")} AS p FROM benchmark), dt AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
    c AS (SELECT query_id, doc_id, p, t FROM ph JOIN dt ON len(p) > 0 AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' '))
    SELECT query_id, doc_id, len(list_filter(generate_series(1, len(t) - len(p) + 1), lambda i: t[i:i + len(p) - 1] = p)) AS hits FROM c""")
def q4_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Every question's whole token sequence as the phrase."""
    return positional.phrase_hits(block_index(spark, d), questions(spark, d)).select("query_id", "doc_id", F.col("hits").cast("long").alias("hits"))


@query(f"WITH {QUESTIONS}, {bm25_sql()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {top_sql('bm25', 5)}")
def q5_top_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same five, with blocks passed over whose bounds are too low."""
    return _rounded(positional.top_k(block_index(spark, d), questions(spark, d), 5))


_QUOTED = f"""qq AS (SELECT item_id * 3 + k AS query_id, CASE k WHEN 0 THEN '"' || text || '"' WHEN 1 THEN '"' || text || ' zzyzx"' ELSE text END AS asked, text, k FROM benchmark, range(3) g(k)),
    ph AS (SELECT query_id, {TOKENS.format("text")} AS p FROM qq WHERE k = 0 AND trim(text) <> '' AND NOT contains(text, '"')), dt AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
    cand AS (SELECT query_id, doc_id, p, t FROM ph JOIN dt ON len(p) > 0 AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
    hits AS (SELECT query_id, doc_id, len(list_filter(generate_series(1, len(t) - len(p) + 1), lambda i: t[i:i + len(p) - 1] = p))::DOUBLE AS score, 'phrase' AS mode FROM cand),
    wq AS (SELECT query_id, replace(asked, '"', ' ') AS query FROM qq WHERE query_id NOT IN (SELECT query_id FROM hits))"""


@query(f"""WITH {_QUOTED}, {bm25_sql(name="c", queries="wq")}, {bm25_sql(f"SELECT doc_id, {_SYMBOLS} AS text FROM documents", "s", "wq")},
    b AS (SELECT query_id, doc_id, sum(score) AS score, 'words' AS mode FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY query_id, doc_id UNION ALL SELECT * FROM hits)
    SELECT query_id, doc_id, round(score, 5) AS score, mode, rank FROM {top_sql("b", 5)}""")
def q4_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Every question in quotes, in quotes with a word that no text has, and without quotes."""
    asked = questions(spark, d)
    text = F.col("query")
    forms = (F.concat(F.lit('"'), text, F.lit('"')), F.concat(F.lit('"'), text, F.lit(' zzyzx"')), text)
    every = asked.select(F.posexplode(F.array(*forms)).alias("k", "form"), "query_id").select((F.col("query_id") * 3 + F.col("k")).alias("query_id"), F.col("form").alias("query"))
    found = positional.quoted_search(block_index(spark, d), field_indexes(spark, d), every, 5)
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"), "mode", "rank")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)
    SELECT doc_id, term, count(*) AS tf, max(dl) AS dl, min(pos) AS first_position FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM t) GROUP BY doc_id, term""")
def i2_postings(spark: SparkSession, d: str) -> DataFrame:
    made = lexical.postings(documents(spark, d), positions=True)
    return made.select("doc_id", "term", "tf", "dl", F.element_at("positions", 1).alias("first_position"))


@query(f"SELECT doc_id, {_SYMBOLS} AS symbols FROM documents")
def c14_symbols(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", identifier_words(F.col("text")).alias("symbols"))


@query(f"""WITH {QUESTIONS}, {GOLD}, {bm25_sql("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM gold)")}
    SELECT query_id, doc_id, rank FROM {top_sql("bm25", 10)}""")
def q23_scope(spark: SparkSession, d: str) -> DataFrame:
    """Search inside a scope of documents, which is a table: the scope comes before the ranking."""
    scope = gold(spark, d).select("doc_id").distinct()
    return lexical.bm25(documents(spark, d).join(scope, "doc_id", "left_semi"), questions(spark, d), 10).select("query_id", "doc_id", "rank")


@query("""WITH t AS (SELECT conv_id, turn, text AS question, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN previous IS NULL THEN trim(question) ELSE 'Previous question (context only, do not answer): ' || previous || chr(10) || 'Current question (answer this question only): ' || trim(question) END AS query FROM t""")
def q24_conversation(spark: SparkSession, d: str) -> DataFrame:
    """A question with the one before it in its conversation; other roles are skipped."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").where("role = 'user'")
    previous = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = F.concat(F.lit("Previous question (context only, do not answer): "), F.col("previous"), F.lit("\nCurrent question (answer this question only): "), F.trim("text"))
    return turns.withColumn("previous", previous).select("conv_id", "turn", F.when(F.col("previous").isNull(), F.trim("text")).otherwise(both).alias("query"))


@query("""WITH f AS (SELECT item_id AS query_id, unnest(string_split(text, ' ')) AS w FROM benchmark), c AS (SELECT DISTINCT query_id, lower(w) AS w FROM f WHERE w <> ''),
    p AS (SELECT source || '/' || lang || '_' || doc_id || '.txt' AS path FROM documents), s AS (SELECT query_id, path, count(*) AS score FROM c JOIN p ON contains(lower(p.path), w) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= 5""")
def s2_relevant(spark: SparkSession, d: str) -> DataFrame:
    """The five files whose path holds the most distinct words of a question."""
    return relevant_files(documents(spark, d).select(F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")), questions(spark, d))


__all__ = ["QUERIES", "ORACLES", "hybrid", "ranked"]
