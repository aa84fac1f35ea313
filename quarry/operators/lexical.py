"""Lexical search: postings, BM25, field-summed search and phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import filled, identifier_words, pieces, tokens
from quarry.operators import segments
from quarry.storage import scratch, sent, settle, spread, tasks

K1, B, EPSILON = 1.5, 0.75, 1e-9
QUERY_ROWS = 200_000  # query terms up to which they are broadcast


def ranked(scores: DataFrame, k: int, score: str = "score", by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best of each query: by score to 6 places, then smallest id. Keeps a group limit before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(by).orderBy(F.round(score, 6).desc(), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, dl, t), t with empty tokens at its ends perhaps. The length is taken here: next to an explode it would be worked out again for every token."""
    if tokenizer is tokens:
        cut, count = pieces, filled
    else:
        cut, count = tokenizer, F.size
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "doc_id")
    return texts.select("doc_id", F.coalesce(cut(F.col("t")), F.array().cast("array<string>")).alias("t")).select("doc_id", count(F.col("t")).cast("int").alias("dl"), "t")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = tokens, positions: bool = False) -> DataFrame:
    """(doc_id, term, tf, dl[, positions]), counted where the texts are. Documents without tokens have no rows."""
    return segments.flat(tokenized(docs, id_col, text_col, tokenizer), positions)


def corpus_stats(docs: DataFrame, text_col: str = "text", tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row: n documents and their average length."""
    return tokenized(docs, text_col, text_col, tokenizer).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query_id, term, qtf): repeated terms count as often."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokenizer(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


ALL = ""  # the term that every document has once in stored counts, so that documents without tokens count too


def _terms() -> Column:
    return F.explode(F.concat("t", F.array(F.lit(ALL)))).alias("term")


def _counts(each: DataFrame) -> DataFrame:
    return each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


@dataclass(frozen=True)
class Index:
    """Stored segments of a collection (`segments`) and its totals: texts are tokenized once for all searches. Fields that lie in the same segments have the same path and a prefix each."""

    path: str
    tokenizer: Callable[[Column], Column]
    n: int
    avgdl: float
    prefix: str = ""

    def segments(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def postings(self, spark: SparkSession) -> DataFrame:
        """(term, doc_id, tf, dl), and ALL once a document."""
        p, rows = self.prefix, self.segments(spark)
        kind = rows.schema["docs"].dataType.elementType.simpleString()

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    s = segments.Segment(batch, row, p)
                    every = np.arange(len(s.docs))
                    at = np.append(s.at, every)
                    terms = pa.concat_arrays([s.terms.take(pa.array(np.repeat(np.arange(len(s.ends)), np.diff(s.ends, prepend=0)))), pa.array([ALL] * len(every), pa.string())])
                    yield pa.RecordBatch.from_arrays([terms, s.docs.take(pa.array(at)), pa.array(np.append(s.tf, np.ones_like(every)), pa.int64()), pa.array(s.dl[at], pa.int32())], ["term", "doc_id", "tf", "dl"])

        return rows.select("docs", *(p + c for c in ("dl", "terms", "n", "at", "tf"))).mapInArrow(flat, f"term string, doc_id {kind}, tf long, dl int")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = tokens, path: str | None = None) -> Index:
    """Tokenize all texts and store their segments at the path, or in a folder of the session's. Nothing is shuffled."""
    spark = docs.sparkSession
    path = path or f"{scratch(spark, 'postings')}/rows"
    segments.store(segments.make(tokenized(docs, id_col, text_col, tokenizer)), path)
    return Index(path, tokenizer, *segments.totals(spark.read.parquet(path)))


def build_fields(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = tokens) -> tuple[Index, Index]:
    """The indexes of the content and of its identifier words, a document's in the same segment, so that their scores are summed there."""
    spark = docs.sparkSession
    path = f"{scratch(spark, 'fields')}/rows"
    cut, count = (pieces, filled) if tokenizer is tokens else (tokenizer, F.size)
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    words = lambda text: F.coalesce(cut(text), F.array().cast("array<string>"))
    parts = texts.select("doc_id", words(F.col("text")).alias("t"), words(identifier_words(F.col("text"))).alias("s_t"))
    parts = parts.select("doc_id", count(F.col("t")).cast("int").alias("dl"), "t", count(F.col("s_t")).cast("int").alias("s_dl"), "s_t")
    segments.store(segments.make(parts, ("", "s_")), path)
    stored = spark.read.parquet(path)
    return Index(path, tokenizer, *segments.totals(stored)), Index(path, tokenizer, *segments.totals(stored, "s_"), "s_")


def _totals(found: DataFrame) -> tuple[int, float]:
    n, avgdl = found.where(F.col("term") == ALL).agg(F.count(F.lit(1)), F.avg("dl")).first()
    return n, avgdl or 1.0


def _idf(n: int) -> Column:
    return F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def term_weights(index, asked: DataFrame) -> DataFrame:
    """(query_id, term, w) of the asked terms (query_id, term, qtf) that stored segments have; index: its path, n and prefix, if it has one."""
    prefix = getattr(index, "prefix", "")
    df = segments.frequencies(asked.sparkSession.read.parquet(index.path), sent(asked.select("term").distinct()), prefix)
    return asked.join(df, "term").select("query_id", "term", (F.col("qtf") * _idf(index.n)).alias("w"))


def _index_scores(fields: Sequence[Index], queries: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """Scores summed over fields of the same segments: where the postings are, so that only each segment's k best of a query move."""
    weights = None
    for number, index in enumerate(fields):
        asked = settle(query_terms(queries, tokenizer=index.tokenizer))
        one = term_weights(index, asked).withColumn("field", F.lit(number))
        weights = one if weights is None else weights.unionByName(one)
    stored = fields[0].segments(queries.sparkSession)
    return segments.scored(stored, settle(weights), [f.prefix for f in fields], [f.avgdl for f in fields], k, k1, b, EPSILON)


def bm25_scores(
    docs: DataFrame | Index, queries: DataFrame, k1: float = K1, b: float = B, tokenizer: Callable[[Column], Column] = tokens, id_col: str = "doc_id", text_col: str = "text", within: DataFrame | None = None, best: int | None = None
) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with the query. docs: a table of texts, or a stored index of one.

    Of a table's texts, which are tokenized once, only tokens that some query has leave the scan, summed by document. Scores are
    summed where a document's rows are, so query terms times documents never move: only each task's best do, when ranked.
    within: the documents (doc_id) of an index that are searched; counts are then those of these documents. best: so many of a query are
    enough; the whole index then gives each segment's best only, as all scores are as many as queries times documents.
    """
    spark = queries.sparkSession
    if isinstance(docs, Index) and within is None:
        return _index_scores([docs], queries, best, k1, b)
    asked = settle(query_terms(queries, tokenizer=docs.tokenizer if isinstance(docs, Index) else tokenizer))
    few = asked.count() <= QUERY_ROWS
    hint = F.broadcast if few else (lambda t: t)
    if isinstance(docs, Index):
        held = docs.postings(spark).join(sent(within.select("doc_id").distinct()), "doc_id", "left_semi")
        n, avgdl = _totals(held)
        terms = held.join(hint(asked.select("term").distinct()), "term", "left_semi")
    else:
        wanted = asked.select("term").union(spark.createDataFrame([(ALL,)], "term string")).distinct()
        each = tokenized(docs, id_col, text_col, tokenizer).select("doc_id", "dl", _terms())
        found = settle(_counts(each.join(hint(wanted), "term", "left_semi")))
        n, avgdl = _totals(found)
        terms = found.where(F.col("term") != ALL)
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of a query at most
    weights = asked.join(df, "term").select("query_id", "term", (F.col("qtf") * _idf(n)).alias("w"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)) + EPSILON)
    terms = terms.repartition(tasks(spark), "doc_id")
    return terms.join(hint(weights), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).where(F.col("score") > EPSILON)


def bm25(docs: DataFrame | Index, queries: DataFrame, k: int, **how) -> DataFrame:
    """(query_id, doc_id, score, rank, distance); distance falls as the score rises."""
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(bm25_scores(docs, queries, best=k, **how), k).withColumn("distance", F.exp(-0.1 * F.col("score")))


def with_symbols(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text's identifier words in its place."""
    return docs.withColumn(text_col, identifier_words(F.col(text_col)))


def fields_search(docs: DataFrame | tuple[Index, Index], queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """BM25 over the content and over its identifier words, summed by document. docs: a table, or the two fields' indexes, best of one `build_fields`."""
    if isinstance(docs, tuple) and docs[0].path == docs[1].path and how.get("within") is None:
        return ranked(_index_scores(docs, queries, k, how.get("k1", K1), how.get("b", B)), k)
    content, symbols = docs if isinstance(docs, tuple) else (docs.select(id_col, text_col), with_symbols(docs.select(id_col, text_col), text_col))
    how = how | {"id_col": id_col, "text_col": text_col}
    both = bm25_scores(content, queries, **how).unionByName(bm25_scores(symbols, queries, **how))
    return ranked(both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), k)


def phrase_matches(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, hits): places where a phrase's tokens follow one another. A phrase of no token has no match.

    Documents meet phrases on the phrase's longest token, which few have, and are then looked through whole.
    """
    asked = phrases.select("query_id", tokens(F.col("query")).alias("p")).where("size(p) > 0")
    longest = F.element_at(F.array_sort(F.transform("p", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    asked = settle(asked.withColumn("term", longest))
    has = tokenized(docs, id_col, text_col).select("doc_id", F.explode("t").alias("term")).join(sent(asked.select("term").distinct()), "term", "left_semi").distinct()
    pairs = sent(settle(has.join(sent(asked), "term").select("doc_id", "query_id", "p")))
    line = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    texts = tokenized(docs, id_col, text_col).select("doc_id", "t").join(pairs, "doc_id").where(line(F.col("t")).contains(line(F.col("p"))))
    starts = F.filter(F.sequence(F.lit(1), F.size("t") - F.size("p") + 1), lambda i: F.slice("t", i, F.size("p")) == F.col("p"))
    return texts.select("query_id", "doc_id", F.size(starts).cast("long").alias("hits"))


def quoted_search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A query that is one quoted phrase is searched as such; without a hit, or with other quotes, as words. (query_id, doc_id, score, rank, mode)"""
    bare = F.trim("query")
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    is_quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    phrase = is_quoted & (F.trim(inner) != "") & ~inner.contains('"')
    asked = queries.withColumn("phrase", phrase)
    words = F.trim(F.regexp_replace(F.replace(bare, F.lit('"'), F.lit(" ")), r"\s+", " "))
    asked = asked.withColumn("query", F.when(is_quoted, words).otherwise(F.col("query")))
    hits = phrase_matches(docs, asked.where("phrase"), id_col, text_col).withColumn("score", F.col("hits").cast("double")).select("query_id", "doc_id", "score")
    missed = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    plain = fields_search(docs, missed, k, id_col, text_col).drop("rank").withColumn("mode", F.lit("words"))
    return ranked(hits.withColumn("mode", F.lit("phrase")).unionByName(plain), k)
