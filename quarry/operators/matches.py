"""Texts that hold other texts, and paths that hold words, by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.contained import held
from quarry.operators.lexical import tokenized
from quarry.storage import sent, settle


ONE_PASS = 1 << 20  # bytes of queries up to which all are looked for together


def holding(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id): documents whose text has the query's text in it, worked out once and kept. Null and empty queries are in none.

    Up to ONE_PASS bytes of queries are looked for all together in one pass over the texts (`contained`), which don't move. Of more,
    a text that holds a query has all its tokens but perhaps the outer ones, which may be parts of words. So documents meet
    queries on the longest inner token and are then looked through. Queries of under three tokens, which have none, are looked for
    together as above.
    """
    asked = settle(queries.where("query != ''").select("query_id", "query", tokens(F.col("query")).alias("t")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if asked.agg(F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()[0] <= ONE_PASS:
        return settle(held(texts, asked))
    inner = F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    long = asked.where("size(t) >= 3").select("query_id", "query", longest.alias("term"))
    short = asked.where("size(t) < 3").select("query_id", "query")
    has = tokenized(docs, id_col, text_col).select("doc_id", F.explode("t").alias("term")).join(sent(long.select("term").distinct()), "term", "left_semi").distinct()
    pairs = settle(has.join(sent(long.select("query_id", "term")), "term").select("doc_id", "query_id"))
    named = texts.join(sent(pairs), "doc_id").join(sent(long.select("query_id", "query")), "query_id")
    found = named.where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id")
    return settle(found if short.isEmpty() else found.unionByName(held(texts, short)))


def relevant_files(files: DataFrame, queries: DataFrame, most: int = 5, path_col: str = "path") -> DataFrame:
    """(query_id, path, score, rank): the `most` files whose path holds the most distinct words of a query, in any case; equal scores in order of paths.

    Paths meet words on the parts of a path that are as long as some word, so that no pair without a word in common is made.
    """
    words = queries.select("query_id", F.explode(F.split("query", " ")).alias("w")).where("w != ''").select("query_id", F.lower("w").alias("w")).distinct()
    words = settle(words)
    sizes = sorted(r[0] for r in words.select(F.length("w")).distinct().collect())  # lengths of words
    low = F.col("low")
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))
    none = F.array().cast("array<string>")
    parts = F.array_distinct(F.flatten(F.array(none, *[F.when(F.length(low) >= n, at(n)).otherwise(none) for n in sizes])))
    named = files.select(F.col(path_col).alias("path"), F.lower(F.col(path_col)).alias("low"))
    found = named.select("path", F.explode(parts).alias("w")).join(sent(words), "w").groupBy("query_id", "path").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
