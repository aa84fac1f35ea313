"""Rank fusion, the balanced shortlist, reranking and facet merging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(vector: DataFrame, lexical: DataFrame, weights: Sequence[float] = (1.0, 1.0), k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, doc_id, rank) lists: query_id, doc_id, vector_rank, bm25_rank, rrf, fused_rank.

    An id repeated in a list counts with its last rank and keeps its first place for ties; scores of 0 or less go;
    ties keep the vector list's order and then the lexical one's.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id", "doc_id").agg(F.max("rank").alias(f"{name}_rank"), F.min("rank").alias(f"{name}_first"))

    both = one(vector, "vector").join(one(lexical, "bm25"), ["query_id", "doc_id"], "full_outer")
    part = lambda name, w: F.coalesce(F.lit(float(w)) / (k + F.col(f"{name}_rank")), F.lit(0.0))
    both = both.withColumn("rrf", part("vector", weights[0]) + part("bm25", weights[1])).where("rrf > 0")
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), F.col("vector_first").asc_nulls_last(), F.col("bm25_first").asc_nulls_last())
    return both.withColumn("fused_rank", F.row_number().over(order)).select("query_id", "doc_id", "vector_rank", "bm25_rank", "rrf", "fused_rank")


def balanced(fused: DataFrame, channels: Sequence[DataFrame], limit: int) -> DataFrame:
    """Candidates from each channel in turn, rank by rank, then by fused order; kept in fused order. Adds shortlist_rank."""
    turns = None
    for n, channel in enumerate(channels):
        rows = channel.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.lit(n).alias("channel"))
        turns = rows if turns is None else turns.unionByName(rows)
    first = turns.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "channel")).alias("turn"))
    rows = fused.join(first, ["query_id", "doc_id"], "full_outer")
    take = Window.partitionBy("query_id").orderBy(F.col("turn").asc_nulls_last(), F.col("fused_rank").asc_nulls_last())
    chosen = rows.withColumn("n", F.row_number().over(take)).where((F.col("n") <= limit) & F.col("fused_rank").isNotNull())
    kept = Window.partitionBy("query_id").orderBy("fused_rank")
    return chosen.withColumn("shortlist_rank", F.row_number().over(kept)).drop("n", "turn")


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | Column, top: int, query_col: str = "query", text_col: str = "content") -> DataFrame:
    """Score (query, text) pairs and keep the best `top` of each query; equal scores keep shortlist order.

    scorer is a column, or a function of two string series to finite floats, called a batch at a time.
    """
    if not isinstance(scorer, Column):
        scorer = F.pandas_udf(scorer, "double")(F.col(query_col), F.col(text_col))
    scored = candidates.withColumn("rerank_score", scorer)
    scored = scored.withColumn("rerank_score", F.when(F.isnan("rerank_score") | F.col("rerank_score").isNull(), F.raise_error(F.lit("the scorer gave no finite score"))).otherwise(F.col("rerank_score")))
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 6).desc(), "shortlist_rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top)


def keyword_overlap(query: Column, text: Column, tokenizer) -> Column:
    """A deterministic stand-in for a model: the share of the query's distinct tokens in the text."""
    asked = F.array_distinct(tokenizer(query))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, tokenizer(text))) / F.size(asked))


def merge_facets(passages: DataFrame, limit: int = 5) -> DataFrame:
    """Passages of a question's facets (query_id, facet_no, rank, doc_id) merged in turns to `limit` distinct ones.

    Turns go through the facets in order until every facet had its chance to be represented, and backwards after that. A turn
    skips passages already taken. Each question is one small group: facets times their candidate limit.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [g.sort_values("rank")["doc_id"].tolist() for _, g in rows.groupby("facet_no", sort=True)]
        streams = [iter(x) for x in lists]
        taken: dict = {}
        forward = True
        while len(taken) < limit:
            before = len(taken)
            for stream in streams if forward else reversed(streams):
                fresh = next((d for d in stream if d not in taken), None)
                if fresh is not None:
                    taken[fresh] = len(taken) + 1
                if len(taken) == limit:
                    break
            if len(taken) == before:
                break
            forward = forward and len(taken) < len(streams)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "doc_id": list(taken), "rank": list(taken.values())})

    kinds = dict(passages.dtypes)
    return passages.select("query_id", "facet_no", "rank", "doc_id").groupBy("query_id").applyInPandas(merge, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank int")
