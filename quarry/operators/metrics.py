"""Retrieval and answer metrics, and the statistics of reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_ranks(ranked: DataFrame) -> DataFrame:
    """Repeated documents count once, at their first rank; ranks close up. ranked: arm, query_id, doc_id, rank."""
    first = ranked.groupBy("arm", "query_id", "doc_id").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "query_id").orderBy("first")))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per arm and question with gold: recall at 5 and 10, nDCG at 10, MRR, precision at 5, average precision.

    gold: query_id, doc_id (distinct). Questions without gold have no row; ones without hits score 0.
    """
    size = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    marked = document_ranks(ranked).join(gold.distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").join(size, "query_id").fillna(0, ["hit"])
    up_to = Window.partitionBy("arm", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("found", F.sum("hit").over(up_to))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    gain = F.when(F.col("rank") <= 10, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)
    scores = marked.groupBy("arm", "query_id").agg(
        F.max("n_gold").alias("n_gold"),
        at(5).alias("h5"),
        at(10).alias("h10"),
        F.sum(gain).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("hit") * F.col("found") / F.col("rank")).alias("precisions"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return scores.select(
        "arm",
        "query_id",
        (F.col("h5") / F.col("n_gold")).alias("recall5"),
        (F.col("h10") / F.col("n_gold")).alias("recall10"),
        (F.col("dcg") / ideal).alias("ndcg10"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("h5") / 5).alias("precision5"),
        (F.col("precisions") / F.col("n_gold")).alias("average_precision"),
    )


def span_scores(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Per question: hit, recall, mrr, ndcg, precision of passages against answer groups.

    ranked: query_id, rank, group_no (the group a passage matches, null if none); groups: query_id, answers (their number).
    Two passages of one group both gain while the ideal counts the group once, so ndcg may exceed 1.
    """
    hit = F.col("group_no").isNotNull()
    each = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("passages"),
        F.count_if(hit).alias("hits"),
        F.count_distinct("group_no").alias("found"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    each = each.join(groups, "query_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("answers", "passages").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return each.select(
        "query_id",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        (F.col("found") / F.col("answers")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("gain") / ideal).alias("ndcg"),
        (F.col("hits") / F.col("passages")).alias("precision"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share, to 4 places; of nothing: 0 and 0."""
    p, d = k / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.round(middle - half, 4)), F.when(n == 0, 0.0).otherwise(F.round(middle + half, 4))


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided p of the discordant pairs."""
    n = wins + losses
    if not n:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n)


def sign_test_column(wins: Column, losses: Column) -> Column:
    """The same over columns, with binomials in logarithms built up term by term."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.log((n - i + 1) / i)).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - i + 1) / i) - n * math.log(2.0))).alias("sum"))
    rest = F.when(k >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step)["sum"]).otherwise(F.lit(0.0))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * (rest + F.exp(-n * math.log(2.0)))))


def kappa(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """graded_twice, agreement, cohen_kappa of two labels a row; rows without both are left out. Counted by label pair, so the tables stay as small as the label set."""
    cells = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("x"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = rows.join(columns, rows["a"] == columns["b"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("by_chance"))
    all_of = total.crossJoin(chance).where("total > 0")  # one row each
    p, e = F.col("same") / F.col("total"), F.col("by_chance") / (F.col("total") * F.col("total"))
    return all_of.select(F.col("total").alias("graded_twice"), F.round(p, 4).alias("agreement"), F.round(F.when(e == 1, 1.0).otherwise((p - e) / (1 - e)), 4).alias("cohen_kappa"))


def transitions(before: DataFrame, after: DataFrame, on: str, label: str, labels: list) -> DataFrame:
    """A row for each label before, a column for each after; counts of items that both have."""
    both = before.select(on, F.col(label).alias("before")).join(after.select(on, F.col(label).alias("after")), on)
    return both.groupBy("before").pivot("after", labels).agg(F.count(F.lit(1))).fillna(0)


def fixed_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows by the SHA-256 of their ids: the same whatever the order."""
    return df.orderBy(F.sha2(F.col(id_col).cast("string"), 256)).limit(n)


def resume(planned: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """What the ledger has no complete event for."""
    return planned.join(ledger.where("event = 'complete'").select(*keys).distinct(), keys, "left_anti")
