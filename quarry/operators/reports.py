"""Reports over graded answers, judged answers and run ledgers. All are aggregations that combine before they shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.metrics import sign_test_column, wilson
from quarry.operators.scans import percentiles, running_total

# What a judge's word for relevance counts, and the metrics of an answer.
RELEVANCE = {"full": 1.0, "partial": 0.5, "none": 0.0}
METRICS = ("faithfulness", "answer_relevance", "context_relevance", "context_precision", "context_recall", "completeness", "citation_precision")
GRADES = ("exact", "partial", "miss")


def share(flags: Column) -> Column:
    """Share of true ones; of none: null."""
    return F.when(F.size(flags) > 0, F.size(F.filter(flags, lambda x: x)) / F.size(flags))


def average_precision(flags: Column) -> Column:
    """Mean, over true places, of the share of true ones up to there; none true, or no flags: 0."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        n, hits = s["n"] + 1, s["hits"] + x.cast("int")
        return F.struct(n.alias("n"), hits.alias("hits"), (s["sum"] + F.when(x, hits / n).otherwise(0.0)).alias("sum"))

    return F.aggregate(flags, start, step, lambda s: F.when(s["hits"] > 0, s["sum"] / s["hits"]).otherwise(0.0))


def quality_scores(verdicts: DataFrame) -> DataFrame:
    """question_id and METRICS; null where one doesn't apply.

    verdicts: question_id, refused, claims (array of supported), relevance, passages (array of useful), facts (array of in_passages,
    in_answer), cited and gold (arrays of ids). Where n_passages or n_facts say how many verdicts there should be, reading a row with another number raises.
    """
    for expected, given in (("n_passages", "passages"), ("n_facts", "facts")):
        if expected in verdicts.columns:
            wrong = F.raise_error(F.concat(F.lit(f"the judge gave another number of {given} than "), F.col(expected).cast("string")))
            verdicts = verdicts.withColumn(given, F.when(F.size(given) == F.col(expected), F.col(given)).otherwise(wrong.cast(verdicts.schema[given].dataType)))
    relevance = F.element_at(F.create_map(*[x for k, v in RELEVANCE.items() for x in (F.lit(k), F.lit(v))]), F.col("relevance"))
    cited = F.transform("cited", lambda x: F.array_contains("gold", x))
    made = {
        "faithfulness": F.when(~F.col("refused"), share(F.col("claims"))),
        "answer_relevance": relevance,
        "context_relevance": share(F.col("passages")),
        "context_precision": average_precision(F.col("passages")),
        "context_recall": share(F.transform("facts", lambda f: f["in_passages"])),
        "completeness": share(F.transform("facts", lambda f: f["in_answer"])),
        "citation_precision": F.when(F.size("gold") > 0, share(cited)),
    }
    return verdicts.select("question_id", *[made[m].alias(m) for m in METRICS])


def mean_scores(scores: DataFrame) -> DataFrame:
    """One row: the mean of each metric to 4 places, nulls left out."""
    return scores.agg(*[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def answer_summary(items: DataFrame) -> DataFrame:
    """One row: checked_questions, answered, abstained, faithfulness, relevance, unsupported_claims, missing_evidence.

    items: status, abstained, faithfulness, relevance, claims (array of supported). Only answered ones count in the means.
    """
    good = F.col("status") == "success"
    answered = good & ~F.col("abstained")
    return items.agg(
        F.count_if(good).alias("checked_questions"),
        F.count_if(answered).alias("answered"),
        F.count_if(good & F.col("abstained")).alias("abstained"),
        F.round(F.avg(F.when(answered, F.col("faithfulness"))), 4).alias("faithfulness"),
        F.round(F.avg(F.when(answered, F.col("relevance"))), 4).alias("relevance"),
        F.coalesce(F.sum(F.when(answered, F.size(F.filter("claims", lambda c: ~c)))), F.lit(0)).alias("unsupported_claims"),
        F.count_if(F.col("status") == "missing_evidence").alias("missing_evidence"),
    )


def check_answers(answers: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.DataFrame], order: str = "question_id") -> DataFrame:
    """answers (question_id, answer, evidence) with status, claims (array of supported), relevance and error from a judge.

    The judge gets answers and evidence, a batch at a time, and gives claims, relevance and error. Answers without evidence aren't judged: missing_evidence. The
    first failure, in the given order, ends a check: later answers are not_checked. Every answer is judged in parallel all the same, as
    which one fails first is known only afterwards.
    """

    @F.pandas_udf("claims array<boolean>, relevance string, error string")
    def run(texts: pd.Series, evidence: pd.Series) -> pd.DataFrame:
        return judge(texts, evidence)

    asked = answers.withColumn("judged", F.when(F.col("evidence") != "", run(F.coalesce("answer", F.lit("")), F.coalesce("evidence", F.lit("")))))
    failed = asked.where("judged.error is not null").agg(F.min(order).alias("first_failed"))  # one row
    rows = asked.crossJoin(F.broadcast(failed))
    status = (
        F.when(F.col("first_failed").isNotNull() & (F.col(order) > F.col("first_failed")), "not_checked")
        .when(F.coalesce(F.col("evidence"), F.lit("")) == "", "missing_evidence")
        .when(F.col("judged.error").isNotNull(), "error")
        .otherwise("success")
    )
    told = status == "success"
    return rows.select(*answers.columns, status.alias("status"), F.when(told, F.col("judged.claims")).alias("claims"), F.when(told, F.col("judged.relevance")).alias("relevance"), F.when(status == "error", F.col("judged.error")).alias("error"))


def arm_report(scores: DataFrame, metrics: Sequence[str], places: int = 4) -> DataFrame:
    """(arm, questions, metrics, latency_p50_s, latency_p95_s): means by arm, and nearest-rank latencies. scores: arm, query_id, latency_seconds, the metrics."""
    means = [F.round(F.avg(m), places).alias(m) for m in metrics]
    latency = percentiles(scores, ["arm"], "latency_seconds", {"latency_p50_s": 0.5, "latency_p95_s": 0.95})
    latency = latency.select("arm", *[F.round(c, 3).alias(c) for c in ("latency_p50_s", "latency_p95_s")])
    return scores.groupBy("arm").agg(F.count(F.lit(1)).alias("questions"), *means).join(latency, "arm", "left")


def paired(scores: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """One row about the questions that both arms have: questions, first_better, second_better, first_mean, second_mean, and p of the exact sign test. Scores that are equal to 9 places are."""
    both = scores.where(F.col("arm").isin(first, second)).groupBy("query_id").agg(F.max(F.when(F.col("arm") == first, F.col(metric))).alias("a"), F.max(F.when(F.col("arm") == second, F.col(metric))).alias("b"))
    both = both.where("a is not null and b is not null")
    row = both.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.round("a", 9) > F.round("b", 9)).alias("first_better"), F.count_if(F.round("a", 9) < F.round("b", 9)).alias("second_better"), F.round(F.avg("a"), 6).alias("first_mean"), F.round(F.avg("b"), 6).alias("second_mean"))
    return row.withColumn("p", F.round(sign_test_column(F.col("first_better"), F.col("second_better")), 6))


def run_summary(events: DataFrame, planned: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(arm, completed, remaining, errors, metrics): a question's last event of a run counts. events: arm, query_id, event, n (their order), the metrics; planned: query_id."""
    order = F.struct("n", "event", *metrics)
    last = events.where("event in ('complete', 'error')").groupBy("arm", "query_id").agg(F.max(order).alias("e"))
    done = F.col("e.event") == "complete"
    means = [F.round(F.avg(F.when(done, F.col(f"e.{m}"))), 6).alias(m) for m in metrics]
    total = planned.agg(F.count_distinct("query_id").alias("planned"))  # one row
    rows = last.join(planned.select("query_id").distinct(), "query_id", "left_semi").groupBy("arm").agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("errors"), *means)
    return rows.crossJoin(F.broadcast(total)).withColumn("remaining", F.col("planned") - F.col("completed")).drop("planned")


def grade_counts(graded: DataFrame, by: str, grades: Sequence[str] = GRADES) -> DataFrame:
    """(collection, n, a count, low and high for each grade), with a row `all`: counts and 95 % intervals of each grade's share."""
    counts = [F.count_if(F.col("grade") == g).alias(g) for g in grades]
    rows = graded.groupBy(F.coalesce(F.col(by), F.lit("")).alias("collection")).agg(F.count(F.lit(1)).alias("n"), *counts)
    every = rows.agg(F.lit("all").alias("collection"), F.sum("n").alias("n"), *[F.sum(g).alias(g) for g in grades])
    rows = rows.unionByName(every.where("n is not null"))
    for g in grades:
        low, high = wilson(F.col(g), F.col("n"))
        rows = rows.withColumn(f"{g}_low", low).withColumn(f"{g}_high", high)
    return rows


def grade_changes(before: DataFrame, after: DataFrame, on: str, order: Sequence) -> DataFrame:
    """(before, after, n, change): items that both runs graded, by both grades; `change` is better, worse or same. order: grades from the best."""
    place = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    both = before.select(on, F.col("grade").alias("before")).join(after.select(on, F.col("grade").alias("after")), on)
    change = F.when(place("after") < place("before"), "better").when(place("after") > place("before"), "worse").otherwise("same")
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).withColumn("change", change)


def unblinded(grades: DataFrame, key: DataFrame, on: str, sides: Sequence[str] = ("A", "B")) -> DataFrame:
    """(arm, grade, n): grades given to sides, through a key (on, side, arm) that says which arm a side was."""
    rows = grades.unpivot(on, list(sides), "side", "grade").where("grade is not null")
    return rows.join(key.select(on, "side", "arm"), [on, "side"]).groupBy("arm", "grade").agg(F.count(F.lit(1)).alias("n"))


def category_summary(graded: DataFrame, by: str) -> DataFrame:
    """(category, questions, correct_percent), with `all` (of all questions) and `average` (of the categories' percents, unweighted). graded: `by`, correct."""
    each = graded.groupBy(F.col(by).alias("category")).agg(F.count(F.lit(1)).alias("questions"), (100 * F.avg(F.col("correct").cast("int"))).alias("p"))
    whole = graded.agg(F.lit("all").alias("category"), F.count(F.lit(1)).alias("questions"), (100 * F.avg(F.col("correct").cast("int"))).alias("p"))
    mean = each.agg(F.lit("average").alias("category"), F.sum("questions").alias("questions"), F.avg("p").alias("p"))
    return each.unionByName(whole).unionByName(mean).withColumn("correct_percent", F.round("p", 1)).drop("p")


def accuracy(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(answered, correct, partial, wrong, accuracy), for each group if any. graded: grade of GRADES."""
    exact = F.col("grade") == "exact"
    rows = graded.groupBy(*by) if by else graded.groupBy()
    return rows.agg(F.count(F.lit(1)).alias("answered"), F.count_if(exact).alias("correct"), F.count_if(F.col("grade") == "partial").alias("partial"), F.count_if(F.col("grade") == "miss").alias("wrong"), F.round(F.avg(exact.cast("int")), 4).alias("accuracy"))


def release_gate(graded: DataFrame, by: str, least: float = 0.8) -> DataFrame:
    """(by, share, passed): whether each group has at least that share of exact answers."""
    part = F.avg((F.col("grade") == "exact").cast("int"))
    return graded.groupBy(by).agg(F.round(part, 6).alias("share"), (part >= least).alias("passed"))


def spend(started: DataFrame, ended: DataFrame, key: str, failed_cost: float = 0.01, open_cost: float = 0.5) -> DataFrame:
    """One row: calls_started, known_cost, and what to reserve for failed calls and for those without an end. started: key; ended: key, cost (null if failed)."""
    calls = ended.groupBy(key).agg(F.max("cost").alias("cost"), F.lit(True).alias("ended"))
    reserve = F.when(F.col("cost").isNotNull(), 0.0).when(F.col("ended"), failed_cost).otherwise(open_cost)
    return started.select(key).distinct().join(calls, key, "left").agg(F.count(F.lit(1)).alias("calls_started"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("known_cost"), F.round(F.coalesce(F.sum(reserve), F.lit(0.0)), 4).alias("reserved"))


def capped_run(planned: DataFrame, order: Sequence[str], cost: str, cap: int, proves: str) -> DataFrame:
    """planned rows with `status`: what a run in the given order makes of them within a cap. made: called and proven; failed: the first call that proves nothing, which ends the run;
    over_cap: the first row whose call would pass the cap, which ends it too; not_reached: all others.

    Costs are summed in ranges of the order, so no task runs over all rows. A null cost counts 0. The order is total.
    """
    rows = running_total(planned, [], [F.col(c).asc_nulls_last() for c in order], cost, "__total")
    at = F.struct(*order)
    stop = rows.where((F.col("__total") > cap) | ~F.coalesce(F.col(proves), F.lit(False))).agg(F.min(at).alias("__stop"))  # one row
    met = rows.crossJoin(F.broadcast(stop))
    reached = F.when(F.col("__total") > cap, "over_cap").otherwise("failed")
    status = F.when(F.col("__stop").isNull() | (at < F.col("__stop")), "made").when(at == F.col("__stop"), reached).otherwise("not_reached")
    return met.withColumn("status", status).select(*planned.columns, "status")


def outcomes(calls: DataFrame, by: str, outcome: str = "outcome", names: Sequence[str] = ("answered", "busy", "other")) -> DataFrame:
    """(level, a count of each outcome)."""
    return calls.groupBy(F.col(by).alias("level")).agg(*[F.count_if(F.col(outcome) == n).alias(n) for n in names])


def anchor_ranks(hits: DataFrame, anchors: DataFrame, threshold: int = 5) -> DataFrame:
    """(query_id, channel, rank, hit): the first rank whose text holds the question's anchor, null if none, and whether it is within the threshold.

    hits: query_id, channel, rank, content; anchors: query_id, anchor. Every channel has a row for every question.
    """
    found = hits.join(anchors, "query_id").where(F.col("content").contains(F.col("anchor"))).groupBy("query_id", "channel").agg(F.min("rank").alias("rank"))
    every = anchors.select("query_id").crossJoin(F.broadcast(hits.select("channel").distinct()))  # a few channels
    return every.join(found, ["query_id", "channel"], "left").withColumn("hit", F.coalesce(F.col("rank") <= threshold, F.lit(False)))
