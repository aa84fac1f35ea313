"""Evaluation and report queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip_citations, tokens
from quarry.operators import intervals, judgments, lexical, metrics, reports, scans
from quarry.plans.tables import GOLD, PASSAGES, QUESTIONS, TOKENS, bm25_sql, documents, gold, lexical_index, passages, questions, table, top_sql
from quarry.storage import sent, settle

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- two arms over the same questions: BM25 order, and its ten hits in order of id

_ARMS = f"""{QUESTIONS}, {GOLD}, {bm25_sql()}, top AS {top_sql("bm25", 10)},
    ranked AS (SELECT 'score' AS arm, query_id, doc_id, rank FROM top UNION ALL SELECT 'id', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM top)"""
_METRICS = f"""{_ARMS}, size AS (SELECT query_id, count(DISTINCT doc_id) AS n_gold FROM gold GROUP BY query_id),
    marked AS (SELECT r.*, n_gold, (g.doc_id IS NOT NULL)::INT AS hit FROM ranked r JOIN size USING (query_id) LEFT JOIN gold g ON r.query_id = g.query_id AND r.doc_id = g.doc_id),
    cum AS (SELECT *, sum(hit) OVER (PARTITION BY arm, query_id ORDER BY rank) AS found FROM marked),
    metrics AS (SELECT arm, query_id, sum(hit) FILTER (rank <= 5) / max(n_gold) AS recall5, sum(hit) FILTER (rank <= 10) / max(n_gold) AS recall10,
        sum(hit / log2(rank + 1)) / list_sum(list_transform(generate_series(1, least(max(n_gold), 10)), lambda i: 1 / log2(i + 1))) AS ndcg10,
        coalesce(1.0 / min(rank) FILTER (hit = 1), 0.0) AS mrr, sum(hit) FILTER (rank <= 5) / 5 AS precision5, sum(hit * found / rank) / max(n_gold) AS average_precision
        FROM cum GROUP BY arm, query_id)"""


def arms(spark: SparkSession, d: str) -> DataFrame:
    top = settle(lexical.bm25(lexical_index(spark, d), questions(spark, d), 10).select("query_id", "doc_id", "rank"))
    by_id = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return top.withColumn("arm", F.lit("score")).unionByName(by_id.withColumn("arm", F.lit("id")))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(arms(spark, d), gold(spark, d))


def _round(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


@query(f"WITH {_METRICS} SELECT arm, query_id, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(ndcg10, 6) AS ndcg10, round(mrr, 6) AS mrr FROM metrics")
def e5_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _round(_metrics(spark, d).select("arm", "query_id", "recall5", "recall10", "ndcg10", "mrr"), "recall5", "recall10", "ndcg10", "mrr")


@query(f"WITH {_METRICS} SELECT arm, query_id, round(precision5, 6) AS precision5, round(average_precision, 6) AS average_precision FROM metrics")
def e7_map(spark: SparkSession, d: str) -> DataFrame:
    return _round(_metrics(spark, d).select("arm", "query_id", "precision5", "average_precision"), "precision5", "average_precision")


_EVENTS = f"""{_METRICS}, events_of AS (SELECT arm, query_id, CASE WHEN query_id % 7 = 0 THEN 'error' ELSE 'complete' END AS event, recall5, recall10, ndcg10, mrr, (query_id % 13 + 1) / 10.0 AS latency_seconds FROM metrics)"""
_MEANS = ("recall5", "recall10", "ndcg10", "mrr")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A ledger over both arms: every question is tried twice, and the second time each seventh fails."""
    rows = _metrics(spark, d).select("arm", "query_id", *_MEANS, ((F.col("query_id") % 13 + 1) / 10.0).alias("latency_seconds"))
    again = rows.withColumn("n", F.lit(2)).withColumn("event", F.when(F.col("query_id") % 7 == 0, "error").otherwise("complete"))
    return rows.withColumn("n", F.lit(1)).withColumn("event", F.lit("complete")).unionByName(again)


@query(f"""WITH {_EVENTS} SELECT arm, count(*) FILTER (event = 'complete') AS completed, count(*) FILTER (event = 'error') AS errors, (SELECT count(*) FROM q) - count(*) FILTER (event = 'complete') AS remaining,
    round(avg(recall5) FILTER (event = 'complete'), 6) AS recall5, round(avg(recall10) FILTER (event = 'complete'), 6) AS recall10, round(avg(ndcg10) FILTER (event = 'complete'), 6) AS ndcg10, round(avg(mrr) FILTER (event = 'complete'), 6) AS mrr FROM events_of GROUP BY arm""")
def e6_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_summary(_events(spark, d), questions(spark, d).select("query_id"), _MEANS)


_SIGN = "least(1.0, 2 * list_sum(list_transform(generate_series(0, least(w, l)), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2)))))"


@query(f"""WITH {_METRICS}, c AS (SELECT count(*) AS questions, count(*) FILTER (round(a.ndcg10, 9) > round(b.ndcg10, 9)) AS w, count(*) FILTER (round(a.ndcg10, 9) < round(b.ndcg10, 9)) AS l,
        round(avg(a.ndcg10), 6) AS first_mean, round(avg(b.ndcg10), 6) AS second_mean FROM metrics a JOIN metrics b USING (query_id) WHERE a.arm = 'score' AND b.arm = 'id')
    SELECT questions, w AS first_better, l AS second_better, first_mean, second_mean, round({_SIGN}, 6) AS p FROM c""")
def e10_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.paired(_metrics(spark, d), "ndcg10", "score", "id")


@query(f"""WITH {_EVENTS} SELECT arm, count(*) AS questions, round(avg(recall5), 4) AS recall5, round(avg(recall10), 4) AS recall10, round(avg(ndcg10), 4) AS ndcg10, round(avg(mrr), 4) AS mrr,
    round(quantile_disc(latency_seconds, 0.5), 3) AS latency_p50_s, round(quantile_disc(latency_seconds, 0.95), 3) AS latency_p95_s FROM events_of GROUP BY arm""")
def e10_arms(spark: SparkSession, d: str) -> DataFrame:
    return reports.arm_report(_events(spark, d).where("n = 2"), _MEANS)


@query(f"""WITH {_METRICS}, c AS (SELECT count(*) FILTER (round(a.ndcg10, 9) > round(b.ndcg10, 9)) AS w, count(*) FILTER (round(a.ndcg10, 9) < round(b.ndcg10, 9)) AS l FROM metrics a JOIN metrics b USING (query_id) WHERE a.arm = 'score' AND b.arm = 'id')
    SELECT w AS wins, l AS losses, round(CASE WHEN w + l = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, least(w, l)), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2))))) END, 6) AS p FROM c""")
def e9_sign_test(spark: SparkSession, d: str) -> DataFrame:
    counts = e10_report(spark, d).select(F.col("first_better").alias("wins"), F.col("second_better").alias("losses"))
    return counts.withColumn("p", F.round(metrics.sign_test_column(F.col("wins"), F.col("losses")), 6))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def e8_percentile(spark: SparkSession, d: str) -> DataFrame:
    return scans.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


# ---- spans

_SPANS = f"""{PASSAGES}, l AS (SELECT doc_id, n AS l_n, start_offset AS l_start, end_offset AS l_end FROM passages),
    r AS (SELECT doc_id, n AS r_n, greatest(0, start_offset - 20) AS r_start, end_offset - 20 AS r_end FROM passages WHERE end_offset > 20)"""


@query(f"WITH {_SPANS} SELECT doc_id, l_n, r_n FROM l JOIN r USING (doc_id) WHERE least(l_end, r_end) - greatest(l_start, r_start) > 0 AND (least(l_end, r_end) - greatest(l_start, r_start)) * 2 >= least(l_end - l_start, r_end - r_start)")
def e1_span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """All lines against themselves shifted."""
    base = passages(spark, d)
    left = base.select("doc_id", F.col("n").alias("l_n"), F.col("start_offset").alias("l_start"), F.col("end_offset").alias("l_end"))
    right = base.where("end_offset > 20").select("doc_id", F.col("n").alias("r_n"), F.greatest(F.lit(0), F.col("start_offset") - 20).alias("r_start"), (F.col("end_offset") - 20).alias("r_end"))
    return intervals.overlap_join(left, right, ["doc_id"]).select("doc_id", "l_n", "r_n")


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents stand for questions: a third of their lines are relevant, a third irrelevant; what was found are their lines 20 characters on, each seventh left out."""
    base = passages(spark, d).select(F.col("doc_id").alias("question_id"), F.col("n").cast("int").alias("ordinal"), F.col("doc_id").alias("source_id"), "start_offset", "end_offset")
    labels = base.where("ordinal % 3 <> 2").withColumn("label", F.when(F.col("ordinal") % 3 == 0, "relevant").otherwise("irrelevant"))
    found = base.where("ordinal % 7 <> 6").select("question_id", (F.col("ordinal") + 1).alias("rank"), "source_id", (F.col("start_offset") + 20).alias("start_offset"), (F.col("end_offset") + 20).alias("end_offset"))
    return found, labels


@query(f"""WITH {PASSAGES}, l AS (SELECT doc_id, n, n % 3 = 0 AS good, start_offset AS a, end_offset AS b FROM passages WHERE n % 3 <> 2), p AS (SELECT doc_id, n + 1 AS rank, start_offset + 20 AS a, end_offset + 20 AS b FROM passages WHERE n % 7 <> 6),
    m AS (SELECT p.doc_id, p.rank, min(l.n) FILTER (good) AS g FROM p JOIN l ON p.doc_id = l.doc_id AND least(p.b, l.b) - greatest(p.a, l.a) > 0 AND (least(p.b, l.b) - greatest(p.a, l.a)) * 2 >= least(p.b - p.a, l.b - l.a) GROUP BY ALL),
    r AS (SELECT p.doc_id, p.rank, g, m.doc_id IS NULL AS unjudged FROM p LEFT JOIN m USING (doc_id, rank)), answers AS (SELECT doc_id, count(*) AS n FROM l WHERE good GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS k, count(g) AS hits, count(DISTINCT g) AS found, min(rank) FILTER (g IS NOT NULL) AS first, sum(CASE WHEN g IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM r GROUP BY doc_id),
    q AS (SELECT (hits > 0)::INT::DOUBLE AS hit, found / n AS recall, coalesce(1.0 / first, 0) AS mrr, gain / list_sum(list_transform(generate_series(1, least(n, k)), lambda i: 1 / log2(i + 1))) AS ndcg, hits / k AS precision FROM s JOIN answers USING (doc_id))
    SELECT count(*) AS judged_questions, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(precision), 4) AS precision, (SELECT count(*) FROM r WHERE unjudged) AS unjudged_passages FROM q""")
def e4_score_batch(spark: SparkSession, d: str) -> DataFrame:
    return judgments.score_batch(*_labelled(spark, d))


@query()
def e2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Answer groups of all lines, each with its first and its last half as further labels."""
    base = passages(spark, d).select(F.col("doc_id").alias("question_id"), "n", F.col("doc_id").alias("source_id"), "start_offset", "end_offset")
    half = F.col("start_offset") + F.floor((F.col("end_offset") - F.col("start_offset")) / 2)
    first, last = base.withColumn("end_offset", half), base.withColumn("start_offset", half)
    every = None
    for k, part in enumerate((first, base, last)):
        rows = part.where("end_offset > start_offset").select("question_id", (F.col("n") * 3 + k).cast("int").alias("ordinal"), "source_id", "start_offset", "end_offset")
        every = rows if every is None else every.unionByName(rows)
    return judgments.answer_groups(every).select("question_id", "ordinal", "group_no")


@query(f"""WITH {_ARMS}, sizes AS (SELECT query_id, count(DISTINCT doc_id) AS answers FROM gold GROUP BY query_id),
    j AS (SELECT t.query_id, t.rank, g.doc_id AS group_no FROM top t LEFT JOIN gold g ON t.query_id = g.query_id AND t.doc_id = g.doc_id),
    s AS (SELECT query_id, count(*) AS passages, count(group_no) AS hits, count(DISTINCT group_no) AS found, min(rank) FILTER (group_no IS NOT NULL) AS first, sum(CASE WHEN group_no IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM j GROUP BY query_id)
    SELECT query_id, (hits > 0)::DOUBLE AS hit, round(found / answers, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, round(gain / list_sum(list_transform(generate_series(1, least(answers, passages)), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(hits / passages, 6) AS precision FROM s JOIN sizes USING (query_id)""")
def e3_scores(spark: SparkSession, d: str) -> DataFrame:
    top = arms(spark, d).where("arm = 'score'").select("query_id", "doc_id", "rank")
    answers = settle(gold(spark, d))
    marked = top.join(answers.withColumn("group_no", F.col("doc_id")), ["query_id", "doc_id"], "left")
    scores = metrics.span_scores(marked, answers.groupBy("query_id").agg(F.count_distinct("doc_id").alias("answers")))
    return _round(scores, "recall", "mrr", "ndcg", "precision")


@query(f"""WITH {_ARMS}, f AS (SELECT arm, query_id, min(rank) AS rank FROM ranked JOIN gold USING (query_id, doc_id) GROUP BY arm, query_id)
    SELECT query_id, arm AS channel, rank, coalesce(rank <= 5, false) AS hit FROM (SELECT query_id, arm FROM q, (SELECT DISTINCT arm FROM ranked)) LEFT JOIN f USING (query_id, arm)""")
def e30_anchor_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each question's text is its anchor; both arms are channels."""
    hits = sent(arms(spark, d)).join(documents(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id").withColumnRenamed("arm", "channel")
    return reports.anchor_ranks(hits, questions(spark, d).where("query != ''").withColumnRenamed("query", "anchor"))


@query(f"""WITH {_ARMS}, hit AS (SELECT query_id, min(rank) AS r FROM top JOIN gold USING (query_id, doc_id) GROUP BY query_id)
    SELECT count(*) AS questions, count(*) FILTER (r = 1) AS top1, count(*) FILTER (r <= 5) AS top5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM q LEFT JOIN hit USING (query_id)""")
def e21_code_ranks(spark: SparkSession, d: str) -> DataFrame:
    every = questions(spark, d).select("query_id").join(e30_anchor_rank(spark, d).where("channel = 'score'").select("query_id", "rank"), "query_id", "left")
    return every.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


_KEYWORDS = r"list_filter(list_transform(regexp_split_to_array(lower(query), '\s+'), lambda w: trim(w, '.,;:\"''()')), lambda w: length(w) > 3)"
_GRADES = f"""{_ARMS}, t5 AS (SELECT query_id, string_agg(lower(text), ' ' ORDER BY rank) AS body FROM top JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id),
    k AS (SELECT query_id, {_KEYWORDS} AS kws, lower(query) AS query, body FROM q JOIN t5 USING (query_id)),
    g AS (SELECT query_id, CASE WHEN len(kws) = 0 THEN contains(body, query)::INT::DOUBLE ELSE len(list_filter(kws, lambda w: contains(body, w))) / len(kws) END AS ratio, contains(body, query) AS whole FROM k)"""


def _grades(spark: SparkSession, d: str) -> DataFrame:
    top = sent(arms(spark, d).where("arm = 'score' and rank <= 5")).join(documents(spark, d).select("doc_id", "text"), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.lower("text").alias("t"))))
    body = top.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("body"))
    asked = questions(spark, d).join(body, "query_id").withColumn("query", F.lower("query"))
    words = F.filter(F.transform(F.split("query", r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:"'()]+|[.,;:"'()]+$""", "")), lambda w: F.length(w) > 3)
    asked = asked.withColumn("kws", words).withColumn("whole", F.col("body").contains(F.col("query")))
    ratio = F.size(F.filter("kws", lambda w: F.col("body").contains(w))) / F.size("kws")
    return asked.withColumn("ratio", F.when(F.size("kws") == 0, F.col("whole").cast("int").cast("double")).otherwise(ratio))


@query(f"WITH {_GRADES} SELECT query_id, CASE WHEN whole OR ratio >= 0.8 THEN 'Yes' WHEN ratio >= 0.4 THEN 'Partial' ELSE 'No' END AS grade, round(ratio, 6) AS ratio FROM g")
def e20_keyword_grade(spark: SparkSession, d: str) -> DataFrame:
    grade = F.when(F.col("whole") | (F.col("ratio") >= 0.8), "Yes").when(F.col("ratio") >= 0.4, "Partial").otherwise("No")
    return _grades(spark, d).select("query_id", grade.alias("grade"), F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_ARMS} SELECT t.query_id, t.doc_id, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(query, '\\s+', ' ', 'g')))) AS contained
    FROM top t JOIN documents USING (doc_id) JOIN q ON t.query_id = q.query_id""")
def e19_containment(spark: SparkSession, d: str) -> DataFrame:
    from quarry.functions.text import collapsed

    top = sent(arms(spark, d).where("arm = 'score'")).join(documents(spark, d).select("doc_id", "text"), "doc_id").join(sent(questions(spark, d)), "query_id")
    return top.select("query_id", "doc_id", F.lower(collapsed(F.col("text"))).contains(F.lower(collapsed(F.col("query")))).alias("contained"))


@query(f"""WITH {_ARMS}, m AS (SELECT t.query_id, t.rank, {TOKENS.format("query")} AS a, lower(text) AS body FROM top t JOIN documents USING (doc_id) JOIN q ON t.query_id = q.query_id WHERE rank <= 5),
    h AS (SELECT query_id, min(rank) AS r FROM m WHERE len(list_filter(a, lambda w: length(w) > 3)) > 0 AND len(list_filter(a, lambda w: length(w) > 3 AND contains(body, w))) / len(list_filter(a, lambda w: length(w) > 3)) >= 0.5 GROUP BY query_id)
    SELECT count(*) AS n, count(*) FILTER (r = 1) AS hit1, count(r) AS hit5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM q LEFT JOIN h USING (query_id)""")
def e36_token_hits(spark: SparkSession, d: str) -> DataFrame:
    top = sent(arms(spark, d).where("arm = 'score' and rank <= 5")).join(documents(spark, d).select("doc_id", F.lower("text").alias("body")), "doc_id")
    asked = questions(spark, d).withColumn("long", F.filter(tokens(F.col("query")), lambda w: F.length(w) > 3))
    found = F.size(F.filter("long", lambda w: F.col("body").contains(w))) / F.size("long")
    first = top.join(sent(asked), "query_id").where((F.size("long") > 0) & (found >= 0.5)).groupBy("query_id").agg(F.min("rank").alias("r"))
    every = asked.select("query_id").join(first, "query_id", "left")
    return every.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") == 1).alias("hit1"), F.count("r").alias("hit5"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


# ---- labels, grades and reports. labels stand for two graders, and grades come from both flags.

_GRADE = "CASE WHEN quality = 1 AND toxic = 0 THEN 'exact' WHEN quality = 1 THEN 'partial' ELSE 'miss' END"


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(documents(spark, d).select("doc_id", "source", "lang"), "doc_id").withColumn("grade", F.expr(_GRADE))


@query("""WITH c AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS p FROM c),
    e AS (SELECT sum(x * y) AS e FROM (SELECT a, count(*) AS x FROM c GROUP BY a) r JOIN (SELECT b, count(*) AS y FROM c GROUP BY b) s ON r.a = s.b)
    SELECT n AS graded_twice, round(p, 4) AS agreement, round((p - e / (n * n)) / (1 - e / (n * n)), 4) AS cohen_kappa FROM n, e""")
def e13_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kappa(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT doc_id FROM labels ORDER BY sha256(doc_id::VARCHAR) LIMIT 50")
def e14_sample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fixed_sample(table(spark, d, "labels").select("doc_id"), "doc_id", 50)


def _wilson_sql(k: str, sign: str) -> str:
    return f"round(({k} / n + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt({k} / n * (1 - {k} / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4)"


_INTERVALS = ", ".join(f"{_wilson_sql(g, '-')} AS {g}_low, {_wilson_sql(g, '+')} AS {g}_high" for g in reports.GRADES)


@query(f"""WITH g AS (SELECT source, {_GRADE} AS grade FROM labels JOIN documents USING (doc_id)), c AS (
    SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE coalesce(source, '') END AS collection, count(*) AS n, count(*) FILTER (grade = 'exact') AS exact, count(*) FILTER (grade = 'partial') AS partial, count(*) FILTER (grade = 'miss') AS miss FROM g GROUP BY ROLLUP (source))
    SELECT *, {_INTERVALS} FROM c""")
def e28_grades(spark: SparkSession, d: str) -> DataFrame:
    return reports.grade_counts(_graded(spark, d), "source")


@query(f"""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER ({_GRADE} = 'exact') AS k FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS low,
        round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS high FROM g""")
def e26_wilson(spark: SparkSession, d: str) -> DataFrame:
    counts = _graded(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") == "exact").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return counts.select("source", low.alias("low"), high.alias("high"))


@query("""SELECT quality AS before, toxic AS after, count(*) AS n, CASE WHEN toxic > quality THEN 'better' WHEN toxic < quality THEN 'worse' ELSE 'same' END AS change
    FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL""")
def e27_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Both flags stand for the grades of two runs."""
    labels = table(spark, d, "labels")
    grades = lambda c: labels.where(F.col(c).isNotNull()).select("doc_id", F.col(c).alias("grade"))
    return reports.grade_changes(grades("quality"), grades("toxic"), "doc_id", [1, 0])


@query("""WITH u AS (SELECT doc_id, unnest(['A', 'B']) AS side, unnest([quality, toxic]) AS grade FROM labels), k AS (SELECT doc_id, side, lang || '/' || side AS arm FROM documents, (VALUES ('A'), ('B')) v(side) WHERE doc_id % 3 <> 0)
    SELECT arm, grade, count(*) AS n FROM u JOIN k USING (doc_id, side) WHERE grade IS NOT NULL GROUP BY ALL""")
def e29_unblind(spark: SparkSession, d: str) -> DataFrame:
    """A key names the arm behind each side; items without a key aren't counted."""
    key = documents(spark, d).where("doc_id % 3 <> 0").select("doc_id", "lang", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"))
    key = key.select("doc_id", "side", F.concat("lang", F.lit("/"), "side").alias("arm"))
    return reports.unblinded(table(spark, d, "labels").select("doc_id", F.col("quality").alias("A"), F.col("toxic").alias("B")), key, "doc_id")


@query("""WITH r AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang AS category, count(*) AS questions, 100.0 * avg(quality) AS p FROM r GROUP BY lang)
    SELECT category, questions, round(p, 1) AS correct_percent FROM (SELECT * FROM c UNION ALL SELECT 'all', count(*), 100.0 * avg(quality) FROM r UNION ALL SELECT 'average', sum(questions), avg(p) FROM c)""")
def e31_category_average(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_summary(_graded(spark, d).withColumn("correct", F.col("quality")), "lang")


@query(f"SELECT lang, round(avg(({_GRADE} = 'exact')::INT), 6) AS share, avg(({_GRADE} = 'exact')::INT) >= 0.8 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def e22_release_gate(spark: SparkSession, d: str) -> DataFrame:
    return reports.release_gate(_graded(spark, d), "lang")


@query(f"SELECT count(*) AS answered, count(*) FILTER ({_GRADE} = 'exact') AS correct, count(*) FILTER ({_GRADE} = 'partial') AS partial, count(*) FILTER ({_GRADE} = 'miss') AS wrong, round(avg(({_GRADE} = 'exact')::INT), 4) AS accuracy FROM labels JOIN documents USING (doc_id)")
def e15_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.accuracy(_graded(spark, d))


_VERDICTS = """v AS (SELECT conv_id, conv_id % 7 = 0 AS refused, ['full', 'partial', 'none'][conv_id % 3 + 1] AS relevance, CASE WHEN conv_id % 13 = 5 THEN [] ELSE list(role = 'assistant' ORDER BY turn) END AS passages, list(length(text) >= 60 ORDER BY turn) AS claims,
        list(role = 'user' ORDER BY turn) AS fin, list(turn % 2 = 0 ORDER BY turn) AS fout, list(turn ORDER BY turn) AS cited, CASE WHEN conv_id % 5 = 0 THEN [] ELSE [0, 2, 3] END AS gold FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id),
    s AS (SELECT conv_id AS question_id, CASE WHEN NOT refused THEN list_avg(claims::INT[]) END AS faithfulness, CASE relevance WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS answer_relevance, list_avg(passages::INT[]) AS context_relevance,
        coalesce(list_sum(list_transform(generate_series(1, len(passages)), lambda i: CASE WHEN passages[i] THEN list_sum(passages[1:i]::INT[]) / i ELSE 0 END)) / nullif(list_sum(passages::INT[]), 0), 0) AS context_precision,
        list_avg(fin::INT[]) AS context_recall, list_avg(fout::INT[]) AS completeness, CASE WHEN len(gold) > 0 THEN list_avg(list_transform(cited, lambda c: list_contains(gold, c)::INT)) END AS citation_precision FROM v)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations stand for judged answers: turns are passages, claims, facts and citations. Some questions found no passage."""
    turns = table(spark, d, "conversations").where("turn is not null")
    turn = F.struct("turn", (F.col("role") == "assistant").alias("passage"), (F.length("text") >= 60).alias("claim"), (F.col("role") == "user").alias("in_passages"), (F.col("turn") % 2 == 0).alias("in_answer"))
    rows = turns.groupBy(F.col("conv_id").alias("question_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    gold_ids = F.when(F.col("question_id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(*[F.lit(x).cast("long") for x in (0, 2, 3)]))
    words = F.when(F.col("question_id") % 3 == 0, "full").when(F.col("question_id") % 3 == 1, "partial").otherwise("none")
    return rows.select("question_id", (F.col("question_id") % 7 == 0).alias("refused"), F.col("t.claim").alias("claims"), words.alias("relevance"), F.when(F.col("question_id") % 13 == 5, F.array().cast("array<boolean>")).otherwise(F.col("t.passage")).alias("passages"), F.transform("t", lambda x: F.struct(x["in_passages"], x["in_answer"])).alias("facts"), F.col("t.turn").alias("cited"), gold_ids.alias("gold"))


@query(f"WITH {_VERDICTS} SELECT question_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in reports.METRICS) + " FROM s")
def e12_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.quality_scores(_verdicts(spark, d)), *reports.METRICS)


@query(f"WITH {_VERDICTS} SELECT " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in reports.METRICS) + " FROM s")
def e12_quality_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means that leave nulls out; none at all is null."""
    return reports.mean_scores(reports.quality_scores(_verdicts(spark, d)))


@query("""WITH t AS (SELECT conv_id, turn, role = 'assistant' AS useful FROM conversations), r AS (SELECT conv_id, useful, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM t),
    c AS (SELECT *, sum(useful::INT) OVER (PARTITION BY conv_id ORDER BY rank) AS hits FROM r)
    SELECT conv_id, round(coalesce(sum(CASE WHEN useful THEN hits / rank END) / nullif(sum(useful::INT), 0), 0.0), 6) AS average_precision, round(avg(useful::INT), 6) AS share FROM c GROUP BY conv_id""")
def e11_average_precision(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("useful", (F.col("role") == "assistant").cast("int")).withColumn("rank", F.row_number().over(w))
    rows = rows.withColumn("hits", F.sum("useful").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("useful")
    precision = F.when(total > 0, F.sum(F.when(F.col("useful") == 1, F.col("hits") / F.col("rank"))) / total).otherwise(0.0)
    return rows.groupBy("conv_id").agg(F.round(precision, 6).alias("average_precision"), F.round(F.avg("useful"), 6).alias("share"))


@query(f"""WITH {_VERDICTS}, i AS (SELECT CASE WHEN conv_id % 11 = 0 THEN 'missing_evidence' ELSE 'success' END AS status, refused AS abstained, list_avg(claims::INT[]) AS faithfulness, CASE relevance WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS relevance, claims FROM v)
    SELECT count(*) FILTER (status = 'success') AS checked_questions, count(*) FILTER (status = 'success' AND NOT abstained) AS answered, count(*) FILTER (status = 'success' AND abstained) AS abstained,
        round(avg(faithfulness) FILTER (status = 'success' AND NOT abstained), 4) AS faithfulness, round(avg(relevance) FILTER (status = 'success' AND NOT abstained), 4) AS relevance,
        coalesce(sum(len(list_filter(claims, lambda c: NOT c))) FILTER (status = 'success' AND NOT abstained), 0)::BIGINT AS unsupported_claims, count(*) FILTER (status = 'missing_evidence') AS missing_evidence FROM i""")
def e16_answer_summary(spark: SparkSession, d: str) -> DataFrame:
    verdicts = _verdicts(spark, d)
    scores = reports.quality_scores(verdicts.withColumn("refused", F.lit(False))).select("question_id", "faithfulness", F.col("answer_relevance").alias("relevance"))
    status = F.when(F.col("question_id") % 11 == 0, "missing_evidence").otherwise("success")
    return reports.answer_summary(verdicts.select("question_id", status.alias("status"), F.col("refused").alias("abstained"), "claims").join(scores, "question_id"))


@query("""WITH a AS (SELECT doc_id AS question_id, coalesce(text, '') AS answer, CASE WHEN doc_id % 6 = 5 THEN '' ELSE source END AS evidence FROM documents),
    f AS (SELECT min(question_id) AS f FROM a WHERE evidence <> '' AND question_id % 1000 = 199),
    s AS (SELECT *, CASE WHEN f IS NOT NULL AND question_id > f THEN 'not_checked' WHEN evidence = '' THEN 'missing_evidence' WHEN question_id % 1000 = 199 THEN 'error' ELSE 'success' END AS status FROM a, f)
    SELECT question_id, status, CASE WHEN status = 'success' THEN CASE WHEN contains(answer, ' a ') THEN 'full' ELSE 'none' END END AS relevance, CASE WHEN status = 'error' THEN 'judge failed' END AS error FROM s""")
def e17_check_answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for answers; a stub judges them and fails on one."""

    def judge(answers: pd.Series, evidence: pd.Series) -> pd.DataFrame:
        told = answers.str.extract(r"^(\d*)\n", expand=False).replace("", "0").astype("int64")
        return pd.DataFrame({"claims": [[True]] * len(answers), "relevance": answers.map(lambda t: "full" if " a " in t else "none"), "error": [None if i % 1000 != 199 else "judge failed" for i in told]})

    n = F.col("doc_id")
    rows = documents(spark, d).select(n.alias("question_id"), F.concat(n.cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("answer"), F.when(n % 6 == 5, "").otherwise(F.col("source")).alias("evidence"))
    return reports.check_answers(rows, judge).select("question_id", "status", "relevance", "error")


# ---- ledgers. events stand for one: a purchase is a completed call, an error a failed one.

_LEDGER = "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'started' END"


@query(f"""WITH e AS (SELECT user_id, (props::JSON->>'k') AS k, {_LEDGER} AS event FROM events) SELECT DISTINCT user_id, k FROM e WHERE (user_id, k) NOT IN (SELECT (user_id, k) FROM e WHERE event = 'complete')""")
def e23_resume(spark: SparkSession, d: str) -> DataFrame:
    """A user's k stands for a planned call: most users have some without a complete event."""
    ledger = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.expr(_LEDGER).alias("event"))
    return metrics.resume(ledger.select("user_id", "k").distinct(), ledger, ["user_id", "k"])


@query("""WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), t AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN value END) AS cost, bool_or(event_type = 'error') AS failed FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
    SELECT count(*) AS calls_started, round(coalesce(sum(cost), 0), 4) AS known_cost, round(sum(CASE WHEN cost IS NOT NULL THEN 0 WHEN failed THEN 0.01 ELSE 0.5 END), 4) AS reserved FROM s LEFT JOIN t USING (user_id)""")
def e24_spend(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    ended = events.where("event_type in ('purchase', 'error')").select("user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("cost"))
    return reports.spend(events.where("event_type = 'click'"), ended, "user_id")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS extra""")
def e25_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the manifest that the index lacks, and the reverse."""
    manifest, index = documents(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda a, b, name: a.exceptAll(b).agg(F.count(F.lit(1)).alias(name))
    return count(manifest, index, "missing").crossJoin(count(index, manifest, "extra"))


@query("SELECT event_type AS level, count(*) FILTER (value >= 50) AS answered, count(*) FILTER (value < 50 AND value >= 10) AS busy, count(*) FILTER (value < 10) AS other FROM events GROUP BY event_type")
def e33_outcomes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return reports.outcomes(table(spark, d, "events").withColumn("outcome", F.when(v >= 50, "answered").when(v >= 10, "busy").otherwise("other")), "event_type")


@query(r"""SELECT item_id, trim(replace(regexp_replace(regexp_replace(text || ' [dsid_0a1b, dsid_22] and dsid_ff .', '\[(?:\s*dsid_[0-9a-f]+\s*[,;]?\s*)+\]|dsid_[0-9a-f]+', '', 'g'), ' {2,}', ' ', 'g'), ' .', '.')) AS stripped FROM benchmark""")
def e32_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", strip_citations(F.concat("text", F.lit(" [dsid_0a1b, dsid_22] and dsid_ff ."))).alias("stripped"))


@query(r"""WITH n AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS question FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY lower(question) ORDER BY item_id) AS k FROM n WHERE item_id % 10 <> 3)
    SELECT item_id, question FROM r WHERE k = 1 AND question <> ''""")
def e34_question_edit(spark: SparkSession, d: str) -> DataFrame:
    """Normalised questions without repeats, removed ids left out."""
    from quarry.functions.text import collapsed

    rows = table(spark, d, "benchmark").select("item_id", collapsed(F.col("text")).alias("question")).where("question != ''")
    removed = rows.where("item_id % 10 = 3").select("item_id")
    rows = rows.join(removed, "item_id", "left_anti")
    first = rows.groupBy(F.lower("question").alias("k")).agg(F.min_by("question", "item_id").alias("question"), F.min("item_id").alias("item_id"))
    return first.select("item_id", "question")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= 3""")
def e35_smoke(spark: SparkSession, d: str) -> DataFrame:
    """The first three of each set that no run has finished."""
    left = documents(spark, d).select("lang", "doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("k <= 3").drop("k")


@query(f"""WITH {_ARMS} SELECT t.query_id, count(*) AS passage_count, count(DISTINCT source) AS source_count FROM top t JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY t.query_id""")
def e18_batch(spark: SparkSession, d: str) -> DataFrame:
    """All questions of a batch in one job: passages and distinct sources of each."""
    top = sent(arms(spark, d).where("arm = 'score' and rank <= 5")).join(documents(spark, d).select("doc_id", "source"), "doc_id")
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("passage_count"), F.count_distinct("source").alias("source_count"))


@query("""WITH p AS (SELECT event_id, ts, user_id % 9 + 1 AS cost, NOT (event_type = 'error' AND event_id % 1000 = 999) AS fine FROM events WHERE event_type <> 'purchase'),
    r AS (SELECT *, sum(cost) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM p), s AS (SELECT min((ts, event_id)) AS stop FROM r WHERE total > 20000 OR NOT fine)
    SELECT event_id, CASE WHEN stop IS NULL OR (ts, event_id) < stop THEN 'made' WHEN (ts, event_id) > stop THEN 'not_reached' WHEN total > 20000 THEN 'over_cap' ELSE 'failed' END AS status FROM r, s""")
def e35_capped(spark: SparkSession, d: str) -> DataFrame:
    """Events that no purchase has finished, called in order of time within a cap."""
    events = table(spark, d, "events").where("event_type <> 'purchase'")
    planned = events.select("event_id", "ts", (F.col("user_id") % 9 + 1).alias("cost"), (~((F.col("event_type") == "error") & (F.col("event_id") % 1000 == 999))).alias("fine"))
    return reports.capped_run(planned, ["ts", "event_id"], "cost", 20_000, "fine").select("event_id", "status")
