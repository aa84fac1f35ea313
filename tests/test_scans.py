"""Running totals, percentiles, overlaps and retention against brute force, in several tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import intervals, judgments, reports, scans, stores


def test_running_total_of_one_group_in_several_tasks(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = scans.running_total(rows, ["g"], [F.desc("id")], "v", "total")
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    total, expected = 0, {}
    for i in reversed(range(5000)):
        total += i % 7
        expected[i] = total
    assert {r["id"]: r["total"] for r in got.collect()} == expected


def test_running_total_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, None), ("a", 1, 3), ("a", 1, 3), ("a", None, 1)], "g string, t int, v int")
    got = sorted(((r["g"], r["t"], r["total"]) for r in scans.running_total(rows, ["g"], [F.col("t").asc_nulls_first()], "v", "total").collect()), key=str)
    assert got == sorted([(None, 1, 5), (None, 2, 5), ("a", None, 1), ("a", 1, 4), ("a", 1, 7)], key=str)
    assert scans.running_total(rows.limit(0), [], [F.col("t")], "v", "total").count() == 0


def nearest(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values))) - 1]


@pytest.mark.parametrize("few", [0, 100_000])
def test_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(scans, "FEW", few)
    r = random.Random(few)
    groups = {"a": [r.gauss(0, 1) for _ in range(3000)], "b": [2.0**-k for k in range(25)] + [1e300, -1e300], "c": [5.0] * 50, None: [1.0, 2.0], "d": [0.0, -0.0, float("inf"), float("-inf"), 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    if few == 0:
        df = df.where("g is null or g <> 'd'")  # an infinite range has no buckets
        groups.pop("d")
    got = {x["g"]: (x["low"], x["mid"], x["high"]) for x in scans.percentiles(df, ["g"], "v", {"low": 0.01, "mid": 0.5, "high": 0.95}).collect()}
    assert got == {g: tuple(nearest(vs, p) for p in (0.01, 0.5, 0.95)) for g, vs in groups.items()}
    one = scans.percentiles(df.where("g = 'a'"), [], "v", {"p": 0.3}).first()["p"]
    assert one == nearest(groups["a"], 0.3)


def test_percentiles_of_infinite_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "FEW", 0)
    values = [float("-inf"), -1.0, 2.0, 3.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [scans.percentiles(df, [], "v", {"p": p}).first()["p"] for p in (0.1, 0.5, 0.7, 1.0)] == [nearest(values, p) for p in (0.1, 0.5, 0.7, 1.0)]


def test_retention_removes_one_after_another(spark):
    r = random.Random(9)
    items = [(i, r.randint(0, 30), r.randint(1, 9), r.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(items, "id long, modified long, size long, store string")
    for by, budget, age, incoming in ((None, 300, 1000, 0), (["store"], 200, 12, 50), (None, 10**6, 5, 0)):
        kept = set()
        for store in "xy" if by else [None]:
            mine = sorted((t, i, s) for i, t, s, g in items if store in (None, g))
            total = sum(s for *_, s in mine)
            for t, i, s in mine:
                if t < 30 - age or total + incoming > budget:
                    total -= s
                else:
                    kept.add(i)
        got = stores.retained(df, F.lit(30), age, budget, by=by, incoming=incoming)
        assert {x["id"] for x in got.collect()} == kept and got.columns == df.columns


def test_capped_run(spark):
    rows = [(n, 2, n != 6) for n in range(10)]
    run = lambda cap, rows=rows: [r["status"] for r in reports.capped_run(spark.createDataFrame(rows, "n int, cost long, fine boolean"), ["n"], "cost", cap, "fine").orderBy("n").collect()]
    assert run(9) == ["made"] * 4 + ["over_cap"] + ["not_reached"] * 5
    assert run(100) == ["made"] * 6 + ["failed"] + ["not_reached"] * 3
    assert run(12) == ["made"] * 6 + ["over_cap"] + ["not_reached"] * 3
    assert run(100, rows[:6]) == ["made"] * 6


def spans(r, n, length):
    return [(r.choice("pq"), k, a, a + r.choice(length)) for k, a in enumerate(r.randint(-50, 900) for _ in range(n))]


@pytest.mark.parametrize("width", [None, 1, 64])
def test_overlap_join(spark, width):
    r = random.Random(1)
    left, right = spans(r, 120, (0, 1, 7, 40, 300)), spans(r, 120, (1, 9, 30))
    one = spark.createDataFrame(left, "s string, l int, l_start long, l_end long")
    two = spark.createDataFrame(right, "s string, r int, r_start long, r_end long")
    expected = sorted((k, m) for s, k, a, b in left for t, m, c, e in right if s == t and 0 < min(b, e) - max(a, c) and (min(b, e) - max(a, c)) * 2 >= min(b - a, e - c))
    got = intervals.overlap_join(one, two, ["s"], width)
    assert sorted((x["l"], x["r"]) for x in got.collect()) == expected and expected
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_a_source_with_many_spans(spark):
    n = 100_000
    passages = spark.range(n).select(F.lit("q").alias("question_id"), (F.col("id") + 1).cast("int").alias("rank"), F.lit("s").alias("source_id"), (F.col("id") * 10 + 3).alias("start_offset"), (F.col("id") * 10 + 11).alias("end_offset"))
    labels = spark.range(n).select(F.lit("q").alias("question_id"), F.col("id").cast("int").alias("ordinal"), F.lit("s").alias("source_id"), (F.col("id") * 10).alias("start_offset"), (F.col("id") * 10 + 9).alias("end_offset"), F.when(F.col("id") % 2 == 0, "relevant").otherwise("irrelevant").alias("label"))
    row = judgments.score_batch(passages, labels).first()
    assert (row["judged_questions"], row["hit"], row["recall"], row["mrr"], row["precision"], row["unjudged_passages"]) == (1, 1.0, 1.0, 1.0, 0.5, 0)


def test_answer_groups_in_order(spark):
    r = random.Random(2)
    rows = [("q", k, *s[:1], *s[2:]) for k, s in enumerate(spans(r, 150, (0, 5, 20, 60)))]
    groups, expected = [], {}
    for _, k, source, a, b in rows:
        same = lambda x: x[0] == source and 0 < min(b, x[2]) - max(a, x[1]) and (min(b, x[2]) - max(a, x[1])) * 2 >= min(b - a, x[2] - x[1])
        g = next((i for i, group in enumerate(groups) if any(map(same, group))), len(groups))
        groups += [[]] if g == len(groups) else []
        groups[g].append((source, a, b))
        expected[k] = g
    got = judgments.answer_groups(spark.createDataFrame(rows, "question_id string, ordinal int, source_id string, start_offset long, end_offset long"))
    assert {x["ordinal"]: x["group_no"] for x in got.collect()} == expected


def test_a_judge_gives_a_verdict_for_each_passage(spark):
    schema = "question_id long, refused boolean, claims array<boolean>, relevance string, passages array<boolean>, facts array<struct<in_passages: boolean, in_answer: boolean>>, cited array<long>, gold array<long>, n_passages int"
    right = (1, False, [True], "full", [], [], [], [], 0)
    assert reports.quality_scores(spark.createDataFrame([right], schema)).first()["context_precision"] == 0
    with pytest.raises(Exception, match="another number of passages"):
        reports.quality_scores(spark.createDataFrame([(*right[:-1], 2)], schema)).collect()


def test_questions_are_grouped_many_to_a_batch(spark):
    from pyspark.sql import functions as F

    labels = spark.range(40).select((F.col("id") % 20).alias("question_id"), (F.col("id") / 20).cast("int").alias("ordinal"), F.lit("s").alias("source_id"), F.lit(0).cast("long").alias("start_offset"), F.lit(9).cast("long").alias("end_offset"), F.lit("relevant").alias("label"))
    groups = judgments.answer_groups(labels)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" in plan  # no Python call a question
    assert {(r["ordinal"], r["group_no"]) for r in groups.collect()} == {(0, 0), (1, 0)} and groups.count() == 40
    passages = labels.select("question_id", (F.col("ordinal") + 1).alias("rank"), "source_id", (F.col("start_offset") + 9 * F.col("ordinal")).alias("start_offset"), (F.col("end_offset") + 9 * F.col("ordinal")).alias("end_offset"))
    scored = judgments.score_batch(passages, labels)
    assert scored._jdf.queryExecution().toString().count("InArrow") == 0  # groups are worked out once and kept
    row = scored.first()
    assert (row["judged_questions"], row["hit"], row["precision"], row["unjudged_passages"]) == (20, 1.0, 0.5, 20)
