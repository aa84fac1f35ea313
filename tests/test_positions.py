"""Positions of passages, passages found again, and sources read in time that grows with their length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import positions, windows

TEXTS = {1: "one\n😀 two\f\n\nthree 😀😀\nend", 2: "", 3: None, 4: "\n\n", 5: "a\fb\fc"}


def sources(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string")


def test_lines(spark):
    got = [tuple(r) for r in positions.lines(sources(spark, TEXTS)).orderBy("doc_id", "n").collect()]
    expected = []
    for i, t in TEXTS.items():
        at = 0
        for n, line in enumerate((t or "").split("\n")):
            if line:
                expected.append((i, n, at, at + len(line), line))
            at += len(line) + 1
    assert got == expected


def test_places(spark):
    docs = sources(spark, TEXTS)
    wrong = spark.createDataFrame([(1, 90, 0, 3, "two"), (1, 91, 20, 99, "x"), (2, 92, 0, 1, "x"), (9, 93, 0, 1, "x")], "doc_id long, n int, start_offset long, end_offset long, content string")
    got = {(r["doc_id"], r["n"]): r for r in positions.placed(positions.lines(docs).unionByName(wrong), docs).collect()}
    for (i, n), r in got.items():
        text = TEXTS[i] or ""
        a, b = min(r["start_offset"], len(text)), min(r["end_offset"], len(text))
        assert (r["first_line"], r["last_line"]) == (text[:a].count("\n") + 1, text[:b].count("\n") + 1)
        assert (r["first_page"], r["last_page"]) == (text[:a].count("\f") + 1, text[:b].count("\f") + 1)
        assert (r["start_utf16"], r["end_utf16"]) == (len(text[:a].encode("utf-16-le")) // 2, len(text[:b].encode("utf-16-le")) // 2)
        assert r["ok"] == (n < 90 and "\f" not in text[a:b])
    assert (9, 93) not in got and (2, 92) in got


def test_form_feeds_of_a_passage_may_be_spaces(spark):
    docs = sources(spark, {1: "a\fb"})
    rows = spark.createDataFrame([(1, 0, 0, 3, "a b"), (1, 1, 0, 3, "a\fb")], "doc_id long, n int, start_offset long, end_offset long, content string")
    assert {r["n"]: r["ok"] for r in positions.placed(rows, docs).collect()} == {0: True, 1: False}


def test_locations(spark):
    rows = spark.createDataFrame([("x/a.PDF", 1, 1, 2, 2), ("a.pdf", 1, 1, 2, 4), ("b.ipynb", 1, 9, 3, 3), ("c.txt", 4, 4, 1, 1), (None, 4, 6, 1, 1)], "path string, first_line long, last_line long, first_page long, last_page long")
    columns = [F.col(c) for c in rows.columns]
    assert [r[0] for r in rows.select(positions.location(*columns)).collect()] == ["p.2", "p.2-4", "cell 3", "L4", "L4-L6"]


def test_occurrences_against_find():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab😀\n") for _ in range(r.randint(0, 60)))
        patterns = ["".join(r.choice("ab😀\n") for _ in range(r.randint(1, 9))) for _ in range(5)] + [text[a : a + r.randint(1, 40)] for a in (0, 3, 11) if text[a:]]
        found = positions.Occurrences(text, patterns)
        for p in patterns:
            assert found.places[p].tolist() == [i for i in range(len(text)) if text.startswith(p, i)]


def located(text, content, line):
    """The rule by hand: the first place from the line's start on; a second one makes it unknown, unless the line is known and it is on a later one."""
    flat = text.replace("\f", " ")
    lower = sum(len(x) for x in flat.splitlines(keepends=True)[: line - 1]) if line else 0
    a = flat.find(content, lower) if content else -1
    if a < 0:
        return None
    b = flat.find(content, a + 1)
    if b >= 0 and (not line or flat.count("\n", a, b) == 0):
        return None
    return a


def test_repeated_passages_are_told_apart_by_lines(spark):
    r = random.Random(5)
    rows, docs = [], {}
    for i in range(60):
        docs[i] = "\n".join(r.choice(["same line", "another", "x same line y", "😀 wide", "pa\fge", "", "same"]) for _ in range(r.randint(0, 9)))
        for n in range(8):
            rows.append((i, n, r.choice(["same line", "another", "😀 wide", "pa ge", "", "missing", "same"]), None, None, r.choice([None, 1, 2, 5, 40])))
    rows += [(0, 100, "x", 5, 2, None), (99, 0, "no source", None, None, None)]
    got = {(x["doc_id"], x["n"]): x for x in positions.relocated(spark.createDataFrame(rows, "doc_id long, n int, content string, start_offset long, end_offset long, start_line long"), sources(spark, docs)).collect()}
    assert len(got) == len(rows)
    for i, n, content, _, _, line in rows:
        text, x = docs.get(i, ""), got[i, n]
        a = located(text, content, line)
        assert x["start_offset"] == a and x["location_verified"] == (a is not None)
        if a is not None:
            b = a + len(content)
            assert (x["end_offset"], x["start_line"], x["end_line"]) == (b, text[:a].count("\n") + 1, text[: max(a, b - 1)].count("\n") + 1)
            assert x["start_utf16"] == len(text[:a].encode("utf-16-le")) // 2 and x["end_utf16"] == len(text[:b].encode("utf-16-le")) // 2


def test_right_offsets_stay_though_the_passage_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "b", 2, 3, None), (1, 1, "b", 0, 1, None)], "doc_id long, n int, content string, start_offset long, end_offset long, start_line long")
    got = {x["n"]: x["start_offset"] for x in positions.relocated(rows, sources(spark, {1: "b b"})).collect()}
    assert got == {0: 2, 1: 0}


def test_time_grows_with_length(spark):
    def took(lines):
        docs = sources(spark, {1: "\n".join(f"line {i} of a long text" for i in range(lines))}).cache()
        docs.count()
        began = time.time()
        found = positions.placed(positions.lines(docs), docs)
        assert found.where("ok and first_line = n + 1").count() == lines
        rows = found.select("doc_id", "n", "content", F.lit(None).cast("long").alias("start_offset"), F.lit(None).cast("long").alias("end_offset"), F.lit(None).cast("long").alias("start_line"))
        assert positions.relocated(rows, docs).where("location_verified").count() == lines
        return time.time() - began

    took(20_000)
    one, two = took(50_000), took(100_000)
    assert two < 3.2 * one + 2


def test_no_line_carries_its_text(spark):
    docs = sources(spark, TEXTS)
    plan = positions.placed(positions.lines(docs), docs)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Generate explode")[0]
    assert "text#" not in top


def test_source_context(spark):
    docs = sources(spark, {1: "short", 2: "x" * 30})
    rows = spark.createDataFrame([(1, 0, "short"), *[(2, n, t) for n, t in enumerate(["a", "b", " ", "d", "e", "b"])]], "doc_id long, n int, content string")
    got = {(r["doc_id"], r["n"]): r["context"] for r in windows.source_context(rows, docs, whole=10).collect()}
    assert got == {(1, 0): "short", (2, 0): "a\n\nb", (2, 1): "a\n\nb", (2, 2): "a\n\nb", (2, 3): "a\n\nb", (2, 4): "a\n\nb\n\nd", (2, 5): "a\n\nb\n\nd\n\ne"}


def test_lines_carry_columns_and_need_no_join(spark):
    docs = spark.createDataFrame([(1, "a\n\nb😀\nc", "x"), (2, None, "y"), (3, "", "z"), (4, "last\n", None)], "doc_id long, text string, path string")
    found = positions.lines(docs, "path")
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == [(1, 0, 0, 1, "a", "x"), (1, 2, 3, 5, "b😀", "x"), (1, 3, 6, 7, "c", "x"), (4, 0, 0, 4, "last", None)]
    from quarry.plans import registry

    plan = registry.QUERIES["c11_cleaned_prose"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
