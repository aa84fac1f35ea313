import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, lexical, lifecycle, matches, reports, stores
from quarry.sources import readers


def test_index_gives_what_the_table_gives(spark):
    rows = [(i, t) for i, t in enumerate(["Cedar cedar oak", "", None, "oak | elm", "snake_case camelCase", "a" * 300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "cedar OAK oak"), (1, "camel"), (2, "?")], "query_id long, query string")
    index = lexical.build_index(docs)
    plain = sorted(map(tuple, lexical.bm25(docs, asked, 5).collect()))
    assert plain and plain == sorted(map(tuple, lexical.bm25(index, asked, 5).collect()))
    pair = index, lexical.build_index(lexical.with_symbols(docs))
    assert sorted(map(tuple, lexical.fields_search(docs, asked, 5).collect())) == sorted(map(tuple, lexical.fields_search(pair, asked, 5).collect()))
    assert lexical.bm25(lexical.build_index(docs.limit(0)), asked, 5).count() == 0


@pytest.mark.parametrize("metric", dense.METRICS)
def test_dense_in_turns_and_blocks(spark, metric, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_VECTORS", 3)
    r = np.random.default_rng(0)
    vectors = np.round(r.normal(size=(60, 5)), 1)
    vectors[7] = vectors[3]  # a tie
    vectors[9] = 0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(8)], "query_id long, vector array<float>")
    x = vectors.astype(np.float32).astype(np.float64)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = {"cosine": unit @ unit.T, "dot": x @ x.T, "l2": -((x[:, None] - x[None]) ** 2).sum(axis=2)}[metric]
    expected = {(q, n, i) for q in range(8) for n, i in enumerate(sorted(range(60), key=lambda i: (-round(scores[q, i], 6), i))[:4], 1)}
    assert {(f["query_id"], f["rank"], f["doc_id"]) for f in dense.search(table, asked, 4, metric).collect()} == expected
    assert dense.search(table.limit(0), asked, 4, metric).count() == 0 and dense.search(table, asked.limit(0), 4, metric).count() == 0


def test_holding_is_contains(spark):
    docs = [(1, "the quick brown fox jumps"), (2, "Quick brown fo"), (3, None), (4, ""), (5, "unthe quick brown foxes"), (6, "a  b")]
    asked = ["the quick brown fox", "quick brown fo", "fox", "", None, "ick brown fo", "a  b", "  "]
    got = matches.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    expected = {(q, d) for q, a in enumerate(asked) if a for d, t in docs if t and a in t}
    assert {tuple(r) for r in got.collect()} == expected


def test_relevant_files(spark):
    files = spark.createDataFrame([(f"d/{n}",) for n in ("Report-2020.txt", "notes.txt", "plan.md", "a_report.md", "b_report.md", "c_report.md", "d_report.md", "e_report.md")], "path string")
    asked = spark.createDataFrame([(1, "the REPORT of 2020"), (2, "zebra"), (3, "")], "query_id long, query string")
    got = [(r["query_id"], r["path"], r["score"], r["rank"]) for r in matches.relevant_files(files, asked).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, "d/Report-2020.txt", 2, 1) and [g[1] for g in got[1:]] == [f"d/{c}_report.md" for c in "abcd"] and len(got) == 5


def test_cleaned_drops_what_is_empty(spark):
    rows = spark.createDataFrame([("a.md", "**Bold** <span>x</span>"), ("a.md", "---\n"), ("b.py", "x = '<span>'"), ("c.TXT", "  "), ("d", None)], "path string, content string")
    got = {(r["path"], r["searchable"]) for r in lifecycle.cleaned(rows).collect()}
    assert {p for p, _ in got} == {"a.md", "b.py"} and ("b.py", "x = '<span>'") in got


def test_checked_scores(spark):
    wanted = spark.createDataFrame([(1, 2)], "query_id long, n long")
    schema = "query_id long, place int, score double"
    assert lifecycle.checked_scores(spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2)], schema), wanted).count() == 2
    faults = {"invalid": [(1, 0, float("nan")), (1, 1, 0.2)], "range": [(1, 0, 0.1), (1, 2, 0.2)], "twice": [(1, 0, 0.1), (1, 1, 0.1), (1, 1, 0.2)], "every": [(1, 0, 0.1)]}
    for word, rows in faults.items():
        with pytest.raises(Exception, match=word):
            lifecycle.checked_scores(spark.createDataFrame(rows, schema), wanted).collect()


def test_a_failing_scorer_keeps_the_order(spark):
    rows = spark.createDataFrame([(q, d, n, "q", d) for q in (1, 2) for n, d in enumerate(("a", "bb", "c"), 1)] + [(3, "z", 1, "q", "z")], "query_id long, doc_id string, shortlist_rank int, query string, content string")

    def fails(queries: pd.Series, texts: pd.Series) -> pd.Series:
        raise RuntimeError("no")

    for scorer, first, told in ((fails, "a", False), (lambda q, t: t.str.len().astype(float), "bb", True), (lambda q, t: t.str.len().mask(t == "c").astype(float), "a", False)):
        got = lifecycle.rerank_or_keep(rows, scorer, 2).collect()
        best = {r["query_id"]: r for r in got if r["final_rank"] == 1}
        assert best[1]["doc_id"] == best[2]["doc_id"] == first and best[1]["reranked"] is told and best[3]["reranked"] is False


def test_embedders_of_each_kind(spark):
    class Many:
        def embed_batch(self, items):
            return [[1.0, len(i)] for i in items]

    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    for embedder in (Many(), lambda items: [[1.0, len(i)] for i in items]):
        assert [tuple(r[0]) for r in rows.select(lifecycle.embedded(F.col("t"), embedder)).collect()] == [(1.0, 2.0), (1.0, 0.0)]


def test_evidence(spark):
    cases = [
        ("a/b.PDF", "p.2-3", " one\ftwo ", "Source document: b.PDF\nPrinted page number: unavailable.\n[PDF page 2]\none\n[PDF page 3]\ntwo"),
        ("b.pdf", "p.2-4", "x", "Source document: b.pdf\nPrinted page number: unavailable.\nPDF page range: 2-4. Exact page within range: unavailable.\nx"),
        ("b.txt", "L3", "x", "Source document: b.txt\nSource lines: L3\nx"),
        (None, None, None, "Source location: unavailable\n"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "n string, l string, c string")
    assert [r[0] for r in rows.select(lifecycle.evidence(F.col("n"), F.col("l"), F.col("c"))).collect()] == [c[3] for c in cases]


def test_stamps_and_provenance(spark):
    made = lifecycle.provenance({"a": 1})
    json.dumps(made)
    assert made["packages"]["pyspark"] and made["settings"] != lifecycle.provenance({"a": 2})["settings"]
    rows = spark.createDataFrame([("p", 1)], "path string, size long")
    assert lifecycle.source_stamp({}, rows) != lifecycle.source_stamp({}, rows.withColumn("size", F.lit(2).cast("long")))


def test_labels(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "run_id long, rank int, label string")
    changes = spark.createDataFrame([(1, 1, None, 1), (1, 3, "x", 1), (1, 3, "y", 2)], "run_id long, rank int, label string, n int")
    assert {tuple(r) for r in stores.set_labels(stored, changes).collect()} == {(1, 2, "b"), (1, 3, "y")}


def test_readers_of_tables_and_fallbacks():
    assert readers.csv_text('a,"b, c"\n\n,\n1,"two\nlines"\n') == "a | b, c\n1 | two lines"
    office = {".docx": lambda data: "office"}

    def fails(data):
        raise ValueError("broken")

    assert readers.decoded(".pdf", b"", office | {".pdf": fails}) == "office"
    assert readers.decoded(".pdf", b"", office | {".pdf": lambda data: " "}) == "office"
    assert readers.decoded(".pdf", b"", office | {".pdf": lambda data: "text"}) == "text"
    for own in ({}, {".pdf": fails}):
        with pytest.raises((RuntimeError, ValueError)):
            readers.decoded(".pdf", b"", own)


def test_average_precision(spark):
    rows = spark.createDataFrame([([True, False, True],), ([False],), ([],)], "f array<boolean>")
    got = [r[0] for r in rows.select(reports.average_precision(F.col("f"))).collect()]
    assert got[0] == pytest.approx((1 + 2 / 3) / 2) and got[1] == 0 and got[2] == 0


def test_ignore_rules_fail_closed(spark, tmp_path, monkeypatch):
    import subprocess

    from quarry.sources import scope

    paths = [f"{tmp_path}/{n}" for n in ("kept.txt", "secret.txt")]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, size int")
    outside = scope.without_ignored(files, str(tmp_path))
    assert outside.count() == 2
    (tmp_path / ".git").mkdir()  # a broken repository
    with pytest.raises(RuntimeError):
        scope.without_ignored(files, str(tmp_path))
    (tmp_path / ".git").rmdir()
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("secret*\n")
    assert [r["path"] for r in scope.without_ignored(files, str(tmp_path)).collect()] == paths[:1]
    monkeypatch.setenv("PATH", "")
    with pytest.raises(RuntimeError):
        scope.without_ignored(files, str(tmp_path))


def test_one_of_two_publishers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quarry.operators.index import Generations, RebuildRequired

    first = Generations(spark, str(tmp_path)).publish(spark.range(3), {"v": 1})["generation"]

    def publish(n):
        try:
            return Generations(spark, str(tmp_path)).publish(spark.range(n), {"v": n}, first)["rows"]
        except RebuildRequired:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [n for n in pool.map(publish, (4, 5, 6, 7)) if n]
    assert len(won) == 1 and Generations(spark, str(tmp_path)).open({"v": won[0]}).count() == won[0]
    Generations(spark, str(tmp_path)).clear()
    with pytest.raises(RebuildRequired):
        Generations(spark, str(tmp_path)).open()
