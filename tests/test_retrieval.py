import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, fusion, index, lexical, metrics, stores, windows


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_by_hand(spark):
    found = lexical.bm25(docs(spark, [("first", "Cedar cedar کتاب"), ("second", "کتاب")]), asked(spark, "CEDAR"), 2).collect()
    score = math.log(2) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2) + 1e-9)
    assert [r["doc_id"] for r in found] == ["first"]
    assert math.isclose(found[0]["score"], score) and math.isclose(found[0]["distance"], math.exp(-0.1 * score))


def test_bm25_edges(spark):
    empty = docs(spark, [])
    assert lexical.bm25(empty, asked(spark, "x"), 3).count() == 0
    assert lexical.bm25(docs(spark, [("a", ""), ("b", None)]), asked(spark, "x"), 3).count() == 0
    assert lexical.bm25(docs(spark, [("a", "x")]), asked(spark, "!!!"), 3).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25(empty, asked(spark, "x"), 0)


def test_bm25_against_exhaustive_scoring(spark):
    r = random.Random(1)
    rows = [(f"d{i:03}", " ".join(r.choice("common rare blue red green".split()) for _ in range(r.randint(0, 9)))) for i in range(60)]
    queries = ["common", "rare blue blue", "green red"]
    n, avg = len(rows), sum(len(t.split()) for _, t in rows) / len(rows)
    expected = set()
    for q, text in enumerate(queries):
        scored = []
        for d, t in rows:
            words, s = t.split(), 0.0
            for term in text.split():
                df = sum(term in x.split() for _, x in rows)
                tf = words.count(term)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg) + 1e-9)
            if s > 1e-9:
                scored.append((-round(s, 6), d))
        expected |= {(q, d, k) for k, (_, d) in enumerate(sorted(scored)[:7], 1)}
    got = {(x["query_id"], x["doc_id"], x["rank"]) for x in lexical.bm25(docs(spark, rows), asked(spark, *queries), 7).collect()}
    assert got == expected


def test_quoted_queries(spark):
    rows = docs(spark, [("1", "The rollback rule is in the rollout plan."), ("2", "The rule of the rollback is elsewhere."), ("3", "Lunch menus.")])
    found = lexical.quoted_search(rows, asked(spark, '"rollback rule"', '"zebra xylophone"', '"what is the rollback rule today"', 'a "b" c "', '"'), 5).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert by[0] == {"1"} and 1 not in by and "1" in by[2]


def ranks(spark, *ids):
    return spark.createDataFrame([(0, d, n) for n, d in enumerate(ids, 1)], "query_id long, doc_id string, rank int")


def order(df, by="fused_rank"):
    return [r["doc_id"] for r in df.orderBy(by).collect()]


def test_fusion(spark):
    both = fusion.rrf(ranks(spark, "first", "second"), ranks(spark, "first"))
    assert [round(r["rrf"], 9) for r in both.orderBy("fused_rank").collect()] == [round(2 / 61, 9), round(1 / 62, 9)]
    repeated = fusion.rrf(ranks(spark, "duplicate", "middle", "duplicate"), ranks(spark))
    assert order(repeated) == ["middle", "duplicate"]
    v, x = ranks(spark, "vector"), ranks(spark, "lexical")
    for weights, expected in (((0, 1), ["lexical"]), ((1, 0), ["vector"]), ((0, 0), []), ((-1, 1), ["lexical"]), ((1, 2), ["lexical", "vector"]), ((1, 1), ["vector", "lexical"])):
        assert order(fusion.rrf(v, x, weights)) == expected


def test_balanced_shortlist(spark):
    fused = ranks(spark, *"abcdef").withColumnRenamed("rank", "fused_rank")
    assert order(fusion.balanced(fused, [ranks(spark, *"abcd"), ranks(spark, *"ef")], 4)) == list("abef")


def test_facet_merge_goes_backwards_after_the_first_round(spark):
    groups = [["shared", "a2"], ["b1", "b2"], ["c1", "shared", "c3"]]
    rows = [(0, f, n, d) for f, g in enumerate(groups) for n, d in enumerate(g, 1)]
    merged = fusion.merge_facets(spark.createDataFrame(rows, "query_id long, facet_no int, rank int, doc_id string"), 5)
    assert order(merged, "rank") == ["shared", "b1", "c1", "c3", "b2"]


def test_reranker_checks_scores(spark):
    rows = spark.createDataFrame([(0, "a", 1, "q", "x"), (0, "b", 2, "q", "xx")], "query_id long, doc_id string, shortlist_rank int, query string, content string")
    assert order(fusion.rerank(rows, lambda q, t: t.str.len().astype(float), 2), "final_rank") == ["b", "a"]
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(rows, F.lit(None).cast("double"), 2).collect()


def test_windows(spark):
    text = "Before.\nMiddle.\nAfter."
    passages = spark.createDataFrame([("s", 0, 0, 7, "Before."), ("s", 1, 8, 15, "Middle."), ("s", 2, 16, 22, "After.")], "doc_id string, n int, start_offset long, end_offset long, content string")
    hits = spark.createDataFrame([(0, "s", 1, 1), (0, "s", 2, 2)], "query_id long, doc_id string, n int, rank int")
    sources = spark.createDataFrame([("s", text)], "doc_id string, text string")
    wide = windows.expand(hits, passages, sources, 1).orderBy("rank").first()
    assert (wide["start_offset"], wide["end_offset"]) == (0, 22)
    whole = windows.expand(hits, passages, sources, 0, 100).collect()
    assert len(whole) == 1 and whole[0]["rank"] == 1 and whole[0]["whole_document"]
    stale = spark.createDataFrame([("s", "changed text of the same length")], "doc_id string, text string")
    kept = windows.expand(hits, passages, stale, 1).orderBy("rank").first()
    assert (kept["start_offset"], kept["end_offset"]) == (8, 15)
    with pytest.raises(ValueError):
        windows.expand(hits, passages, sources, 4)


def test_document_metrics(spark):
    ranked = ranks(spark, "noise", "a", "a", "noise2", "noise3", "noise4", "b").withColumn("arm", F.lit("x"))
    gold = spark.createDataFrame([(0, "a"), (0, "b")], "query_id long, doc_id string")
    r = metrics.retrieval_metrics(ranked, gold).first()
    assert (r["recall5"], r["recall10"], r["mrr"]) == (0.5, 1.0, 0.5)
    assert math.isclose(r["ndcg10"], (1 / math.log2(3) + 1 / math.log2(7)) / (1 + 1 / math.log2(3)))
    ranked = ranks(spark, *"axbyzc").withColumn("arm", F.lit("x"))
    gold = spark.createDataFrame([(0, x) for x in "abc"], "query_id long, doc_id string")
    r = metrics.retrieval_metrics(ranked, gold).first()
    assert r["precision5"] == 0.4 and math.isclose(r["average_precision"], (1 + 2 / 3 + 3 / 6) / 3)


def test_kappa(spark):
    rows = spark.createDataFrame([("y", "y"), ("y", "n"), ("n", "n"), (None, "n")], "a string, b string")
    r = metrics.kappa(rows, "a", "b").first()
    assert (r["graded_twice"], r["agreement"], r["cohen_kappa"]) == (3, 0.6667, 0.4)


def test_generations(spark, tmp_path):
    store = index.Generations(spark, str(tmp_path / "g"))
    with pytest.raises(index.RebuildRequired):
        store.open()
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    first = store.publish(rows, {"v": 1})
    with pytest.raises(index.RebuildRequired):
        store.open({"v": 2})
    with pytest.raises(index.RebuildRequired):
        store.publish(rows, {"v": 2}, expected="another")
    with pytest.raises(ValueError):
        store.publish(rows.limit(0), {"v": 2})
    assert store.open({"v": 1}).count() == 1 and store.manifest()["generation"] == first["generation"]
    assert store.open_or_build({"v": 3}, lambda: rows.union(rows)).count() == 2


def test_files(spark, tmp_path):
    from quarry.sources import readers, scope

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.html").write_text("<p>two</p>")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "c.txt").write_text("x")
    (tmp_path / "test_d.py").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_files(spark, str(tmp_path / "*.*")).collect()}
    assert got["a.txt"] == "one" and got["b.html"] == "two"
    listing = scope.listing(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[1] for r in scope.discover(listing, str(tmp_path)).collect()}
    assert found == {"a.txt", "b.html", "test_d.py"}
    assert scope.validate_scope(scope.discover(listing, str(tmp_path))).count() == 2
    assert scope.validate_scope(scope.discover(listing, str(tmp_path), include=["test_*"])).count() == 1
    with pytest.raises(ValueError):
        scope.allowed_extensions(["exe"])


def test_vectors_and_stores(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(dense.valid(F.col("v"), 2)).collect()] == [True, False, False, False]
    with pytest.raises(stores.Conflict):
        stores.compare_and_set("a", "b")
    stores.check_workspace(spark.createDataFrame([("a", "x")], "name string, content string"))
    with pytest.raises(ValueError):
        stores.check_workspace(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, content string"))


def test_a_refreshed_retriever_equals_a_new_one(spark, tmp_path):
    from quarry.api import Retriever, Settings
    from quarry.operators.answers import hashed_embedding
    from quarry.operators.index import RebuildRequired

    rows = [(i, f"Paper {i} is about topic{i}. " * 60, f"/p/{i}.txt") for i in range(5)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, path string")
    first = Retriever(make(rows), embed=hashed_embedding)
    questions = spark.createDataFrame([(1, "what is topic3"), (2, "what is topic9")], "query_id long, query string")
    first.search(questions).count()  # vectors are made
    changed = [*rows[:2], (3, "Paper 3 is about topic9 now. " * 50, "/p/3.txt"), (4, rows[4][1], "/p/other.txt"), (7, "topic9 again. " * 70, "/p/7.txt"), (8, None, "/p/8.txt")]
    second, fresh = first.refreshed(make(changed)), Retriever(make(changed), embed=hashed_embedding)
    columns = ["doc_id", "id", "searchable", "start_offset", "end_offset"]
    flat = lambda t, cols: sorted(map(str, t.select(*cols).collect()))
    assert flat(second.passages, columns) == flat(fresh.passages, columns)
    assert flat(second._vectors, ["id", "embedding"]) == flat(fresh.vectors, ["id", "embedding"])
    assert flat(second.search(questions), ["query_id", "doc_id", "n", "rank"]) == flat(fresh.search(questions), ["query_id", "doc_id", "n", "rank"])
    assert first.passages.where("doc_id = 2").count()  # the one before keeps its tables
    second.save(str(tmp_path / "saved"))
    opened = Retriever.open(spark, str(tmp_path / "saved"), embed=hashed_embedding)
    assert flat(opened.search(questions), ["query_id", "doc_id", "n", "rank"]) == flat(fresh.search(questions), ["query_id", "doc_id", "n", "rank"])
    assert flat(opened.refreshed(make(rows)).passages, columns) == flat(first.passages, columns)
    for folder, settings in (("saved", Settings(chunk_size=300)), ("none", None)):
        with pytest.raises(RebuildRequired):
            Retriever.open(spark, str(tmp_path / folder), settings, hashed_embedding)
