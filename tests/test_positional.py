"""Phrases from stored positions, the best k from block bounds, storage that goes with its session, and the Retriever's lexical rules."""

import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quarry import storage
from quarry.api import Retriever, Settings
from quarry.operators import lexical, matches, positional


def table(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def test_phrases_against_brute_force(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("a b c the rule".split()) for _ in range(r.randint(0, 30)))) for i in range(200)] + [(900, None), (901, "..."), (902, "A, b! a-b A b a b a")]
    phrases = ["a", "a a", "a a a", "a b a b a", "the rule", "rule the rule", "the missing rule", "", "!!", "A  B", "c c the"] + [t for _, t in docs[:20]]
    expected = {}
    for q, p in enumerate(phrases):
        for i, t in docs:
            x, y = words(t), words(p)
            n = sum(x[k : k + len(y)] == y for k in range(len(x) - len(y) + 1)) if y else 0
            if n:
                expected[q, i] = n
    for block in (1, 4, 64):
        index = positional.build(table(spark, docs), block=block)
        found = positional.phrase_hits(index, asked(spark, *phrases))
        assert {(x["query_id"], x["doc_id"]): x["hits"] for x in found.collect()} == expected
    assert "text" not in found._jdf.queryExecution().executedPlan().toString().lower().replace("context", "")
    assert positional.phrase_hits(positional.build(table(spark, [])), asked(spark, "a")).count() == 0


def test_positions_are_stored_as_differences(spark):
    index = positional.build(table(spark, [(1, "x a x x b x")]), block=4)
    row = index.rows(spark).where("term = 'x'").first()
    assert (row["docs"], row["tf"], row["dl"], row["deltas"], row["top_tf"], row["low_dl"]) == ([1], [4], [6], [0, 2, 1, 2], 4, 6)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_k_is_that_of_all_scores(spark, k):
    r = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(vocabulary, [1 / (n + 1) for n in range(60)], k=r.choice((0, 3, 20, 90))))) for i in range(600)]
    docs += [(1000 + i, "w50 w51 w52 w53") for i in range(5)]
    queries = asked(spark, "w50 w51 w52 w53", "w0", "w0 w0 w59", "none", "", "w3 w40 w41 w7")
    index, counts = positional.build(table(spark, docs)), []
    got = sorted((x["query_id"], x["doc_id"], round(x["score"], 6), x["rank"]) for x in positional.top_k(index, queries, k, counts=counts).collect())
    expected = sorted((x["query_id"], x["doc_id"], round(x["score"], 6), x["rank"]) for x in lexical.bm25(table(spark, docs), queries, k).collect())
    assert got == expected and counts[1] <= counts[0]
    if k == 1:
        assert counts[1] < counts[0]
    with pytest.raises(ValueError):
        positional.top_k(index, queries, 0)


def test_short_queries_without_a_nested_loop(spark):
    docs = [(1, "abc"), (2, "b"), (3, None), (4, ""), (5, "xyz a.b 😀")]
    queries = ["a", "b", "😀", "a.b", "", "bc", "yz a.b 😀", "a"]
    found = matches.holding(table(spark, docs), asked(spark, *queries))
    expected = sorted((q, i) for q, p in enumerate(queries) for i, t in docs if p and t and p in t)
    assert sorted((x["query_id"], x["doc_id"]) for x in found.collect()) == expected
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_patterns_in_turns(spark, monkeypatch):
    from quarry.operators import contained

    monkeypatch.setattr(contained, "TURN_BYTES", 4)
    docs, queries = [(i, f"t{i} u{i % 3}") for i in range(9)], [f"t{i}" for i in range(9)] + ["u0", "u1"]
    got = contained.held(table(spark, docs), asked(spark, *queries))
    assert sorted((x["query_id"], x["doc_id"]) for x in got.collect()) == sorted((q, i) for q, p in enumerate(queries) for i, t in docs if p in t)


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.repeat(F.lit("y"), 1000)).alias("a"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(storage.sent(wide)) and not hinted(storage.sent(wide, most_bytes=15_000)) and not hinted(storage.sent(wide, most=9))
    assert hinted(storage.sent(wide.drop("a"), most_bytes=15_000))


def test_an_index_of_changed_files_is_built_again(spark, tmp_path):
    from quarry.plans import tables

    folder = f"{tmp_path}/documents.parquet"
    table(spark, [(1, "old words")]).write.parquet(folder)
    one = tables.lexical_index(spark, str(tmp_path))
    assert tables.lexical_index(spark, str(tmp_path)) is one
    table(spark, [(1, "new words"), (2, "more")]).write.mode("overwrite").parquet(folder)
    found = lexical.bm25(tables.lexical_index(spark, str(tmp_path)), asked(spark, "new"), 5)
    assert [x["doc_id"] for x in found.collect()] == [1]


def test_the_shared_folder_is_empty_after_the_session(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from quarry.session import session
from quarry.operators import positional
from quarry.storage import forget, settle
import os
spark = session("clean", 2, 2, **{{"spark.checkpoint.dir": {str(tmp_path)!r}, "spark.driver.memory": "1g"}})
kept = settle(spark.range(5)); gone = settle(spark.range(7)); count = lambda: sum(len(f) for _, _, f in os.walk({str(tmp_path)!r}))
before = count(); forget(gone); assert 0 < count() < before and kept.count() == 5
positional.phrase_hits(positional.build(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), spark.createDataFrame([(1, "a b")], "query_id long, query string")).collect()
spark.stop()
print("left", count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "left 0" in out.stdout, out.stderr[-2000:]


def test_the_retriever_finds_identifiers_and_quoted_phrases(spark):
    docs = table(spark, [(1, "def parseHttpHeader(x): return x", "a.py"), (2, "The rollback rule is in the plan.", "b.txt"), (3, "The rule of a rollback is elsewhere, the rollback of a rule.", "c.txt"), (4, "Lunch menus", "d.txt")], "doc_id long, text string, path string")
    found = Retriever(docs, Settings(top_k=3, stemming=False, facets=1, whole_documents=0))
    ids = lambda *q, **how: [sorted(x["doc_id"] for x in found.search(asked(spark, *q), **how).where(f"query_id = {n}").collect()) for n in range(len(q))]
    assert ids("header", '"rollback rule"') == [[1], [2]]
    assert ids("rollback rule", scope=table(spark, [(3,), (4,)], "doc_id long")) == [[3]]

    def fails(queries, texts):
        raise RuntimeError("no model")

    seen = ids("rollback rule", scorer=fails)
    assert seen == [[2, 3]]
    headed = lambda queries, texts: texts.str.startswith("Source: c.txt\n").astype(float)
    best = found.search(asked(spark, "rollback rule"), scorer=headed).where("rank = 1").first()
    assert best["doc_id"] == 3
