import pytest

from quarry.operators.qualify import normalised, qualified, unambiguous

ASKED = "question_id string, question string, answer string, gold array<long>"


def _sets(spark, questions, documents):
    rows = [(i, "what?", "that", gold) for i, gold in questions]
    return spark.createDataFrame(rows, ASKED), spark.createDataFrame(documents, "doc_id long, text string")


def test_both_sides_qualify(spark):
    asked, docs = _sets(spark, [("a", [1, 2, 1]), ("b", [1, 3]), ("c", [4]), ("d", []), ("e", None), ("f", [2, None]), ("g", [2])], [(1, "x"), (2, "y"), (3, "z"), (3, "z again"), (5, "w"), (6, "v")])
    chosen, corpus = normalised(asked, docs)
    assert {r["question_id"]: r["gold"] for r in chosen.collect()} == {"a": [1, 2], "g": [2]}  # 3 is ambiguous, 4 and null are nowhere
    assert {r["doc_id"]: r["is_gold"] for r in corpus.collect()} == {1: True, 2: True, 5: False, 6: False}
    chosen, corpus = normalised(asked, docs, limit=1, others=1, keep_unlabelled=True)
    assert {r["question_id"]: (r["gold"], r["qualified"]) for r in chosen.collect()} == {"a": ([1, 2], True), "d": ([], False), "e": ([], False)}
    rows = corpus.collect()
    assert len(rows) == 3 and {r["doc_id"] for r in rows if r["is_gold"]} == {1, 2}


def test_against_brute_force(spark):
    ids = [i * 7 % 50 for i in range(70)]  # 20 ids stand twice
    asked, docs = _sets(spark, [(f"q{i}", [0, i % 50, (i * i + 20) % 60]) for i in range(40)], [(i, f"text {i}") for i in ids])
    good = {i for i in ids if ids.count(i) == 1}
    want = {f"q{i}" for i in range(40) if {0, i % 50, (i * i + 20) % 60} <= good}
    left = unambiguous(docs)
    assert {r["doc_id"] for r in left.collect()} == good
    assert {r["question_id"] for r in qualified(asked, left).collect()} == want
    asked, _ = _sets(spark, [(f"q{i}", [20 + i % 50, 20 + (i * i) % 40]) for i in range(40)], [(1, "x")])
    want = {f"q{i}" for i in range(40) if {20 + i % 50, 20 + (i * i) % 40} <= good}
    got = {r["question_id"] for r in qualified(asked, left).collect()}
    assert got == want and got


@pytest.mark.parametrize(
    "questions, documents, kept",
    [
        ([("a", [1])], [(1, "x"), (1, "y")], {"drop_repeated": False}),
        ([("a", [2])], [(1, "x")], {}),
        ([("a", [1]), ("a", [1])], [(1, "x")], {}),
        ([(" ", [1])], [(1, "x")], {}),
        ([("a", [1])], [(1, " \n")], {}),
        ([("a", [1])], [(None, "x")], {}),
        ([], [(1, "x")], {}),
        ([("a", [1])], [(1, "x")], {"limit": 0}),
    ],
)
def test_faults_are_refused(spark, questions, documents, kept):
    with pytest.raises(ValueError):
        normalised(*_sets(spark, questions, documents), **kept)


def test_the_queries_where_no_question_qualifies(spark, tmp_path):
    from quarry.plans import registry

    spark.createDataFrame([(4, "one question here"), (5, "one question there"), (6, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one question")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert registry.QUERIES["s17_questions"](spark, str(tmp_path)).collect() == []  # document 4 stands twice
    assert sorted(map(tuple, registry.QUERIES["s17_corpus"](spark, str(tmp_path)).collect())) == [(5, False), (6, False)]
