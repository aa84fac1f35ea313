import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.api import Retriever, Settings
from quarry.functions.stem import fold, stem
from quarry.operators import answers, judgments
from quarry.sources.layout import page_text


def test_stems():
    pairs = {"deployment": "deploy", "deploy": "deploy", "running": "run", "hopping": "hop", "hoping": "hope", "happy": "happi", "skies": "sky", "relational": "relat", "cats": "cat", "generously": "generous", "knightly": "knight"}
    assert {w: stem(w) for w in pairs} == pairs and fold("café") == "cafe"


def test_intents(spark):
    wants = {
        "Find three passages, at most seven words": (3, 7, True, True),
        "Give 9 passages up to 40 words": (5, 10, True, True),
        "Return 99999999999 passages of no more than zero words": (5, 10, True, True),
        "x": (2, 10, False, False),
        "Which passages show it?": (2, 10, True, True),
        "What are passages?": (2, 10, False, False),
        "Add the page numbers": (2, 10, False, True),
        "Please cite it": (2, 10, False, True),
        "Why is it so?": (2, 10, False, False),
    }
    rows = spark.createDataFrame([(q,) for q in wants], "q string").select("q", answers.intents(F.col("q")).alias("i")).collect()
    assert {r["q"]: tuple(r["i"]) for r in rows} == wants


def test_anchors_and_envelopes():
    texts = ["One  “two” three", "four five"]
    assert answers.place_anchor('"TWO" three', 1, texts) == (1, "“two” three")
    assert answers.place_anchor("four five", 1, texts, 1) == (2, "four") and answers.place_anchor("six", 1, texts) is None
    assert answers.decode_answer('{"result": " x ", "reason": "y"}') == ("x\ny", False) and answers.decode_answer('{"error": "e"}') == ("e", True)
    for bad in (None, "x", "[]", '{"result": ""}', '{"result": 1}', '{"result": "a", "more": "b"}'):
        assert answers.decode_answer(bad)[1]
    assert answers.request_fingerprint("q", model=None) == answers.request_fingerprint("q") != answers.request_fingerprint("q", model="m")


def test_span_scores(spark):
    spans = {"answer": (360, 500), "near": (380, 520), "noise": (0, 100), "other": (560, 700)}
    row = lambda n, rank: ("q", rank, "s", *spans[n])
    passages = spark.createDataFrame([row("noise", 1), row("answer", 2)], "question_id string, rank int, source_id string, start_offset long, end_offset long")
    labels = spark.createDataFrame([("q", 1, "s", *spans["answer"], "relevant"), ("q", 2, "s", *spans["near"], "relevant"), ("q", 3, "s", *spans["noise"], "irrelevant")], "question_id string, ordinal int, source_id string, start_offset long, end_offset long, label string")
    assert [r["group_no"] for r in judgments.answer_groups(labels.where("label = 'relevant'")).collect()] == [0, 0]
    r = judgments.score_batch(passages, labels).first()
    assert (r["judged_questions"], r["hit"], r["recall"], r["mrr"], r["ndcg"], r["precision"], r["unjudged_passages"]) == (1, 1.0, 1.0, 0.5, 0.6309, 0.5, 0)


def test_layout(spark):
    rows = []
    for page in range(1, 5):
        rows += [(1, page, 0, 0, f"Running head {page}", 0.02, 0.04, 9.0, False), (1, page, 1, 0, "Body of the ﬁrst exam-", 0.3, 0.32, 10.0, False), (1, page, 1, 1, "ple text.", 0.33, 0.35, 10.0, False), (1, page, 2, 0, str(page), 0.95, 0.97, 9.0, False)]
    rows.append((1, 1, -1, 0, "Chapter One", 0.2, 0.24, 16.0, True))
    rows += [(2, 1, 0, 0, "BOLD CAPITALS", 0.2, 0.24, 10.0, True), (2, 1, 1, 0, "ALL OF IT.", 0.3, 0.34, 10.0, True), (2, 1, 2, 0, "Bold Words", 0.4, 0.44, 10.0, True), (2, 1, 3, 0, "PLAIN", 0.5, 0.54, 10.0, False)]
    both = {r["doc_id"]: r["text"] for r in page_text(spark.createDataFrame(rows, "doc_id long, page int, block int, line int, text string, top double, bottom double, size double, bold boolean")).collect()}
    assert both[2] == "\n# BOLD CAPITALS\n\nALL OF IT.\n\nBold Words\n\nPLAIN"
    text = both[1]
    assert text == "\n# Chapter One\n\nBody of the first example text." + "\fBody of the first example text." * 3


def test_retriever(spark):
    docs = spark.createDataFrame([("d1", "The deployment failed twice.", "ops/deploy_notes.txt"), ("d2", "Lunch is at noon.", "misc/lunch.txt")], "doc_id string, text string, path string")
    asked = spark.createDataFrame([(1, "deploy"), (2, "zebra"), (3, "When is lunch? Explain the deployment.")], "query_id long, query string")
    for embed in (None, answers.hashed_embedding):
        found = Retriever(docs, Settings(top_k=2), embed).search(asked).collect()
        by = {}
        for r in found:
            by.setdefault(r["query_id"], set()).add(r["doc_id"])
            assert r["whole_document"] and r["start_offset"] == 0
        assert "d1" in by[1] and by[3] == {"d1", "d2"} and (embed is not None or 2 not in by)
    with pytest.raises(ValueError):
        Settings(top_k=0)


def test_context_hook(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "c string, x string")

    def hook(chunk, context):
        if chunk == "b":
            raise RuntimeError("no")
        return context.upper()

    assert [r[0] for r in rows.select(answers.contextualised(F.col("c"), F.col("x"), hook)).collect()] == ["X\n\na", "b"]


def test_layout_carries_initials_and_cuts_at_captions(spark):
    made = []
    add = lambda doc, page, block, *lines, size=10.0: made.extend((doc, page, block, i, t, 0.3, 0.35, size, False) for i, t in enumerate(lines))
    body = "plain words that stand here to be the body of the text"
    add(1, 1, 0, body)
    add(1, 1, 1, "O", size=30.0)
    add(1, 1, 2, "nce upon a time", "Figure 1: A wood", "in spring.", "It was SelecƟon-", "Based and well-", "known.")
    add(1, 1, 3, "The Second Part", size=16.0)
    add(1, 1, 4, "A", size=30.0)
    add(1, 2, 0, "The Third Part", size=16.0)  # a heading doesn't take the initial, and opens the page that its paragraph stands on
    add(1, 2, 1, "nother day. Table 2. stays here")
    add(1, 3, 0, "X", size=30.0)
    add(1, 3, 1, "Th", size=30.0)  # replaces the one before
    add(1, 4, 0, "ey went on. " + body)
    add(1, 4, 1, "Z", size=30.0)  # nothing follows
    add(2, 1, 0, "Table 1. First line", body, "Table 2: Last")
    add(2, 1, 1, "12", size=30.0)
    got = {r["doc_id"]: r["text"] for r in page_text(spark.createDataFrame(made, "doc_id long, page int, block int, line int, text string, top double, bottom double, size double, bold boolean")).collect()}
    first = f"{body}\n\n# Chapter 1\n\nOnce upon a time\n\nFigure 1: A wood in spring. It was Selection- Based and wellknown.\n\n# The Second Part\n"
    assert got[1] == "\f".join([first, "\n# The Third Part\n\nAnother day. Table 2. stays here", "", f"\n# Chapter 2\n\nThey went on. {body}"])
    assert got[2] == f"Table 1. First line {body}\n\nTable 2: Last\n\n12"


def test_cut_off_answers_are_asked_for_once_more(spark):
    from quarry.operators.answers import ABSTENTION, answered_whole

    def generator(queries, passages, room):
        cut = passages.str.len() > room
        return pd.DataFrame({"text": passages.where(~cut, "cut").replace("blank", " ").to_numpy(), "finish": cut.map({True: "length", False: "stop"}).where(passages != "odd", "filter").to_numpy()})

    rows = [(1, "q", "x" * 5), (2, "q", "x" * 30), (3, "q", "x" * 50), (4, "q", " "), (5, "q", None), (6, "q", "blank"), (7, "q", "odd")]
    got = {r["query_id"]: (r["answer"], r["attempts"], r["error"]) for r in answered_whole(spark.createDataFrame(rows, "query_id long, query string, answer string"), generator, 10).collect()}
    assert got == {1: ("x" * 5, 1, None), 2: ("x" * 30, 2, None), 3: (None, 2, "incomplete"), 4: (ABSTENTION, 0, None), 5: (ABSTENTION, 0, None), 6: (None, 1, "empty"), 7: (None, 1, "incomplete")}
