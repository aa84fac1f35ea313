import json
import random
import re

from quarry.operators.answers import ABSTENTION, INVALID, place_anchor
from quarry.operators.selections import selections


def item(passage, anchor, paraphrase="says so", caveat="in part", addresses_request=True, **more):
    return {"passage": passage, "anchor": anchor, "paraphrase": paraphrase, "caveat": caveat, "addresses_request": addresses_request, **more}


TEXTS = [("The “old” house\n stood by the river all year", "a/old.txt", "L3-L4", ""), ("A ship came to the river", "b/log.PDF", "p.3-4", "PDF page range: 3-4\n[PDF page 3]\nA ship came\n[PDF page 4]\nto the river"), ("The same words and the same words", "", None, "")]


def run(spark, answers, texts=TEXTS, **kept):
    rows = list(enumerate(answers))
    given = [(q, r, *t, "x") for q, _ in rows for r, t in enumerate(texts, 1)]
    asked = spark.createDataFrame([(q, a if a is None or isinstance(a, str) else json.dumps({"selections": a})) for q, a in rows], "query_id long, answer string")
    found = selections(asked, spark.createDataFrame(given, "query_id long, rank int, content string, name string, location string, evidence string, answer string"), **kept).collect()
    return [(r["answer"], r["failed"]) for r in sorted(found)]


def test_shown(spark):
    got = run(
        spark,
        [
            [item(1, 'THE "old"   house'), item(1, "ship came", " what ", " why ")],
            [item(2, "came to"), item(1, "the “old” house"), item(1, "The old")],
            [item(3, "the same"), item(2, "a ship came", addresses_request=False)],
            [item(9, 5, addresses_request=False)],
            [],
            [item(2, "to the river")],
        ],
        most=3,
        words=2,
        cite=True,
    )
    short = "\n\nThe supplied evidence supports only {} selection(s)."
    one = "1. old.txt. Source lines: L3-L4.\nAnchor: “The “old””\nParaphrase: says so [1]\nContext: in part"
    assert got[0] == (one + "\n\n2. log.PDF. Exact PDF page: unavailable (source range 3-4).\nAnchor: “ship came”\nParaphrase: what [2]\nContext: why".replace("Exact PDF page: unavailable (source range 3-4)", "PDF page 3") + short.format(2), False)
    assert got[1][0].startswith("1. log.PDF. Exact PDF page: unavailable (source range 3-4).\nAnchor: “came to”") and "2. old.txt" in got[1][0] and got[1][0].endswith(short.format(2))
    assert got[2] == ("1. Source location: unavailable.\nAnchor: “The same”\nParaphrase: says so [3]\nContext: in part" + short.format(1), False)
    assert got[3] == got[4] == (ABSTENTION, False) and got[5][0].startswith("1. log.PDF. PDF page 4.")


def test_refused(spark):
    good = item(1, "river")
    bad = [
        None, "", "x", "[]", "{}", '{"selections": {}}', '{"selections": [], "more": 1}', [good] * 3, [item(1, "nowhere")], [item(3, "river")],
        [item(0, "river")], [item(4, "river")], [item("1", "river")], [item(1.0, "river")], [item(True, "river")], [item(1, " ")], [item(1, "river", caveat="\n")],
        [item(1, "river", paraphrase=3)], [item(1, "river", more=1)], [{k: v for k, v in good.items() if k != "caveat"}], [item(1, "river", addresses_request="yes")], [item(1, "river", addresses_request=None)], ["river"], [good, None],
    ]
    assert run(spark, bad) == [(INVALID, True)] * len(bad)


def test_without_passages(spark):
    asked = spark.createDataFrame([(1, json.dumps({"selections": [item(1, "x")]})), (2, '{"selections": []}')], "query_id long, answer string")
    none = spark.createDataFrame([], "query_id long, rank int, content string, name string, location string, evidence string")
    assert {r["query_id"]: (r["answer"], r["failed"]) for r in selections(asked, none).collect()} == {1: (INVALID, True), 2: (ABSTENTION, False)}


def test_against_brute_force(spark):
    draw = random.Random(5)
    words = ["river", "Ship", "“old”", "house", "it’s"]
    texts = [(" ".join(draw.choices(words, k=6)), f"f{i}.txt", f"L{i + 1}", "") for i in range(4)]
    asked = [[item(draw.randint(1, 4), " ".join(draw.choices(words, k=draw.randint(1, 3))).lower().replace("’", "'")) for _ in range(draw.randint(1, 3))] for _ in range(80)]

    def slow(chosen):
        out, seen, lost = [], set(), False
        for c in chosen:
            found = place_anchor(c["anchor"], c["passage"], [t[0] for t in texts], 2)
            lost |= found is None
            if found and found[1] not in seen:
                seen.add(found[1])
                out.append((found[0], found[1]))
        return None if not out and lost else out

    got = run(spark, asked, texts=texts, most=3, words=2, cite=True)
    for chosen, (answer, failed) in zip(asked, got):
        want = slow(chosen)
        shown = list(zip(map(int, re.findall(r"\[(\d)\]", answer)), re.findall(r"Anchor: “(.*)”\n", answer)))
        assert (failed, shown) == (want is None, want or [])
    assert {f for _, f in got} == {True, False}
