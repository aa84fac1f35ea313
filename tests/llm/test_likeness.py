"""Likeness of edited copies against the length that edits leave."""

import difflib
import random

from quarry.llm import fingerprints


def likeness(a, b):
    return fingerprints.PrefixHash(fingerprints.codes_of(a)).likeness(fingerprints.PrefixHash(fingerprints.codes_of(b)))


def word(r):
    return "".join(r.choice("abcdefghijklmno\U0001f600") for _ in range(r.randint(3, 9)))


def test_a_change_near_each_end():
    r = random.Random(1)
    words = [word(r) for _ in range(300)]
    copy = ["XXXX", *words[1:-1], "YYYY"]
    assert likeness(" ".join(words), " ".join(copy)) > 0.95


def test_edited_copies_and_bounds():
    r = random.Random(2)
    for _ in range(60):
        words = [word(r) for _ in range(r.randint(60, 400))]
        copy = list(words)
        for _ in range(r.randint(1, 5)):
            at = r.randrange(len(copy))
            copy[at : at + r.choice((0, 1, 3))] = [word(r) + "Z" for _ in range(r.choice((0, 1, 3)))]
        a, b = " ".join(words), " ".join(copy)
        left = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        score = likeness(a, b)
        assert left - 16 * 12 <= score * max(len(a), len(b)) <= min(len(a), len(b))
        assert score > 0.8 or left < 0.85 * max(len(a), len(b))


def test_unlike_and_repetitive_texts():
    r = random.Random(3)
    assert likeness(" ".join(word(r) for _ in range(300)), " ".join(word(r) for _ in range(300))) < 0.05
    assert likeness("ab" * 500, "ab" * 100) == 0.2 and likeness("", "") == 1 and likeness("", "x") == 0
    assert likeness("x" + "ab " * 400 + "y", "z" + "ab " * 300 + "w") <= 902 / 1202


def test_next_of_many_null_ids(spark):
    """Null ids come after all others in descending order, by the hashes of their texts, and are dealt by those."""
    import hashlib

    from pyspark.sql import functions as F

    from quarry.llm import fingerprints

    rows = [(i, f"text of {i}") for i in range(40)] + [(None, f"text without id {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {r["text"]: r["tie"] for r in docs.select("text", F.xxhash64("text").alias("tie")).collect()}
    down = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)
    expected = []
    for k, (i, t) in enumerate(down):
        half, other = len(t) // 2, down[(k + 1) % len(down)][1]
        expected.append((str(i), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["edited_sha256"]) for r in fingerprints.fingerprint_documents(docs).collect()]
    assert sorted(got) == sorted(expected)
