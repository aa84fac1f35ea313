"""The n-gram join, fill-in-the-middle and importance resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fill_middle, importance, ngram_join, overlap, simhash
from test_operators import DATA, ODD, brute_components, by_id, docs, odd  # noqa: F401

OPERATORS = {
    "op11": lambda d: ngram_join.join(d),
    "op12": lambda d: fill_middle.restore(fill_middle.transform(d)),
    "op13": lambda d: importance.resample(d, d.withColumn("item_id", F.col("doc_id"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_odd_row_and_none_for_none(odd, name):  # noqa: F811
    got = sorted((r["doc_id"] for r in OPERATORS[name](odd).collect()), key=str)
    assert got == sorted((r[0] for r in ODD), key=str)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def sets_of(rows):
    return {i: set(simhash.shingle_hashes(t, 5, True).tolist()) for i, t in rows.items()}


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def variants(seed, n):
    """Texts with edits of one another, of several similarities, some longer than a fragment's usual share and some shorter than a shingle."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    made = [[word() for _ in range(r.choice((3, 9, 40, 200)))] for _ in range(12)]
    while len(made) < n:
        other = list(r.choice(made))
        for _ in range(r.randint(0, 4)):
            other[r.randrange(len(other))] = word()
        if r.random() < 0.4:
            other = other[: max(1, int(len(other) * r.uniform(0.75, 1)))]
        made.append(other)
    return {i: " ".join(x) for i, x in enumerate(made)} | {n: "", n + 1: "  \n", n + 2: "A b  C", n + 3: "a B c"}


@pytest.mark.parametrize("fragments,limit", [(1, 20_000), (8, 20_000), (8, 6)])
def test_join_against_all_pairs(spark, fragments, limit):
    rows = variants(fragments + limit, 150)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = by_id(ngram_join.join(df, fragments=fragments, limit=limit))
    sets = sets_of(rows)
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(sets, near)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert got[152]["component_id"] == got[153]["component_id"] == 152 and got[150]["component_id"] != got[151]["component_id"]


def test_partial_overlaps_sum_to_the_whole(spark):
    rows = {0: " ".join(f"a{i}" for i in range(300)), 1: " ".join(f"a{i}" for i in range(40, 340))}
    sets = {i: overlap.shingle_set(t, 5) for i, t in rows.items()}
    hot = sets[0][::6]
    cut = ngram_join.segments(spark.createDataFrame([(t,) for t in rows.values()], "t string"), 5, hot)
    a, b = (overlap.node_of(s) for s in sets.values())
    parts = ngram_join.partial_overlaps(spark.createDataFrame([(a, b)], "a long, b long"), cut).collect()
    assert len(parts) == 8 and sum(r["common"] for r in parts) == len(np.intersect1d(sets[0], sets[1]))


def test_counts_of_frequent_shingles_are_bounded_and_near():
    often, r = overlap.Often(), np.random.default_rng(0)
    rare = r.integers(0, 2**63, 10**6).astype(np.uint64)
    for i in range(200):
        often.add(np.concatenate([rare[i * 5000 : (i + 1) * 5000], np.arange(20, dtype=np.uint64)]))
    keys, times = often.found(8)
    assert keys.tolist() == list(range(20)) and times.tolist() == [200] * 20


def expected_fim(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_against_brute_force(spark):
    r = random.Random(4)
    parts = ["\n", "a", "é", "😀", "<", "<P", "S>", ">", "<M>", "\r", " ", "line of text\n", ""]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(1500)]
    rows += [(None, "x\ny\nz"), (7, None), (8, "\n" * 5000), (9, "long line " * 100_000 + "\nend")]
    made = fill_middle.restore(fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {}
    for x in made.collect():
        got.setdefault(x["restored"], []).append((x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]))
    forms = set()
    for i, t in rows:
        e = (i, *expected_fim(i, t or ""))
        forms.add(e[2])
        assert e in got[t or ""]
    assert forms == {"plain", "psm", "spm"} and made.count() == len(rows)


def test_restore_takes_odd_outputs(spark):
    rows = spark.createDataFrame([("plain", None, 1), (None, "x", 2), ("psm", "<P>a<S>b<M>c", 3)], "form string, output string, row long")
    assert {r["row"]: r["restored"] for r in fill_middle.restore(rows).collect()} == {1: "", 2: "x", 3: "acb"}
    with pytest.raises(Exception, match="three markers"):
        fill_middle.restore(spark.createDataFrame([("psm", "<P>a", 1)], "form string, output string, row long")).collect()


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features_of(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def expected_draw(rows, target, n, buckets, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features_of(text, n)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out, able = [], []
    for i, text in rows:
        words, found = features_of(text, n)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if words >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, rank.get(r)) for r in out), key=str)


@pytest.mark.parametrize("n,size", [(1, 1 << 16), (1, 40), (3, 40)])
def test_resampling_against_brute_force(spark, n, size):
    r = random.Random(n + size)
    words = ["Alpha", "beta", "GAMMA", "délta", "e1", "it's", "Ünder", "x-y", "a_b"]
    rows = [(i, "".join(r.choice(words) + r.choice((" ", "\n", ", ", " ")) for _ in range(r.choice((0, 3, 19, 20, 60))))) for i in range(120)]
    rows += [(200, None), (None, "some words " * 15), (201, "é" * 5000)]
    target = ["alpha beta gamma", None, "alpha alpha under"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.resample(df, items, n=n, buckets=64, percent=30, size=size)
    assert sorted(map(tuple, got.collect()), key=str) == expected_draw(rows, target, n, 64, 30)


def test_chunks_count_each_run_once():
    text = "One two, three four five SIX seven".encode()
    known = importance.Buckets(1 << 30)
    for n in (1, 2, 3):
        whole = importance.words_of(text)
        expected = sorted(importance.features(whole, len(whole), n, known).tolist())
        for size in (1, 6, 12, 1000):
            parts = importance.split(text, n, size)
            assert sum(own for _, own in parts) == 7
            assert sorted(x for t, own in parts for x in importance.features(importance.words_of(t), own, n, known).tolist()) == expected


def test_repeated_long_rows_each_count(spark):
    rows = [(1, "a long text of words " * 20)] * 3 + [(1, "another long text " * 20)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "text")], "item_id long, text string"), size=50, percent=50)
    assert sorted(r["n_features"] for r in got.collect()) == [60, 100, 100, 100] and got.where("rank is not null").count() == 2
