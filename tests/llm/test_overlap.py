"""Near-dedup by exact similarity: against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import overlap, pipeline, simhash

KINDS = ("cut", "extended", "swapped")


def copies(seed=5, bases=40):
    """Texts and copies of them with a passage cut off, foreign text added, or words swapped, at several similarities."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(12)]
    texts, kinds = [], []
    for _ in range(bases):
        base = line + [word() for _ in range(r.randint(40, 250))]
        texts.append(base)
        kinds.append(None)
        for kind in KINDS:
            share = r.choice((0.7, 0.76, 0.79, 0.82, 0.87, 0.92))
            if kind == "cut":
                other = base[: int(len(base) * share)]
            elif kind == "extended":
                other = base + [word() for _ in range(int(len(base) * (1 / share - 1)))]
            else:
                other = list(base)
                for i in r.sample(range(len(base)), max(1, int(len(base) * (1 - share) / 8))):
                    other[i] = word()
            texts.append(other)
            kinds.append(kind)
    return [" ".join(t) for t in texts], kinds


def brute(texts):
    sets = [set(simhash.shingle_hashes(t, 5, True).tolist()) for t in texts]
    root, edges = list(range(len(texts))), []
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                edges.append((i, j))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], edges


def test_no_near_copy_stays(spark):
    texts, kinds = copies()
    classes, edges = brute(texts)
    assert all(any(kinds[j] == k for _, j in edges) for k in KINDS)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup_stage(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} <= {i for i, c in enumerate(classes) if i == c}


def test_stage_keeps_what_brute_force_keeps(spark):
    """Texts of similarity 0.7 to 0.8 stay."""
    texts, _ = copies(6)
    classes, _ = brute(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(classes) if i == c]


@pytest.mark.parametrize("limit", [20_000, 5])
def test_large_buckets_and_shards(spark, limit):
    """Chains of variants of one text, where most pairs aren't similar."""
    r = random.Random(8)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(120)]]
    for _ in range(70):
        other = list(r.choice(texts))
        for _ in range(r.randint(1, 5)):
            other[r.randrange(120)] = f"w{r.randrange(10**6)}"
        texts.append(other)
    texts = [" ".join(t) for t in texts]
    classes, _ = brute(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    sets = {i: overlap.shingle_set(t, 5) for i, t in enumerate(texts)}
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    found = []
    for i, s in sets.items():
        node, keys = overlap.node_of(s), overlap.prefix(s, *none)
        hot = np.sort(keys[::2])  # as if a sample had found half of the shingles in 12 texts
        found.append((i, node, len(s), overlap.parities(s), keys.view(np.int64).tolist(), overlap.salts(keys, node, hot, np.full(len(hot), 12), limit).tolist()))
    found = spark.createDataFrame(found, "doc_id long, node long, n int, parity binary, prefix array<long>, salt array<int>")
    links = {x["a"]: x["b"] for x in overlap.similar_classes(found, rows, 5, limit=limit).collect()}
    got, first = [], {}
    for i, s in sets.items():
        node = overlap.node_of(s)
        got.append(first.setdefault(links.get(node, node), i))
    assert got == classes


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(0)
    for _ in range(500):
        a = np.unique(r.integers(0, 400, r.integers(1, 120), dtype=np.uint64))
        b = np.unique(np.concatenate([r.choice(a, max(1, int(len(a) * r.uniform(0.7, 1))), replace=False), r.integers(0, 400, r.integers(0, 12), dtype=np.uint64)]))
        hot = np.unique(r.integers(0, 400, 50, dtype=np.uint64))
        rank = r.permutation(len(hot)) + 1
        if overlap.similar(a, b):
            assert set(overlap.prefix(a, hot, rank).tolist()) & set(overlap.prefix(b, hot, rank).tolist())


def test_parities_rule_out_no_similar_pair():
    r = np.random.default_rng(1)
    ruled = 0
    for _ in range(2000):
        n = int(r.integers(0, 3000))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.uniform(0.5, 1)], r.integers(0, 2**64, int(r.integers(0, n // 3 + 2)), dtype=np.uint64)]))
        fits = overlap.possible(overlap.parities(a), len(a), overlap.parities(b), len(b))
        assert fits or not overlap.similar(a, b)
        ruled += not fits
    assert ruled > 1000


def test_sets_are_those_of_the_words(monkeypatch):
    """Against hashes of the joined words, in one batch and in many, with odd white space, short texts and repeats."""
    r = random.Random(3)
    space = (" ", "  ", "\n", "\t", "\x0b", "\x0c\r")
    texts = [None, "", " \n", "a", "A", "b a", " a\tB ", "a b", "a\x1cb c\xa0d", "É b", "é b", "a b c d e", "x A b C d e", "a b c d e x"]
    texts += ["".join(r.choice("aBcé\U0001f600") + r.choice(space) for _ in range(r.choice((2, 5, 6, 30, 200)))) for _ in range(150)]
    for words in (1, 2, 5):
        expected = [set(simhash.shingle_hashes(t, words, True).tolist()) for t in texts]
        whole = [s.tolist() for s in overlap.shingle_sets(texts, words)]
        monkeypatch.setattr(overlap, "_TEXT", 50)
        assert [s.tolist() for s in overlap.shingle_sets(texts, words)] == whole
        monkeypatch.undo()
        assert all(s == sorted(set(s)) for s in whole)
        assert [len(s) for s in whole] == [len(s) for s in expected]
        for i in range(0, len(texts), 3):
            assert [len(set(whole[i]) & set(s)) for s in whole] == [len(expected[i] & s) for s in expected]
    assert not list(overlap.shingle_sets([], 5))


def test_a_batch_hashes_each_word_once(monkeypatch):
    """Not each of the 5-word shingles, which are as many as the words and five times as long."""
    calls, real = [], overlap.xxhash.xxh64_intdigest
    monkeypatch.setattr(overlap.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or real(*a))
    r = random.Random(1)
    assert len(overlap.shingle_set(" ".join(f"w{r.randrange(50)}" for _ in range(5000)), 5)) > 4900
    assert len(calls) < 100


def test_shingles_frequent_over_all_tasks_go_last(spark, monkeypatch):
    """Those that few texts of each task have too; and the most frequent ones if not all fit."""
    r = random.Random(2)
    line = lambda k: " ".join(f"l{k}x{i}" for i in range(5))
    texts = [f"{line('a')} {r.random()} {r.random()} " + (line("b") if i % 2 else line(i)) for i in range(24)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(4, "doc_id").coalesce(4)
    a, b = (overlap.shingle_set(line(k), 5)[0] for k in "ab")
    hot, rank, times = overlap.hot_shingles(rows, 5)
    assert hot.tolist() == sorted([a, b])
    counts = dict(zip(hot.tolist(), times.tolist()))
    assert counts[a] == 24 and 9 <= counts[b] <= 12  # a task that has one b leaves it out
    assert dict(zip(hot.tolist(), rank.tolist())) == {a: 2, b: 1}
    monkeypatch.setattr(overlap, "MOST_HOT", 1)
    assert overlap.hot_shingles(rows, 5)[0].tolist() == [a]
    assert all(len(x) == 0 for x in overlap.hot_shingles(rows.limit(0), 5))


def test_odd_rows(spark):
    long = "word and more words of a long text. " * 3000
    rows = [(1, "a b"), (1, "other words here"), (2, "A  b"), (3, ""), (4, None), (None, "a b"), (5, long), (6, long + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("__gone", F.lit("x")).withColumn("own", F.lit("x"))
    kept = overlap.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "5", "None"]
    assert overlap.drop_similar(docs.limit(0)).count() == 0
