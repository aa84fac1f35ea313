"""Queries over whole tables against brute force."""

from quarry.plans import registry

DATA = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_upsert(spark):
    docs = documents(spark)
    last = max(i for i in docs if i % 4)
    added = {i: last + 1 + k for k, i in enumerate(sorted(i for i in docs if i % 4 == 0))}
    df = registry.QUERIES["w2_upsert"](spark, DATA)
    assert "isnull(ordinal" not in df._jdf.queryExecution().toString()
    assert {tuple(r) for r in df.select("doc_id", "ordinal", "n_chars").collect()} == {(i, added.get(i, i), r["n_chars"] + 1) for i, r in docs.items()}


def test_span_overlap(spark):
    expected = []
    for i, r in documents(spark).items():
        at, spans = 0, []
        for n, line in enumerate((r["text"] or "").split("\n")):
            if line:
                spans.append((n, at, at + len(line)))
            at += len(line) + 1
        for n, a, b in spans:
            for m, c, e in spans:
                c, e = max(0, c - 20), e - 20
                shared = min(b, e) - max(a, c)
                if e > 0 and shared > 0 and shared * 2 >= min(b - a, e - c):
                    expected.append((i, n, m))
    got = [tuple(r) for r in registry.QUERIES["e1_span_overlap"](spark, DATA).collect()]
    assert sorted(got) == sorted(expected) and max(n for _, n, _ in got) >= 6


def test_answers_hold_whole_texts(spark):
    from quarry.plans.evaluation import arms

    docs = documents(spark)
    expected = {}
    for r in arms(spark, DATA).where("arm = 'score' and rank <= 3").orderBy("rank").collect():
        expected.setdefault(r["query_id"], []).append(f"[{r['rank']}] {docs[r['doc_id']]['source']} (L1)\n{docs[r['doc_id']]['text']}")
    got = {r["query_id"]: r["answer"] for r in registry.QUERIES["a1_passages"](spark, DATA).collect()}
    assert got == {q: "\n\n".join(parts) for q, parts in expected.items()}


def test_long_phrases(spark):
    import re

    cut = lambda t: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]
    asked = {r["item_id"]: cut(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    expected = {}
    for i, r in documents(spark).items():
        words = cut(r["text"])
        for q, phrase in asked.items():
            hits = sum(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1)) if phrase else 0
            if hits:
                expected[q, i] = hits
    got = {(r["query_id"], r["doc_id"]): r["hits"] for r in registry.QUERIES["q4_phrase"](spark, DATA).collect()}
    assert got == expected and max(len(asked[q]) for q, _ in got) > 3
