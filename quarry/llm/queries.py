"""The queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, fill_middle, fingerprints, html_tree, importance, mixing, ngram_join, packed_ids, quality, secrets, sentencepiece_codec, sharding, simhash


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), words=3, radius=3)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_documents(spark, sf_dir)).drop("repeats")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.classify(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir)).drop("n_chars")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir), shards=16)


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.encode_and_read_back(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, a document for a repository."""
    return secrets.scan_secrets(_documents(spark, sf_dir), owner_col="source", repo_col="doc_id")


def op10_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), html_tree.trained())


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir), words=5)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs' digests, and those of the texts that are rebuilt from them."""
    made = fill_middle.restore(fill_middle.transform(_documents(spark, sf_dir), seed=7, fim_percent=100, spm_percent=50))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1, buckets=10_000, percent=10, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sharding": op7_sharding,
    "op8_packed_ids": op8_packed_ids,
    "op9_secrets": op9_secrets,
    "op10_html_tree": op10_html_tree,
    "op11_ngram_join": op11_ngram_join,
    "op12_fill_middle": op12_fill_middle,
    "op13_importance": op13_importance,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DRAW = "('0x' || substr(sha256({0} || doc_id), {1}, 8))::BIGINT"

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op11_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], w[5:])[1:len(w) - 4], lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5]))) END AS s FROM w),
        sets AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
        each AS MATERIALIZED (SELECT id, n, hash(unnest(s)) AS h FROM sets),
        links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM each a JOIN each b ON a.h = b.h AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT id AS a, id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a),
        class AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)
        SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN class USING (id)""",
    "op12_fill_middle": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
            {", ".join(f"{_DRAW.format(chr(39) + '7:' + chr(39), 1 + 8 * i)} AS h{i}" for i in range(4))} FROM documents),
        c AS (SELECT *, len(l) AS n, least(h0 % (len(l) + 1), h1 % (len(l) + 1)) AS a, greatest(h0 % (len(l) + 1), h1 % (len(l) + 1)) AS b FROM d),
        f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h2 % 100 >= 100 THEN 'plain' WHEN h3 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
            array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""",
    "op13_importance": rf"""
        WITH u AS (SELECT 0 AS side, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        e AS (SELECT side, doc_id, unnest(w) AS w FROM u),
        steps AS (SELECT w, list_prepend(4294967295, flatten(list_transform(generate_series(1, strlen(w)), lambda i: list_prepend(('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1])))) AS x FROM (SELECT DISTINCT w FROM e)),
        k AS MATERIALIZED (SELECT w, xor(list_reduce(x, lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 10000 AS bucket FROM steps),
        f AS MATERIALIZED (SELECT side, doc_id, bucket FROM e JOIN k USING (w)),
        n AS (SELECT r AS bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM range(10000) g(r) LEFT JOIN f ON f.bucket = r GROUP BY r),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
        d AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
        r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(({_DRAW.format("'2024:'", 1)} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN d USING (doc_id)),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20 QUALIFY rank <= 10 * count(*) OVER () // 100)
        SELECT doc_id, n_features, weight, score, rank FROM r LEFT JOIN o USING (doc_id)""",
}
