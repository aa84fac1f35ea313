import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, stores
from quarry.sources import readers


def test_turns_and_limits(spark):
    stored = spark.createDataFrame([("c", 1, "r1", "q1")], "conversation_id string, turn_no int, run_id string, question string")
    new = spark.createDataFrame([("c", "r1", "again"), ("c", "r2", "q2"), ("d", "r3", "q3")], "conversation_id string, run_id string, question string")
    rows = {(r["conversation_id"], r["turn_no"]): r["question"] for r in stores.append_turns(stored, new).collect()}
    assert rows == {("c", 1): "q1", ("c", 2): "q2", ("d", 1): "q3"}
    many = spark.range(101).select(F.lit("c").alias("conversation_id"), F.col("id").cast("string").alias("run_id"), F.lit("q").alias("question"))
    with pytest.raises(ValueError):
        stores.append_turns(stored, many)
    with pytest.raises(ValueError):
        stores.check_questions(spark.createDataFrame([("1",), ("1",)], "question_id string"))
    states = stores.interrupted(spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "done")], "batch_id string, status string"), ["b"])
    assert [r["status"] for r in states.orderBy("batch_id").collect()] == ["interrupted", "running", "done"]


def test_runs_and_conversations_have_limits(spark):
    schema = "workspace_id string, conversation_id string, run_id string, question string"
    stored = spark.createDataFrame([("w", "c", "r1", "q", 1)], schema + ", turn_no int").select("workspace_id", "conversation_id", "turn_no", "run_id", "question")
    assert stores.append_turns(stored, spark.createDataFrame([("w", "c", "r1", " q ")], schema), strict=True).count() == 1
    with pytest.raises(ValueError, match="another question"):
        stores.append_turns(stored, spark.createDataFrame([("w", "c", "r1", "other")], schema), strict=True)
    many = spark.range(1000).selectExpr("'w' AS workspace_id", "concat('c', id) AS conversation_id", "'r' AS run_id", "'q' AS question")
    assert stores.append_turns(stored.limit(0), many).count() == 1000
    with pytest.raises(ValueError, match="conversations"):
        stores.append_turns(stored, many)


def test_a_workspace_is_replaced_only_where_it_changes(spark):
    schema = "workspace_id string, place long, id string, name string, content string"
    held = [("same", 0, "a", "A", "x"), ("same", 1, "b", "B", "y"), ("order", 0, "a", "A", "x"), ("order", 1, "b", "B", "y"), ("gone", 0, "a", "A", "x"), ("old", 0, "a", "A", "x"), ("twice", 0, "a", "A", "x"), ("null", 0, "a", "A", "x"), ("fewer", 0, "a", "A", "x"), ("fewer", 1, "b", "B", "y")]
    new = [("same", 0, "a", " A ", "x"), ("same", 1, "b", "B", "y"), ("order", 0, "b", "B", "y"), ("order", 1, "a", "A", "x"), ("old", 0, "a", "A", "x"), ("twice", 0, "a", "A", "x"), ("twice", 1, "a", "A", "z"), ("null", 0, "a", "A", None), ("new", 0, "a", "A", "é"), ("fewer", 0, "a", "A", "x")]
    stored = spark.createDataFrame(held, schema).withColumn("revision", F.lit("r1"))
    claims = [(w, "r0" if w == "old" else None if w == "new" else "r1") for w in ("same", "order", "gone", "old", "twice", "null", "new", "fewer")] + [("same", "r1")]
    got = {r["workspace_id"]: (r["documents"], r["bytes"], r["state"]) for r in stores.workspace_changes(stored, spark.createDataFrame(new, schema), spark.createDataFrame(claims, "workspace_id string, expected string")).collect()}
    assert got == {"same": (2, 2, "unchanged"), "order": (2, 2, "replaced"), "gone": (0, 0, "replaced"), "old": (1, 1, "conflict"), "twice": (2, 2, "invalid"), "null": (1, 0, "invalid"), "new": (1, 2, "replaced"), "fewer": (1, 1, "replaced")}
    empty = spark.createDataFrame([], schema)
    assert stores.workspace_changes(empty.withColumn("revision", F.lit("r1")), empty, spark.createDataFrame([("w", None)], "workspace_id string, expected string")).collect()[0]["state"] == "replaced"


def test_snapshots_feed_the_delta(spark):
    from quarry.sources.scope import snapshot

    files = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 2, "2024-01-01"), ("a", 1, "2024-01-01")], "path string, size long, modified string").withColumn("modified", F.to_timestamp("modified"))
    later = files.where("path = 'a'").unionByName(files.where("path = 'b'").withColumn("modified", F.to_timestamp(F.lit("2024-01-02"))))
    assert snapshot(files).count() == 2
    assert [tuple(r) for r in index.source_delta(snapshot(files), snapshot(later)).collect()] == [("b", "changed")]


def test_identity_and_spans(spark):
    rows = spark.createDataFrame([("value",), ("é",)], "v string")
    for key in (b"k", b"x" * 80):
        assert [r[0] for r in rows.select(stores.keyed_identity(F.col("v"), key)).collect()] == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in ("value", "é")]
    spans = spark.createDataFrame([("t", "a", None, "run", 10.0, "ok"), ("t", "b", "a", "search", 4.0, "ok"), ("t", "c", "a", "search", 3.0, "error")], "trace_id string, span_id string, parent_id string, operation string, duration_ms double, status string")
    got = {r["operation"]: (r["n"], r["failures"], r["ms"], r["own_ms"]) for r in stores.span_totals(spans).collect()}
    assert got == {"run": (1, 0, 10.0, 3.0), "search": (2, 1, 7.0, 7.0)}


def test_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": {"b": [{"c": 1}, {"c": 2}]}}\n')
    (tmp_path / "r.json").write_text(json.dumps({"rows": [{"x": 1}, {"x": 2}]}))
    rows = readers.read_records(spark, str(tmp_path / "r.jsonl"))
    assert readers.select_field(rows, "a.b[].c", "v").first()["v"] == [1, 2]
    assert [r["x"] for r in readers.read_records(spark, str(tmp_path / "r.json"), "rows").collect()] == [1, 2]
    assert readers.shape(spark, '{"a": 1}') == "STRUCT<a: BIGINT>"


def test_refresh_equals_rebuild(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, revision string, vector array<double>")
    before = make([("a", "1", [1.0]), ("b", "1", [2.0]), ("c", "1", [3.0])])
    now = make([("a", "1", [1.0]), ("b", "2", [9.0]), ("d", "1", [4.0])])
    delta = index.source_delta(before, now)
    assert {(r["path"], r["change"]) for r in delta.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    new = now.join(delta.select("path"), "path", "left_semi")
    assert sorted(map(tuple, index.refresh(before, delta, new).select("path", "revision").collect())) == sorted(map(tuple, now.select("path", "revision").collect()))


def test_registry(spark):
    held = index.Registry(1)
    a = held.acquire("a", lambda: spark.range(3))
    held.acquire("b", lambda: spark.range(4))
    assert set(held.held) == {"a", "b"}  # both in use
    held.release("a")
    held.acquire("c", lambda: spark.range(5))
    assert "a" not in held.held and a.count() == 3


def test_streams(spark, tmp_path):
    from quarry.streaming.refresh import chunk_stream, counts_by_window

    spark.createDataFrame([(1, "Some text. " * 100)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    chunk_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 2
    events = spark.createDataFrame([("2024-01-01 10:05:00", "x", 1.0), ("2024-01-01 10:55:00", "x", 2.0), ("2024-01-01 11:00:00", "x", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in counts_by_window(events).collect()) == [(1, 4.0), (2, 3.0)]
