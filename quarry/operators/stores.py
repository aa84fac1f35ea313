"""Workspaces, labels, conversations, traces: tables with keyed updates and limits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scans import running_total
from quarry.storage import settle

MOST_DOCUMENTS, MOST_BYTES, MOST_TOTAL = 500, 16 << 20, 64 << 20


class Conflict(RuntimeError):
    """The revision isn't the expected one."""


def source_id(path: Column) -> Column:
    """The id of an imported file: its path's SHA-256."""
    return F.concat(F.lit("file-"), F.sha2(path, 256))


def set_labels(stored: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("run_id", "rank")) -> DataFrame:
    """Labels by key: a change sets its key's label, a null one clears it; others stay. Of several changes of a key, that of the highest `n` counts."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("label"), "n").alias("new"))
    both = stored.select(*keys, F.struct("label").alias("old")).join(last, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("new", "old")["label"].alias("label")).where("label is not null")


def upsert(stored: DataFrame, new: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """New rows replace those of the same key in place; others go after the last, by key. Columns as stored; new has no ordinal.

    Added rows are dealt by ranges of the key and each part counts its own; one count a part meets on the driver.
    """
    spark = stored.sparkSession
    names = [c for c in stored.columns if c not in (key, ordinal)]
    revised = new.select(key, F.struct(*names).alias("new"))
    kept = F.coalesce("new", "old")
    held = stored.select(key, ordinal, F.struct(*names).alias("old")).join(revised, key, "left").select(key, ordinal, *[kept[c].alias(c) for c in names])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = new.select(key, *names).join(stored.select(key), key, "left_anti")
    added = settle(added.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()))
    before = stored.agg(F.coalesce(F.max(ordinal), F.lit(-1))).first()[0] + 1
    starts = []
    for part, n in sorted((r["__part"], r["count"]) for r in added.groupBy("__part").count().collect()):
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__before")
    added = added.join(F.broadcast(starts), "__part").withColumn(ordinal, place)  # one row a part
    return held.unionByName(added.select(key, ordinal, *names))


def check_workspace(documents: DataFrame, name: str = "name", content: str = "content") -> None:
    """Raise for a workspace over its limits or with repeated ids."""
    size = F.octet_length(content)
    n, largest, total, ids = documents.agg(F.count(F.lit(1)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)), F.count_distinct(name)).first()
    if n > MOST_DOCUMENTS or largest > MOST_BYTES or total > MOST_TOTAL:
        raise ValueError(f"a workspace holds {MOST_DOCUMENTS} documents of {MOST_BYTES} bytes, {MOST_TOTAL} in all")
    if ids != n:
        raise ValueError("names repeat")


def compare_and_set(current: str | None, expected: str | None) -> None:
    if current != expected:
        raise Conflict("changed meanwhile; reload")


def workspace_changes(stored: DataFrame, incoming: DataFrame, claims: DataFrame) -> DataFrame:
    """(workspace_id, documents, bytes, state) of each claim to replace a workspace's documents.

    stored, incoming: workspace_id, place (from 0), id, name, content; stored also has a revision, one a workspace. claims: workspace_id, expected (null: a new workspace).
    state: `invalid` (over the limits, a repeated or empty id), `conflict` (the revision isn't the expected one), `unchanged` (every place holds the same document) or
    `replaced`. Places meet places, so a workspace of any size is compared by many tasks. Claims of one workspace count once; one without incoming rows empties it.
    """
    at = ["workspace_id", "place"]

    def placed(t: DataFrame, column: str) -> DataFrame:
        return t.select(*at, F.struct(F.col("id"), F.trim("name").alias("name"), F.sha2(F.col("content").cast("binary"), 256).alias("digest")).alias(column))

    moved = placed(stored, "was").join(placed(incoming, "is"), at, "full_outer")
    moved = moved.groupBy("workspace_id").agg(F.count_if(~F.col("was").eqNullSafe(F.col("is"))).alias("moved"))
    size = F.octet_length("content")
    ids = incoming.groupBy("workspace_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.count_if(F.col("content").isNull()).alias("absent"))
    bad = (F.max("n") > 1) | (F.sum("n") > MOST_DOCUMENTS) | (F.max("largest") > MOST_BYTES) | (F.sum("bytes") > MOST_TOTAL) | (F.sum("absent") > 0) | (F.count_if(F.coalesce("id", F.lit("")) == "") > 0)
    sizes = ids.groupBy("workspace_id").agg(F.sum("n").alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), bad.alias("bad"))
    now = stored.groupBy("workspace_id").agg(F.max("revision").alias("revision"))
    rows = claims.dropDuplicates(["workspace_id"]).join(now, "workspace_id", "left").join(sizes, "workspace_id", "left").join(moved, "workspace_id", "left")
    state = F.when(F.coalesce("bad", F.lit(False)), "invalid").when(~F.col("revision").eqNullSafe(F.col("expected")), "conflict")
    state = state.when(F.col("revision").isNotNull() & (F.coalesce("moved", F.lit(0)) == 0), "unchanged").otherwise("replaced")
    return rows.select("workspace_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("bytes", F.lit(0)).alias("bytes"), state.alias("state"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def retained(items: DataFrame, now: Column, max_age: float, budget: int, time_col: str = "modified", size_col: str = "size", by: list[str] | None = None, id_col: str = "id", incoming: int = 0) -> DataFrame:
    """What stays when the oldest go, one after another, while too old or while the rest and `incoming` are over budget: the newest whose running size fits.

    Of items of one time the smaller id goes first. Items lie in ranges of time, so a store or a group of any size is summed by many tasks.
    """
    names = items.columns
    rows = running_total(items, by or [], [F.col(time_col).desc(), F.col(id_col).desc()], size_col, "__total")
    return rows.where((F.col(time_col) >= now - max_age) & (F.col("__total") + incoming <= budget)).select(*names)


def first_valid(*values: Column) -> Column:
    """The first of several names for a number that is there, finite and not negative."""
    return F.coalesce(*[F.when((v >= 0) & (F.abs(v.cast("double")) < float("inf")), v) for v in values])


def allowed_attributes(attributes: Column, names: list[str]) -> Column:
    return F.map_filter(attributes, lambda k, _: k.isin(*names))


MOST_TURNS, MOST_QUESTIONS, MOST_CONVERSATIONS = 100, 200, 1000


def append_turns(stored: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Conversations (conversation_id, turn_no, run_id, ...) with new rows, which have no turn_no, after the last of each.

    A run that is there already changes nothing. Raises where a conversation would have over MOST_TURNS turns, if strict where a run comes with another question
    than its own and, if rows have a workspace_id, where a workspace would have over MOST_CONVERSATIONS conversations.
    """
    if strict:
        seen = stored.select("conversation_id", "run_id", F.trim("question").alias("__q")).unionByName(new.select("conversation_id", "run_id", F.trim("question").alias("__q")))
        if seen.groupBy("conversation_id", "run_id").agg((F.min("__q") != F.max("__q")).alias("differ")).where("differ").limit(1).count():
            raise ValueError("a run belongs to another question")
    fresh = new.join(stored.select("conversation_id", "run_id"), ["conversation_id", "run_id"], "left_anti").dropDuplicates(["conversation_id", "run_id"])
    last = stored.groupBy("conversation_id").agg(F.max("turn_no").alias("__last"))
    order = Window.partitionBy("conversation_id").orderBy("run_id")
    fresh = fresh.join(last, "conversation_id", "left").withColumn("turn_no", (F.coalesce("__last", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("__last")
    both = stored.unionByName(fresh.select(*stored.columns))
    if both.groupBy("conversation_id").count().where(F.col("count") > MOST_TURNS).limit(1).count():
        raise ValueError(f"a conversation has {MOST_TURNS} turns at most")
    if "workspace_id" in both.columns:
        held = both.select("workspace_id", "conversation_id").distinct().groupBy("workspace_id").count()
        if held.where(F.col("count") > MOST_CONVERSATIONS).limit(1).count():
            raise ValueError(f"a workspace has {MOST_CONVERSATIONS} conversations at most")
    return both


def check_questions(questions: DataFrame) -> None:
    """Raise for a question set that is too long or repeats ids."""
    n, ids = questions.agg(F.count(F.lit(1)), F.count_distinct("question_id")).first()
    if n > MOST_QUESTIONS or ids != n:
        raise ValueError(f"a set has {MOST_QUESTIONS} questions with ids of their own")


def interrupted(batches: DataFrame, running: list[str]) -> DataFrame:
    """Batches whose status says running though no run holds them are interrupted."""
    dead = (F.col("status") == "running") & ~F.col("batch_id").isin(*(running or [""]))
    return batches.withColumn("status", F.when(dead, "interrupted").otherwise(F.col("status")))


def keyed_identity(value: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a value in hex, from built-in hashes: the same in every engine that knows the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), value.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), digest), 256)


def span_totals(spans: DataFrame) -> DataFrame:
    """(trace_id, operation): number, failures, time, and time that isn't spent in child spans."""
    inside = spans.groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("duration_ms").alias("inside"))
    own = spans.join(inside, ["trace_id", "span_id"], "left").withColumn("own", F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("inside", F.lit(0.0))))
    return own.groupBy("trace_id", "operation").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failures"), F.sum("duration_ms").alias("ms"), F.sum("own").alias("own_ms"))
