"""An index on disk: generations, deltas and refresh."""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RebuildRequired(RuntimeError):
    """What is stored can't be used as it is."""


def scope_fingerprint(paths: DataFrame, by: list[str] | None = None, path_col: str = "path") -> DataFrame:
    """The first 16 hex digits of the SHA-256 of the sorted paths, for each scope."""
    digest = F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(path_col)), "\n"), 256), 1, 16)
    return paths.groupBy(*(by or [])).agg(digest.alias("fingerprint"))


def index_key(*parts: Column) -> Column:
    """The first 8 hex digits of the MD5 of path, provider and model."""
    return F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 8)


def source_delta(before: DataFrame, now: DataFrame, key: str = "path", stamp: list[str] | None = None) -> DataFrame:
    """(path, change) of what was added, changed or removed."""
    stamp = stamp or ["revision"]
    a = before.select(key, F.struct(*stamp).alias("was"))
    b = now.select(key, F.struct(*stamp).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def refresh(stored: DataFrame, delta: DataFrame, made: DataFrame, key: str = "path") -> DataFrame:
    """Stored rows of unchanged sources with the new rows of the others: nothing fresh is made again."""
    return stored.join(delta.select(key), key, "left_anti").unionByName(made)


def embed_once(passages: DataFrame, embed, text_col: str = "content") -> DataFrame:
    """passages with `vector`: each distinct text is embedded once. embed: DataFrame(text) -> DataFrame(text, vector)."""
    vectors = embed(passages.select(F.col(text_col).alias("text")).distinct())
    return passages.join(vectors, passages[text_col] == vectors["text"], "left").drop("text")


class Generations:
    """Versions of a table below a folder on the driver's disk or a mounted one. Readers keep the version they opened.

    A new version is written beside the others and becomes current by one atomic replacement of a pointer; the one before stays.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    @property
    def pointer(self) -> str:
        return os.path.join(self.folder, "current.json")

    def manifest(self) -> dict | None:
        try:
            with open(self.pointer, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def publish(self, rows: DataFrame, stamp: dict, expected: str | None = None) -> dict:
        """Write a version and make it current, unless another was published since `expected`. An empty table is refused."""
        name = f"generation-{uuid4().hex}"
        path = os.path.join(self.folder, f"writing-{name}")  # no other publisher clears it away
        rows.write.mode("errorifexists").parquet(path)
        n = self.spark.read.parquet(path).count()
        with open(os.path.join(self.folder, "publish.lock"), "w", encoding="utf-8") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)  # what is read, compared and replaced is one publisher's; a lost one's lock goes with it
            now = self.manifest()
            if not n or (expected is not None and (now or {}).get("generation") != expected):
                shutil.rmtree(path, ignore_errors=True)
                if not n:
                    raise ValueError("an index can't be empty")
                raise RebuildRequired("another version was published meanwhile")
            made = {"generation": name, "previous": (now or {}).get("generation"), "rows": n, "stamp": stamp, "published": time.time()}
            os.rename(path, os.path.join(self.folder, name))
            write_json_atomic(self.pointer, made)
        for old in os.listdir(self.folder):
            if old.startswith("generation-") and old not in (name, made["previous"]):
                shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)
        return made

    def open(self, stamp: dict | None = None) -> DataFrame:
        """The current version; RebuildRequired if there is none, its stamp is another or rows are missing."""
        now = self.manifest()
        if now is None or (stamp is not None and now["stamp"] != stamp):
            raise RebuildRequired("no version with this stamp")
        rows = self.spark.read.parquet(os.path.join(self.folder, now["generation"]))
        if rows.count() != now["rows"]:
            raise RebuildRequired("the version isn't whole")
        return rows

    def clear(self) -> None:
        """Forget all versions."""
        shutil.rmtree(self.folder, ignore_errors=True)
        os.makedirs(self.folder, exist_ok=True)

    def open_or_build(self, stamp: dict, build) -> DataFrame:
        try:
            return self.open(stamp)
        except RebuildRequired:
            before = self.manifest()
            self.publish(build(), stamp, before["generation"] if before else None)
            return self.open(stamp)


def write_json_atomic(path: str, value) -> None:
    staged = f"{path}.{uuid4().hex}"
    with open(staged, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(staged, path)


class Registry:
    """Persisted tables by key, the least recently used given up beyond `most`; those in use stay."""

    def __init__(self, most: int = 8):
        self.most, self.held, self.uses = most, {}, {}

    def acquire(self, key: str, make) -> DataFrame:
        if key not in self.held:
            self.held[key] = make().persist()
        self.held[key] = self.held.pop(key)
        self.uses[key] = self.uses.get(key, 0) + 1
        for old in [k for k in self.held if not self.uses.get(k)][: max(0, len(self.held) - self.most)]:
            self.held.pop(old).unpersist()
        return self.held[key]

    def release(self, key: str) -> None:
        self.uses[key] = max(0, self.uses.get(key, 0) - 1)
