"""Which files are in scope: discovery, limits, ignore rules."""

from __future__ import annotations

import fnmatch
import os
import subprocess
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import estimated_tokens
from quarry.sources.readers import EXTENSIONS

MAX_DEPTH, INDEX_DEPTH, SCOPE_DEPTH, MOST_FILES, MOST_TOKENS = 5, 12, 20, 5000, 2_000_000
NOISE = ("test_*.py", "*_test.py", "*.pyc", "__pycache__")
SKIPPED_DIRS = frozenset("node_modules target build dist venv env __pycache__ vendor coverage site-packages out".split())


# Names that stand for folders of the user's.
SHORTCUTS = {"desktop": "~/Desktop", "documents": "~/Documents", "downloads": "~/Downloads"}


def resolve(path: str) -> str:
    """An absolute path; three shortcuts, `~` and variables are opened."""
    path = SHORTCUTS.get(path.strip().lower(), path)
    return os.path.abspath(os.path.expandvars(os.path.expanduser(path)))


def inside(path: str, roots: Sequence[str]) -> bool:
    """Whether a path is below an allowed root with no symbolic link on its way."""
    full = resolve(path)
    return os.path.realpath(full) == full and any(os.path.commonpath([full, resolve(r)]) == resolve(r) for r in roots)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of all files below a path, from the file system's metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def snapshot(files: DataFrame) -> DataFrame:
    """(path, size, modified, revision) of a listing, one row a path: what `index.source_delta` compares. A file whose size or time of change differs has another revision."""
    once = files.groupBy("path").agg(F.max(F.struct("modified", "size")).alias("of")).select("path", "of.size", "of.modified")
    stamp = F.concat_ws("\n", "path", F.col("size").cast("string"), F.unix_micros("modified").cast("string"))
    return once.withColumn("revision", F.sha2(stamp, 256))


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Whether the whole path or the base name fits a shell pattern."""
    found = F.lit(False)
    base = F.element_at(F.split(path, "/"), -1)
    for p in patterns:
        regex = fnmatch.translate(p).replace("(?s:", "(?s)(?:").replace(r"\z", "$").replace(r"\Z", "$")
        found = found | path.rlike(f"^{regex}") | base.rlike(f"^{regex}")
    return found


def discover(files: DataFrame, root: str, max_depth: int = MAX_DEPTH, include: Sequence[str] = (), exclude: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    """Files of known extensions down to a depth, hidden ones and build folders left out, by include and exclude patterns."""
    inner = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    parts = F.split(inner, "/")
    ok = (F.size(parts) <= max_depth + 1) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED_DIRS)) & F.lower("path").rlike(r"(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")
    found = files.where(F.col("path").startswith(root.rstrip("/") + "/") & ok)
    if include:
        found = found.where(matches(F.col("path"), include))
    if exclude:
        found = found.where(~matches(F.col("path"), exclude))
    return found.orderBy("path").limit(max_files) if max_files else found


def allowed_extensions(names: Iterable[str]) -> list[str]:
    out = sorted({n.lower() if n.startswith(".") else f".{n.lower()}" for n in names})
    if bad := [n for n in out if n not in EXTENSIONS]:
        raise ValueError(f"unsupported: {', '.join(bad)}")
    return out


def validate_scope(files: DataFrame, extensions: Sequence[str] | None = None, most_files: int = MOST_FILES, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Files of a scope within its budget. Tests and caches are noise, unless nothing else is there."""
    if extensions:
        files = files.where(F.concat(F.lit("."), F.element_at(F.split(F.lower("path"), r"\."), -1)).isin(*allowed_extensions(extensions)))
    clean = files.where(~matches(F.col("path"), NOISE))
    chosen = clean if clean.limit(1).count() else files
    n, total = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(estimated_tokens(F.col("size"))), F.lit(0))).first()
    if n > most_files or total > most_tokens:
        raise ValueError(f"{n} files of about {total} tokens: a scope holds {most_files} files and {most_tokens} tokens")
    return chosen


def _repository(root: str) -> bool:
    """Whether a folder is inside a work tree, told without git."""
    at = os.path.realpath(root)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return True
        if os.path.dirname(at) == at:
            return False
        at = os.path.dirname(at)


def without_ignored(files: DataFrame, root: str) -> DataFrame:
    """Files that git's ignore rules let through; outside a repository all. Asked of git on the driver, for a bounded scope.

    Inside a repository an answer that git can't give is an error: what is private stays out.
    """
    if not _repository(root):
        return files
    paths = [r["path"] for r in files.select("path").limit(MOST_FILES + 1).collect()]
    if len(paths) > MOST_FILES:
        raise ValueError(f"over {MOST_FILES} files")
    try:
        asked = subprocess.run(["git", "-C", root, "check-ignore", "--stdin", "-z"], input="\0".join(paths), capture_output=True, text=True)
    except FileNotFoundError as missing:
        raise RuntimeError("git is needed to read a repository's ignore rules") from missing
    if asked.returncode not in (0, 1):
        raise RuntimeError(f"git gave no answer about ignored files: {asked.stderr.strip()}")
    ignored = files.sparkSession.createDataFrame([(p,) for p in asked.stdout.split("\0") if p], "path string")
    return files.join(F.broadcast(ignored), "path", "left_anti")  # MOST_FILES rows at most
