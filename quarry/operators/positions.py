"""Where passages are in their sources: lines, pages, cells and UTF-16 offsets, and passages found again.

Each source is read once, next to the arrays of its passages' offsets: one table of its line feeds, form feeds and wide characters is made in
one pass, and offsets are looked up in it. So a source takes time in proportion to its length, and its text is in one row only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVELS = 21  # patterns are told apart by windows of up to 2 ** 20 code points
#: Extensions of sources whose form feeds part pages or cells, and how these are named.
PAGED = {".pdf": "p.", ".ipynb": "cell "}


class OffsetTable:
    """Line feeds, form feeds and characters outside the basic plane of a text, by code point offset."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.feeds = np.flatnonzero(self.codes == 10)
        self.pages = np.flatnonzero(self.codes == 12)
        self.wide = np.flatnonzero(self.codes > 0xFFFF)

    def line(self, offsets: np.ndarray) -> np.ndarray:
        """Lines, from 1, of offsets."""
        return np.searchsorted(self.feeds, offsets, "left") + 1

    def page(self, offsets: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pages, offsets, "left") + 1

    def utf16(self, offsets: np.ndarray) -> np.ndarray:
        return offsets + np.searchsorted(self.wide, offsets, "left")


_PLACES = "array<struct<first_line: long, last_line: long, first_page: long, last_page: long, start_utf16: long, end_utf16: long, ok: boolean>>"


def _places(texts: pd.Series, starts: pd.Series, ends: pd.Series, contents: pd.Series) -> pd.Series:
    out = []
    for text, a, b, given in zip(texts, starts, ends, contents):
        text = text or ""
        table, n = OffsetTable(text), len(text)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        low, high = np.clip(a, 0, n), np.clip(b, 0, n)
        made = [table.line(low), table.line(high), table.page(low), table.page(high), table.utf16(low), table.utf16(high)]
        flat = text.replace("\f", " ")
        ok = [0 <= x < y <= n and flat[x:y] == c for x, y, c in zip(a.tolist(), b.tolist(), given)]
        out.append([dict(zip(("first_line", "last_line", "first_page", "last_page", "start_utf16", "end_utf16", "ok"), row)) for row in zip(*[m.tolist() for m in made], ok)])
    return pd.Series(out)


def _gathered(passages: DataFrame, extra: list[str]) -> DataFrame:
    """(doc_id, p): each source's passages in one array, which is no longer than the source."""
    return passages.groupBy("doc_id").agg(F.collect_list(F.struct("n", "start_offset", "end_offset", "content", *extra)).alias("p"))


def placed(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Passages (doc_id, n, start_offset, end_offset, content) with first_line, last_line, first_page, last_page, start_utf16, end_utf16, and ok: whether the source has the content there, form feeds as spaces.

    sources: doc_id, text, once each. Passages without a source have no row. Offsets beyond the text count as its ends, and aren't ok.
    """
    met = sources.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(_gathered(passages, []), "doc_id")
    parts = F.arrays_zip(F.col("p"), F.pandas_udf(_places, _PLACES)("text", F.col("p.start_offset"), F.col("p.end_offset"), F.col("p.content")).alias("w"))
    each = met.select("doc_id", F.explode(parts).alias("x"))
    found = each.select("doc_id", F.col("x")["p"].alias("p"), F.col("x")["w"].alias("w"))
    return found.select("doc_id", "p.n", "p.start_offset", "p.end_offset", "p.content", "w.*")


def location(path: Column, first_line: Column, last_line: Column, first_page: Column, last_page: Column) -> Column:
    """`p.3`, `p.3-4` or `cell 2` where a source's form feeds part pages or cells, else `L5` or `L5-L9`."""
    kind = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^./]*)$", 1))
    lines = F.when(first_line == last_line, F.concat(F.lit("L"), first_line)).otherwise(F.concat(F.lit("L"), first_line, F.lit("-L"), last_line))
    pages = F.when(first_page == last_page, first_page.cast("string")).otherwise(F.concat(first_page, F.lit("-"), last_page))
    named = lines
    for extension, word in PAGED.items():
        named = F.when(kind == extension, F.concat(F.lit(word), pages)).otherwise(named)
    return named


def lines(sources: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n, start_offset, end_offset, content) of the lines that aren't empty, n from 0, with the source's columns `more`. Nothing is shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch["text"], "\n")
            sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            content = parts.flatten()
            length = pc.utf8_length(content).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            ends = np.cumsum(length + 1)
            starts = ends - length - 1
            starts -= starts[first[owner]] if len(owner) else 0
            some = np.flatnonzero(length > 0)
            made = {"n": pa.array((np.arange(len(owner)) - first[owner])[some], pa.int32()), "start_offset": pa.array(starts[some]), "end_offset": pa.array((starts + length)[some]), "content": content.take(pa.array(some))}
            rows = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(rows), *made.values(), *(batch[name].take(rows) for name in more)], ["doc_id", *made, *more])

    kinds = dict(sources.dtypes)
    kept = "".join(f", `{name}` {kinds[name]}" for name in more)
    return sources.select("doc_id", "text", *more).mapInArrow(cut, f"doc_id {kinds['doc_id']}, n int, start_offset long, end_offset long, content string{kept}")


# ---- passages found again


class Occurrences:
    """All places of many patterns in a text, found together.

    A window of 2 ** k code points has a hash made of those of its halves, so each level is one pass over the text. A pattern is looked for at
    the greatest level that isn't longer, by the hashes of its first and its last window, which overlap or meet; places are in order. What
    agrees in both is compared as text.
    """

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, text: str, patterns: list[str]):
        self.text = text
        self.places: dict[str, np.ndarray] = {p: np.empty(0, np.int64) for p in patterns}
        by_level: dict[int, list[str]] = {}
        for p in self.places:
            if 0 < len(p) <= len(text):
                by_level.setdefault(min(len(p).bit_length(), _LEVELS) - 1, []).append(p)
        if not by_level:
            return
        at = self._codes(text)
        names = [p for group in by_level.values() for p in group]
        inside = self._codes("".join(names))  # a pattern's own windows don't reach beyond it
        starts = dict(zip(names, np.cumsum([0] + [len(p) for p in names]).tolist()))
        for level in range(max(by_level) + 1):
            if level in by_level:
                self._look(level, at, by_level[level], inside, starts)
            at, inside = self._doubled(at, 1 << level), self._doubled(inside, 1 << level)

    @classmethod
    def _codes(cls, text: str) -> np.ndarray:
        return cls._mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))

    @classmethod
    def _mixed(cls, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * cls._MIX
        return x ^ (x >> np.uint64(29))

    @classmethod
    def _doubled(cls, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of windows twice as wide."""
        if len(at) <= width:
            return at[:0]
        return cls._mixed(at[:-width] * np.uint64(0xBF58476D1CE4E5B9) + at[width:])

    def _look(self, level: int, at: np.ndarray, patterns: list[str], inside: np.ndarray, starts: dict[str, int]) -> None:
        width = 1 << level
        firsts = inside[np.array([starts[p] for p in patterns], np.int64)]
        some = np.flatnonzero(np.isin(at, np.unique(firsts)))
        some = some[np.argsort(at[some], kind="stable")]
        keys = at[some]
        begins, stops = np.searchsorted(keys, firsts, "left"), np.searchsorted(keys, firsts, "right")
        for p, a, b in zip(patterns, begins.tolist(), stops.tolist()):
            n = len(p)
            where = some[a:b]
            where = where[where + n <= len(self.text)]
            for shift in {*range(width, n - width, width), n - width}:  # patterns beyond the last level are told by all their windows
                where = where[at[where + shift] == inside[starts[p] + shift]]
            if len(where) and self.text[where[0] : where[0] + n] == p:
                self.places[p] = where

    def first_two(self, pattern: str, lower: int) -> tuple[int, int]:
        """The first place at or after `lower` and the one after that; -1 for none."""
        found = self.places.get(pattern)
        if found is None:
            return -1, -1
        k = int(np.searchsorted(found, lower))
        return (int(found[k]) if k < len(found) else -1), (int(found[k + 1]) if k + 1 < len(found) else -1)


def _line_starts(text: str) -> np.ndarray:
    """Where lines begin as `splitlines` cuts them, and the end."""
    return np.concatenate([[0], np.cumsum([len(part) for part in text.splitlines(keepends=True)], dtype=np.int64)]).astype(np.int64)


_FOUND = "array<struct<start_offset: long, end_offset: long, start_utf16: long, end_utf16: long, start_line: long, end_line: long>>"


def _found(texts: pd.Series, starts: pd.Series, ends: pd.Series, contents: pd.Series, lines_of: pd.Series) -> pd.Series:
    names = ("start_offset", "end_offset", "start_utf16", "end_utf16", "start_line", "end_line")
    out = []
    for text, a, b, given, told in zip(texts, starts, ends, contents, lines_of):
        text = text or ""
        n, table, flat = len(text), OffsetTable(text), text.replace("\f", " ")
        exact = [x is not None and y is not None and 0 <= x < y <= n and flat[x:y] == c for x, y, c in zip(a, b, given)]
        lost = [c for c, ok in zip(given, exact) if not ok and c]
        seen, begins = (Occurrences(flat, lost), _line_starts(flat)) if lost else (None, None)
        spans = []
        for x, y, c, line, ok in zip(a, b, given, told, exact):
            if ok:
                spans.append((int(x), int(y)))
                continue
            line = int(line) if line is not None and line == line and line > 0 else 0
            x, again = seen.first_two(c, int(begins[min(line - 1, len(begins) - 1)]) if line else 0) if c else (-1, -1)
            if x >= 0 and again >= 0 and not (line and table.line(np.array([again]))[0] > table.line(np.array([x]))[0]):
                x = -1  # the passage could be either
            spans.append((x, x + len(c)) if x >= 0 else (-1, -1))
        low, high = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        some = np.maximum(low, 0), np.maximum(high, 0)
        made = [low, high, table.utf16(some[0]), table.utf16(some[1]), table.line(some[0]), table.line(np.maximum(some[0], some[1] - 1))]
        out.append([dict(zip(names, row)) if row[0] >= 0 else dict.fromkeys(names) for row in zip(*[m.tolist() for m in made])])
    return pd.Series(out)


def relocated(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, n, content, start_offset, end_offset, start_utf16, end_utf16, start_line, end_line, location_verified): where passages stand in their sources.

    passages: doc_id, n, content, start_offset, end_offset, start_line (each of the last three null if not known); sources: doc_id, text, once
    each. A passage that isn't at its offsets is looked for, from the start of its line if that is known. One that stands there twice could be
    either, and has no place, unless its line is known and the second is on a later one. Form feeds count as spaces. A passage that has no place, no content or no source has nulls.
    """
    rows = passages.groupBy("doc_id").agg(F.collect_list(F.struct("n", "start_offset", "end_offset", F.coalesce("content", F.lit("")).alias("content"), F.col("start_line").cast("long").alias("start_line"))).alias("p"))
    met = rows.join(sources.select("doc_id", "text"), "doc_id", "left")
    found = F.pandas_udf(_found, _FOUND)("text", F.col("p.start_offset"), F.col("p.end_offset"), F.col("p.content"), F.col("p.start_line"))
    each = met.select("doc_id", F.explode(F.arrays_zip(F.col("p"), found.alias("w"))).alias("x"))
    each = each.select("doc_id", F.col("x")["p"]["n"].alias("n"), F.col("x")["p"]["content"].alias("content"), F.col("x")["w"].alias("w"))
    return each.select("doc_id", "n", "content", "w.*", F.col("w.start_offset").isNotNull().alias("location_verified"))
