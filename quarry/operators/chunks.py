"""Chunking: exact slices of a text with their offsets and headings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 700, 100
LONG_TEXT, LONG_SIZE, LONG_OVERLAP = 150_000, 1600, 250
MARKDOWN = frozenset((".md", ".markdown"))
CODE = frozenset(".py .rs .js .ts .tsx .jsx .c .h .cpp .hpp .go .java .kt .sh .bash .zsh .sql".split())

# Where a chunk may end, best first: after a blank line, a sentence, a line, a word.
_BLANK, _SENTENCE, _LINE, _SPACE = (re.compile(p) for p in (r"\n\s*\n", r"[.!?؟](?=\s)", r"\n", r"\s+"))
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_CAPTION = re.compile(r"(?:Figure|Fig\.|Table)\s+\d+[.:]\s")
_PARAGRAPH = re.compile(r"\n\s*\n|\f")
_SYMBOL = re.compile(r"\s*(?:pub\s+|pub\(crate\)\s+|async\s+|export\s+|static\s+)*(?:def|fn|class|function|struct|impl|interface|type)\s+([A-Za-z_][A-Za-z0-9_]*)")


def _last(cut: re.Pattern, text: str, start: int, limit: int, floor: int) -> int | None:
    return max((m.end() for m in cut.finditer(text, start, limit) if m.end() >= floor), default=None)


def _window_end(text: str, start: int, size: int) -> int:
    """The end of the chunk that begins at start: the best kind of place in its second half, else any space, else the limit."""
    limit = start + size
    if limit >= len(text):
        return len(text)
    places = (_last(cut, text, start, limit, start + size // 2) for cut in (_BLANK, _SENTENCE, _LINE, _SPACE))
    return next((p for p in places if p is not None), _last(_SPACE, text, start, limit, 0) or limit)


def _next_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the next chunk begins: within the overlap, at a whole paragraph or sentence if one begins there, and not inside a word."""
    at = max(start + 1, end - overlap)
    unit = _BLANK.search(text, at, end) or _SENTENCE.search(text, at, end)
    at = unit.end() if unit else at
    while at < end and not text[at - 1].isspace():
        at += 1
    return min(at, end)


def slices(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk. Chunks are trimmed of white space, and none is only that."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below it")
    start = 0
    while start < len(text):
        end = _window_end(text, start, size)
        raw = text[start:end]
        if raw.strip():
            yield start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip())
        if end == len(text):
            return
        start = _next_start(text, start, end, overlap)


def sections(text: str) -> Iterator[tuple[str, int, int]]:
    """(breadcrumb, start, end) of Markdown sections, trimmed. Headings in fenced code aren't headings."""
    trail: list[tuple[int, str]] = []
    fence, start, at = "", 0, 0

    def section(end: int) -> Iterator[tuple[str, int, int]]:
        raw = text[start:end]
        if raw.strip():
            yield " > ".join(t for _, t in trail), start + len(raw) - len(raw.lstrip()), start + len(raw.rstrip())

    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2].strip():
                fence = ""
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif heading := _HEADING.match(line):
            yield from section(max(at - 1, start))
            level = len(heading[1])
            trail = [t for t in trail if t[0] < level] + [(level, heading[2].strip())]
            start = at
        at += len(line) + 1
    yield from section(len(text))


def caption_units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each figure or table caption, and of what lies between captions."""
    breaks = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    edges = [0, *(e for _, e in breaks)]
    ends = [*(s for s, _ in breaks), len(text)]
    begun = 0
    for i, (start, end) in enumerate(zip(edges, ends)):
        if _CAPTION.match(text[start:end].strip()):
            if text[begun:start].strip():
                yield begun, start
            yield start, end
            begun = breaks[i][1] if i < len(breaks) else len(text)
    if text[begun:].strip():
        yield begun, len(text)


def first_symbol(text: str) -> str:
    return next((m[1] for m in map(_SYMBOL.match, text.split("\n")) if m), "")


def chunk_spans(text: str | None, path: str = "", size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, str, int, int]]:
    """(content, heading, start, end) by the file's kind: book-length prose in wide windows, PDF and Markdown by section, code with its first symbol."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below it")
    if not text or not text.strip():
        return []
    kind = PurePosixPath(path).suffix.lower()
    if kind not in CODE and len(text) >= LONG_TEXT:
        size, overlap = max(size, LONG_SIZE), max(overlap, LONG_OVERLAP)
    has_heading = any(_HEADING.match(line) for line in text.split("\n"))

    def within(heading: str, a: int, b: int) -> Iterator[tuple[str, str, int, int]]:
        for s, e in slices(text[a:b], size, overlap):
            yield text[a + s : a + e], heading, a + s, a + e

    if kind == ".pdf":
        parts = sections(text) if has_heading else [("", 0, len(text))]
        units = ((h, a + s, a + e) for h, a, b in parts for s, e in caption_units(text[a:b]))
        made = (c for u in units for c in within(*u))
        return [c for c in made if not all(x.startswith("# ") for x in c[0].splitlines() if x.strip())]
    if kind in MARKDOWN and has_heading:
        if made := [c for part in sections(text) for c in within(*part)]:
            return made
    named = first_symbol if kind in CODE else (lambda _: "")
    return [(c, named(c), a, b) for c, _, a, b in within("", 0, len(text))]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_id, content, heading, start_offset, end_offset); content is the slice with form feeds as spaces. Narrow: no shuffle."""
    path = F.col(path_col) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.coalesce(path, F.lit("")).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(d, n, c.replace("\f", " "), h, a, b) for d, t, p in zip(batch["doc_id"], batch["t"], batch["p"]) for n, (c, h, a, b) in enumerate(chunk_spans(t, p, size, overlap))]
            yield pd.DataFrame(made, columns=["doc_id", "chunk_id", "content", "heading", "start_offset", "end_offset"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, chunk_id int, content string, heading string, start_offset long, end_offset long")
