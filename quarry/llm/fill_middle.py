"""Fill-in-the-middle: texts cut between lines into prefix, middle and suffix, and put together with markers.

A batch of texts is one UTF-8 buffer with a start for each text, and all its rows are cut together: bytes are classed by a lookup
table, a line begins where a text does or the byte before is a line feed, running sums over the buffer that begin anew with each
text number lines and code points, and a search in the sums finds every row's cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_FEED, _OPEN, _CLOSE, _NAME, _INNER = 1, 2, 4, 8, 16  # classes of bytes
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[ord("\n")] = _FEED
_CLASSES[ord("<")], _CLASSES[ord(">")] = _OPEN, _CLOSE
_CLASSES[[ord(c) for c in "PSM"]] = _NAME
_CLASSES[0x80:0xC0] = _INNER  # bytes inside a code point


class Buffer:
    """The texts of an Arrow column: their bytes, where each starts (and one place more, the end), and the bytes' classes."""

    def __init__(self, column: pa.Array):
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, places, data = column.buffers()
        starts = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        first, last = int(starts[0]), int(starts[-1])
        self.bytes = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.empty(0, np.uint8)
        self.starts = starts - first
        self.kinds = _CLASSES[self.bytes]

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many places of the buffer before each are set."""
        out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def lines(self) -> np.ndarray:
        """Where lines begin."""
        begins = np.zeros(len(self.bytes), bool)
        begins[1:] = self.kinds[:-1] == _FEED
        begins[self.starts[:-1][self.starts[:-1] < self.starts[1:]]] = True
        return begins

    def markers(self) -> tuple[np.ndarray, np.ndarray]:
        """Where markers are, and their rows."""
        k = self.kinds
        at = np.flatnonzero((k[:-2] == _OPEN) & (k[1:-1] == _NAME) & (k[2:] == _CLOSE)) if len(k) > 2 else np.empty(0, np.int64)
        rows = np.searchsorted(self.starts, at, "right") - 1
        whole = at + 3 <= self.starts[rows + 1]
        return at[whole], rows[whole]


def _built(pieces: list, sizes: np.ndarray) -> pa.Array:
    """A column of texts from the bytes of all rows in turn."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(b"".join(pieces))).cast(pa.string())


def cut(column: pa.Array, draws: np.ndarray, fim_percent: int, spm_percent: int) -> dict[str, pa.Array]:
    """All rows' outputs. draws: four numbers a row; the first two place the cuts, the others choose plain and the order of parts."""
    texts = Buffer(column)
    starts, ends = texts.starts[:-1], texts.starts[1:]
    lines = texts.sums(texts.lines())
    n = (lines[ends] - lines[starts]).astype(np.int64)
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    # the first place with more lines begun before it or at it than the text's own before the cut
    place = lambda k: np.searchsorted(lines[1:], lines[starts] + k, "right")
    low, high = place(np.minimum(one, two)), place(np.maximum(one, two))
    low, high = np.minimum(low, ends), np.minimum(high, ends)
    plain = (starts == ends) | (draws[:, 2] % 100 >= fim_percent)
    plain[texts.markers()[1]] = True
    spm = draws[:, 3] % 100 < spm_percent
    chars = texts.sums(texts.kinds != _INNER)
    data, pieces = memoryview(texts.bytes), []
    for a, b, c, d, is_plain, is_spm in zip(starts.tolist(), low.tolist(), high.tolist(), ends.tolist(), plain.tolist(), spm.tolist()):
        if is_plain:
            pieces.append(data[a:d])
        elif is_spm:
            pieces += (SUFFIX, data[c:d], PREFIX, data[a:b], MIDDLE, data[b:c])
        else:
            pieces += (PREFIX, data[a:b], SUFFIX, data[c:d], MIDDLE, data[b:c])
    counted = lambda x, y: pa.array((chars[y] - chars[x]).astype(np.int64), mask=plain)
    return {
        "n": pa.array(n),
        "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))),
        "prefix_chars": counted(starts, low),
        "middle_chars": counted(low, high),
        "output": _built(pieces, ends - starts + np.where(plain, 0, 9)),
    }


def rebuilt(column: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts from outputs and their forms. The markers of an output are its only ones, and the first is at its start."""
    texts = Buffer(column)
    at, rows = texts.markers()
    made = form != "plain"
    at = at[made[rows]]
    if len(at) != 3 * int(made.sum()):
        raise ValueError("an output has three markers")
    marks = np.zeros((len(form), 3), np.int64)
    marks[made] = at.reshape(-1, 3)
    data, pieces = memoryview(texts.bytes), []
    for a, d, kind, (_, p, q) in zip(texts.starts[:-1].tolist(), texts.starts[1:].tolist(), form.tolist(), marks.tolist()):
        if kind == "plain":
            pieces.append(data[a:d])
        elif kind == "spm":
            pieces += (data[p + 3 : q], data[q + 3 : d], data[a + 3 : p])
        else:
            pieces += (data[a + 3 : p], data[q + 3 : d], data[p + 3 : q])
    return _built(pieces, np.diff(texts.starts) - np.where(made, 9, 0))


def transform(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Draws are the first four groups of eight digits of the hex SHA-256 of `seed:doc_id`, so a document is cut alike in every run.
    Nulls: a null text is empty and plain; a null id draws as the empty one. Texts with a marker are plain. Repeated rows each get a
    row, the same. An empty table gives no rows; other columns are ignored. A batch is bounded in bytes, and a text alone may be over it.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cut(batch["t"], np.stack([batch[f"h{i}"].to_numpy() for i in range(4)], axis=1), fim_percent, spm_percent)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *found.values()], ["doc_id", *found])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, into: str = "restored") -> DataFrame:
    """outputs (form, output, others) with the text that each was made of. Null outputs count as empty plain ones."""
    names = outputs.columns
    form, text = F.coalesce(F.col("form"), F.lit("plain")).alias("__form"), F.coalesce(F.col("output"), F.lit("")).alias("__output")
    rows = outputs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "output"]).alias("row"), form, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rebuilt(batch["__output"], batch["__form"].to_numpy(zero_copy_only=False).astype(str))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["__output"], made], ["row", "__output", "__made"])

    back = rows.mapInArrow(tidy(run), f"row {rows.schema['row'].dataType.simpleString()}, __output string, __made string")
    return back.select(*[F.col("__output").alias(c) if c == "output" else F.col(f"row.`{c}`") for c in names], F.col("__made").alias(into))
