"""SentencePiece encoding and decoding over a table of distinct chunks.

In a vocabulary where no piece has a marker after another character, and none a line feed among others, no merge
crosses the start of a marked word or a line feed. So a text falls into chunks that are segmented independently: a run of
markers with the characters after it, or a line feed. The chunks of a corpus are counted, and the most frequent of them, as many as a table of
bounded size holds, are segmented once and sent to the tasks; a chunk that isn't among them is segmented once in each task that meets it.
Ids and decoded characters are joined back by position. Dealing the other chunks out by key would move many times the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from uuid import uuid4

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle, tidy

MARK = "▁"
_CHUNK = re.compile("\n|▁*[^▁\n]+|▁+")
_ROOM, _ROOM_IDS = 500_000, 1 << 24  # chunks, and ids of chunks, that a worker's table holds before it begins anew
_ROWS = 256  # texts encoded at a time
MOST_CHUNKS, MOST_CHUNK_BYTES = 100_000, 4 << 20  # of the corpus's table, which is sent to the tasks


def _chunks(text: str) -> list[str]:
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class _Numbers(dict):
    """Numbers a key when it is first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class ChunkCodec:
    """Encodes and decodes exactly as the library does, without begin and end ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.chunked = not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces) and self._plain()
        lead = self.model.encode("\n")  # a line feed parts what follows from the marker put before a text
        self.lead, self._feed = len(lead), lead
        self.chunked = self.chunked and len(lead) >= 2 and self.model.encode("\na")[: len(lead)] == lead
        self.key, self.base, self.first = None, ([], []), None
        self.clear()

    def _plain(self) -> bool:
        """Whether the model takes characters as they are, with one marker before the text and none removed."""
        probe = " a  ééＡﬁ \t b  "
        return self.model.decode(self.model.encode(probe)) == probe and self.model.encode("") == []

    def use(self, key: str | None, base: tuple[list[str], list[np.ndarray]]) -> None:
        """Begin with a corpus's table: its chunks and their ids. key tells tables apart."""
        if key != self.key:
            self.key, self.base = key, base
            self.first = None
            self.clear()

    def clear(self) -> None:
        """Forget all chunks but those of the corpus's table, which are numbered and decoded once."""
        if self.first is None:
            self.table = _Numbers()
            self.texts: list[str] = []
            self.plain: list[str] = []
            self.flat, self.filled = np.empty(1 << 16, np.int32), 0
            self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
            chunks, ids = self.base
            if chunks:
                self.table.update(zip(chunks, range(len(chunks))))
                self._add([x.tolist() for x in ids])
            self.first = (dict(self.table), len(self.table), self.filled)
        else:
            numbers, known, self.filled = self.first
            self.table = _Numbers(numbers)
            del self.texts[known:], self.plain[known:]
            self.flat = self.flat[: max(self.filled, 1 << 16)].copy()
            self.start, self.count = self.start[:known].copy(), self.count[:known].copy()

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks, as they are in a text."""
        return [x[self.lead :] for x in self.model.encode(["\n" + c for c in chunks], num_threads=1)]

    def _add(self, found: list[list[int]]) -> None:
        """Put the ids of the chunks that the table numbered last into it, with their decimals and what they decode to after a line feed."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        if self.filled + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.empty(len(self.flat) + total, np.int32)])
        self.flat[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        ends = self.filled + np.cumsum(sizes)
        self.filled += total
        self.start = np.concatenate([self.start, ends - sizes])
        self.count = np.concatenate([self.count, sizes])
        self.texts += [",".join(map(str, x)) for x in found]
        self.plain += [t[1:] for t in self.model.decode([self._feed + x for x in found])]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """The ids of each text, and the same in decimal joined by commas."""
        return [(ids, decimals) for ids, decimals, _ in self.both_ways(texts)]

    def both_ways(self, texts: list[str]) -> list[tuple[np.ndarray, str, str]]:
        """The ids of each text, the same in decimal joined by commas, and the text that they decode to."""
        if not self.chunked:  # another vocabulary: the library's own way
            return [(np.asarray(x, np.int32), ",".join(map(str, x)), self.decode(x)) for x in self.model.encode(texts, num_threads=1)]
        if len(self.table) > _ROOM + len(self.base[0]) or self.filled > _ROOM_IDS:
            self.clear()
        known = len(self.table)
        parts = [_chunks(t) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        place = list(map(self.table.__getitem__, chain.from_iterable(parts)))
        if len(self.table) > known:
            self._add(self.segment(list(islice(self.table, known, None))))
        at = np.array(place, np.int64)
        n = self.count[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(int(n.sum()))]
        out, i, k, text_of, plain_of = [], 0, 0, self.texts.__getitem__, self.plain.__getitem__
        for size in sizes.tolist():
            j = int(ends[i + size - 1]) if size else k
            chunks = place[i : i + size]
            out.append((ids[k:j], ",".join(map(text_of, chunks)), "".join(map(plain_of, chunks))[1:]))  # the marker before a text is no space of its own
            i, k = i + size, j
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    """The worker's codec of a model file."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def chunk_table(texts: DataFrame, model_path: str, text_col: str = "t", most: int = MOST_CHUNKS, most_bytes: int = MOST_CHUNK_BYTES) -> DataFrame:
    """(chunk, n, ids): the corpus's distinct chunks that occur most often, each segmented once.

    Tasks count what they see twice or more at least, half a million chunks at a time, and the counts are summed by chunk. The table ends at a power of two of
    occurrences, the least at which it has no more than `most` rows and `most_bytes` bytes of chunks: ties don't matter, and only a row a power meets on the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def flushed() -> pd.DataFrame:
            some = {c: n for c, n in seen.items() if n > 1}
            seen.clear()
            return pd.DataFrame({"chunk": list(some), "n": list(some.values())}).astype({"chunk": object, "n": "int64"})

        for batch in batches:
            for text in batch["t"]:
                seen.update(_chunks(text))
                if len(seen) > _ROOM:
                    yield flushed()
        yield flushed()

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = codec(model_path)
        for batch in batches:
            yield batch.assign(ids=used.segment(batch["chunk"].tolist()))

    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(tidy(count), "chunk string, n long")
    totals = settle(rows.groupBy("chunk").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n")).cast("int")
    held, sizes, least = 0, 0, None
    for row in sorted(totals.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("chunk")).alias("bytes")).collect(), reverse=True):
        held, sizes = held + row["rows"], sizes + row["bytes"]
        if held > most or sizes > most_bytes:
            break
        least = row["power"]
    kept = totals.where(power >= least) if least is not None else totals.where("false")
    return kept.mapInPandas(tidy(segment), "chunk string, n long, ids array<int>")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, corpus_table: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (array of int, if keep_ids), n_tokens, ids_sha256, decoded_sha256.

    Nulls: a null text is empty (no ids, empty decoded text), a null id is kept. Repeated rows each get a row. An empty table
    gives no rows; other columns are ignored. The model file must be at model_path on the driver and every executor.
    corpus_table: count the corpus first and segment its most frequent chunks once; without it each task segments all that it meets. Results are the same.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    key = sent = None
    if corpus_table and codec(model_path).chunked:
        table = chunk_table(texts, model_path).select("chunk", "ids").toPandas()  # MOST_CHUNKS rows at most
        key, sent = uuid4().hex, docs.sparkSession.sparkContext.broadcast((table["chunk"].tolist(), [np.asarray(x, np.int32) for x in table["ids"]]))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = codec(model_path)
        used.use(key, sent.value if sent else ([], []))
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch[i : i + _ROWS]
                found = used.both_ways(part["t"].tolist())
                out = {"doc_id": part["doc_id"], "n_tokens": [len(x) for x, _, _ in found]}
                out["ids_sha256"] = [hashlib.sha256(text.encode()).hexdigest() for _, text, _ in found]
                out["decoded_sha256"] = [hashlib.sha256(text.encode()).hexdigest() for _, _, text in found]
                if keep_ids:
                    out["ids"] = [x for x, _, _ in found]
                yield pd.DataFrame(out)
        used.clear()  # another task's rare words are mostly others

    kind = texts.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if keep_ids else ""
    return texts.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
