"""Token ids in Simple-8b files.

A file is a series of blocks of whole documents in ascending id order, kept as rows of a Parquet table that Spark's writer
commits, so a lost task leaves nothing half written. A block holds, little-endian:

    magic "QS8B", version u32, documents u32, ids u64, ranks u32, groups u32
    i64 id and u8 null flag of each document, u32 length of each document
    u32 id of each rank: ids are coded as their rank by frequency in the block, so that common ones take few bits
    u32 end, in words, of each group of 4,096 ids: any group can be decoded by itself
    u64 words

A word's top 4 bits are its selector; the rest holds that many values of that width. Selector 15 is an escape: the next
word is one raw value of any size. The last word of a group is filled up with zeros, which the group's count leaves out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count as numbers, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scratch, tasks, tidy

# Fixed values of the format: values a word holds, and their width in bits, for selectors 0 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 40, 60)
ESCAPE = 15
GROUP = 4096  # ids between two offsets
BLOCK = 1 << 17  # ids after which a block is closed
_ROOM, _ROOM_IDS = 800_000, 1 << 24  # words, and ids of words, that a worker's table holds before it begins anew
_CHARS = 1 << 22  # characters tokenized at a time, whole documents
_HEAD = struct.Struct("<4sIIQII")
_COUNT = np.array([*COUNTS, 1], np.int64)


def _selectors(values: np.ndarray) -> np.ndarray:
    """The narrowest selector that fits at each position, were a word to begin there. Values past a group's end are zeros.

    A value's class is the first selector wide enough for it, and a selector fits if no class among the values it would hold is
    higher. Selectors later on hold fewer and wider values, so the first that fits is as many as don't.
    """
    n = len(values)
    groups = -(-n // GROUP)
    small = values.astype(np.uint32) if values.max() < 1 << 32 else values
    flat = np.zeros(n, np.uint8)
    for width in WIDTHS:
        if int(small.max()) >> width:
            flat += small >= small.dtype.type(1 << width)
    classes = np.zeros((groups, GROUP + max(COUNTS)), np.uint8)
    padded = np.zeros(groups * GROUP, np.uint8)
    padded[:n] = flat
    classes[:, :GROUP] = padded.reshape(groups, GROUP)
    highest = {1: classes}  # by number of values: the highest class among so many from each position on
    for count in sorted(set(COUNTS) - {1}):
        half = min(k for k in highest if 2 * k >= count)
        out, shift = highest[half].copy(), count - half
        np.maximum(out[:, :-shift], highest[half][:, shift:], out=out[:, :-shift])
        highest[count] = out
    best = np.zeros((groups, GROUP), np.uint8)
    for selector, count in enumerate(COUNTS):
        best += highest[count][:, :GROUP] > selector
    return best.reshape(-1)[:n]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of the values, and the end of each group in words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    group_end = np.minimum((np.arange(n) // GROUP + 1) * GROUP, n)
    best = _selectors(values)
    hop = np.minimum(np.arange(n) + _COUNT[best], group_end)
    begins, at = np.zeros(n, bool), np.arange(0, n, GROUP)
    while len(at):  # from word to word, in all groups at once
        begins[at] = True
        at = hop[at]
        at = at[(at % GROUP != 0) & (at < n)]
    starts = np.flatnonzero(begins)
    selector = best[starts].astype(np.int64)
    extra = selector == ESCAPE
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(extra)[:-1]))
    words = np.zeros(len(starts) + int(extra.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(max(COUNTS), np.uint64)])
    ends = group_end[starts]
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        for k in range(count):
            at = starts[mine] + k
            word |= np.where(at < ends[mine], padded[at], np.uint64(0)) << np.uint64(k * width)
        words[place[mine]] = word
    words[place[extra]] = np.uint64(ESCAPE << 60)
    words[place[extra] + 1] = values[starts[extra]]
    after = place + 1 + extra
    last = np.concatenate([starts[1:] // GROUP != starts[:-1] // GROUP, [True]])
    return words, after[last].astype(np.uint32)


def unpack(words: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The n values, a selector at a time over all words."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word is no selector: walk from escape to escape
        at = 0
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if i >= at:
                raw[i + 1] = True
                at = i + 2
    head = np.flatnonzero(~raw)
    kinds = selector[head]
    counts = _COUNT[kinds]
    group = np.searchsorted(ends, head, "right")
    before = np.cumsum(counts) - counts
    first = np.searchsorted(group, np.arange(len(ends)), "left")
    at = before - before[first][group] + group * GROUP  # counts of a group's last word may overshoot
    stop = np.minimum((group + 1) * GROUP, n)
    for s in range(ESCAPE + 1):
        mine = np.flatnonzero(kinds == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            out[at[mine]] = words[head[mine] + 1]
            continue
        count, width = COUNTS[s], WIDTHS[s]
        k = np.arange(count)
        values = (words[head[mine]][:, None] >> (k * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        to = at[mine][:, None] + k
        ok = to < stop[mine][:, None]
        out[to[ok]] = values[ok]
    return out


def write_block(ids: list[int | None], lengths: np.ndarray, flat: np.ndarray) -> bytes:
    """A block of documents: their ids, token counts and all token ids one after another."""
    times = np.bincount(flat, minlength=1)  # token ids are places in a vocabulary
    ranked = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    rank = np.zeros(len(times), np.uint64)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint64)
    words, ends = pack(rank[flat])
    return b"".join(
        [
            _HEAD.pack(b"QS8B", 1, len(ids), len(flat), len(ranked), len(ends)),
            np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], np.uint8).tobytes(),
            lengths.astype("<u4").tobytes(),
            ranked.astype("<u4").tobytes(),
            ends.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What write_block was given."""
    magic, version, docs, n, ranks, groups = _HEAD.unpack_from(block)
    if (magic, version) != (b"QS8B", 1):
        raise ValueError("not a block of this format")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    ids, none = take("<i8", docs), take("u1", docs)
    lengths, kinds, ends = take("<u4", docs), take("<u4", ranks), take("<u4", groups)
    values = unpack(np.frombuffer(block, "<u8", -1, at), ends, n)
    names = [None if z else i for i, z in zip(ids.tolist(), none.tolist())]
    return names, lengths, kinds[values.astype(np.int64)] if n else np.empty(0, np.uint32)


#: Words of one pre-token of Latin letters, or two with marks after them.
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+([.,;:!?%&*$#|]+)?")
#: Pre-tokens by which one ends, in any text, between a letter and a mark of _END.
_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,;:!?%&*$#|])"
#: Capitals that don't compose with a combining mark as their small letters do, so that case and NFC don't commute.
_CAPITAL = r"[HJTWY][^\x{0}-\x{2ff}]*[\x{308}\x{30a}\x{30c}\x{331}]"


class WordTokenizer:
    """Ids as the tokenizers library gives them; a word between ASCII white space is tokenized once, without the marks after it if those are pre-tokens of their own.

    Only for vocabularies whose normaliser folds white space and whose pre-tokenizer drops it (checked on loading):
    there no token reaches over it. Others are tokenized text by text.
    """

    def __init__(self, path: str):
        self.model = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and splits[0].get("behavior") == "Removed" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 for t in spec["added_tokens"])
        self.cuts = splits[0].get("pattern") == {"Regex": _SPLITS}
        self.added = [t["content"].lower() for t in spec["added_tokens"]]  # they match a text as it is, not its lower case
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.table, self.filled = defaultdict(numbers().__next__), 0  # words are numbered as they come
        self.flat = np.empty(1 << 16, np.uint32)
        self.start, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)  # ids of a batch beyond _ROOM_IDS at most, and a text has under 2**31 characters

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Tokenize the words that the table numbered last, simple ones many at a time: they are one or two pre-tokens, each of which ends with an end-of-word token."""
        simple = [_SIMPLE.fullmatch(w) for w in words]
        easy = [w for w, m in zip(words, simple) if m]
        sizes = np.zeros(len(words), np.int64)
        is_easy = np.fromiter((m is not None for m in simple), bool, len(words))
        joined = np.fromiter(chain.from_iterable(self._ids([" ".join(easy[i : i + 100]) for i in range(0, len(easy), 100)])), np.uint32)
        pieces = np.fromiter((2 if m[1] else 1 for m in simple if m), np.int64, len(easy))
        stops = np.flatnonzero(self.ends_word[joined]) + 1
        if len(stops) != pieces.sum():  # not as expected: a word at a time
            is_easy[:] = False
            joined = joined[:0]
        else:
            sizes[is_easy] = np.diff(stops[np.cumsum(pieces) - 1], prepend=0)
        rest = self._ids([w for w, e in zip(words, is_easy.tolist()) if not e])
        sizes[~is_easy] = list(map(len, rest))
        total, ends = int(sizes.sum()), np.cumsum(sizes)
        owner = np.repeat(is_easy, sizes)
        found = np.empty(total, np.uint32)
        found[owner] = joined
        found[~owner] = np.fromiter(chain.from_iterable(rest), np.uint32)
        if self.filled + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.filled + total))
        self.flat[self.filled : self.filled + total] = found
        known = len(self.table) - len(words)
        if len(self.table) > len(self.start):
            room = 2 * len(self.table)
            self.start, self.count = np.resize(self.start, room), np.resize(self.count, room)
        self.start[known : len(self.table)] = self.filled + ends - sizes
        self.count[known : len(self.table)] = sizes
        self.filled += total

    def _words(self, texts: list[str]) -> pa.ListArray:
        """The words of each text, A-Z in lower case as the normaliser has them in the end and marks cut off; they stay as they are in texts with an added token in any case, or a capital of _CAPITAL."""
        whole = pa.array(texts, pa.string())
        low = pc.ascii_lower(whole)
        stays = pc.match_substring_regex(whole, _CAPITAL)
        for token in self.added:
            stays = pc.or_(stays, pc.match_substring(low, token, ignore_case=True))
        if self.cuts and whole.nbytes < 1 << 30:  # spaces make texts longer, and Arrow's have 2**31 bytes at most
            low = pc.replace_substring_regex(low, _END, r"\1 \2")
        return pc.ascii_split_whitespace(pc.if_else(stays, whole, low))

    @staticmethod
    def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """start, start + 1, ... of so many each, one after another."""
        ends = np.cumsum(count, dtype=np.int32)
        return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's."""
        if not self.by_word:
            ids = self._ids(texts)
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self.table) > _ROOM or self.filled > _ROOM_IDS:
            self.clear()
        known = len(self.table)
        parts = self._words(texts)
        sizes = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        words = parts.flatten().dictionary_encode()  # a word of the batch is looked up once
        place = np.fromiter(map(self.table.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(words.dictionary))
        at = words.indices.to_numpy()
        if len(self.table) > known:
            self._learn(list(islice(self.table, known, None)))
        # the ids of the batch's words one after another: a short table, from which the texts' ids are taken
        own = self._spread(self.start[place], self.count[place])
        near, n = self.flat[own], self.count[place][at]
        first = np.cumsum(self.count[place], dtype=np.int32) - self.count[place]
        ids = near[self._spread(first[at], n)]
        edge = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids, np.diff(edge)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


_BLOCKS = "part int, block int, documents long, before long, ids long, payload binary"  # before: ids of the part before the block


def write_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append end_id, and write the blocks to folder, parts and blocks in ascending id order.

    Rows are range-partitioned by id and sorted within a partition, so that part numbers follow ids. Null ids come first;
    rows with one id are in order of a hash of their texts. A null text is empty.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, part, number = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list = []
        flat: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = before = 0

        def block() -> pd.DataFrame:
            nonlocal names, flat, lengths, held, number, before
            payload = write_block(names, np.concatenate(lengths), np.concatenate(flat))
            out = pd.DataFrame({"part": [part], "block": [number], "documents": [len(names)], "before": [before], "ids": [held], "payload": [payload]})
            names, flat, lengths, held, number, before = [], [], [], 0, number + 1, before + held
            return out

        for batch in batches:
            size = batch["t"].str.len().cumsum() // _CHARS
            for _, rows in batch.groupby(size, sort=True):
                ids, sizes = used.encode(rows["t"].tolist())
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                names += [None if z else int(x) for x, z in zip(rows["id"], rows["none"])]
                flat.append(ids)
                lengths.append(sizes + 1)
                held += len(ids)
                if held >= BLOCK:
                    yield block()
        if names:
            yield block()

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(id_col).isNull().alias("none"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    ).withColumn("tie", F.xxhash64("t"))
    order = [F.col("none").desc(), F.col("id"), F.col("tie")]
    dealt = rows.repartitionByRange(tasks(docs.sparkSession), F.col("none").desc(), "id").sortWithinPartitions(*order)
    dealt.select("id", "none", "t").mapInPandas(run, _BLOCKS).write.parquet(folder)
    return folder


def read_files(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (if keep_ids)."""
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    sizes = blocks.groupBy("part").agg(F.sum("ids").alias("ids")).collect()  # one row a part
    starts, total = [], 0
    for part, n in sorted((r["part"], r["ids"]) for r in sizes):
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, earlier long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload in zip(batch["start"], batch["payload"]):
                names, lengths, ids = read_block(payload)
                ends = np.cumsum(lengths.astype(np.int64))
                own = [ids[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                out = {
                    "doc_id": pd.array(names, dtype="Int64"),
                    "start": start + ends - lengths,
                    "n_tokens": lengths.astype(np.int64),
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in own],
                }
                if keep_ids:
                    out["ids"] = [x.astype(np.int64) for x in own]
                yield pd.DataFrame(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    placed = blocks.join(F.broadcast(offsets), "part").select((F.col("earlier") + F.col("before")).alias("start"), "payload")
    return placed.mapInPandas(run, schema)


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, **columns) -> DataFrame:
    """Write docs to a new folder of the shared one and read the files back.

    An empty table gives no rows; repeated rows each get theirs; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{scratch(spark, 'packed-ids')}/blocks"
    return read_files(spark, write_files(docs, tokenizer_path, folder, **columns), keep_ids)
