"""SimHash near-duplicates, linked through sharded BK-trees.

1. Fingerprints: a bit is 1 if it is set in over half the XXH64 of a text's word shingles.
2. Routing: 64 bits are cut into radius + keep blocks. Two fingerprints within the radius agree on some choice of
   `keep` whole blocks, so rows dealt by each such choice meet at least once, whatever the data (pigeonhole). More
   `keep` means more, smaller buckets: 2 suits up to about 10^9 texts, 3 beyond.
3. Shards: a bucket is one BK-tree shard, built in the task that reads it; children hang on integer Hamming
   distances and a search follows only edges within the radius. A bucket of over `limit` rows is cut into S shards
   and dealt as S (S + 1) / 2 cells of two shards, so no task holds more than two and no pair of shards is left out.
   The shard trees travel with the shuffle and not from the driver: their number grows with the corpus.
4. A task gives back a spanning forest of the links it found, never all pairs; subtrees wholly in the searcher's own
   class are not entered. Components of the forests are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, settle, tasks, tidy, whole_row

SEED = 42
LIMIT = 20_000  # rows of a BK-tree shard
_BATCH = 50_000  # rows of whole buckets handled at a time
_ASKS = 8192  # searches begun at a time
_FRONTIER = 400_000  # steps of a search held at a time


# ---- fingerprints


def shingle_hashes(text: str | None, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of each shingle; a text of fewer words is one shingle, one of none has none."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        whole = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
        shingles = [whole[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    if distinct:
        shingles = set(shingles)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = 3, distinct: bool = False) -> int:
    """The 64-bit SimHash, unsigned. Null and wordless texts: 0."""
    return _majority(shingle_hashes(text, words, distinct))


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, signed."""
    return _signed(_majority(hashes))


# ---- BK-trees, all those of a batch of buckets at once


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the classes of a[i] and b[i]; root[x] is x's class, its lowest row."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class Forest:
    """A BK-tree for each bucket: rows with equal `bucket` share a tree whose root is its first row."""

    def __init__(self, bucket: np.ndarray, bits: np.ndarray):
        n = len(bits)
        self.bits = bits
        first = np.concatenate(([True], bucket[1:] != bucket[:-1])) if n else np.empty(0, bool)
        self.top = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.empty(0, np.int64)
        self.parent, self.edge, self.levels = np.full(n, -1, np.int64), np.zeros(n, np.int64), []
        left, at = np.flatnonzero(~first), self.top[~first]
        while len(left):
            far = np.bitwise_count(bits[left] ^ bits[at]).astype(np.int64)
            order = np.lexsort((left, far, at))
            left, at, far = left[order], at[order], far[order]
            lead = np.concatenate(([True], (at[1:] != at[:-1]) | (far[1:] != far[:-1])))
            nodes = left[lead]
            self.parent[nodes], self.edge[nodes] = at[lead], far[lead]
            self.levels.append(nodes)
            at = nodes[np.cumsum(lead) - 1]
            left, at = left[~lead], at[~lead]
        # children of a node by edge: node * 65 + edge is sorted
        order = np.argsort(self.parent * 65 + self.edge, kind="stable")
        self.kids = order[self.parent[order] >= 0]
        self.keys = self.parent[self.kids] * 65 + self.edge[self.kids]

    def classes(self, radius: int) -> np.ndarray:
        """Class of each row: rows of a tree within the radius are linked, and links are followed."""
        n, parent = len(self.bits), self.parent
        root = np.arange(n)
        held = np.flatnonzero((parent >= 0) & (self.edge <= radius))
        root = _join(root, held, parent[held])
        alone = np.bincount(self.top, minlength=n)[self.top] == 1 if n else np.empty(0, bool)
        asks = np.flatnonzero(~alone)
        for i in range(0, len(asks), _ASKS):
            item = asks[i : i + _ASKS]
            root = self._search(item, self.top[item], radius, root)
        return root

    def _search(self, item: np.ndarray, node: np.ndarray, radius: int, root: np.ndarray) -> np.ndarray:
        """Follow edges within the radius, a piece of the frontier at a time and the last piece first, so that memory is bounded."""
        whole = self._uniform(root)
        stack = [(item, node)]
        while stack:
            item, node = stack.pop()
            skip = whole[node] & (root[node] == root[item])
            item, node = item[~skip], node[~skip]
            if not len(item):
                continue
            far = np.bitwise_count(self.bits[item] ^ self.bits[node]).astype(np.int64)
            hit = (far <= radius) & (root[item] != root[node])
            if hit.any():
                root = _join(root, item[hit], node[hit])
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), "right")
            count = high - low
            total = int(count.sum())
            if not total:
                continue
            at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
            item, node = np.repeat(item, count), self.kids[at]
            stack += [(item[i : i + _FRONTIER], node[i : i + _FRONTIER]) for i in range(0, total, _FRONTIER)]
        return root

    def _uniform(self, root: np.ndarray) -> np.ndarray:
        """Whether a node's whole subtree is in the node's own class."""
        whole = np.ones(len(root), bool)
        for nodes in reversed(self.levels):
            up = self.parent[nodes]
            bad = ~whole[nodes] | (root[nodes] != root[up])
            whole[up[bad]] = False
        return whole


def _linked(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            root = Forest(frame["cell"].to_numpy(), frame["bits"].to_numpy().view(np.uint64)).classes(radius)
            ids = frame["id"].to_numpy()
            out = np.flatnonzero(ids[root] != ids)
            return pd.DataFrame({"a": ids[out], "b": ids[root][out]})

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < _BATCH:
                continue
            frame = pd.concat(held, ignore_index=True)
            cells = frame["cell"].to_numpy()
            cut = int(np.searchsorted(cells, cells[-1], "left"))  # the last bucket may go on
            if cut:
                yield solve(frame[:cut])
            held, size = [frame[cut:].reset_index(drop=True)], len(frame) - cut
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def block_masks(radius: int, keep: int) -> list[int]:
    """Bit masks of every choice of `keep` of radius + keep blocks."""
    n = radius + keep
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, keep)]


def tree_links(prints: DataFrame, radius: int, keep: int = 2, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect what bits within the radius connect, each id to the first of its class in a tree. prints: id, bits (signed long)."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(radius, keep)])
    rows = prints.select("id", "bits", F.posexplode(masks).alias("table", "mask"))
    rows = rows.select("id", "bits", F.xxhash64("table", F.col("bits").bitwiseAND(F.col("mask"))).alias("key"))
    # buckets over the limit, to be cut into shards
    big = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("s"))
    rows = rows.join(settle(big), "key", "left")
    mine = F.pmod(F.xxhash64("bits", "id"), F.col("s").cast("long")).cast("int")
    others = F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("s") - 1))
    rows = rows.withColumn("mine", F.coalesce(mine, F.lit(0))).select("id", "bits", "key", "mine", F.explode(others).alias("other"))
    rows = rows.select("id", "bits", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    dealt = rows.repartition(tasks(prints.sparkSession), "cell").sortWithinPartitions("cell", "id")
    return dealt.mapInPandas(tidy(_linked(radius)), "a long, b long")


def linked_classes(prints: DataFrame, radius: int, keep: int = 2, limit: int = LIMIT) -> DataFrame:
    """(a, b) for each id a whose class has a smaller id b, b the smallest. prints: id, bits (signed long).

    Two prints are linked if their bits differ in at most `radius` places; links are followed. Prints should be
    distinct; repeated ones are linked like others.
    """
    return components(tree_links(prints, radius, keep, limit))


# ---- the operator


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distinct: bool = False, radius: int = 3, keep: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Texts link if their SimHashes over `words`-word shingles (each distinct one once, if `distinct`) differ in at most
    `radius` bits.
    Nulls: a null text counts as empty and an empty text has fingerprint zero, linked like any other; a row with a
    null id is no one's link and has a null component_id. Repeated rows and ids each get a row, classed by its own text. An empty table gives no rows; other columns are ignored.
    """

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bits": [_signed(fingerprint(t, words, distinct)) for t in batch["t"]]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = settle(texts.mapInPandas(tidy(prints), "doc_id long, bits long"))
    # equal prints are one node, named by its smallest id
    nodes = settle(found.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("id")))
    links = linked_classes(nodes.select("id", "bits"), radius, keep)
    named = nodes.join(links, nodes["id"] == links["a"], "left").select("bits", F.coalesce("b", "id").alias("component_id"))
    return found.join(named, "bits", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is its class's smallest, all columns kept. A row with a null id stays."""
    found = near_duplicates(docs, id_col, text_col, **how)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    own = F.col(id_col).cast("long").alias("own")
    return docs.select(whole_row(docs), own).join(gone, F.col("own") == F.col("doc_id"), "left_anti").select("row.*")
