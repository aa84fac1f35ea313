"""Texts linked by the exact Jaccard similarity of their distinct word shingles, without comparing all pairs.

1. Prefix filter: all texts order their shingles in one way. Two sets with a similarity of at least 4/5 share one of the
   first n - ceil(4 n / 5) + 1 shingles of each, whatever the order, so no such pair is left out. The order puts shingles
   that many texts have last, so that boilerplate makes no large buckets. Each task counts all its texts' shingles and gives those
   that it meets more than once; their sums over all tasks decide the cost and no link.
2. Buckets of texts that share such a shingle: small ones give all their pairs, large ones the pairs with their first text.
   A bucket that the counts expect to be over `limit` is dealt as several, whose first texts are paired in turn.
   A frequent shingle that all its texts have right after the same other one in the order adds no pair to that one's bucket, and goes.
3. A pair that can't be similar is left out by a bound: the parities of classes of shingles, a class for each
   shingle at least, differ in no more places than the sets do. The others are checked on the whole sets, which are read
   from the texts again for those that are left, and components are taken of the pairs that pass.
4. In large buckets, pairs of texts in different components follow, in cells of two shards, by the same bound and check:
   first only those that join all that the bound lets pass, then all that are left between components. A bucket over `limit` is cut
   by bands of set sizes first: sets of bands that aren't neighbours can't be similar and never meet.

Similarity is that of 64-bit hashes of the shingles, which are sums over the hashes of their words: a word is hashed once in some MB of
text, and a shingle's words once multiplied by their places, all texts of a batch together. Candidates from elsewhere can be given; they are checked like the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, gathered, settle, stored, tasks, tidy, whole_row
from quarry.llm.simhash import SEED, _join, _signed

SMALL = 8  # texts of a bucket whose pairs are all given at once
LIMIT = 20_000  # texts of a shard of a large bucket
OFTEN = 2  # texts of a task that have a shingle for it to be counted over all
_BLOCK = 1 << 22  # shingles counted at a time
MOST_HOT = 100_000  # shingles that go last, or a few more
MOST_IDS = 2_000_000  # ids that are broadcast
CLASSES = 512  # parity bits of a set at least, and those that a cell compares
_BATCH = 50_000  # rows of whole buckets handled at a time
_CHECKS = 1_000  # pairs whose sets a task holds in turn
_PAIRS = 1 << 18  # pairs looked at at a time
_TEXT = 1 << 22  # characters of whole texts hashed at a time


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return next(shingle_sets([text], words))


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, as sorted hashes; a text of fewer words is one shingle, one of none has none."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= _TEXT:
            yield from _hashed(held, words)
            held, size = [], 0
    yield from _hashed(held, words)


def _hashed(texts: list[str], words: int) -> Iterator[np.ndarray]:
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))  # A-Z and ASCII white space only
    found = pc.ascii_split_whitespace(bare)
    coded = found.flatten().dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known), np.uint64, len(known))[coded.indices.to_numpy()]
    place = np.array([xxhash.xxh64_intdigest(b"%d" % k, SEED) | 1 for k in range(words)], np.uint64)  # odd: shingles that differ in one word never meet
    sums = each * place[0]
    for k in range(1, min(words, len(each))):
        sums[:-k] += each[k:] * place[k]
    sums = _mixed(sums)
    at, blank = found.offsets.to_numpy().tolist(), pc.equal(bare, "").to_pylist()
    for start, end, none in zip(at, at[1:], blank):
        if none:
            yield sums[:0]
        elif end - start < words:
            yield _mixed((each[start:end] * place[: end - start]).sum(keepdims=True) + np.uint64(words - (end - start)))
        else:
            ordered = np.sort(sums[start : end - words + 1])
            yield ordered[np.append(True, ordered[1:] != ordered[:-1])]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The sums with all their bits spread over all places (MurmurHash3's last steps), one to one."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def node_of(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7))


def parities(hashes: np.ndarray) -> bytes:
    """Whether each class of shingles has an odd number. Classes are low bits of the hash, so wider parities fold to narrower ones."""
    width = max(CLASSES, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    while len(bits) > longs:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def possible(x: bytes, n: int, y: bytes, m: int) -> bool:
    """Whether sets of sizes n and m with these parities can be similar: such sets differ in at most a ninth of n + m."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    least = min(len(a), len(b))
    far = int(np.bitwise_count(folded(a, least) ^ folded(b, least)).sum())
    return 5 * n >= 4 * m and 5 * m >= 4 * n and 9 * far <= n + m


def before(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """For each frequent shingle of a prefix the one before it, if that is frequent too; else 0. Empty if none has any."""
    if len(keys) < 2 or not len(hot):
        return keys[:0]
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    often = hot[at] == keys
    both = often[1:] & often[:-1]
    return np.concatenate([keys[:1] * np.uint64(0), np.where(both, keys[:-1], 0)]) if both.any() else keys[:0]


def prefix(hashes: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set that a similar set must share one of. hot is sorted; rank is its order, from 1."""
    n = len(hashes)
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        often = hot[at] == hashes
        if often.any():
            hashes = np.concatenate([hashes[~often], hashes[often][np.argsort(rank[at[often]])]])
    return hashes[: n - -(-4 * n // 5) + 1] if n else hashes


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted sets have a similarity of at least 4/5."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


class Often:
    """Counts of shingles that come often, in bounded memory: after each block, those met once go, so a count is short by the number of blocks at most."""

    def __init__(self):
        self.keys, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size >= _BLOCK:
            self._count(2)

    def _count(self, least: int) -> None:
        keys, times = np.unique(np.concatenate([np.empty(0, np.uint64), *self.held]), return_counts=True)
        merged, at = np.unique(np.concatenate([self.keys, keys[times >= least]]), return_inverse=True)
        sums = np.zeros(len(merged), np.int64)
        np.add.at(sums, at, np.concatenate([self.times, times[times >= least]]))
        self.keys, self.times, self.held, self.size = merged, sums, [], 0

    def found(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self._count(1 if not len(self.keys) else 2)
        mine = self.times >= least
        return self.keys[mine], self.times[mine]


def hot_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles over all texts, about MOST_HOT at most, their places in the order, and their counts over the tasks OFTEN of whose texts have them.

    How many have each count tells which are the most frequent, so no task sorts them all. Of those with the last count, as many as fit are taken by their hashes.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = Often()
        for batch in batches:
            for s in shingle_sets(batch["t"], words):
                often.add(s)
        keys, times = often.found(OFTEN)
        yield pd.DataFrame({"h": keys.view(np.int64), "n": times})

    seen = texts.select("t").mapInPandas(tidy(count), "h long, n long")
    summed = settle(seen.groupBy("h").agg(F.sum("n").alias("n")))
    room, last, parts = MOST_HOT, 0, 0
    for times, many in sorted(((r["n"], r["count"]) for r in summed.groupBy("n").count().collect()), reverse=True):
        last, parts = times, min(1 << 20, (room << 20) // many)
        room -= many
        if room <= 0:
            break
    often = summed.where((F.col("n") > last) | (F.col("n") == last) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < parts)).orderBy(F.desc("n"), "h").collect()
    hot = np.array([r["h"] for r in often], np.int64).view(np.uint64)
    times = np.array([r["n"] for r in often], np.int64)
    rank = np.arange(len(hot), 0, -1)
    order = np.argsort(hot)
    return hot[order], rank[order], times[order]


def salts(keys: np.ndarray, node: int, hot: np.ndarray, times: np.ndarray, limit: int) -> np.ndarray:
    """The part of its bucket, from 1, that a text falls in, for each of its prefix shingles; 0 where the bucket isn't expected to be over the limit."""
    if not len(hot) or not len(keys):
        return np.zeros(len(keys), np.int32)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    parts = np.where(hot[at] == keys, -(-times[at] // limit), 1)
    return np.where(parts > 1, (node & 0x7FFFFFFF) % parts + 1, 0).astype(np.int32)


def _whole_buckets(batches: Iterator[pd.DataFrame], keys: list[str], solve) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < _BATCH:
            continue
        frame = pd.concat(held, ignore_index=True)
        cut = int(np.flatnonzero(_begins(frame, keys))[-1])  # the last bucket may go on
        if cut:
            yield from solve(frame[:cut])
        held, size = [frame[cut:].reset_index(drop=True)], len(frame) - cut
    if size:
        yield from solve(pd.concat(held, ignore_index=True))


def _begins(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before."""
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for key in keys:
        column = frame[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return new


def _fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _first_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of buckets sorted by key, salt and node. Rows of a large or dealt bucket also come back with their key and no b; `lead`: the first of a dealt part.

    A bucket all of whose rows have the same `earlier` key is part of that one's and gives nothing.
    """

    def solve(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame[_begins(frame, ["key", "salt", "node"])]  # texts with equal sets
        first = _begins(frame, ["key", "salt"])
        starts = np.flatnonzero(first)
        earlier = frame["earlier"].to_numpy()
        if len(starts):
            one = (np.minimum.reduceat(earlier, starts) == np.maximum.reduceat(earlier, starts)) & (earlier[starts] != 0) & (frame["salt"].to_numpy()[starts] == 0)
            frame = frame[~one[np.cumsum(first) - 1]]  # every pair is in the earlier shingle's bucket too
            first = _begins(frame, ["key", "salt"])
        key, node, n, salt = (frame[c].to_numpy() for c in ("key", "node", "n", "salt"))
        bucket = np.cumsum(first) - 1
        size, lead = np.bincount(bucket)[bucket], np.flatnonzero(first)[bucket]
        a, b = [lead[(size > SMALL) & ~first]], [np.flatnonzero((size > SMALL) & ~first)]
        for d in range(1, SMALL):
            at = np.flatnonzero((size[d:] <= SMALL) & (bucket[d:] == bucket[:-d]))
            a.append(at)
            b.append(at + d)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = _fit(n[a], n[b])
        none = np.zeros(int(ok.sum()), bool)
        yield pd.DataFrame({"key": pd.array([pd.NA] * len(none), "Int64"), "a": node[a[ok]], "b": pd.array(node[b[ok]], "Int64"), "lead": none}).drop_duplicates()
        big = (size > SMALL) | (salt > 0)
        yield pd.DataFrame({"key": pd.array(key[big], "Int64"), "a": node[big], "b": pd.array([pd.NA] * int(big.sum()), "Int64"), "lead": (first & (salt > 0))[big]})

    return _whole_buckets(batches, ["key", "salt"], solve)


class _Parities:
    """The parities of a batch of sets, of several widths."""

    def __init__(self, parities):
        self.rows = [np.frombuffer(p, np.uint64) for p in parities]
        self.longs = np.array([len(r) for r in self.rows], np.int64)
        self.made: dict[int, np.ndarray] = {}

    def folded_to(self, longs: int) -> np.ndarray:
        if longs not in self.made:
            self.made[longs] = np.array([folded(r, longs) if len(r) >= longs else np.zeros(longs, np.uint64) for r in self.rows], np.uint64).reshape(-1, longs)
        return self.made[longs]

    def possible(self, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows that can be similar, narrow parities looked at first, and the share of their sizes that they are seen to differ in."""
        most = n[p].astype(np.int64) + n[q]
        far = self._far(p, q, self.folded_to(CLASSES // 64))
        ok = 9 * far <= most
        p, q, far, most = p[ok], q[ok], far[ok], most[ok]
        least = np.minimum(self.longs[p], self.longs[q])
        for longs in np.unique(least[least > CLASSES // 64]).tolist():
            mine = np.flatnonzero(least == longs)
            far[mine] = self._far(p[mine], q[mine], self.folded_to(longs))
        ok = 9 * far <= most
        return p[ok], q[ok], far[ok] / np.maximum(most[ok], 1)

    @staticmethod
    def _far(p: np.ndarray, q: np.ndarray, bits: np.ndarray) -> np.ndarray:
        far = np.zeros(len(p), np.int64)
        step = max(1, (1 << 20) // bits.shape[1])
        for i in range(0, len(p), step):
            far[i : i + step] = np.bitwise_count(bits[p[i : i + step]] ^ bits[q[i : i + step]]).sum(axis=1)
        return far


def _forest(p: np.ndarray, q: np.ndarray, far: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what all the pairs join, the nearest first, and the classes after them. root: a row's class, its lowest row."""
    order = np.argsort(far, kind="stable")
    p, q = p[order], q[order]
    chosen = [np.empty((0, 2), np.int64)]
    while True:
        apart = root[p] != root[q]
        p, q = p[apart], q[apart]
        if not len(p):
            return np.concatenate(chosen), root
        best = np.unique(np.concatenate([np.unique(root[x], return_index=True)[1] for x in (p, q)]))  # each class's nearest
        chosen.append(np.stack([p[best], q[best]], axis=1))
        root = _join(root, p[best], q[best])


def _cross_pairs(whole: bool):
    """Pairs of a cell's rows in different components that sizes and parities don't rule out: all, or only as many as join what all would."""

    def solve(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, n, group, half = (frame[c].to_numpy() for c in ("node", "n", "c", "half"))
        bits = _Parities(frame["parity"])
        starts = np.append(np.flatnonzero(_begins(frame, ["cell"])), len(frame))
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            _, first, inverse = np.unique(group[start:end], return_index=True, return_inverse=True)
            if len(first) < 2:
                continue
            root = first[inverse]
            step = max(1, _PAIRS // (end - start))
            for i in range(start, end, step):
                x, y = np.arange(i, min(i + step, end))[:, None], np.arange(i + 1, end)[None, :]
                p, q = np.nonzero((y > x) & (root[x - start] != root[y - start]) & ((half[x] == 0) | (half[x] != half[y])) & _fit(n[x], n[y]))
                p, q, far = bits.possible(p + i, q + i + 1, n)
                if not whole:
                    pairs, root = _forest(p - start, q - start, far, root)
                    p, q = pairs[:, 0] + start, pairs[:, 1] + start
                yield pd.DataFrame({"a": node[p], "b": node[q]})

    return lambda batches: _whole_buckets(batches, ["cell"], solve)


def sent_whole(ids: DataFrame) -> DataFrame:
    """Ids, stored; to be broadcast if they are few, so that texts needn't move."""
    ids = settle(ids)
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def touched(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def of(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the nodes that are asked for; no other row of a large table moves."""
    return nodes.join(sent_whole(asked), "node", "left_semi")


def _sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, s) for the nodes of the pairs, read from the texts again."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(shingle_sets(batch["t"], words))
            yield pd.DataFrame({"node": [node_of(s) for s in made], "s": [s.tobytes() for s in made]})

    asked = sent_whole(of(nodes, touched(pairs)).select("id").distinct())
    sets = settle(texts.join(asked, texts["doc_id"] == asked["id"], "left_semi").select("t").mapInPandas(tidy(read), "node long, s binary"))
    return sets.dropDuplicates(["node"]) if sets.count() > asked.count() else sets  # more only where ids repeat


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs, distinct, that sizes and parities don't rule out."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [possible(*row) for row in zip(batch["x"], batch["n"], batch["y"], batch["m"])]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    pairs = settle(_distinct(pairs))
    n = pairs.count()
    pairs = gathered(pairs, n)
    near = of(nodes.select("node", "n", "parity"), touched(pairs))
    both = pairs.join(near.select(F.col("node").alias("b"), F.col("parity").alias("y"), F.col("n").alias("m")), "b")
    both = both.join(near.select(F.col("node").alias("a"), F.col("parity").alias("x"), "n"), "a")
    return settle(gathered(both, n).mapInPandas(tidy(check), "a long, b long"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs of at least 4/5 similarity, checked on the whole sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["x"], batch["y"])]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    n = pairs.count()
    sets = _sets(pairs, nodes, texts, words)
    both = gathered(pairs, n, _CHECKS).join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    return settle(gathered(both, n, _CHECKS).mapInPandas(tidy(check), "a long, b long"))


def similar_classes(found: DataFrame, texts: DataFrame, words: int, more: DataFrame | None = None, limit: int = LIMIT, verify=None) -> DataFrame:
    """(a, b) for each node a whose class has a smaller node b, b the smallest: links are similarities of 4/5, and are followed.

    found: doc_id, node, n, parity, prefix, salt and earlier (none: all 0; earlier may be left out; rows stored); texts: doc_id, t, which sets are read from again; more: further candidates (a, b).
    verify(pairs, nodes, texts, words) gives the pairs that are similar; without it whole sets are compared.
    """
    verify = verify or _verified
    if "earlier" not in found.columns:
        found = found.withColumn("earlier", F.array().cast("array<long>"))
    spark = found.sparkSession
    known = found.where("doc_id is not null")
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("parity").alias("parity")), "nodes")
    rows = known.select(F.inline(F.arrays_zip("prefix", "salt", "earlier")), "node", "n")
    rows = rows.select(F.col("prefix").alias("key"), F.coalesce("salt", F.lit(0)).alias("salt"), F.coalesce("earlier", F.lit(0)).alias("earlier"), "node", "n")
    dealt = rows.repartition(tasks(spark), "key", "salt").sortWithinPartitions("key", "salt", "node")
    out = settle(dealt.mapInPandas(tidy(_first_pairs), "key long, a long, b long, lead boolean"))
    pairs = out.where("b is not null").select("a", "b")
    members = out.where("b is null").select("key", F.col("a").alias("node"))
    leads = out.where("b is null and lead").select("key", F.col("a").alias("node"))
    pairs = pairs.unionByName(leads.join(leads.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b"))
    if more is not None:
        pairs = pairs.unionByName(more)
    pairs = _plausible(pairs, nodes)
    links = components(verify(pairs, nodes, texts, words))
    for whole in (False, True):  # first what joins most, so that few pairs are left for all to be looked at
        rest = _distinct(_cells(members, links, nodes, limit).mapInPandas(tidy(_cross_pairs(whole)), "a long, b long"))
        rest = settle(rest)
        links = components(links.unionByName(verify(rest, nodes, texts, words)))
    return links


def _cells(members: DataFrame, links: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The rows of large buckets of several components, in their cells.

    A bucket of up to the limit is a cell. A larger one is cut into bands, within which sizes grow by a quarter, and bands over the limit into
    shards. Every two shards of one band or of neighbouring bands meet in a cell; `half` tells them apart there (0: all pairs count).
    """
    named = members.join(gathered(links, links.count()), members["node"] == links["a"], "left").select("key", "node", F.coalesce("b", "node").alias("c"))
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key", "m")
    named = settle(named.join(sent_whole(mixed), "key"))  # a large bucket's rows stay where they are
    rows = named.join(of(nodes.select("node", "n", "parity"), named.select("node").distinct()), "node")
    cells = rows.where(F.col("m") <= limit).select("node", "c", "n", "parity", F.xxhash64("key").alias("cell"), F.lit(0).alias("half"))
    over = rows.where(F.col("m") > limit)
    if not named.where(F.col("m") > limit).isEmpty():
        over = over.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1.25)) + 1e-9))
        sizes = settle(over.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("s")))
        at = lambda by, name: sizes.select("key", (F.col("band") - by).alias("band"), F.col("s").alias(name))
        for by, name in ((0, "s"), (1, "above"), (-1, "below")):
            over = over.join(at(by, name), ["key", "band"], "left")
        mine = F.pmod(F.xxhash64("node"), F.col("s").cast("long")).cast("int")
        over = over.withColumn("mine", mine)
        shards = lambda n: F.when(F.col(n).isNotNull(), F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        cell = lambda low, a, b, half: F.struct(F.xxhash64("key", *low, a, b).alias("cell"), half.cast("int").alias("half"))
        band = F.col("band")
        met = F.concat(
            F.transform(shards("s"), lambda o: cell((band, band), F.least("mine", o), F.greatest("mine", o), F.when(o == F.col("mine"), 0).when(o > F.col("mine"), 1).otherwise(2))),
            F.transform(shards("above"), lambda o: cell((band, band + 1), F.col("mine"), o, F.lit(1))),
            F.transform(shards("below"), lambda o: cell((band - 1, band), o, F.col("mine"), F.lit(2))),
        )
        cells = cells.unionByName(over.select("node", "c", "n", "parity", F.explode(met).alias("met")).select("node", "c", "n", "parity", "met.cell", "met.half"))
    return cells.repartition(tasks(members.sparkSession), "cell").sortWithinPartitions("cell", "node")


def shingle_table(texts: DataFrame, words: int, limit: int = LIMIT, print_of=None, hot: tuple | None = None) -> DataFrame:
    """(doc_id, node, n, parity, prefix, salt, earlier, bits) of texts (doc_id, t), stored. Texts with equal sets are one node."""
    hot, rank, times = hot or hot_shingles(texts, words)
    large = bool((times > limit).any())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(shingle_sets(batch["t"], words))
            named = [node_of(s) for s in made]
            first = [prefix(s, hot, rank) for s in made]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "node": named,
                    "n": [len(s) for s in made],
                    "parity": [parities(s) for s in made],
                    "prefix": [p.view(np.int64) for p in first],
                    "salt": [s if s.any() else s[:0] for s in (salts(p if large else p[:0], node, hot, times, limit) for p, node in zip(first, named))],  # mostly none
                    "earlier": [before(p, hot).view(np.int64) for p in first],
                    "bits": [print_of(s) if print_of else 0 for s in made],
                }
            )

    return stored(texts.mapInPandas(tidy(scan), "doc_id long, node long, n int, parity binary, prefix array<long>, salt array<int>, earlier array<long>, bits long"), "shingles")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, print_of=None, candidates=None, limit: int = LIMIT) -> DataFrame:
    """The rows of docs whose id is its class's smallest, all columns kept. A row with a null id stays.

    print_of(hashes) is a fingerprint of a shingle set and candidates(nodes) gives further pairs (a, b) from nodes (id, bits). A null
    text counts as empty; wordless texts are alike. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = shingle_table(texts, words, limit, print_of)
    more = None
    if candidates:
        more = candidates(found.where("doc_id is not null").groupBy("node").agg(F.first("bits").alias("bits")).withColumnRenamed("node", "id"))
    links = similar_classes(found, texts, words, more, limit)
    ids = found.where("doc_id is not null").select("doc_id", "node")
    named = ids.join(links, ids["node"] == links["a"], "left").select("doc_id", F.coalesce("b", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("least"))
    gone = named.join(least, "c").where("doc_id != least").select("doc_id").distinct()
    own = F.col(id_col).cast("long").alias("own")
    return docs.select(whole_row(docs), own).join(sent_whole(gone), F.col("own") == F.col("doc_id"), "left_anti").select("row.*")
