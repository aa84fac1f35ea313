"""Document fingerprints from prefix polynomial hashes.

prefix[i] is the sum of (c[j] + 1) * B**j over j < i, modulo 2**31 - 1, for two bases. From two such arrays any span
of a text is compared with any span of another in constant time, and longest common extensions are found by binary search:
at both ends, and between them from each next place where ANCHOR code points agree, looked up by their hash. A document's
fingerprint is its length and the last entries of its arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tasks

P = (1 << 31) - 1
BASES = (1_000_003, 998_244_353 % P)
ANCHOR = 16  # code points that must agree for an extension to begin after a difference
_AHEAD = 64  # anchors among which the nearest is taken


class _Powers:
    """B**j for both bases, grown as texts need them."""

    def __init__(self, bases: tuple[int, ...] = BASES):
        self.bases = bases
        self.held = [np.ones(1, np.uint64) for _ in bases]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.held[0]) <= n:
            size = len(self.held[0])
            self.held = [np.concatenate([h, h * np.uint64(pow(b, size, P)) % np.uint64(P)]) for h, b in zip(self.held, self.bases)]
        return self.held


_powers = _Powers()
_inverse = _Powers(tuple(pow(b, -1, P) for b in BASES))


class PrefixHash:
    """The prefix arrays of a text's code points, either all new or going on from another text's first `kept`."""

    def __init__(self, codes: np.ndarray, after: PrefixHash | None = None, kept: int = 0):
        self.n = len(codes)
        powers = _powers.upto(self.n)
        values = codes[kept:].astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for i, power in enumerate(powers):
            start = after.prefix[i][kept] if after is not None else np.uint64(0)
            terms = values * power[kept : self.n] % np.uint64(P)
            tail = (np.cumsum(terms) + start) % np.uint64(P)  # below 2**63 for texts under 2**32 code points
            self.prefix.append(np.concatenate([after.prefix[i][: kept + 1] if after is not None else np.zeros(1, np.uint64), tail]))

    def fingerprint(self) -> str:
        return "".join(f"{int(p[-1]):08x}" for p in self.prefix) + f"{self.n:x}"

    def same(self, a: int, other: PrefixHash, b: int, length: int) -> bool:
        """Whether the spans of that length at a here and at b there are equal."""
        powers = _powers.upto(max(a, b))
        for x, y, power in zip(self.prefix, other.prefix, powers):
            mine = (int(x[a + length]) - int(x[a])) * int(power[b])
            theirs = (int(y[b + length]) - int(y[b])) * int(power[a])
            if (mine - theirs) % P:
                return False
        return True

    def common_prefix(self, other: PrefixHash) -> int:
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            if all(x[mid] == y[mid] for x, y in zip(self.prefix, other.prefix)):
                low = mid
            else:
                high = mid - 1
        return low

    def common_suffix(self, other: PrefixHash) -> int:
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(self.n - mid, other, other.n - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def grams(self, start: int, end: int) -> np.ndarray:
        """The hash of the ANCHOR code points at each place of a span, wherever it is."""
        inverse, parts = _inverse.upto(self.n), []
        for x, power in zip(self.prefix, inverse):
            span = (x[start + ANCHOR : end + 1] + np.uint64(P) - x[start : end + 1 - ANCHOR]) % np.uint64(P)
            parts.append(span * power[start : end + 1 - ANCHOR] % np.uint64(P))
        return parts[0] << np.uint64(31) | parts[1]

    def extension(self, a: int, other: PrefixHash, b: int, most: int) -> int:
        """Length of the longest equal spans at a here and at b there."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(a, other, b, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def _between(self, other: PrefixHash, start: int, end: int, other_end: int) -> int:
        """Total length of further extensions in spans from start on, one after the other in both texts."""
        if min(end, other_end) - start < ANCHOR:
            return 0
        there, at = np.unique(other.grams(start, other_end), return_inverse=True)
        here = self.grams(start, end)
        rank = np.minimum(np.searchsorted(there, here), len(there) - 1)
        places = np.flatnonzero(there[rank] == here)
        if not len(places):
            return 0
        rank, width = rank[places], other_end - start
        keys = np.sort(at * width + np.arange(len(at)))  # an anchor's places there are together, in order
        i = j = total = next_ = 0
        while next_ < len(places):
            some = slice(next_, next_ + _AHEAD)
            found = np.searchsorted(keys, rank[some] * width + j)
            key = keys[np.minimum(found, len(keys) - 1)]
            on = (found < len(keys)) & (key // width == rank[some])
            if not on.any():
                next_ += _AHEAD
                continue
            cost = np.where(on, places[some] + key % width, np.iinfo(np.int64).max)
            best = int(np.argmin(cost))
            i, j = int(places[some][best]), int(key[best] % width)
            length = self.extension(start + i, other, start + j, min(end - start - i, other_end - start - j))
            if not length:  # hashes of unlike anchors met
                next_ += best + 1
                continue
            total, i, j = total + length, i + length, j + length
            next_ = int(np.searchsorted(places, i))
        return total

    def likeness(self, other: PrefixHash) -> float:
        """Share of the longer text in common extensions: from both ends, and between them in the same order; two empty texts: 1."""
        if not max(self.n, other.n):
            return 1.0
        least = min(self.n, other.n)
        front = self.common_prefix(other)
        back = min(self.common_suffix(other), least - front)
        return (front + back + self._between(other, front, self.n - back, other.n - back)) / max(self.n, other.n)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in ascending order, each after its next in descending order."""
    last: tuple[str, PrefixHash] | None = None
    for batch in batches:
        out = []
        for doc_id, none, copy, text in zip(batch["id"], batch["none"], batch["copy"], batch["t"]):
            codes = codes_of(text)
            mine = PrefixHash(codes)
            if not copy:
                other, theirs = last if last is not None else (text, mine)
                n = len(codes)
                half = n // 2
                edited = text[: n - half] + other[:half]
                changed = PrefixHash(codes_of(edited), mine, n - half)
                out.append((None if none else doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), mine.fingerprint(), changed.fingerprint(), mine.likeness(changed), mine.likeness(theirs)))
            last = text, mine
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before in ascending order of (id, hash of the text), and for the first the last. Texts move
    once, to range buckets by id; the last row of each bucket goes to the following one as well.
    Nulls: a null text is empty; null ids come first in ascending order. Repeated rows each get a row and may be each
    other's next; a single row is its own. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = tasks(spark)
    rows = docs.select(
        F.col(id_col).isNull().alias("none"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts, nulls = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, 100 * n), F.count_if(F.col(id_col).isNull())).first()
    cuts = np.array(sorted(set(cuts or [])), np.int64)  # one a partition
    first = n if nulls else 0  # buckets of null ids, by their texts' hash

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right") + first).astype("int32")

    rows = rows.withColumn("tie", F.xxhash64("t"))
    by_hash = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * first), F.lit(first - 1)).cast("int")
    rows = rows.withColumn("bucket", F.when(F.col("none"), by_hash).otherwise(range_of("id")))
    ends = rows.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("end")).collect()  # one a bucket
    ends = sorted((r["bucket"], r["end"]["id"], r["end"]["tie"]) for r in ends)
    following = [b for b, _, _ in ends[1:] + ends[:1]]
    hops = spark.createDataFrame([(b, i, t, f) for (b, i, t), f in zip(ends, following)], "bucket int, end_id long, end_tie long, following int")
    last = (F.col("id") == F.col("end_id")) & (F.col("tie") == F.col("end_tie"))
    to = F.when(last, F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("copy")), F.struct(F.col("following").alias("to"), F.lit(True).alias("copy"))))
    to = to.otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("copy"))))
    dealt = rows.join(F.broadcast(hops), "bucket").select("none", "id", "tie", "t", F.inline(to))
    dealt = dealt.repartitionById(first + len(cuts) + 1, F.col("to")).sortWithinPartitions("to", F.col("copy").desc(), F.col("none").desc(), "id", "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("id", "none", "copy", "t").mapInPandas(_compare, schema)
