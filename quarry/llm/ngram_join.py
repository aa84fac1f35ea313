"""Documents linked by the Jaccard similarity of their word n-grams, counted by vertical fragments.

1. Order: all n-grams in one global order, by their hashes, those that many documents have last.
2. Fragments: the order is cut into FRAGMENTS ranges, the last one for the n-grams that many documents have, and so is each
   document's set. A document's segments lie in as many rows, so a long one is in no row whole.
3. Candidates: two similar sets share one of the first n - ceil(4 n / 5) + 1 n-grams of each in the order (see `overlap`).
4. Partial overlaps: in each fragment, the segments of a candidate pair are intersected by themselves; the sums per pair are the
   overlaps, and decide the links. Documents with equal sets are one node and are never paired.

Similarity is that of 64-bit hashes of the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import overlap
from quarry.llm.common import gathered, settle, tidy

FRAGMENTS = 8


def fragment_of(hashes: np.ndarray, hot: np.ndarray, fragments: int) -> np.ndarray:
    """The range of the global order that each n-gram lies in; hot is sorted."""
    if fragments == 1:
        return np.zeros(len(hashes), np.int64)
    at = ((hashes >> np.uint64(32)) * np.uint64(fragments - 1) >> np.uint64(32)).astype(np.int64)
    if len(hot) and len(hashes):
        near = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        at[hot[near] == hashes] = fragments - 1
    return at


def segments(texts: DataFrame, words: int, hot: np.ndarray, fragments: int = FRAGMENTS) -> DataFrame:
    """(node, fragment, s): the sets of texts (t) cut by fragment, without empty segments."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, at, parts = [], [], []
            for whole in overlap.shingle_sets(batch["t"], words):
                node, place = overlap.node_of(whole), fragment_of(whole, hot, fragments)
                for k in np.unique(place).tolist():
                    nodes.append(node)
                    at.append(k)
                    parts.append(whole[place == k].view(np.int64))
            yield pd.DataFrame({"node": nodes, "fragment": at, "s": parts})

    return texts.select("t").mapInPandas(tidy(cut), "node long, fragment int, s array<long>")


def partial_overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """(a, b, fragment, common): how many n-grams the segments of each pair have in common, fragment by fragment."""
    left = pairs.join(cut.select(F.col("node").alias("b"), "fragment", F.col("s").alias("y")), "b")
    both = left.join(cut.select(F.col("node").alias("a"), "fragment", F.col("s").alias("x")), ["a", "fragment"])
    return both.select("a", "b", "fragment", F.size(F.array_intersect("x", "y")).alias("common"))


def by_fragments(hot: np.ndarray, fragments: int = FRAGMENTS):
    """A check of pairs for `overlap.similar_classes`: those whose summed overlaps are at least four fifths of their unions."""

    def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
        touched = overlap.touched(pairs)
        asked = overlap.sent_whole(overlap.of(nodes, touched).select("id").distinct())
        read = texts.join(asked, texts["doc_id"] == asked["id"], "left_semi")
        cut = settle(segments(read, words, hot, fragments))
        if cut.groupBy("node", "fragment").count().where("count > 1").limit(1).count():  # only where ids repeat
            cut = settle(cut.dropDuplicates(["node", "fragment"]))
        sums = partial_overlaps(pairs, cut).groupBy("a", "b").agg(F.sum("common").alias("common"))
        sizes = overlap.of(nodes.select("node", "n"), touched)
        told = sums.join(sizes.select(F.col("node").alias("a"), "n"), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
        return settle(gathered(told.where("5 * common >= 4 * (n + m - common)").select("a", "b"), pairs.count()))

    return verify


def join(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", fragments: int = FRAGMENTS, limit: int = overlap.LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Documents link when 100 times the intersection of their sets is at least 80 times the union. A text of fewer words is one n-gram.
    Nulls: a null text counts as empty; texts without words have an empty set and link with nothing, so they are their own class; a row
    with a null id is no one's link and has a null component_id. Repeated rows and ids each get a row, classed by its own text. An
    empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hot = overlap.hot_shingles(texts, words)
    found = overlap.shingle_table(texts, words, limit, hot=hot)
    links = overlap.similar_classes(found.where("n > 0"), texts, words, limit=limit, verify=by_fragments(hot[0], fragments))
    nodes = found.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"))
    classed = settle(nodes.join(links, nodes["node"] == links["a"], "left").select("node", "id", F.coalesce("b", "node").alias("c")))
    least = classed.groupBy("c").agg(F.min("id").alias("component_id"))
    named = classed.join(least, "c").select("node", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = found.select("doc_id", "node", "n").join(named, "node", "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
