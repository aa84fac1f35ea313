"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Equal texts are one group and never parted. Groups over 1 / (shards * GRAIN) of all bytes, of which there are
shards * GRAIN at most, are items of their own; all others fall by hash into shards * GRAIN bundles. So at most
2 * shards * GRAIN items meet on the driver at any corpus size, and one item is a small part of a shard unless
a single group of copies is larger than that itself.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle, tasks

GRAIN = 1024
MOST_CHUNKS = 2048  # parts of a shard that count their own rows


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: the two partial partitions of largest spread are combined again and again, the fullest bin with the emptiest."""
    heap: list = []
    for i, size in enumerate(sizes):
        loads = (size,) + (0,) * (shards - 1)  # fullest first
        heapq.heappush(heap, (-size, i, loads, ((i,),) + ((),) * (shards - 1)))
    while len(heap) > 1:
        _, i, loads, bins = heapq.heappop(heap)
        _, j, others, more = heapq.heappop(heap)
        both = sorted(((a + b, n) for n, (a, b) in enumerate(zip(loads, reversed(others)))), reverse=True)
        merged = [(bins[n], more[shards - 1 - n]) for _, n in both]  # a bin is a pair of bins, opened at the end
        heapq.heappush(heap, (both[-1][0] - both[0][0], min(i, j), tuple(x for x, _ in both), merged))
    shard_of = [0] * len(sizes)
    for shard, top in enumerate(heap[0][3] if heap else ()):
        stack = [top]
        while stack:
            at = stack.pop()
            if len(at) == 1:
                shard_of[at[0]] = shard
            elif at:
                stack += at
    return shard_of


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", grain: int = GRAIN) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: shard sizes are as near equal as whole groups of equal texts allow. Slots count from 0 in
    each shard without gaps, in order of a hash of the id.
    Nulls: a null text has size 1 and goes with the empty texts; a null id is an id of its own. Repeated rows each
    get a slot. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),  # texts that only share a hash would go to the same shard, no more
    )
    rows = settle(rows)
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    items = shards * grain
    own = F.col("size") * items >= F.lit(total)
    heavy = groups.where(own).collect()  # items rows at most
    bundle = F.pmod(F.xxhash64("group"), F.lit(items)).cast("int")
    light = groups.where(~own).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()  # the same
    heavy.sort(key=lambda r: r["group"])
    light.sort(key=lambda r: r["bundle"])
    shard_of = differencing([r["size"] for r in heavy + light], shards)
    by_group = spark.createDataFrame([(r["group"], s) for r, s in zip(heavy, shard_of)], "group long, s1 int")
    by_bundle = spark.createDataFrame([(r["bundle"], s) for r, s in zip(light, shard_of[len(heavy) :])], "bundle int, s2 int")
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(by_group), "group", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("s1", "s2"))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(min(tasks(spark), MOST_CHUNKS))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "chunk")
    )
    counts = sorted((r["shard"], r["chunk"], r["count"]) for r in dealt.groupBy("shard", "chunk").count().collect())  # shards * MOST_CHUNKS rows at most
    starts, last, before = [], None, 0
    for shard, chunk, n in counts:
        before = before if shard == last else 0
        starts.append((shard, chunk, before))
        last, before = shard, before + n
    starts = spark.createDataFrame(starts, "shard int, chunk int, before long")
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return dealt.join(F.broadcast(starts), ["shard", "chunk"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + within - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
