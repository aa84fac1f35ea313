"""Joins of spans that overlap, in bins as wide as the spans are long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scans import percentiles

LEAST_WIDTH = 16


def bin_width(*spans: DataFrame, share: float = 0.9) -> int:
    """Offsets of a bin: nine tenths of the spans (start, end) are no longer, so most lie in one or two bins."""
    rows = None
    for side in spans:
        one = side.select((F.col("end") - F.col("start")).alias("n")).where("n > 0")
        rows = one if rows is None else rows.unionByName(one)
    found = percentiles(rows, [], "n", {"width": share}).first()
    return max(LEAST_WIDTH, int(found["width"])) if found and found["width"] is not None else LEAST_WIDTH


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int | None = None) -> DataFrame:
    """Pairs of spans (l_start, l_end) and (r_start, r_end) with equal `on` of which at least half of the shorter overlaps, each pair once.

    Spans meet in bins of `width` offsets (from the spans' own lengths if not given) of their source, so a source with many spans is many keys,
    and spans that are far apart in it never meet. A pair counts in the bin where its overlap begins. Spans without length, and those with null keys or offsets, meet
    nothing. Offsets may be negative.
    """
    if width is None:
        width = bin_width(left.select(F.col("l_start").alias("start"), F.col("l_end").alias("end")), right.select(F.col("r_start").alias("start"), F.col("r_end").alias("end")))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))).alias("__bin")
    one = left.where("l_end > l_start").select("*", bins("l_start", "l_end"))
    two = right.where("r_end > r_start").select("*", bins("r_start", "r_end"))
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    shorter = F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start"))
    met = one.join(two, [*on, "__bin"]).where((F.col("__bin") == F.floor(F.greatest("l_start", "r_start") / width)) & (overlap > 0) & (overlap * 2 >= shorter))
    return met.drop("__bin")
