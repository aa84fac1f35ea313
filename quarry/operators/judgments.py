"""Relevance judgments: answer groups from labelled spans, and batch scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.intervals import overlap_join
from quarry.operators.metrics import span_scores
from quarry.storage import stored


def _numbered(sources: list, starts: list, ends: list) -> list[int]:
    """Group numbers of one question's spans, which are in order."""
    width = max(1, int(np.quantile([max(1, b - a) for a, b in zip(starts, ends)], 0.9)))
    seen: dict[tuple, list[tuple]] = {}
    numbers, groups = [], 0
    for source, a, b in zip(sources, starts, ends):
        bins = [(source, k) for k in range(a // width, (b - 1) // width + 1)] if b > a else []
        near = {n for k in bins for c, e, n in seen.get(k, ()) if 0 < min(b, e) - max(a, c) and (min(b, e) - max(a, c)) * 2 >= min(b - a, e - c)}
        number = min(near, default=groups)
        groups += number == groups
        numbers.append(number)
        for k in bins:
            seen.setdefault(k, []).append((a, b, number))
    return numbers


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions with their spans in order, to spans with their group; each row of `spans` is a question's."""
    for batch in batches:
        lists = batch["spans"]
        spans = lists.flatten()
        columns = {name: spans.field(name) for name in ("ordinal", "source_id", "start_offset", "end_offset")}
        source, start, end = (columns[name].to_pylist() for name in ("source_id", "start_offset", "end_offset"))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        numbers, at = [], 0
        for n in sizes.tolist():
            numbers += _numbered(source[at : at + n], start[at : at + n], end[at : at + n])
            at += n
        owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        made = [batch["question_id"].take(owner), *columns.values(), pa.array(numbers, pa.int32())]
        yield pa.RecordBatch.from_arrays(made, ["question_id", *columns, "group_no"])


def answer_groups(labels: DataFrame) -> DataFrame:
    """Relevant spans (question_id, ordinal, source_id, start_offset, end_offset) with their group_no.

    In order, a span joins the first group one of whose spans it matches (one source, half of the shorter in common),
    else it founds one. The order decides, so a question's labels, which people made, are gone through together, many questions to a batch; a span looks only at those
    before it that share one of its bins of offsets, which are as wide as most of the question's spans are long.
    """
    kinds = dict(labels.dtypes)
    names = ("question_id", "ordinal", "source_id", "start_offset", "end_offset")
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", group_no int"
    spans = F.array_sort(F.collect_list(F.struct(*names[1:])))
    return labels.groupBy("question_id").agg(spans.alias("spans")).mapInArrow(_group, schema)


def match_passages(passages: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, rank, group_no, judged): the lowest group each passage matches, null for none, and whether it matches any span. passages: question_id, rank, source_id, start_offset, end_offset; a span of `groups` may have a null group."""
    left = passages.select("question_id", "rank", "source_id", F.col("start_offset").alias("l_start"), F.col("end_offset").alias("l_end"))
    right = groups.select("question_id", "source_id", "group_no", F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end"))
    hits = overlap_join(left, right, ["question_id", "source_id"]).groupBy("question_id", "rank").agg(F.min("group_no").alias("group_no"), F.lit(True).alias("judged"))
    found = passages.select("question_id", "rank").join(hits, ["question_id", "rank"], "left").withColumnRenamed("question_id", "query_id")
    return found.withColumn("judged", F.coalesce("judged", F.lit(False)))


def score_batch(passages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: judged questions, means of hit, recall, mrr, ndcg and precision to 4 places, and passages without a judgment.

    labels: question_id, ordinal, source_id, start_offset, end_offset, label. Questions without a relevant label aren't scored.
    """
    names = ("question_id", "ordinal", "source_id", "start_offset", "end_offset")
    passages = stored(passages.select("question_id", "rank", *names[2:]), "passages")
    labels = stored(labels.select(*names, "label"), "labels")
    relevant = answer_groups(labels.where("label = 'relevant'"))
    # labels of any other kind judge a passage, and have no group
    groups = stored(relevant.unionByName(labels.where("not (label <=> 'relevant')").select(*names, F.lit(None).cast("int").alias("group_no"))), "groups")
    counts = groups.groupBy(F.col("question_id").alias("query_id")).agg(F.count_distinct("group_no").alias("answers")).where("answers > 0")
    matched = stored(match_passages(passages, groups), "matched")
    scores = span_scores(matched, counts)
    unjudged = matched.agg(F.count_if(~F.col("judged")).alias("unjudged_passages"))
    means = [F.round(F.avg(m), 4).alias(m) for m in ("hit", "recall", "mrr", "ndcg", "precision")]
    return scores.agg(F.count(F.lit(1)).alias("judged_questions"), *means).crossJoin(unjudged)
