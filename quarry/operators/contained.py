"""Texts looked through for many short patterns at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import sent

TURN_BYTES = 8 << 20  # patterns that one pass over the texts carries


def held(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, doc_id): texts (doc_id, text) that hold a pattern (query_id, query). Empty patterns are in none.

    Equal patterns count once. Texts don't move: patterns go to every task, TURN_BYTES of them at a time, parted by a hash; more take further passes.
    """
    distinct = patterns.where("query != ''").select("query").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()[0]
    turns = max(1, -(-size // TURN_BYTES))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for turn in range(turns):
        mine = distinct if turns == 1 else distinct.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn)
        words = sorted(r[0] for r in mine.collect())  # bounded by the turn
        carried = texts.sparkSession.sparkContext.broadcast(words)

        def look(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            words = carried.value
            automaton = ahocorasick.Automaton()
            for k, word in enumerate(words):
                automaton.add_word(word, k)
            automaton.make_automaton()
            for batch in batches:
                rows, names = [], []
                for i, text in enumerate(batch["text"].to_pylist()):
                    for k in {k for _, k in automaton.iter(text)} if text and words else ():
                        rows.append(i)
                        names.append(words[k])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], ["doc_id", "query"])

        one = texts.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, query string")
        found = one if found is None else found.unionByName(one)
    return found.join(sent(patterns.where("query != ''").select("query_id", "query")), "query").select("query_id", "doc_id")
