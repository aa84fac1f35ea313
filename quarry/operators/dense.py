"""Dense search over vectors of one width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.lexical import ranked
from quarry.operators.segments import best_of

QUERY_VECTORS = 10_000  # query vectors that one pass over the corpus carries
_BLOCK = 1 << 19  # scores worked out at a time: 4 MiB, and a few times that while the best are found

#: Scores that rise with nearness, of a block of rows x and all queries q: cosine is one minus its distance, the others the distance turned round. A zero vector is like no other.
METRICS = {
    "cosine": lambda x, q: _unit(x) @ _unit(q).T,
    "l2": lambda x, q: 2 * (x @ q.T) - (x * x).sum(axis=1)[:, None] - (q * q).sum(axis=1)[None, :],
    "dot": lambda x, q: x @ q.T,
}


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def valid(vector: Column, width: int) -> Column:
    """Of that width, and all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank): the exact k nearest. queries: query_id, vector; a stated set.

    The corpus doesn't move: blocks of it are multiplied with all the queries, which go to every worker as one matrix, and each block
    keeps k a query. Over QUERY_VECTORS queries come in turns, parted by a hash. Rows with null vectors are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.select("query_id", "vector").where("vector is not null")
    turns = -(-asked.count() // QUERY_VECTORS) or 1
    found = None
    for turn in range(turns):
        mine = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        one = _search(vectors, mine, k, metric, id_col, vector_col)
        found = one if found is None else found.unionByName(one)
    return ranked(found, k)


def _search(vectors: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    asked = queries.toPandas()
    names = asked["query_id"].to_numpy()
    matrix = np.array(asked["vector"].tolist(), np.float64).reshape(len(asked), -1) if len(asked) else np.empty((0, 0))
    sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))
    score = METRICS[metric]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for batch in batches:
            if not len(names) or not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch]).sort_by("doc_id").combine_chunks()
            ids, column = batch["doc_id"], batch["v"].combine_chunks()
            rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            step = max(1, _BLOCK // len(names))
            for i in range(0, len(ids), step):
                scores = score(rows[i : i + step], matrix)
                row, asks = np.nonzero(best_of(np.round(scores, 6), k))
                yield pa.RecordBatch.from_arrays([pa.array(names[asks]), ids.take(pa.array(row + i)).combine_chunks(), pa.array(scores[row, asks])], ["query_id", "doc_id", "score"])

    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    corpus = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v")).where("v is not null")
    return corpus.mapInArrow(nearest, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
