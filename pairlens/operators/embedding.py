"""Scores of vectors against a set of query vectors, a block of queries at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # queries that go to the tasks at once


def scored_against(docs: DataFrame, queries: DataFrame, key: str, label: str, vector: str = "v", block: int = BLOCK) -> DataFrame:
    """``key, own_score, best_score, queries``: dot products with the query of the row's own label, and the best over all queries.

    Queries, one a label, come in blocks of at most ``block`` vectors; a block is a matrix in every task, multiplied by the
    rows of an Arrow batch. Only the three numbers leave a task; those of several blocks are put together
    by ``key``, which has to tell the rows apart. A label without a query has no own score; null or ragged vectors, and rows met by no query, have null scores.
    """
    sizes = sorted(r[0] for r in queries.select(F.size(vector)).distinct().collect())
    if len(sizes) > 1:
        raise ValueError(f"queries of different lengths: {sizes}")
    width = sizes[0] if sizes else 0
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, label)}
    rows = docs.select(key, label, vector)
    out = None
    ordered = queries.select(label, vector).orderBy(label).toLocalIterator()
    for some in _cut(ordered, block):
        at = {r[0]: i for i, r in enumerate(some)}
        matrix = docs.sparkSession.sparkContext.broadcast((at, np.array([r[1] for r in some], float).T))

        def run(batches: Iterator[pa.RecordBatch], matrix=matrix) -> Iterator[pa.RecordBatch]:
            at, m = matrix.value
            for b in batches:
                v = b.column(2)
                good = np.array([x is not None and len(x) == width for x in v.to_pylist()], bool)
                own, best = np.full((2, b.num_rows), np.nan)
                if good.any():
                    score = np.array([x for x, g in zip(v.to_pylist(), good, strict=True) if g], float) @ m
                    mine = np.array([at.get(x, -1) for x, g in zip(b.column(1).to_pylist(), good, strict=True) if g])
                    best[good] = score.max(1)
                    own[good] = np.where(mine >= 0, score[np.arange(len(mine)), mine], np.nan)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, from_pandas=True), pa.array(best, from_pandas=True), pa.array(np.full(b.num_rows, m.shape[1]))], [key, "own_score", "best_score", "queries"])

        got = rows.mapInArrow(run, f"`{key}` {kinds[key]}, own_score double, best_score double, queries long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.select(key, F.lit(None).cast("double").alias("own_score"), F.lit(None).cast("double").alias("best_score"), F.lit(0).cast("long").alias("queries"))
    return out.groupBy(key).agg(F.max("own_score").alias("own_score"), F.max("best_score").alias("best_score"), F.sum("queries").alias("queries"))


def _cut(rows: Iterator, n: int) -> Iterator[list]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some
