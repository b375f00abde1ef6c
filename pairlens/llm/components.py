"""Connected components by alternating large-star and small-star steps on edges that tasks reduce to forests first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the least of its component there, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        p, r = least[x], least[y]
        if (p == r).all():
            break
        np.minimum.at(least, np.maximum(p, r), np.minimum(p, r))
        while (least[least] != least).any():
            least = least[least]
    below = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[below], nodes[least[below]]


def reduced(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The edges of each ``chunk`` of a task as stars with the same components; never more than there were."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(a, b)], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            held.append(batch.slice(at, chunk))
            rows += held[-1].num_rows
            if rows >= chunk:
                yield stars(held)
                held, rows = [], 0
    if rows:
        yield stars(held)


def components(edges: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b longs); component is the smallest node. A written table.

    Tasks reduce what edges they read to stars, ``chunk`` edges at once, which needs no shuffle. What is no star yet after that goes
    through a step: a grouped minimum, combined on the map side, and a join back, twice, so a node with very many
    links is never one task's group. A step leaves no more edges than it got. The number of steps grows with the
    logarithm of the longest path. Loops, nulls and repeated edges do no harm; no edges give an empty table.
    """

    def less(df: DataFrame) -> DataFrame:
        out = written(df.mapInArrow(lambda batches: reduced(batches, chunk), "a long, b long"), "links")
        if hasattr(df, "written_path"):
            discard(df)
        return out

    e = less(less(edges.filter("a <> b").select("a", "b")))  # the second pass reads the first one's small tables together
    while True:
        # every edge leads down: a node with two ends, or with one and links from above, is in no star
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))
        ends = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("top"))
        found = ends.select("node", F.coalesce("low", "node").alias("component"), (F.col("low").isNotNull() & (F.col("top") | (F.col("low") != F.col("high")))).alias("open"))
        found = written(found, "components")
        if found.filter("open").isEmpty():
            discard(e)
            out = found.drop("open")
            out.written_path = found.written_path
            return out
        discard(found)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # larger neighbours go to the least of the neighbourhood
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = written(large, "links")
        discard(e)
        # so do smaller ones, and the node itself
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        e = written(small.filter("a <> b"), "links")
        discard(large)
        e = less(e)
