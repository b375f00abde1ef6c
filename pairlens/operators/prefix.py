"""Ranks, running sums and neighbours in groups of any size.

Rows are dealt by ranges of (group, value, tie), so a group that holds a third of all rows lies in a third of the tasks. A task
numbers its rows in pieces of at most ``PIECE`` rows, so it holds one piece of its range at a time, however large Spark makes that. Only
the first and last group of a piece can go on in others: the sums that they carry are two rows a piece, whatever the data, and are
added by a broadcast of that proven size. The dealt rows are written once, since what is added has to fit the very pieces that were counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import kept

PIECE = 100_000  # rows


def changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Rows that differ from the row before in one of the columns; null equals null. The first row differs."""
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, max(0, n - 1))
        both = pc.and_(pc.is_valid(a), pc.is_valid(b))
        differ = pc.if_else(both, pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return out


def starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def at_edges(new: np.ndarray) -> np.ndarray:
    """Rows of the first and of the last run."""
    begin = starts(new)
    return (begin == 0) | (begin == begin[-1]) if len(new) else new


def pieces(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of at most ``most`` rows and a batch, cut where a group begins if one begins there."""
    held, n = [], 0

    def joined() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most:
            t = joined()
            begin = int(starts(changes([t.column(c) for c in by], n))[-1]) or n
            yield t.slice(0, begin).combine_chunks()
            held, n = t.slice(begin).to_batches(), n - begin
    if n:
        yield joined()


def _ranged(df: DataFrame, by: list[str], order: list[Column], add: Callable[[pa.Table], dict[str, pa.Array]], more: str, name: str) -> DataFrame:
    """``df`` dealt and sorted by ``order``, with each piece's number and the columns that ``add`` makes of its rows; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for i, t in enumerate(pieces(batches, by, PIECE)):
            t = t.append_column("__pid", pa.array(np.full(t.num_rows, task + i, np.int64)))
            for c, v in add(t).items():
                t = t.append_column(c, v)
            yield from t.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return kept(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, __pid long, {more}"), name)


def _before(by: list[str]):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)


def _joined(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a table of at most two rows a piece; nulls meet nulls."""
    few = few.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    return df.join(F.broadcast(few), on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def ranks(df: DataFrame, by: list[str], value: str, tie: list[str], descending: bool = True) -> DataFrame:
    """``df`` with ``rank`` (1 to n in each group, by value, then tie) and ``avg_rank`` (equal values share their mean rank).

    ``tie`` should tell the rows of a group apart: rows that are equal in it too are numbered in any order, and lie in one task.
    Nulls come last when descending, first when ascending. A null group is a group.
    """
    order = [*(F.col(f"`{b}`") for b in by), F.desc(value) if descending else F.asc(value), *(F.col(f"`{t}`") for t in tie)]

    def add(t: pa.Table) -> dict[str, pa.Array]:
        n = t.num_rows
        group, same = changes([t.column(b) for b in by], n), changes([t.column(b) for b in [*by, value]], n)
        begin, first = starts(group), starts(same)
        size = np.diff(np.append(np.flatnonzero(same), n))[np.cumsum(same) - 1]
        return {"__pos": pa.array(np.arange(n) - begin), "__first": pa.array(first - begin), "__same": pa.array(size), "__eg": pa.array(at_edges(group)), "__et": pa.array(at_edges(same))}

    t = _ranged(df, by, order, add, "__pos long, __first long, __same long, __eg boolean, __et boolean", "ranks")
    groups = t.filter("__eg").groupBy(*by, "__pid").agg(F.count(F.lit(1)).alias("__n")).withColumn("__carry", F.coalesce(F.sum("__n").over(_before(by)), F.lit(0))).drop("__n")
    ties = t.filter("__et").groupBy(*by, value, "__pid").agg(F.count(F.lit(1)).alias("__n"))
    ties = ties.select(*by, value, "__pid", F.coalesce(F.sum("__n").over(_before([*by, value])), F.lit(0)).alias("__ahead"), F.sum("__n").over(Window.partitionBy(*by, value)).alias("__total"))
    got = _joined(_joined(t, groups, [*by, "__pid"]), ties, [*by, value, "__pid"])
    carry = F.coalesce("__carry", F.lit(0))
    first = F.col("__first") + carry - F.coalesce("__ahead", F.lit(0))
    return got.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__pos") + carry + 1).alias("rank"), (first + (F.coalesce("__total", "__same") + 1) / 2.0).alias("avg_rank"))


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``sums``, the sum of the column over the rows before, in each group. Null counts as nothing.

    Fractions are added one by one in the order of the rows, from each group's first, as SQL's windows add them: no other group's sum
    is in between, which would leave its rounding in this one. Only a group that lies in several pieces adds their sums.
    """

    def add(t: pa.Table) -> dict[str, pa.Array]:
        n = t.num_rows
        group = changes([t.column(b) for b in by], n)
        begin, edge = starts(group), np.append(np.flatnonzero(group), n)
        out = {}
        for i, c in enumerate(sums.values()):
            x = pc.fill_null(t.column(c), 0).to_numpy()
            if kinds[i] == "long":
                total = np.concatenate([[0], np.cumsum(x)])
                out[f"__s{i}"] = pa.array(total[:-1] - total[begin])
            else:
                before = np.zeros(n)
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    np.cumsum(x[lo : hi - 1], out=before[lo + 1 : hi])
                out[f"__s{i}"] = pa.array(before)
        return out | {"__eg": pa.array(at_edges(group))}

    kinds = ["long" if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") else "double" for c in sums.values()]
    df = df.withColumns({f"__x{i}": F.col(f"`{c}`").cast(k) for i, (c, k) in enumerate(zip(sums.values(), kinds, strict=True))})
    sums = {new: f"__x{i}" for i, new in enumerate(sums)}
    t = _ranged(df, by, [F.col(f"`{c}`") for c in [*by, *order]], add, ", ".join([*(f"__s{i} {k}" for i, k in enumerate(kinds)), "__eg boolean"]), "running")
    groups = t.filter("__eg").groupBy(*by, "__pid").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    groups = groups.select(*by, "__pid", *[F.coalesce(F.sum(f"__t{i}").over(_before(by)), F.lit(0)).alias(f"__c{i}") for i in range(len(sums))])
    got = _joined(t, groups, [*by, "__pid"])
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums.values()], *[(F.col(f"__s{i}") + F.coalesce(f"__c{i}", F.lit(0))).alias(new) for i, new in enumerate(sums)])


def value_ranks(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """Counts of distinct values with ``avg_rank``, the mean rank that rows of the value share, 1 the smallest."""
    return running(counts, by, [value], {"__ahead": n}).withColumn("avg_rank", F.col("__ahead") + (F.col(n) + 1) / 2.0).drop("__ahead")


def nearest(left: DataFrame, right: DataFrame, value: str, key: str, out: str, *by: str) -> DataFrame:
    """For each row of ``left`` the key of the row of ``right`` whose value is nearest, the smaller key among equals; null if there is none.

    Both tables are dealt together by ranges of the value; what a task lacks below or above its range is carried to it.
    """
    kind = right.schema[key].dataType.simpleString()
    r = right.groupBy(*by, value).agg(F.min(key).alias("__rk")).select(*by, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__side"), "__rk")
    own = left.schema[key].dataType.simpleString()
    r = r.withColumn(key, F.lit(None).cast(own)).withColumn(value, F.lit(None).cast(left.schema[value].dataType))
    both = left.select(*by, F.col(value).cast("double").alias("__v"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__rk"), key, value).unionByName(r)

    def add(t: pa.Table) -> dict[str, pa.Array]:
        n = t.num_rows
        group = changes([t.column(b) for b in by], n)
        side = t.column("__side").to_numpy()
        at, run = np.arange(n), np.cumsum(group)
        below = np.maximum.accumulate(np.where(side == 0, at, -1))
        above = np.minimum.accumulate(np.where(side == 0, at, n)[::-1])[::-1]
        below = np.where((below >= 0) & (run[below] == run), below, -1)
        above = np.where((above < n) & (run[np.minimum(above, n - 1)] == run), above, -1)
        v, k = t.column("__v").combine_chunks(), t.column("__rk").combine_chunks()
        pick = lambda c, i: c.take(pa.array(i, pa.int64(), mask=i < 0))
        return {"__lv": pick(v, below), "__lk": pick(k, below), "__hv": pick(v, above), "__hk": pick(k, above), "__eg": pa.array(at_edges(group))}

    order = [*(F.col(f"`{b}`") for b in by), F.col("__v"), F.col("__side"), F.col(f"`{key}`")]
    t = _ranged(both, list(by), order, add, f"__lv double, __lk {kind}, __hv double, __hk {kind}, __eg boolean", "nearest")
    point = F.struct(F.col("__v").alias("v"), F.col("__rk").alias("k"))
    edge = t.filter("__eg").groupBy(*by, "__pid").agg(F.max(F.when(F.col("__side") == 0, point)).alias("__last"), F.min(F.when(F.col("__side") == 0, point)).alias("__next"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__pid")
    edge = edge.select(*by, "__pid", F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__b"), F.first("__next", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__a"))
    got = _joined(t.filter("__side = 1"), edge, [*by, "__pid"])
    lv, lk, hv, hk = F.coalesce("__lv", "__b.v"), F.coalesce("__lk", "__b.k"), F.coalesce("__hv", "__a.v"), F.coalesce("__hk", "__a.k")
    lo, hi = F.abs(F.col("__v") - lv), F.abs(F.col("__v") - hv)
    best = F.when(lv.isNull(), hk).when(hv.isNull(), lk).when(lo < hi, lk).when(hi < lo, hk).otherwise(F.least(lk, hk))
    return got.select(*by, key, value, best.alias(out))
