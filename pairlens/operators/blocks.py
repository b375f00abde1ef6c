"""Draws in blocks: a task makes the weights of many draws as a matrix and multiplies it by the cluster sums.

The draws are those of ``resample``: MD5 of seed, stratum, draw and slot. No row a draw and cluster exists; what leaves a task is
the draws' statistics, one array a model. Everything a task holds grows with the number of clusters and of draws in a
block, both parameters, and never with the rows that were summed. The clusters' sums go to every task, so their number is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 1_000_000  # cluster sums that may go to every task
BLOCK = 2_000  # draws at a time


def hashed(head: str, draws: range, tails: list) -> np.ndarray:
    """``scalars.hash_int(head, draw, tail)`` for every draw (rows) and tail (columns)."""
    out = np.empty((len(draws), len(tails)), np.int64)
    ends = [f"|{t}".encode() for t in tails]
    for i, b in enumerate(draws):
        begun = md5(f"{head}|{b}".encode())
        for j, e in enumerate(ends):
            h = begun.copy()
            h.update(e)
            out[i, j] = int.from_bytes(h.digest()[:6], "big")
    return out


def weight_matrix(head: str, draws: range, k: int) -> np.ndarray:
    """How often each of k clusters is drawn in each of the draws."""
    at = hashed(head, draws, list(range(k))) % k
    return np.bincount((np.arange(len(draws))[:, None] * k + at).ravel(), minlength=len(draws) * k).reshape(len(draws), k).astype(float)


def order_matrix(head: str, draws: range, keys: list) -> np.ndarray:
    """For each draw the places (from 0) of the keys, which are sorted, in a random order."""
    order = np.argsort(hashed(head, draws, keys), axis=1, kind="stable")
    places = np.empty_like(order)
    np.put_along_axis(places, order, np.broadcast_to(np.arange(len(keys)), order.shape), axis=1)
    return places


def collected(sums: DataFrame, *columns: str) -> list:
    """The cluster sums on the driver, if there are no more than ``MOST_CELLS``."""
    rows = sums.select(*columns).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cluster sums: resample fewer, larger clusters, or use resample's joins")
    return rows


def in_blocks(df: DataFrame, draws: int, statistic: Callable[[range], dict], kind: str, block: int = BLOCK) -> DataFrame:
    """``model, values``: for every block of draws each model's statistics, null where undefined. ``statistic`` gets a range of draws."""
    spark = df.sparkSession
    starts = spark.range(0, draws, block, max(1, min(-(-draws // block), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                got = statistic(range(start, min(draws, start + block)))
                yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([v.tolist() for v in got.values()], pa.list_(pa.float64()))], ["model", "values"])

    return starts.mapInArrow(run, f"model {kind}, values array<double>")


def intervals(blocks: DataFrame, model: str = "model", level: float = 0.95) -> DataFrame:
    """``model, low, high, sd, pct_positive`` of all draws; undefined draws are left out. A model's draws, a parameter's number, meet in one task."""
    kind = blocks.schema["model"].dataType.simpleString()
    tails = [(1 - level) / 2, (1 + level) / 2]

    def merge(t: pa.Table) -> pa.Table:
        v = np.concatenate([np.array(x, float) for x in t.column("values").to_pylist()])
        v = v[~np.isnan(v)]
        some = len(v) > 0
        low, high = np.quantile(v, tails) if some else (None, None)
        sd = float(np.std(v, ddof=1)) if len(v) > 1 else None
        return pa.table({"model": t.column("model").slice(0, 1), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64()), "sd": pa.array([sd], pa.float64()), "pct_positive": pa.array([100.0 * np.mean(v > 0) if some else None], pa.float64())})

    out = blocks.groupBy("model").applyInArrow(merge, f"model {kind}, low double, high double, sd double, pct_positive double")
    return out.withColumnRenamed("model", model)


def _cells(rows: list, names: list[str]) -> tuple[list, dict]:
    """Index of the values of each named column, sorted, and the rows' places in it."""
    index = {c: sorted({r[c] for r in rows}) for c in names}
    at = {c: {v: i for i, v in enumerate(index[c])} for c in names}
    return index, at


def contrast_draws(sums: DataFrame, key: str, draws: int, seed: str, other: str | None = None, block: int = BLOCK) -> DataFrame:
    """Blocks of: share in category a minus share in b, clusters resampled within category; with ``other``, a second factor too.

    ``sums`` has model, category, key, half and n (and ``other``). The draws are those of ``resample.draw_contrasts`` and
    ``two_way_contrasts``.
    """
    names = ["model", "category", key, *([other] if other else [])]
    rows = [r for r in collected(sums, *names, "half", "n") if r["category"] in ("a", "b")]
    index, at = _cells(rows, names)
    wide = len(index[other]) if other else 1
    of = {c: sorted({r[key] for r in rows if r["category"] == c}) for c in ("a", "b")}
    place = {c: {v: i for i, v in enumerate(of[c])} for c in of}
    tables = {c: np.zeros((2, len(index["model"]), len(of[c]), wide)) for c in of}
    for r in rows:
        cell = (at["model"][r["model"]], place[r["category"]][r[key]], at[other][r[other]] if other else 0)
        tables[r["category"]][(0, *cell)] += r["half"]
        tables[r["category"]][(1, *cell)] += r["n"]

    def statistic(b: range) -> dict:
        second = weight_matrix(f"{seed}-other", b, wide) if other else np.ones((len(b), 1))
        share = {}
        for c in of:
            w = weight_matrix(f"{seed}|{c}", b, len(of[c])) if of[c] else np.zeros((len(b), 0))
            num, den = np.einsum("bk,xmkj,bj->xmb", w, tables[c], second, optimize=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                share[c] = np.where(den > 0, 50.0 * num / den, np.nan)
        return {m: share["a"][i] - share["b"][i] for i, m in enumerate(index["model"])}

    return in_blocks(sums, draws, statistic, sums.schema["model"].dataType.simpleString(), block)


def level_draws(sums: DataFrame, key: str, draws: int, seed: str, num: str = "half", den: str = "n", scale: float = 50.0, block: int = BLOCK) -> DataFrame:
    """Blocks of: scale * sum(num) / sum(den) of each model, its clusters resampled; the draws of ``resample.ratio_bootstrap``."""
    rows = collected(sums, "model", key, num, den)
    index, _ = _cells(rows, ["model"])
    table = {m: sorted((r[key], float(r[num]), float(r[den])) for r in rows if r["model"] == m) for m in index["model"]}

    def statistic(b: range) -> dict:
        out = {}
        for m, cells in table.items():
            w = weight_matrix(f"{seed}|{m}", b, len(cells))
            x, y = w @ np.array([c[1] for c in cells]), w @ np.array([c[2] for c in cells])
            with np.errstate(invalid="ignore", divide="ignore"):
                out[m] = np.where(y != 0, scale * x / y, np.nan)
        return out

    return in_blocks(sums, draws, statistic, sums.schema["model"].dataType.simpleString(), block)


def label_permutation(sums: DataFrame, key: str, draws: int, seed: str, block: int = BLOCK) -> DataFrame:
    """``model, p_one_sided, p_two_sided`` as ``tests.label_permutation``: whole-number statistics, so no draw depends on rounding."""
    rows = [r for r in collected(sums, "model", "category", key, "half") if r["category"] in ("a", "b")]
    index, at = _cells(rows, ["model", key])
    half = np.zeros((len(index["model"]), len(index[key])))
    for r in rows:
        half[at["model"][r["model"]], at[key][r[key]]] += r["half"]
    first = np.array([next(r["category"] for r in rows if r[key] == k) == "a" for k in index[key]], float)
    k, ka, total = len(index[key]), first.sum(), half.sum(1)
    seen = k * (half @ first) - ka * total

    def statistic(b: range) -> dict:
        v = k * ((order_matrix(seed, b, index[key]) < ka).astype(float) @ half.T) - ka * total
        return {m: np.array([(v[:, i] >= seen[i]).sum(), (abs(v[:, i]) >= abs(seen[i])).sum()], float) for i, m in enumerate(index["model"])}

    return _p_values(in_blocks(sums, draws, statistic, sums.schema["model"].dataType.simpleString(), block), draws)


def _p_values(blocks: DataFrame, draws: int) -> DataFrame:
    p = lambda i: (1 + F.sum(F.col("values")[i])) / (1.0 + draws)
    return blocks.groupBy("model").agg(p(0).alias("p_one_sided"), p(1).alias("p_two_sided"))


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks, 1 the smallest."""
    value, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2.0)[at]


def spearman_permutation(df: DataFrame, x: str, y: str, key: str, draws: int, seed: str, by: str = "model", block: int = BLOCK) -> DataFrame:
    """``by, rho, p`` as ``tests.spearman_permutation``: x's ranks are dealt out anew to y's."""
    rows = collected(df, by, key, x, y)
    kind = df.schema[by].dataType.simpleString()
    table = {}
    for m in sorted({r[by] for r in rows}):
        mine = sorted(((r[key], r[x], r[y]) for r in rows if r[by] == m), key=lambda r: r[0])
        rx, ry = ranks(np.array([r[1] for r in mine], float)), ranks(np.array([r[2] for r in mine], float))
        rx, ry = rx - rx.mean(), ry - ry.mean()
        scale = np.sqrt((rx @ rx) * (ry @ ry))
        table[m] = ([r[0] for r in mine], rx, ry, scale)
    rho = {m: float(rx @ ry / scale) if scale > 0 else None for m, (_, rx, ry, scale) in table.items()}

    def statistic(b: range) -> dict:
        out = {}
        for m, (keys, rx, ry, scale) in table.items():
            if rho[m] is None:
                out[m] = np.array([np.nan])
                continue
            star = ry[order_matrix(seed, b, keys)] @ rx / scale
            out[m] = np.array([(abs(star) >= abs(rho[m]) - 1e-12).sum()], float)
        return out

    said = in_blocks(df, draws, statistic, kind, block).groupBy("model").agg(((1 + F.sum(F.col("values")[0])) / (1.0 + draws)).alias("p"))
    points = df.sparkSession.createDataFrame([(m, r) for m, r in rho.items()], f"`{by}` {kind}, rho double")
    return points.join(said.withColumnRenamed("model", by), by).select(by, "rho", "p")
