"""Exact small-sample tests, tails of t and F, and least squares from one pass of sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .prefix import value_ranks


def beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    values = [_beta(*map(float, v)) if good else math.nan for *v, good in zip(x.ravel(), a.ravel(), b.ravel(), ok.ravel(), strict=True)]
    return np.array(values).reshape(x.shape)


def _beta(x: float, a: float, b: float) -> float:
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1.0 - x, b, a)
    # Lentz's evaluation of 1 / (1 + d1 / (1 + d2 / ...))
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for m in range(1, 10_000):
        k = m // 2
        step = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1.0 / ((1.0 + step * d) or tiny)
        c = (1.0 + step / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * value)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom; null without degrees of freedom."""

    @F.pandas_udf(DoubleType())
    def p(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        f, a, b = (v.to_numpy(float) for v in (f, a, b))
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.Series(np.where(np.isinf(f), 0.0, beta_tail(b / (b + a * f), b / 2, a / 2)))

    return F.nanvl(p(f.cast("double"), d1.cast("double"), d2.cast("double")), F.lit(None).cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return f_tail(t * t, F.lit(1), df)


def cohens_d(df: DataFrame, d: str, *by: str) -> DataFrame:
    """``n, mean, t, p`` of the one-sample t test, and ``d``, mean / sd, with its large-sample interval of 1.96 standard errors. Null without spread."""
    g = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    n, size = F.col("n"), F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))
    se = F.sqrt(1.0 / n + size * size / (2.0 * n))
    t = size * F.sqrt(n)
    return g.select(*by, "n", "mean", t.alias("t"), t_two_sided(t, n - 1).alias("p"), size.alias("d"), (size - 1.96 * se).alias("d_low"), (size + 1.96 * se).alias("d_high"))


def signed_rank_p(twice_ranks: np.ndarray, w2: int) -> float:
    """Two-sided exact p of a signed-rank sum: over all signs, those whose smaller side is at most min(w, rest).

    ``twice_ranks`` are whole numbers (average ranks are halves), so the counts of every sum come from one pass a
    rank over an array, ties included.
    """
    total = int(twice_ranks.sum())
    ways = np.zeros(total + 1)
    ways[0] = 1.0
    for r in np.asarray(twice_ranks, int):
        moved = np.zeros_like(ways)
        moved[r:] = ways[: total + 1 - r]
        ways = (ways + moved) / 2.0  # shares, so nothing overflows
    low = min(int(w2), total - int(w2))
    return min(1.0, 2.0 * float(ways[: low + 1].sum()))


def wilcoxon_exact(df: DataFrame, d: str, *by: str, most: int = 200) -> DataFrame:
    """``by, n, w_plus, p`` of the non-zero differences: the exact distribution over all signs, null where a group has over ``most`` of them.

    Differences are counted by size; a group of up to ``most`` differences sends its ranks to one call. A larger one is known by its
    number before any rank is listed, so no list is longer than ``most``.
    """
    nz = df.filter(F.col(d) != 0).groupBy(*by, F.abs(d).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(d) > 0).alias("up"))
    w_plus = F.sum(F.col("avg_rank") * F.col("up")).alias("w_plus")
    r = value_ranks(nz, list(by), "m")
    sizes = r.groupBy(*by).agg(F.sum("n").alias("__all"), w_plus)
    met = F.lit(True)
    for b in by:
        met = met & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    small = r.alias("l").join(sizes.filter(F.col("__all") <= most).alias("r"), met, "left_semi")
    listed = small.groupBy(*by).agg(F.sum("n").alias("n"), w_plus, F.sort_array(F.collect_list(F.struct((2 * F.col("avg_rank")).cast("long").alias("r"), F.col("n").alias("k")))).alias("ranks"))

    @F.arrow_udf(DoubleType())
    def p(ranks: pa.Array, w: pa.Array) -> pa.Array:
        each, off = ranks.flatten(), np.cumsum(np.append(0, ranks.value_lengths().to_numpy()))
        twice, k = each.field("r").to_numpy(), each.field("k").to_numpy()
        return pa.array([signed_rank_p(np.repeat(twice[lo:hi], k[lo:hi]), round(2 * v)) for lo, hi, v in zip(off[:-1], off[1:], w.to_pylist(), strict=True)], pa.float64())

    got = listed.select(*by, "n", "w_plus", p("ranks", "w_plus").alias("p"))
    large = sizes.filter(F.col("__all") > most).select(*by, F.col("__all").alias("n"), "w_plus", F.lit(None).cast("double").alias("p"))
    got = got.unionByName(large)
    return got.select(*by, "n", "w_plus", F.nanvl("p", F.lit(None).cast("double")).alias("p"))


def least_squares(df: DataFrame, y: str, xs: list[str], *by: str) -> DataFrame:
    """``by, n, coefficients, errors, t, p, r2, f, p_f``: y on a constant and ``xs``, constant first.

    One aggregation sums the products of all columns, a square of few numbers a group, whatever the number of rows; each group's
    square is solved on its own. Rows with a null are left out. Without enough rows, or with columns that depend on each other, all is null.
    """
    columns = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    k = len(columns)
    rows = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*xs, y]))
    # sums about each group's means: products of large values would lose the digits that matter
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("n"))
    part = rows.join(means, list(by)) if by else rows.crossJoin(F.broadcast(means))
    centred = [columns[i] - F.col(f"__m{i}") for i in range(1, k)]
    g = part.groupBy(*by, "n", *[f"__m{i}" for i in range(1, k)]).agg(F.array(*[F.sum(a * b) for a in centred for b in centred]).alias("gram"))

    result = "coefficients array<double>, errors array<double>, t array<double>, p array<double>, r2 double, f double, p_f double"

    @F.pandas_udf(result)
    def solve(gram: pd.Series, mean: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for s, m, c in zip(gram, mean, n, strict=True):
            s, m, c, q = np.array(s, float).reshape(k - 1, k - 1), np.array(m, float), int(c), k - 2
            xx, xy, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
            free = c - q - 1
            scale = np.sqrt(np.diag(xx))
            if free <= 0 or not (scale > 0).all() or np.linalg.matrix_rank(xx / np.outer(scale, scale)) < q:
                out.append((None,) * 7)
                continue
            inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
            beta = inverse @ xy
            left = max(0.0, float(yy - beta @ xy))
            var = left / free
            constant = m[-1] - beta @ m[:-1]
            errors = np.sqrt(var * np.concatenate([[1.0 / c + m[:-1] @ inverse @ m[:-1]], np.diag(inverse)]))
            coefficients = np.concatenate([[constant], beta])
            with np.errstate(invalid="ignore", divide="ignore"):
                t = coefficients / errors
                f = (yy - left) / q / var if var > 0 else np.inf
            p = np.where(np.isinf(t), 0.0, beta_tail(free / (free + t * t), free / 2, 0.5))
            out.append((coefficients.tolist(), errors.tolist(), t.tolist(), p.tolist(), 1 - left / yy if yy > 0 else None, f, 0.0 if np.isinf(f) else float(beta_tail(free / (free + q * f), free / 2, q / 2))))
        return pd.DataFrame(out, columns=["coefficients", "errors", "t", "p", "r2", "f", "p_f"])

    solved = g.select(*by, "n", solve("gram", F.array(*[F.col(f"__m{i}") for i in range(1, k)]), F.col("n")).alias("__s"))
    return solved.select(*by, "n", "__s.*")
