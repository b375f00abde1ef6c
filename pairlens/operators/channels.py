"""One channel of a design alone against the whole: cells that collapse to one comparison, paired changes of contrasts, gaps against a yardstick."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, _cells, collected, in_blocks, intervals, weight_matrix


def collapsed(rows: DataFrame, cell: list[str], items: str, *same: str) -> DataFrame:
    """One comparison a cell: ``cell, n_items, same..., ok``, where ok says that all its items give the same ``same`` columns (nulls are a value)."""
    once = [F.count_distinct(F.coalesce(F.to_json(F.struct(c)), F.lit(""))) == 1 for c in same]
    ok = F.lit(True)
    for o in once:
        ok = ok & o
    return rows.groupBy(*cell).agg(F.count_distinct(items).alias("n_items"), *[F.min(c).alias(c) for c in same], ok.alias("ok"))


def design_checks(comparisons: DataFrame, unit: str, category: str, request: list[str], expected_items: int) -> DataFrame:
    """Counts of a design by category and whether it holds: every cell one comparison of ``expected_items`` items, every request alike in size."""
    sizes = comparisons.groupBy(category, *request).agg(F.count(F.lit(1)).alias("__n"), F.count_if(~F.col("ok")).alias("__bad"), F.count_if(F.col("n_items") != expected_items).alias("__short"))
    units = comparisons.groupBy(category).agg(F.count_distinct(unit).alias("units"))
    g = sizes.groupBy(category).agg(F.sum("__n").alias("comparisons"), F.count(F.lit(1)).alias("requests"), F.min("__n").alias("least"), F.max("__n").alias("most"), F.sum("__bad").alias("not_collapsed"), F.sum("__short").alias("incomplete"))
    return g.join(units, category).withColumn("holds", (F.col("not_collapsed") == 0) & (F.col("incomplete") == 0) & (F.col("least") == F.col("most")))


def paired_contrasts(sums: DataFrame, arm: str, key: str, draws: int, seed: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Contrasts of every model's arms under the same draws, and the changes between them.

    ``sums`` has model, arm, category, key, half and n. First: ``model, arm, contrast, low, high``; second: ``model, arm, against,
    change, low, high`` for every ordered pair of a model's arms. A draw takes the same clusters for all arms, so a change's interval is
    a paired one. Draws are those of ``resample.draw_contrasts``.
    """
    rows = [r for r in collected(sums, "model", arm, "category", key, "half", "n") if r["category"] in ("a", "b")]
    index, _ = _cells(rows, ["model", arm])
    of = {c: sorted({r[key] for r in rows if r["category"] == c}) for c in ("a", "b")}
    place = {c: {v: i for i, v in enumerate(of[c])} for c in of}
    tables: dict[tuple, np.ndarray] = {}
    for r in rows:
        t = tables.setdefault((r["model"], r[arm]), {c: np.zeros((2, len(of[c]))) for c in of})
        t[r["category"]][:, place[r["category"]][r[key]]] += (r["half"], r["n"])

    def contrast(t: dict, w: dict) -> np.ndarray:
        share = {}
        for c in of:
            num, den = w[c] @ t[c][0], w[c] @ t[c][1]
            with np.errstate(invalid="ignore", divide="ignore"):
                share[c] = np.where(den > 0, 50.0 * num / den, np.nan)
        return share["a"] - share["b"]

    pairs = [(m, x, y) for m in index["model"] for x in index[arm] for y in index[arm] if x != y and (m, x) in tables and (m, y) in tables]

    def statistic(b: range) -> dict:
        w = {c: weight_matrix(f"{seed}|{c}", b, len(of[c])) if of[c] else np.zeros((len(b), 0)) for c in of}
        v = {k: contrast(t, w) for k, t in tables.items()}
        return {f"{m}\t{x}\t": v[m, x] for m, x in v} | {f"{m}\t{x}\t{y}": v[m, x] - v[m, y] for m, x, y in pairs}

    ones = {c: np.ones((1, len(of[c]))) for c in of}
    point = {k: float(contrast(t, ones)[0]) for k, t in tables.items()}
    spark = sums.sparkSession
    drawn = intervals(in_blocks(sums, draws, statistic, "string", block)).select("model", "low", "high")
    part = F.split("model", "\t", -1)
    drawn = drawn.select(part[0].alias("model"), part[1].alias("arm"), part[2].alias("against"), "low", "high")
    points = spark.createDataFrame([(str(m), str(x), v) for (m, x), v in point.items()], "model string, arm string, contrast double")
    changes = spark.createDataFrame([(str(m), str(x), str(y), point[m, x] - point[m, y]) for m, x, y in pairs], "model string, arm string, against string, change double")
    levels = points.join(drawn.filter("against = ''").drop("against"), ["model", "arm"])
    return levels, changes.join(drawn, ["model", "arm", "against"])


def overview(levels: DataFrame, changes: DataFrame, by: str = "arm", against: str = "original") -> DataFrame:
    """By arm: models, how many contrasts lie above, below and about zero, medians, and the same of the changes against one arm."""
    sign = lambda: (F.count_if(F.col("low") > 0).alias("above"), F.count_if(F.col("high") < 0).alias("below"), F.count_if((F.col("low") <= 0) & (F.col("high") >= 0)).alias("about"))
    l = levels.groupBy(by).agg(F.count(F.lit(1)).alias("models"), *sign(), F.median("contrast").alias("median"), F.min("contrast").alias("least"), F.max("contrast").alias("most"))
    c = changes.filter(F.col("against") == against).groupBy(by).agg(F.median("change").alias("median_change"), *[x.alias(f"change_{n}") for x, n in zip(sign(), ("above", "below", "about"), strict=True)])
    return l.join(c, by, "left")


def gap_ratio(gaps: DataFrame, yardstick: DataFrame, model: str, gap: Column, dropped: list | None = None) -> DataFrame:
    """By model: mean and median absolute gap of one channel, the yardstick's mean, and their ratio; without the ``dropped`` models."""
    keep = ~F.col(model).isin(dropped) if dropped else F.lit(True)
    one = gaps.filter(keep).groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mean_gap"), F.median(F.abs(gap)).alias("median_gap"))
    other = yardstick.groupBy(model).agg(F.avg(F.abs(gap)).alias("yardstick"))
    return one.join(other, model).withColumn("ratio", F.col("mean_gap") / F.nullif(F.col("yardstick"), F.lit(0.0)))
