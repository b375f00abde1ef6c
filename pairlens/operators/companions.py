"""Summaries over the results of many models: replays, utility, directions, precision, units of work, lookups that fail loudly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bf16
from .resample import ratio_bootstrap


def replay_summary(pools: DataFrame, model: str, cluster: str, s: int, draws: int, seed: str) -> DataFrame:
    """By model: shares kept by replay and live, their paired difference in points with a cluster interval, and whether the replay is supported (it holds zero).

    ``pools`` is ``resimulate.replayed``'s with model and cluster.
    """
    room = F.least(F.lit(s), F.col("members"))
    each = pools.withColumn("__d", 100.0 * (F.col("kept_live") - F.col("kept_replay")) / room)
    sums = each.groupBy(model, cluster).agg(F.sum("__d").alias("d"), F.count(F.lit(1)).alias("n"))
    level = each.groupBy(model).agg(F.count(F.lit(1)).alias("pools"), (100.0 * F.sum("kept_replay") / F.sum(room)).alias("replay_pct"), (100.0 * F.sum("kept_live") / F.sum(room)).alias("live_pct"), (100.0 * F.avg("identical")).alias("identical_pct"))
    diff = ratio_bootstrap(sums, "d", "n", cluster, draws, seed, model).select(model, F.col("point").alias("diff"), "low", "high")
    return level.join(diff, model).withColumn("supported", (F.col("low") <= 0) & (F.col("high") >= 0))


def span(values: DataFrame, model: str, value: str, *by: str) -> DataFrame:
    """Least and greatest value with the models that have them, of equal ones the first."""
    return values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("models"), F.min(value).alias("least"), F.min_by(model, F.struct(F.col(value), F.col(model))).alias("least_model"), F.max(value).alias("most"), F.min_by(model, F.struct(-F.col(value), F.col(model))).alias("most_model"),
    )


def changes_summary(changes: DataFrame, change: str, low: str, high: str, *by: str) -> DataFrame:
    """Range of some changes, the largest either way, and how many intervals hold zero or lie on one side of it."""
    return changes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("models"), F.min(change).alias("least"), F.max(change).alias("most"), F.max(F.abs(change)).alias("largest"),
        F.count_if((F.col(low) <= 0) & (F.col(high) >= 0)).alias("about_zero"), F.count_if(F.col(high) < 0).alias("below_zero"), F.count_if(F.col(low) > 0).alias("above_zero"),
    )


def direction(rho: Column, p: Column, alpha: float = 0.05) -> Column:
    """``a`` where shares fall as the other side's percentage rises beyond chance, ``b`` where they rise, else ``unclear``."""
    clear = F.coalesce(p < alpha, F.lit(False))
    return F.when(clear & (rho < 0), "a").when(clear & (rho > 0), "b").otherwise("unclear")


def by_precision(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Rows of scores that bfloat16 holds exactly and the others, and what shares and ties become when all scores are rounded to it."""
    x, y = F.col(a), F.col(b)
    half = lambda u, v: F.when(u > v, 1.0).when(u == v, 0.5).otherwise(0.0)
    r = rows.withColumn("__x", bf16(x.cast("double"))).withColumn("__y", bf16(y.cast("double"))).withColumn("__coarse", (F.col("__x") == x) & (F.col("__y") == y))
    fine = ~F.col("__coarse")
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__coarse").alias("n_coarse"), (100.0 * F.avg(F.when(fine, half(x, y)))).alias("fine_share"), (100.0 * F.avg(half(x, y))).alias("share"), (100.0 * F.avg((x == y).cast("int"))).alias("pct_ties"),
        (100.0 * F.avg(half(F.col("__x"), F.col("__y")))).alias("rounded_share"), (100.0 * F.avg((F.col("__x") == F.col("__y")).cast("int"))).alias("rounded_pct_ties"),
    )


def labelled(df: DataFrame, key: str, labels: dict[str, str], out: str = "label") -> DataFrame:
    """The display label of each key; a key without one stops the job, so that no table prints a raw one."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.lit(None).cast("map<string,string>")
    return df.withColumn(out, F.coalesce(table[F.col(key)], F.raise_error(F.concat(F.lit("no label for "), F.coalesce(F.col(key), F.lit("null"))))))


def work_units(items: DataFrame, unit: str, order: str, keep: Column) -> DataFrame:
    """Requests: each unit's kept items, how many, and the first and last of their order; a unit whose items all go is none."""
    return items.filter(keep).groupBy(unit).agg(F.count(F.lit(1)).alias("n_items"), F.min(order).alias("first"), F.max(order).alias("last"))


def scoped(models: DataFrame, date: str, audit_date: Column) -> DataFrame:
    """The models scored on the day that an audit covers; later ones are outside it, not silently audited."""
    return models.filter(F.col(date).cast("date") == audit_date)


def base_codes(rows: DataFrame, title: str, code: str, order: str) -> DataFrame:
    """``title, code`` of base entries, codes that end in .00: titles trimmed and in lower case, of several the first by ``order``, the ending cut."""
    base = rows.filter(F.col(code).endswith(".00"))
    return base.groupBy(F.lower(F.trim(title)).alias("title")).agg(F.min_by(F.regexp_replace(code, r"\.00$", ""), order).alias("code"))
