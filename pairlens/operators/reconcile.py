"""Do two runs say the same? Agreement, drift, fingerprints, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreement(both: DataFrame, d1: str, d2: str, *by: str) -> DataFrame:
    """Of two score differences for each key: same winner, identical, and how far apart."""
    x, y = F.col(d1), F.col(d2)
    gap = F.abs(x - y)
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.signum(x) == F.signum(y)) / F.count(F.lit(1))).alias("pct_same_winner"), (100.0 * F.count_if(x == y) / F.count(F.lit(1))).alias("pct_identical"),
        F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.count_if((x == 0) & (y == 0)).alias("ties_in_both"),
        (100.0 * F.count_if((F.signum(x) == F.signum(y)) & (x != 0)) / F.nullif(F.count_if((x != 0) & (y != 0)), F.lit(0))).alias("pct_same_without_ties"),
    )


def bounded_agreement(both: DataFrame, d1: str, d2: str, slack: float | Column) -> DataFrame:
    """A lower bound: pairs whose gap is within twice the largest difference of two runs are undetermined."""
    s = slack if isinstance(slack, Column) else F.lit(slack)
    sure = (F.abs(F.col(d1)) > 2 * s) & (F.abs(F.col(d2)) > 2 * s)
    same = sure & (F.signum(d1) == F.signum(d2))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~sure).alias("undetermined"), (100.0 * F.count_if(same) / F.count(F.lit(1))).alias("lower_bound"))


def counterbalanced(first: DataFrame, second: DataFrame, key: list[str], d: str, *by: str) -> DataFrame:
    """Mean of both orders for each key, then its mean and the share of positive ones."""
    j = first.select(*key, *by, F.col(d).alias("x")).join(second.select(*key, F.col(d).alias("y")), key).withColumn("m", (F.col("x") + F.col("y")) / 2)
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean_gap"), (100.0 * F.count_if(F.col("m") > 0) / F.count(F.lit(1))).alias("pct_a"), F.count_if(F.signum("x") != F.signum("y")).alias("changed"))


def drift(changes: DataFrame, group: str, name: str, change: str) -> DataFrame:
    """By group: the largest change and every name that reaches it."""
    m = changes.groupBy(group).agg(F.max(F.abs(change)).alias("max_change"), F.count(F.lit(1)).alias("n"))
    at = changes.join(m, group).filter(F.abs(F.col(change)) == F.col("max_change")).groupBy(group).agg(F.sort_array(F.collect_set(name)).alias("at"))
    return m.join(at, group)


def fingerprint(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Order-independent fingerprint of a set of rows: sums of two halves of each row's SHA-256; nothing is gathered."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    half = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), half(1).alias("f1"), half(13).alias("f2"))


def duplicates(prints: DataFrame, name: str) -> DataFrame:
    """Groups of equal fingerprints, with the name that stays."""
    return prints.groupBy("n", "f1", "f2").agg(F.count(F.lit(1)).alias("members"), F.min(name).alias("stays")).filter("members > 1").select("stays", "members")


def scale_statistics(both: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """What ``scale_match`` looks at, of two runs' values for the same keys."""
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("r"), (F.median(y) - F.median(x)).alias("median_shift"), (F.max(x) - F.min(x)).alias("range"))


def scale_match() -> Column:
    """Are two runs on one scale: slope near 1, correlation high, medians close. On ``scale_statistics``."""
    return F.col("slope").between(0.8, 1.25) & (F.col("r") >= 0.9) & (F.abs("median_shift") <= 0.1 * F.col("range"))


def canary(scores: DataFrame, score: str, documents: str, *by: str) -> DataFrame:
    """Is a trial run fit to go on: a score for each document, all finite, and not all one value? Null scores count as missing."""
    x = F.col(score)
    finite = F.coalesce(F.bool_and(~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(True))
    g = scores.groupBy(*by).agg(F.count(x).alias("n_scores"), F.count_distinct(documents).alias("n_docs"), finite.alias("finite"), F.count_distinct(score).alias("n_distinct"))
    return g.withColumn("passed", (F.col("n_scores") == F.col("n_docs")) & F.col("finite") & (F.col("n_distinct") > 1))


def changed_labels(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Keys whose label differs, a key of one side alone included: ``key, old_label, new_label``."""
    both = old.select(key, F.col(label).alias("old_label")).join(new.select(key, F.col(label).alias("new_label")), key, "full_outer")
    return both.filter(~F.col("old_label").eqNullSafe(F.col("new_label")))


def completed(design: DataFrame, records: DataFrame, model: str, query: str, at: str, server: str) -> DataFrame:
    """By model: has it exactly the design's queries, since when and until when were they scored, and by which servers?"""
    d = design.select(model, query).distinct().withColumn("wanted", F.lit(True))
    r = records.groupBy(model, query).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("x"), F.max(at).alias("y"), F.collect_set(server).alias("s"))
    both = d.join(r, [model, query], "full_outer")
    return both.groupBy(model).agg(
        F.count("wanted").alias("wanted"), F.count("n").alias("done"), F.bool_and(F.col("wanted").isNotNull() & F.col("n").isNotNull()).alias("complete"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.min("x").alias("scored_from"), F.max("y").alias("scored_to"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))), ",").alias("served_by"),
    )


def check_status(status: Column, baseline: Column, *measured: Column) -> list[Column]:
    """Status of a repeat run's check, and its measurements: a run without banked scores only met itself, so it measured nothing.

    A status that is there already stays, with its measurements.
    """
    banked = F.coalesce(baseline.startswith("banked"), F.lit(False))
    return [F.coalesce(status, F.when(banked, "checked").otherwise("skipped")), *[F.when(status.isNotNull() | banked, m) for m in measured]]


def manifest(runs: DataFrame, model: str, revision: str, role: str) -> DataFrame:
    """One row a model: its revision, its roles together. A model without a revision, or with two, is an error."""
    g = runs.groupBy(model).agg(F.count_distinct(revision).alias("k"), F.min(revision).alias(revision), F.array_join(F.sort_array(F.collect_set(role)), ",").alias("roles"))
    said = F.raise_error(F.concat(F.col(model).cast("string"), F.lit(" has "), F.col("k").cast("string"), F.lit(" revisions")))
    return g.select(model, F.when(F.col("k") == 1, F.col(revision)).otherwise(said.cast(runs.schema[revision].dataType)).alias(revision), "roles")
