"""Statistics of one run, tallies of labelled marks, precision and layout of runs, effect of conditions on pairs of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_wins
from ..functions.text import PRONOUNS, VARIANTS, beside_her, grammatical_by_next, replace_names, replace_words, uniform_pronouns, word

CONDITIONS = ("original", "lowercase_only", "names_only", "pronouns_only", "full", "gram_her_their", "gram_her_them", "gram_pos")


def run_statistics(rows: DataFrame, a: str, b: str, inside: Column, own: Column, *by: str) -> DataFrame:
    """By model: comparisons, those outside the window, ties, shares and contrasts of all, of the ones inside and of the ones with own marks, and the mean gap inside.

    ``rows`` has a category; a contrast without both typed categories is null.
    """
    x, y = F.col(a), F.col(b)
    half = half_wins(x, y)
    share = lambda keep: 50.0 * F.sum(F.when(keep, half)) / F.count_if(keep)
    of = lambda keep: share(keep & (F.col("category") == "a")) - share(keep & (F.col("category") == "b"))
    every = F.lit(True)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("n_outside"), (100.0 * F.count_if(x == y) / F.count(F.lit(1))).alias("pct_ties"), share(every).alias("share"), of(every).alias("contrast"),
        share(inside).alias("share_inside"), F.avg(F.when(inside, F.abs(x - y))).alias("mean_gap_inside"), F.count_if(own).alias("n_own"), share(own).alias("share_own"), of(own).alias("contrast_own"),
    )


def mark_tally(marks: DataFrame, doc: str, kind: str, ref: str, owner: str) -> DataFrame:
    """By kind of mark: documents, occurrences, those of the owner, of others and of nobody (null), and documents with one of the owner's."""
    mine = F.coalesce(F.col(ref) == owner, F.lit(False))
    each = marks.groupBy(kind, doc).agg(F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("own"), F.count_if(F.col(ref).isNull()).alias("none"))
    return each.groupBy(kind).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum("own").alias("n_owner"), F.sum(F.col("n") - F.col("own") - F.col("none")).alias("n_other"), F.sum("none").alias("n_none"), F.count_if(F.col("own") > 0).alias("docs_with_owner"),
    )


def precision(explicit: Column, version: Column, stored: Column) -> Column:
    """What a loader ran at: its own dtype, else single precision before version 5, else what the checkpoint stores; ``unverified`` if nothing says."""
    short = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])[c], c)
    major = F.split_part(version, F.lit("."), F.lit(1)).try_cast("int")
    said = explicit.isNotNull() & (explicit != "auto")
    return F.when(said, short(explicit)).when(explicit.isNull() & (major < 5), "fp32").otherwise(F.coalesce(short(stored), F.lit("unverified")))


# Short names of number formats.
SHORT = {"float32": "fp32", "F32": "fp32", "bfloat16": "bf16", "BF16": "bf16", "float16": "fp16", "F16": "fp16", "F64": "fp64", "float64": "fp64"}


def checked_layouts(models: DataFrame, layouts: DataFrame, records: DataFrame, key: str = "model") -> DataFrame:
    """Each model with its request layout and the batch size of its record; no layout, no record, or another route in it stops the job."""
    j = models.select(key).join(layouts, key, "left").join(records.select(key, F.col("route").alias("__route"), "batch_size"), key, "left")
    why = F.when(F.col("route").isNull(), "no request layout").when(F.col("__route").isNull(), "no run record").when(F.col("route") != F.col("__route"), "its record has another route")
    stop = F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": "), why)).cast("boolean")
    return j.filter(F.when(why.isNull(), F.lit(True)).otherwise(stop)).drop("__route")


def condition_effect(pairs: DataFrame, male: str, female: str, names: Column | None = None, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """``condition, pairs, identical, distinct_texts, changed, gap``: what each condition leaves of the difference between a pair's two texts.

    identical: pairs whose texts are the same after it; changed: texts that it alters; gap: mean difference of the two lengths.
    Only the case folding condition lowers case. All conditions of a pair are made in one pass over it: what several share is made once,
    a text without pronouns has its names replaced alone, and the second of two equal texts is not worked on again.
    """
    for c in conditions:
        if c not in (*VARIANTS, "original", "lowercase_only"):
            raise ValueError(f"unknown condition {c!r}")
    x = pairs.select(F.col(male).alias("m"), F.col(female).alias("f"))
    x = x.withColumn("same", F.coalesce(F.col("m") == F.col("f"), F.lit(False)))
    for side in "mf":
        c, n, base = F.col(side), F.col(f"{side}_n"), F.col(f"{side}_b")
        first = lambda made, what, side=side: made if side == "m" else F.when(F.col("same"), F.col(f"m_{what}")).otherwise(made)
        x = x.withColumns({f"{side}_p": first(F.coalesce(c.rlike(word("|".join(PRONOUNS))), F.lit(False)), "p"), f"{side}_n": first(c if names is None else replace_names(c, names), "n")})
        x = x.withColumn(f"{side}_b", first(F.when(F.col(f"{side}_p"), beside_her(n)), "b"))
        said = {
            "pronouns_only": uniform_pronouns(c), "full": uniform_pronouns(n), "gram_her_their": replace_words(base, [("her", "their")]),
            "gram_her_them": replace_words(base, [("her", "them")]), "gram_pos": grammatical_by_next(n),
        }
        plain = {"original": c, "lowercase_only": F.lower(c), "none": c, "pronouns_only": c}
        of = lambda forms, n=n: F.array(*[forms.get(k, n) for k in conditions])
        made = F.when(F.col(f"{side}_p"), of(plain | said)).otherwise(of(plain))
        x = x.withColumn(f"{side}_c", first(made, "c"))
    each = []
    for i, k in enumerate(conditions):
        a, b = F.col("m_c")[i], F.col("f_c")[i]
        gap = F.length(a) - F.length(b)
        for text, before, one in ((a, F.col("m"), 1), (b, F.col("f"), 0)):
            counted = [F.lit(one).alias("pairs"), F.when(a == b, one).otherwise(0).alias("identical"), (gap * one if one else F.lit(0)).alias("gap"), F.when(gap.isNotNull(), one).otherwise(0).alias("gaps")]
            each.append(F.struct(F.lit(k).alias("condition"), F.md5(text).alias("digest"), *counted, F.when(before != text, 1).otherwise(0).alias("changed")))
    r = x.select(F.explode(F.array(*each)).alias("c")).select("c.*")
    sums = [F.sum(c).alias(c) for c in ("pairs", "identical", "gap", "gaps", "changed")]
    r = r.groupBy("condition", "digest").agg(*sums).groupBy("condition").agg(*sums, F.count("digest").alias("distinct_texts"))
    return r.select("condition", "pairs", "identical", F.try_divide(F.col("gap").cast("double"), F.col("gaps")).alias("gap"), "distinct_texts", "changed")
