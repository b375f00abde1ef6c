"""Generators and samplers: cross products and hash orders instead of random streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from ..functions.text import fill


def cross(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def small(spark: SparkSession, column: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], [column])


def corpus(items: DataFrame, templates: DataFrame, names: DataFrame) -> DataFrame:
    """Counterfactual pairs: each item with each template and name pair, slots filled for both sides."""
    full = cross(items, templates, names)
    side = lambda n, p, q: fill(F.col("template"), {"name": F.col(n), "pronoun": F.col(p), "possessive": F.col(q), "item": F.col("item")})
    return full.select("item", "style", F.concat_ws("/", "name_a", "name_b").alias("name_pair"), side("name_a", "pronoun_a", "poss_a").alias("doc_a"), side("name_b", "pronoun_b", "poss_b").alias("doc_b"))


def hash_order(seed: str, *parts: Column) -> Column:
    return hash_int(F.lit(seed), *parts)


def per_stratum(df: DataFrame, n: int, seed: str, key: str, *by: str) -> DataFrame:
    """n rows of each stratum, by hash order of a key that tells all rows apart."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def filled_pools(queries: DataFrame, members: DataFrame, size: int, on: int, seed: str) -> DataFrame:
    """Pools of ``size``: up to ``on`` members of the query's category, the rest from the others, no member twice.

    The queries are a stated, small set; members are read once against them and cut to the pool's size before the shuffle.
    """
    m = members.crossJoin(F.broadcast(queries)).withColumn("on_category", F.col("category") == F.col("query_category"))
    w = Window.partitionBy("query", "on_category").orderBy(hash_order(seed, F.col("query"), F.col("member")), "member")
    r = m.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size)  # so each task sends ``size`` rows of a window at most
    n_on = F.least(F.max(F.when(F.col("on_category"), F.col("r")).otherwise(0)).over(Window.partitionBy("query")), F.lit(on))
    r = r.withColumn("n_on", n_on)
    return r.filter((F.col("on_category") & (F.col("r") <= on)) | (~F.col("on_category") & (F.col("r") <= size - F.col("n_on")))).select("query", "member", "on_category")


def every_nth(df: DataFrame, step: int, most: int, order: list[str]) -> DataFrame:
    first = df.orderBy(*order).limit(step * most)  # no later row is taken, so only these are numbered in one task
    r = first.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    return r.filter((F.col("i") % step == 0) & (F.col("i") < step * most)).drop("i")


def handcheck(items: DataFrame, document: str, strata: list[str], each: int, rounds: int, seed: str, *parts: str) -> DataFrame:
    """Rounds of cases for checking by hand: ``each`` of every stratum a round, and no document twice in any round.

    Of a document's items one can be drawn, the first by hash over document, strata and ``parts``; within a stratum the documents' hashes
    say which round takes them, so that rounds never need each other's results. Only the first cases of a stratum are kept.
    """
    order = hash_int(seed, *[F.col(c) for c in (document, *strata, *parts)])
    one = items.groupBy(document).agg(F.min_by(F.struct(*strata, *parts), F.struct(order, *strata, *parts)).alias("x"), F.min(order).alias("h")).select(document, "x.*", "h")
    at = one.withColumn("at", F.row_number().over(Window.partitionBy(*strata).orderBy("h", document)) - 1).filter(F.col("at") < each * rounds)
    return at.select(document, *strata, *parts, (F.floor(F.col("at") / each) + 1).cast("int").alias("round"))


def canaries(items: DataFrame, unit: str, query: str, document: str, units: int, seed: str) -> DataFrame:
    """A trial run: some units by hash, the first query of each against the first document of each, and which document is its own.

    ``units`` squared rows, whatever the size of ``items``.
    """
    one = items.groupBy(unit).agg(F.min(F.struct(query, document)).alias("x")).orderBy(hash_int(seed, F.col(unit)), unit).limit(units)
    asked = one.select(F.col(unit).alias("asked"), F.col(f"x.{query}").alias(query))
    answers = one.select(F.col(unit).alias("shown"), F.col(f"x.{document}").alias(document))
    return asked.crossJoin(F.broadcast(answers)).withColumn("own", F.col("asked") == F.col("shown"))


def positions(rows: DataFrame, query: str, sides: list[str]) -> DataFrame:
    """The layout of requests: each query's distinct documents numbered from 0 in the order of their text, and where each row's sides are."""
    each = rows.select(query, F.explode(F.array(*sides)).alias("doc")).distinct()
    at = each.withColumn("at", F.row_number().over(Window.partitionBy(query).orderBy("doc")) - 1)
    for s in sides:
        rows = rows.join(at.select(query, F.col("doc").alias(s), F.col("at").alias(f"{s}_at")), [query, s])
    return rows
