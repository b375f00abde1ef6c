"""Exact deduplication with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def content_hash(text: Column) -> Column:
    """128 bits of a text, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, hash_text=content_hash) -> DataFrame:
    """Groups of equal texts: one row per input row with ``id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by a 128-bit content hash; inside a hash group the bytes of the texts are compared
    (the text is the second grouping key), so a hash collision never merges two texts. Grouping combines
    on the map side first: a text held by a third of all rows reaches the shuffle once per map task.
    Rows then find their group by the 16-byte hash alone; only the rows of colliding hashes, if there are
    any, are matched by text again.

    keep: ``"min"`` keeps the smallest stable id of a group, ``"max"`` the largest.
    normalise: Column -> Column applied before comparing; None compares the texts as they are.
    hash_text: Column -> Column, the content hash.

    Null text counts as empty. Rows repeated with the same id and text are counted in ``group_size`` and
    share one decision. A null id never wins against another id; a group of null ids alone has a null
    ``keep_id`` and its rows count as kept. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).select("__id", "__text", hash_text(F.col("__text")).alias("__h"))
    best = F.min("__id") if keep == "min" else F.max("__id")
    groups = rows.groupBy("__h", "__text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    light = groups.groupBy("__h").agg(
        F.count(F.lit(1)).alias("__texts"),
        F.first("keep_id").alias("keep_id"),
        F.first("group_size").alias("group_size"),
        F.first(F.sha2("__text", 256)).alias("text_sha256"),
    )
    light = written(light, "exact-groups")
    clash = light.filter("__texts > 1").select("__h")
    single = light.filter("__texts = 1").drop("__texts")
    found = rows.select("__id", "__h").join(single, "__h")
    if not clash.isEmpty():
        inside = groups.join(clash, "__h", "left_semi").withColumn("text_sha256", F.sha2("__text", 256))
        again = rows.join(clash, "__h", "left_semi").join(inside, ["__h", "__text"])
        found = found.unionByName(again.select("__id", "__h", "keep_id", "group_size", "text_sha256"))
    return found.select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, hash_text=content_hash) -> DataFrame:
    """``docs`` with one row of each text, the one ``exact_dedup`` keeps; all columns stay.

    A row goes or stays by its id and its text together, so an id that stands for several texts loses only the ones that
    another id keeps. Of rows repeated with the same id and text one stays. Rows with a null id stay if they are not
    the copy of a row with an id, one for each text. Null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(normalise(text) if normalise else text, 256)
    said = written(exact_dedup(docs, id_col, text_col, keep, normalise, hash_text), "exact")
    gone = said.filter(~F.col("kept")).select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    again = not said.filter("kept").groupBy(id_col, "text_sha256").count().filter("count > 1").isEmpty()
    rows = docs.withColumn("__own", sha)
    out = rows.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")) & (F.col("__own") == F.col("__sha")), "left_anti")
    return (out.dropDuplicates([id_col, "__own"]) if again else out).drop("__own")
