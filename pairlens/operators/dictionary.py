"""Names of a table of any size in texts: word n-grams joined to the names, overlaps resolved by a fold over places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"(?U)\w+|\W+"


def found_names(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", most_shipped: int = 200_000, most_bytes: int = 1 << 23) -> DataFrame:
    """``key, names``: the names in each text as written there, each once, longest first; the empty list where there is none.

    What an alternation of all names between word boundaries, longer ones first and in any case, finds from left to right. A name has
    to begin and end with a word character; others, and null or empty ones, are in no text. Texts are cut at word boundaries; a
    name of n words is found as n words and what lies between them, so only n-grams of lengths that the table has are made.
    Up to ``most_shipped`` names of ``most_bytes`` go to the tasks and n-grams that are no name are never sent; more names and
    n-grams meet by a shuffle join, so neither has to fit in a task. Of a text's matches the leftmost longest that
    do not overlap are taken; where all names are single words none do, and a text's distinct words are enough. Matches belong to a text's 128-bit digest: copies share them, ids may repeat or be null.
    """
    n_words = F.size(F.filter(F.split(F.col(name), r"(?U)\W+"), lambda w: w != ""))
    listed = names.filter(F.col(name).rlike(r"(?U)^\w(.*\w)?$")).select(F.lower(name).alias("__name"), n_words.alias("__n")).distinct()
    of = {r["__n"]: r for r in listed.groupBy("__n").agg(F.count(F.lit(1)).alias("names"), F.sum(F.octet_length("__name")).alias("bytes")).collect()}  # by the lengths that names have
    if sum(r["names"] for r in of.values()) <= most_shipped and sum(r["bytes"] for r in of.values()) <= most_bytes:
        listed = F.broadcast(listed)
    d = docs.filter(F.col(text).isNotNull())
    rows = docs.select(F.col(key), F.md5(text).alias("__row"))
    empty = F.array().cast("array<string>")
    by_length = lambda ws: F.transform(F.array_sort(F.transform(ws, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    if set(of) <= {1}:
        # first a row of each text, then of each word: in one step the digest would be made for every word; "outer", as Spark else asks twice for the words
        each = d.select(F.md5(text).alias("__row"), F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+"), F.lit(0))).alias("__words"))
        each = each.select("__row", F.explode_outer("__words").alias("__written")).withColumn("__name", F.lower("__written")).join(listed, "__name").groupBy("__row").agg(F.collect_set("__written").alias("__words"))
        return rows.join(each.select("__row", by_length("__words").alias("names")), "__row", "left").select(key, F.coalesce("names", empty).alias("names"))
    # words and what lies between them take turns, so a gram of n words is 2n - 1 parts from a word on
    d = d.select(F.md5(text).alias("__row"), F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)).alias("__p"))
    first = F.when(F.get("__p", 0).rlike(r"(?U)^\w"), 0).otherwise(1)

    def grams_of(n: int) -> Column:
        last = F.size("__p") - (2 * n - 1)
        gram = lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("__p", at + 1, 2 * n - 1), "").alias("g"))
        return F.coalesce(F.transform(F.when(last >= first, F.sequence(first, last, F.lit(2))), gram), F.array().cast("array<struct<at:int,n:int,g:string>>"))

    # grams are made inside the row: a row for each with all parts of its text would grow with the square of the text
    grams = d.select("__row", F.explode_outer(F.concat(*[grams_of(n) for n in sorted(of)])).alias("__g"))
    hits = grams.select("__row", F.col("__g.at").alias("__at"), F.col("__g.n").alias("__m"), F.col("__g.g").alias("__written"), F.lower("__g.g").alias("__name")).join(listed, "__name")
    hits = hits.filter(F.col("__m") == F.col("__n"))
    match = F.struct(F.col("__at").alias("at"), (-F.col("__m")).alias("less"), F.col("__written").alias("w"))
    each = hits.groupBy("__row").agg(F.array_sort(F.collect_set(match)).alias("__hits"))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("got"))
    taken = F.aggregate("__hits", start, lambda s, h: F.when(h["at"] > s["end"], F.struct((h["at"] - 2 * h["less"] - 2).alias("end"), F.array_append(s["got"], h["w"]).alias("got"))).otherwise(s))["got"]
    return rows.join(each.select("__row", by_length(F.array_distinct(taken)).alias("names")), "__row", "left").select(key, F.coalesce("names", empty).alias("names"))


def agreement(pairs: DataFrame, one: str, two: str, *by: str) -> DataFrame:
    """TP, FP and FN of two token sets a text, with recall, precision and Jaccard over all: ``one`` is held against ``two``."""
    inter = F.size(F.array_intersect(one, two))
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), F.sum(inter).alias("tp"), F.sum(F.size(one) - inter).alias("fp"), F.sum(F.size(two) - inter).alias("fn"), F.count_if((F.size(two) > 0) & (inter > 0)).alias("texts_hit"), F.count_if(F.size(two) > 0).alias("texts_with"))
    ratio = lambda x, y: F.col(x) / F.nullif(y, F.lit(0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": ratio("tp", tp + fp), "recall": ratio("tp", tp + fn), "jaccard": ratio("tp", tp + fp + fn)})
