"""Joins the audits need: with checks of what must match, priorities, prefixes, nearest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pick
from ..functions.text import match_case, pronoun_gender, swap_pronouns, title_of


class Violation(ValueError):
    """An integrity constraint does not hold."""
from .prefix import nearest, running  # noqa: F401  (nearest is a join by value)


def must_be_empty(violations: DataFrame, message: str) -> None:
    """One job that stops at the first violation."""
    if found := violations.limit(3).collect():
        raise Violation(f"{message}: {found}")


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def one_to_one(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Keys that are not once on each side."""
    x, y = (d.groupBy(*key).agg(F.count(F.lit(1)).alias(c)) for d, c in ((a, "left_rows"), (b, "right_rows")))
    return x.join(y, list(key), "full").filter("left_rows is null or right_rows is null or left_rows <> 1 or right_rows <> 1")


def relabelled(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows whose key has a label, which replaces the one they had."""
    return rows.drop(label).join(labels.select(key, label), key)


def by_priority(probe: DataFrame, key: str, candidates: list[tuple[DataFrame, Column]], value: str) -> DataFrame:
    """The value of the first candidate table that has the key; within a table the smallest order column."""
    every = None
    for n, (df, order) in enumerate(candidates):
        one = df.select(key, value, F.lit(n).alias("__p"), order.cast("string").alias("__o"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(key).agg(F.min_by(value, F.struct("__p", "__o")).alias(value), F.min("__p").alias("source"))
    return probe.join(best, key, "left")


def by_prefix(probe: DataFrame, code: str, table: DataFrame, full: str) -> DataFrame:
    """Exact code, else with .00, else .01, else the first code in order that starts with it: equi-joins only.

    ``full`` codes are a 7-character stem and an extension, so a prefix match is a match of stems.
    """
    t = table.select(F.col(full).alias("__f")).distinct()
    tries = probe.select(code, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), c.alias("c")) for p, c in enumerate((F.col(code), F.concat(code, F.lit(".00")), F.concat(code, F.lit(".01"))))])).alias("x")).select(code, "x.*")
    exact = tries.join(t, F.col("c") == F.col("__f")).select(code, "p", "__f")
    stem = t.withColumn("__s", F.substring_index("__f", ".", 1))
    prefix = probe.join(stem, F.col(code) == F.col("__s")).select(code, F.lit(3).alias("p"), "__f")
    best = exact.unionByName(prefix).groupBy(code).agg(F.min_by("__f", F.struct("p", "__f")).alias("found"), F.min("p").alias("step"))
    return probe.join(best, code, "left")


def within_pairs(df: DataFrame, cell: list[str], item: str, *values: str) -> DataFrame:
    """Unordered pairs of a cell's items, each once."""
    l, r = df.alias("l"), df.alias("r")
    on = F.col(f"l.{item}") < F.col(f"r.{item}")
    for c in cell:
        on = on & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return l.join(r, on).select(*[F.col(f"l.{c}").alias(c) for c in cell], F.col(f"l.{item}").alias("x"), F.col(f"r.{item}").alias("y"), *[F.col(f"{s}.{v}").alias(f"{v}_{n}") for v in values for s, n in (("l", "x"), ("r", "y"))])


def scored_once(requests: DataFrame, key: list[str], score) -> DataFrame:
    """Score each distinct key once and give the score to every request."""
    return requests.join(score(requests.select(*key).distinct()), key)


def carried_gender(docs: DataFrame, names: DataFrame, key: str, spans: Column, text: Column) -> DataFrame:
    """What gender a text shows: that of the first token of its names that ``names`` (name, gender) knows, else that of its pronouns.

    ``key, carried, gender, source``; all null where there is no sign. The tokens are joined, so the name table
    may be of any size; of a document one row leaves the tasks.
    """
    tokens = docs.select(F.col(key), F.posexplode(F.split(F.array_join(spans, " "), r"\s+")).alias("at", "token"))
    known = tokens.withColumn("name", F.lower(F.regexp_replace("token", "[^A-Za-z']", ""))).join(names.select("name", "gender"), "name")
    first = known.groupBy(key).agg(F.min_by(F.struct("token", "gender"), "at").alias("got"))
    shown = docs.select(F.col(key), pronoun_gender(text).alias("by_pronoun")).join(first, key, "left")
    named = F.col("got").isNotNull()
    return shown.select(key, F.col("got.token").alias("carried"), F.coalesce("got.gender", "by_pronoun").alias("gender"), F.when(named, "name").when(F.col("by_pronoun").isNotNull(), "pronoun").alias("source"))


def forms(docs: DataFrame, names: DataFrame, surnames: list[str], seed: str, mode: str = "auto", most_names: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A masculine and a feminine form of each document that differ in gender markers alone.

    ``docs`` has ``carried`` and ``gender`` of ``carried_gender``; ``names`` has ``name, gender, count, twin``. ``swap``: the text
    and its swapped twin, where it shows a gender and the swap changes it. ``inject``: a name before the text,
    drawn by hash from the ``most_names`` most frequent masculine ones that have a twin, the text's pronouns set to agree.
    ``auto``: swap where possible, else inject. With ``swap``, documents without a pair have null forms and mode.
    """
    low = F.lower(F.regexp_replace("carried", "[^A-Za-z']", ""))
    d = docs.withColumn("__low", low).join(names.select(F.col("name").alias("__low"), F.col("twin").alias("__twin")), "__low", "left")
    feminine, masculine = swap_pronouns(F.col(text), "feminine"), swap_pronouns(F.col(text), "masculine")
    given = match_case(F.col("carried"), F.col("__twin"))
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.col("carried"), F.lit(r"\E\b"))
    renamed = lambda t: F.when(F.col("__twin").isNotNull(), F.regexp_replace(t, quoted, given)).otherwise(t)
    other = F.when(F.col("gender") == "M", renamed(feminine)).when(F.col("gender") == "F", renamed(masculine))
    d = d.withColumn("__other", other if mode != "inject" else F.lit(None).cast("string"))
    swapped = F.col("__other").isNotNull() & (F.col("__other") != F.col(text))
    best = names.filter((F.col("gender") == "M") & F.col("twin").isNotNull()).orderBy(F.desc("count"), "name").limit(most_names)
    pool = best.agg(F.sort_array(F.collect_list(F.struct("name", "twin"))).alias("__pool"))  # of most_names entries
    d = d.crossJoin(F.broadcast(pool))
    drawn = F.when(F.size("__pool") > 0, F.element_at("__pool", (pick(F.greatest(F.size("__pool"), F.lit(1)), seed, F.col(key)) + 1).cast("int")))
    sur = F.element_at(F.array(*map(F.lit, surnames or [""])), (pick(len(surnames) or 1, seed, "surname", F.col(key)) + 1).cast("int"))
    d = d.withColumn("mode", F.when(swapped, "swap").when(F.lit(mode != "swap") & drawn.isNotNull(), "inject")).withColumn("__n", drawn)
    pair = lambda kept, name, body: F.when(F.col("mode") == "swap", F.when(F.col("gender") == kept, F.col(text)).otherwise(F.col("__other"))).when(F.col("mode") == "inject", title_of(body, F.col(f"__n.{name}"), sur))
    return d.select(key, "mode", pair("M", "name", masculine).alias("male_text"), pair("F", "twin", feminine).alias("female_text"))


def banked(triples: DataFrame, banks: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """``triples`` with each bank's score, null where it has none; a bank that has a key twice is an error, as its score would be a guess."""
    out = triples
    for name, bank in banks.items():
        once = bank.groupBy(*key).agg(F.min(name).alias(name), F.count(F.lit(1)).alias("__n"))
        once = once.select(*key, F.when(F.col("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit(f"{name} is there more than once for"), *[F.col(k).cast("string") for k in key])).cast(bank.schema[name].dataType)).otherwise(F.col(name)).alias(name))
        out = out.join(once, key, "left")
    return out


def cross_half_wins(left: DataFrame, right: DataFrame, cell: list[str], value: str) -> DataFrame:
    """By cell: ``pairs``, all left times all right rows, and ``half``, 2 for each pair that left wins and 1 for each tie.

    The pairs are never made: rows are counted by value, and a running count of the right ones says how many each left value beats.
    Cells without rows on both sides have no row.
    """
    one = left.filter(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count(F.lit(1)).alias("__l"), F.lit(0).cast("long").alias("__r"))
    two = right.filter(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.lit(0).cast("long").alias("__l"), F.count(F.lit(1)).alias("__r"))
    counts = one.unionByName(two).groupBy(*cell, value).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    r = running(counts, cell, [value], {"__below": "__r"})
    g = r.groupBy(*cell).agg((F.sum("__l") * F.sum("__r")).alias("pairs"), F.sum(F.col("__l") * (2 * F.col("__below") + F.col("__r"))).alias("half"))
    return g.filter("pairs > 0")
