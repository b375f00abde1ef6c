"""Secret scanning with built-in expressions only: patterns, plus two character Markov models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]+", 0, 24),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
_SPAN = "array<struct<s:int,k:int,e:int>>"


def _matches(df: DataFrame, text: str, pattern: str, counted: int, least: int, kind: int, out: str) -> DataFrame:
    """Adds ``out``: the spans of the leftmost non-overlapping matches, in code points.

    The texts between the matches come from ``split`` by the same pattern, so positions are running
    sums of lengths; one projection, no shuffle, no Python.
    """
    p = F.lit(pattern)
    df = df.withColumn("__m", F.regexp_extract_all(text, p, F.lit(0)))
    df = df.withColumn("__v", F.regexp_extract_all(text, p, F.lit(counted)) if counted else F.col("__m"))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(text, pattern, -1)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        s = acc["at"] + F.length(F.element_at("__g", i))
        e = s + F.length(F.element_at("__m", i))
        kept = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        more = F.when(F.length(F.element_at("__v", i)) >= least, F.concat(acc["spans"], kept)).otherwise(acc["spans"])
        return F.struct(e.alias("at"), more.alias("spans"))

    found = F.aggregate(F.sequence(F.lit(1), F.size("__m")), start, step)["spans"]
    return df.withColumn(out, F.when(F.size("__m") > 0, found).otherwise(F.array().cast(_SPAN))).drop("__m", "__v", "__g")


def _codes(token: Column) -> Column:
    """Positions in ALPHABET (from 1; 0: none) of a token's characters."""
    return F.transform(F.slice(F.split(token, ""), F.lit(1), F.length(token)), lambda c: F.instr(F.lit(ALPHABET), c))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 60, random_strings: int = 2000) -> list[float]:
    """Log-likelihood ratios of character pairs: random strings against ordinary identifiers.

    Labelled samples: random strings are digests of the numbers below ``random_strings`` written as hex,
    base64 and capitals with digits; identifiers are the words of ``sample_docs`` documents (those of the
    smallest id hash), alone and joined in threes by ``_``, ``-`` and capitals. Both sizes are bounds of the
    training sample only; every document is scanned. Add-one smoothing makes every pair defined, so an
    empty table trains to a model too. Returns ``len(ALPHABET) ** 2`` values, row by row.
    """
    spark, a = docs.sparkSession, len(ALPHABET)
    ids = docs.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    texts = docs.join(F.broadcast(ids), docs[id_col] == F.col("__id"), "left_semi").select(F.coalesce(text_col, F.lit("")).alias("t"))
    words = texts.select(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z]{2,20}(?![A-Za-z0-9+/_=-])"), F.lit(0)).alias("w"))
    w3 = lambda i: F.element_at("w", i)
    n = F.size("w")
    threes = F.when(
        n >= 3,
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), n - 2),
                lambda i: F.array(
                    F.concat_ws("_", w3(i), w3(i + 1), w3(i + 2)),
                    F.concat_ws("-", w3(i), w3(i + 1), w3(i + 2)),
                    F.concat(w3(i), F.initcap(w3(i + 1)), F.initcap(w3(i + 2))),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    plain = words.select(F.explode(F.concat("w", threes)).alias("tok"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(random_strings).select(
        F.explode(
            F.array(
                digest,
                F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", ""),
                F.translate(F.substring(F.base64(F.unhex(digest)), 1, 32), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ23"),
            )
        ).alias("tok")
    )
    both = plain.withColumn("r", F.lit(0)).unionByName(made.withColumn("r", F.lit(1))).withColumn("c", _codes(F.col("tok"))).filter(F.size("c") > 1)
    pairs = both.select("r", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("x"), F.element_at("c", i + 1).alias("y")))).alias("p"))
    counts = [[[1.0] * a for _ in range(a)] for _ in range(2)]
    for row in pairs.groupBy("r", "p.x", "p.y").count().filter("x > 0 and y > 0").collect():  # 2 * len(ALPHABET) ** 2 rows at most
        counts[row["r"]][row["x"] - 1][row["y"] - 1] += row["count"]
    rows = [[[math.log(v / sum(line)) for v in line] for line in side] for side in counts]
    return [rows[1][i][j] - rows[0][i][j] for i in range(a) for j in range(a)]


def secret_scan(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 20, min_ratio: float = 12.0, min_mean: float = 0.4, min_chars: int = 8) -> DataFrame:
    """Spans of secrets in every text: ``id, base, markov, text``, spans as ``array<struct<s,k,e>>``.

    Base spans come from the fixed patterns BASE (k 0 to 2), leftmost and non-overlapping per kind; a match
    that is too short is passed over whole. The Markov models add spans (k 3): runs of ``least`` or more
    characters of ALPHABET whose log-likelihood ratio, random string against ordinary identifier, is above
    ``min_ratio`` in all and ``min_mean`` a character pair, which have ``min_chars`` different characters; base spans are cut out of a run first, and each part left is tested on its own. Positions are code points, the end is exclusive.

    model: the output of ``train``; trained on ``docs`` if not given. Null text counts as empty and has no
    spans; repeated rows give repeated results; an empty table an empty one; other columns are ignored.
    """
    model = train(docs, id_col, text_col) if model is None else model
    a = len(ALPHABET)
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    for k, (_, pattern, counted, shortest) in enumerate(BASE):
        df = _matches(df, "__t", pattern.replace("]+", "]{24,}") if k == 2 else pattern, counted, shortest, k, f"__b{k}")
    df = df.withColumn("base", F.array_sort(F.concat("__b0", "__b1", "__b2"))).drop("__b0", "__b1", "__b2")
    df = _matches(df, "__t", rf"(?<!{_CLASS}){_CLASS}{{{least},}}", 0, least, 3, "__c")
    ratios = F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")

    def score(c: Column) -> Column:
        codes = _codes(F.substring(F.col("__t"), c["s"] + 1, c["e"] - c["s"]))
        # the codes are put in a one-element array so that they are made once for each candidate
        return F.element_at(
            F.transform(
                F.array(codes),
                lambda v: F.aggregate(
                    F.sequence(F.lit(1), F.size(v) - 1),
                    F.lit(0.0),
                    lambda s, i: s + F.element_at(ratios, (F.element_at(v, i) - 1) * a + F.element_at(v, i + 1)),
                ),
            ),
            1,
        )

    def meets(b: Column, c: Column) -> Column:
        return (b["s"] < c["e"]) & (c["s"] < b["e"])

    def part(s: Column, e: Column) -> Column:
        one = F.array(F.struct(s.alias("s"), F.lit(3).alias("k"), e.alias("e")))
        return F.when(e - s >= least, one).otherwise(F.array().cast(_SPAN))

    def rest(c: Column) -> Column:
        """What the base spans, in order of their starts, leave of a run."""
        start = F.struct(c["s"].alias("at"), F.array().cast(_SPAN).alias("parts"))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.concat(acc["parts"], part(acc["at"], b["s"])).alias("parts"))
        return F.aggregate(F.filter("base", lambda b: meets(b, c)), start, step, lambda acc: F.concat(acc["parts"], part(acc["at"], c["e"])))

    df = df.withColumn("__f", F.flatten(F.transform("__c", lambda c: F.when(F.exists("base", lambda b: meets(b, c)), rest(c)).otherwise(F.array(c)))))
    return df.select(F.col(id_col), "base", F.when(F.size("__f") > 0, F.filter("__f", lambda c: (F.size(F.array_distinct(_codes(F.substring(F.col("__t"), c["s"] + 1, c["e"] - c["s"])))) >= min_chars) & (score(c) > F.greatest(F.lit(min_ratio), min_mean * (c["e"] - c["s"] - 1))))).otherwise(F.col("__f")).alias("markov"), F.col("__t").alias("text"))


KINDS = tuple(kind for kind, *_ in BASE) + ("markov",)


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))
