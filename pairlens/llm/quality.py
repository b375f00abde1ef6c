"""Quality of documents and of hosts: rules on whole texts, failure rates by host shrunk by an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import written

U = K.U
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 5
SALTS = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Rules of one document, on its counts. A document that fails one is counted against its host under that rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "symbols": "100 * n_symbols > 10 * n_words",
    "word_size": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}


def _second(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Another 64 bits of each word, from bytes and powers of other constants."""
    first = np.cumsum(size) - size
    at = np.repeat(starts - first, size) + np.arange(int(size.sum()))
    within = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(K.mix(K.BYTE ^ U(0xA5A5A5A5A5A5A5A5))[data[at]] * K.mix(K.powers(int(size.max()))[: int(size.max())])[within], first)
    return K.mix(h + size.astype(U) * U(3))


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of an Arrow column; null counts as empty.

    Windows are told apart by 128 bits: 64 that order them, 64 that are compared.
    """
    data, offsets = K.flat(column)
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS}
    for lo, hi in K.pieces(offsets):
        off = offsets[lo : hi + 1] - offsets[lo]
        part, n = data[offsets[lo] : offsets[hi]], hi - lo
        if not len(part):
            continue
        of_byte = np.repeat(np.arange(n), np.diff(off))
        out["n_symbols"][lo:hi] = np.bincount(of_byte[SYMBOL[part]], minlength=n)
        out["word_chars"][lo:hi] = np.bincount(of_byte[K.BY_SPACE[part] & ((part & 0xC0) != 0x80)], minlength=n)
        row, starts, stops, h = _words(part, off)
        out["n_words"][lo:hi] = np.bincount(row, minlength=n)
        if len(row):
            out["n_repeat_words"][lo:hi] = _repeated(part, row, starts, stops, h, n)
    for i, text in enumerate(column):
        if out["n_words"][i]:
            lines = [x for x in text.as_py().encode().split(b"\n") if x.strip(WHITE)]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``kernels.words``, letters as they are: row, start, end and hash of each word."""
    inside = K.BY_SPACE[data]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]  # first byte of each text that has one
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[head] = inside[head]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, U)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    size = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(K.BYTE[data[at]] * K.powers(int(size.max()))[within], first)
    return np.searchsorted(offsets, starts, "right") - 1, starts, starts + size, K.mix(h + size.astype(U))


def _repeated(data: np.ndarray, row: np.ndarray, starts: np.ndarray, stops: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a window which occurs twice or more in the row."""
    g = K.grams(h, WINDOW)
    inside = np.flatnonzero(K.whole(row, WINDOW))
    if not len(inside):
        return np.zeros(n, np.int64)
    key = K.mix(g[inside] + row[inside].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key, at = key[order], inside[order]
    alike = np.flatnonzero(key[1:] == key[:-1])
    if not len(alike):
        return np.zeros(n, np.int64)
    other = K.grams(_second(data, starts, stops - starts), WINDOW)
    one, two = at[alike], at[alike + 1]
    same = (row[one] == row[two]) & (other[one] == other[two])
    hit = np.zeros(len(row) + 1, np.int64)
    twice = np.unique(np.concatenate([one[same], two[same]]))
    hit[twice] += 1
    ends = twice + WINDOW
    np.subtract.at(hit, ends, 1)
    covered = np.cumsum(hit[:-1]) > 0
    return np.bincount(row[covered], minlength=n)


def text_counts(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` as they are and COUNTS of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = counts(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(got[c]) for c in COUNTS]], [*batch.schema.names[:-1], *COUNTS])

    chosen = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)], F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"__{i} {chosen.schema[f'__{i}'].dataType.simpleString()}" for i in range(len(columns))), *(f"{c} long" for c in COUNTS)])
    return chosen.mapInArrow(run, schema)


def host_rates(rows: DataFrame, host: str, fails: dict[str, Column], strength: float = 10.0) -> DataFrame:
    """``host, n`` and for each rule ``rate_<rule>``: its failure rate, shrunk to that of all hosts.

    The prior of a rule is a beta distribution with the mean m of all documents. Its weight in documents comes from the
    moments of the hosts' rates: with S the weighted sum of squares between hosts, H hosts, N documents and
    N0 = N - sum(n^2) / N - (H - 1), the share of variance between hosts is r = (S - m(1-m)(H-1)) / (m(1-m) N0), held in
    [0.001, 0.999], and the weight is 1/r - 1. With one host, or a rule that all or no documents fail, it is ``strength``.
    Rows are summed by host before anything is shuffled; a null host is none and has no row.
    """
    sums = rows.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"k_{r}") for r, c in fails.items()])
    n = F.col("n").cast("double")
    moments = sums.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("all"), F.sum(n * n).alias("squares"),
        *[x for r in fails for x in (F.sum(f"k_{r}").alias(f"all_{r}"), F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"part_{r}"))],
    )
    wide = sums.join(F.broadcast(moments))  # one row
    hosts, total = F.col("hosts"), F.col("all")
    out = []
    for r in fails:
        m = F.col(f"all_{r}") / total
        between = F.col(f"part_{r}") - total * m * m
        room = m * (1 - m) * (total - F.col("squares") / total - (hosts - 1))
        share = F.when((hosts > 1) & (room > 0), F.least(F.lit(0.999), F.greatest(F.lit(0.001), (between - m * (1 - m) * (hosts - 1)) / room)))
        weight = F.coalesce(1 / share - 1, F.lit(strength))
        out.append(((F.col(f"k_{r}") + weight * m) / (n + weight)).alias(f"rate_{r}"))
    return wide.select(host, "n", *out)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_failed: float = 0.5, rules: dict[str, str] = RULES) -> DataFrame:
    """Each document's counts, its own failures and its host's verdict: ``id, COUNTS, failed, host_failed``.

    A host fails if the shrunk rate of one of ``rules`` is over ``most_failed``: then most of what it has, and of what it
    would have, fails that rule. ``failed`` is the list of the rules that the document itself fails, ``host_failed`` that of its host.

    Null and empty texts have no words. A null host is judged by nobody: its documents have no failed host. Repeated rows
    count once each. An empty table gives no rows; other columns are ignored. Texts are read once; the counts are written
    and give both the hosts' sums and the result. Only failing hosts are joined back, each ``SALTS`` times, to documents dealt by
    host and salt: a host with a third of all rows lies in that many tasks.
    """
    rows = written(text_counts(docs, [id_col, host_col], text_col), "quality-counts")
    fails = {r: F.expr(sql) for r, sql in rules.items()}
    rates = host_rates(rows, "__1", fails)
    bad = rates.select(F.col("__1").alias("__host"), F.array_compact(F.array(*[F.when(F.col(f"rate_{r}") > most_failed, F.lit(r)) for r in rules])).alias("host_failed")).filter(F.size("host_failed") > 0)
    own = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in fails.items()]))
    none = F.array().cast("array<string>")
    bad = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__dealt", F.pmod(F.xxhash64("__0", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    return salted.join(bad, (F.col("__1") == F.col("__host")) & (F.col("__dealt") == F.col("__salt")), "left").select(F.col("__0").alias(id_col), *COUNTS, own.alias("failed"), F.coalesce("host_failed", none).alias("host_failed"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", base: tuple[str, ...] = ("few_words", "repeats"), **how) -> DataFrame:
    """``docs`` without the documents that fail a ``base`` rule or lie on a failed host; all columns stay.

    Rows of one id stay or go together; rows with a null id stay.
    """
    said = written(quality(docs, id_col, text_col, host_col, **how), "quality")
    gone = said.filter(F.arrays_overlap("failed", F.array(*map(F.lit, base))) | (F.size("host_failed") > 0)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
