"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .bloom import Filter
from .common import forget, small_batches

U = K.U
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 19, 8, 16, (1, 2, 3)
PREFIXES = (5, 6, 7, 8)  # bytes
FEATURES = 2 + len(PREFIXES)
BATCH_ROWS, BATCH_MB = 2000, 8  # of texts that a task is given at once


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words, and per word the buckets of its hashes: the word twice, and its prefixes.

    A word no longer than a prefix has the word's own bucket there.
    """
    row, starts, stops, h = K.words(data, offsets, K.ALNUM)
    out = np.empty((len(h), FEATURES), np.int32)
    out[:, 0], out[:, 1] = h & U(BUCKETS - 1), (h >> U(32)) & U(BUCKETS - 1)
    low = K.LOWER[data]
    pad = np.concatenate([low, np.zeros(max(PREFIXES), np.uint8)])
    p = np.zeros(len(h), U)
    for i in range(max(PREFIXES)):
        p = K.mix(p * U(0xD6E8FEB86659FD93) + K.BYTE[pad[starts + i]]) if len(h) else p
        if i + 1 in PREFIXES:
            out[:, 2 + PREFIXES.index(i + 1)] = np.where(stops - starts > i + 1, (p >> U(7)) & U(BUCKETS - 1), out[:, 0])
    return row, out


@dataclass
class Model:
    """Fixed size: BUCKETS * DIM numbers and some hundreds more, whatever it was trained on."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    cuts: dict[str, float] = field(default_factory=dict)
    other_cut: float = 0.5  # of a language that has too few labels

    def pooled(self, f: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Word vectors, the largest filter values of each document, and all filter values."""
        n = len(f)
        x = np.zeros((n + 2 * len(first) + 2, DIM), np.float32)
        doc = np.searchsorted(first, np.arange(n), "right") - 1
        at = np.arange(n) + 2 * doc  # two empty places between documents
        for j in range(FEATURES):
            x[at] += self.table[f[:, j]]
        values = []
        for w, width in zip(self.filters, WIDTHS, strict=True):
            z = x[at] @ w[0]
            for j in range(1, width):
                z += x[at + j] @ w[j]
            values.append(z)
        top = np.concatenate([np.maximum.reduceat(z, first, axis=0) for z in values], 1)
        return x, top, values

    def logits(self, row: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """Of n documents; one without words has the value of no filter."""
        top = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        if len(row):
            has, first = np.unique(row, return_index=True)
            top[has] = self.pooled(f, first)[1]
        return np.maximum(top + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40).astype(np.float64)))


class Vocabulary:
    """Texts as places in a table of the features of their distinct words: four bytes a word and not FEATURES times as many."""

    def __init__(self, texts: Sequence[str]) -> None:
        data, off = K.flat(pa.array(texts, pa.string()))
        names, ends, seen, rows = [], [], [], []
        for lo, hi in K.pieces(off, 1 << 19):
            row, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            name = f[:, 0].astype(np.int64) << 32 | f[:, 1]
            one, first = np.unique(name, return_index=True)
            names.append(name)
            ends.append(np.bincount(row, minlength=hi - lo))
            seen.append(one)
            rows.append(f[first])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        one, first = np.unique(cat(seen, np.int64), return_index=True)
        self.features = np.concatenate([*rows, np.zeros((0, FEATURES), np.int32)])[first]
        places = np.searchsorted(one, cat(names, np.int64)).astype(np.int32)
        self.texts = np.split(places, np.cumsum(cat(ends, np.int64))[:-1]) if ends else []


def fit(docs: list[tuple[np.ndarray, int, str, float]], of: np.ndarray, epochs: int = 6, seed: int = 7, rate: float = 0.08) -> tuple[Model, list[int]]:
    """Trains on (words, label, language, weight of the row's stratum) rows; also the places of the rows that the weights saw.

    Words are places in ``of``, the features of the distinct words.

    The last sixth is kept to set the scale of the scores (Platt's method, with the strata's weights).
    With no rows, or one class, scores are the share of toxic rows or a half.
    """
    rng = np.random.default_rng(seed)
    nf = FILTERS * len(WIDTHS)
    m = Model(
        rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(nf, 0.05, np.float32),
        np.append(np.abs(rng.normal(0, 0.3, nf)), -1.0).astype(np.float32),
    )
    places = [int(i) for i in rng.permutation(len(docs))]
    places = [i for i in places if len(docs[i][0])] or places
    given = docs
    share = sum(y * w for _, y, _, w in docs) / max(sum(w for *_, w in docs), 1e-9)
    if not docs or not 0 < share < 1:
        m.out[:], m.scale = 0, 1.0
        m.shift = 0.0 if not docs else float(np.log((share + 0.01) / (1.01 - share)))
        return m, []
    docs = [given[i] for i in places]
    part = max(1, len(docs) // 6)
    train, held = docs[part:] or docs, docs[:part]
    memory = [np.full(len(m.table), 1e-3, np.float32), *[np.full(w.shape, 1e-3, np.float32) for w in m.filters], np.full(nf, 1e-3, np.float32), np.full(nf + 1, 1e-3, np.float32)]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        order = rng.permutation(len(train))
        for lo in range(0, len(order), 24):
            batch = [train[i] for i in order[lo : lo + 24] if len(train[i][0])]
            if not batch:
                continue
            size = np.array([len(b[0]) for b in batch])
            first = np.cumsum(size) - size
            f = of[np.concatenate([b[0] for b in batch])]
            x, top, values = m.pooled(f, first)
            act = top + m.bias
            hidden = np.maximum(act, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out[:-1] + m.out[-1], -30, 30)))
            g = (p - np.array([b[1] for b in batch])) / len(batch)
            d_out = np.append(hidden.T @ g, g.sum()).astype(np.float32)
            d_act = (g[:, None] * m.out[:-1] * (act > 0)).astype(np.float32)
            rows_, grads = [], []
            d_filters = []
            for k, (w, width) in enumerate(zip(m.filters, WIDTHS, strict=True)):
                d = d_act[:, k * FILTERS : (k + 1) * FILTERS]
                best = np.stack([values[k][a : a + n].argmax(0) for a, n in zip(first, size, strict=True)])
                d_w = np.zeros_like(w)
                for j in range(width):
                    ok = best + j < size[:, None]
                    word = np.minimum(first[:, None] + best + j, len(f) - 1)
                    gj = d * ok
                    xs = x[word + 2 * np.arange(len(batch))[:, None]]
                    d_w[j] = np.einsum("bfd,bf->df", xs, gj)
                    flat = gj.ravel() != 0
                    rows_.append(word.ravel()[flat])
                    grads.append((gj[:, :, None] * w[j].T[None]).reshape(-1, DIM)[flat])
                d_filters.append(d_w)
            for value, grad, mem in [(m.out, d_out, memory[-1]), (m.bias, d_act.sum(0), memory[-2]), *zip(m.filters, d_filters, memory[1:-2], strict=True)]:
                mem += grad * grad
                value -= step * grad / np.sqrt(mem)
            words, back = np.unique(np.concatenate(rows_), return_inverse=True)
            if len(words):
                g_words = np.zeros((len(words), DIM), np.float32)
                np.add.at(g_words, back, np.concatenate(grads))
                buckets, back = np.unique(f[words].ravel(), return_inverse=True)
                g_rows = np.zeros((len(buckets), DIM), np.float32)
                np.add.at(g_rows, back, np.repeat(g_words, FEATURES, 0))
                memory[0][buckets] += (g_rows**2).mean(1)
                m.table[buckets] -= step * g_rows / np.sqrt(memory[0][buckets])[:, None]
    z = np.concatenate([m.logits(np.zeros(len(f), np.int64), of[f], 1) for f, *_ in held])
    y, w = np.array([b[1] for b in held], float), np.array([b[3] for b in held])
    a, b = 1.0, 0.0
    for _ in range(60):  # damped Newton steps on the weighted log loss, held near the start by a small penalty
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, v = w * (p - y), w * p * (1 - p)
        grad = np.array([(r * z).sum() + (a - 1) * 0.5, r.sum() + b * 0.05])
        hess = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 0.05]])
        step_ = np.linalg.solve(hess, grad)
        a, b = a - 0.5 * step_[0], b - 0.5 * step_[1]
    m.scale, m.shift = float(max(a, 0.05)), float(b)
    return m, places[part:] or places


BINS = 1024  # of the scores; a power of two, so that a bin's edge is an exact score


def thresholds(counts: list[tuple[str, int, int, int]], weight: dict[int, float], least: int = 8) -> tuple[dict[str, float], float]:
    """The cut of best F1 of each language, and that of all languages together, from (language, label, bin, rows).

    A language with fewer than ``least`` rows of either label has no cut of its own. ``weight`` of a label brings its
    rows back to the labels' real share. Of equally good cuts the middle one.
    """

    def best(rows: list[tuple[int, int, int]]) -> float | None:
        n = np.zeros((2, BINS + 1))
        for y, at, rows_ in rows:
            n[y, at] += rows_
        if n.sum(1).min() < least:
            return None
        n *= np.array([[weight[0]], [weight[1]]])
        above = n[:, ::-1].cumsum(1)[:, ::-1]  # rejected by a cut at the bin's lower edge
        f1 = 2 * above[1] / (n[1].sum() + above.sum(0))
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)
        return float(top[len(top) // 2]) / BINS

    of = {lang: best([r[1:] for r in counts if r[0] == lang]) for lang in sorted({r[0] for r in counts if r[0]})}
    everything = best([r[1:] for r in counts])
    return {lang: c for lang, c in of.items() if c is not None}, 0.5 if everything is None else everything


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", per_class: int = 2500) -> Model:
    """Fits on a bounded sample of labelled rows: at most ``per_class`` of each label, by smallest id hash.

    Only the fit takes a sample: the thresholds come from all other usable labelled rows, scored by Spark and
    counted by language, label and score. A language with too few of them has the threshold of all languages.
    ``usable``, a condition on ``labels``, says whose labels may be learned from. Rows are weighted back to
    the labels' real shares. An id with several labels has the largest; null ids or labels are left out.
    """
    spark = docs.sparkSession
    named = labels.filter(usable).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = {r["__y"]: r["count"] for r in named.groupBy("__y").count().collect()}
    picked = None
    for y in (0, 1):
        one = named.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    picked = F.broadcast(picked)  # 2 * per_class rows at most
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col in docs.columns else F.lit("")
    sent = docs.select(F.col(id_col).alias("__id"), F.struct(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("__t"))
    rows = sent.join(picked, "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t"))  # of several rows of one id the least text
    id_kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select(F.col("__id").alias("id"), F.col("__y").alias("y"), F.col("__t.lang").alias("lang"), F.col("__t.text").alias("text")).toPandas().sort_values("id")
    words = Vocabulary(got.pop("text").tolist())
    sampled = got["y"].value_counts().to_dict()
    weight = {y: counts.get(y, 0) / max(sampled.get(y, 0), 1) for y in (0, 1)}
    mean = sum(weight[y] for y in got["y"]) / max(len(got), 1) or 1.0
    model, seen = fit([(f, int(y), lang, weight[y] / mean) for f, y, lang in zip(words.texts, got["y"], got["lang"], strict=True)], words.features)
    if not seen:
        return model
    ids = pa.array(got["id"].iloc[seen].tolist(), to_arrow_type(docs.schema[id_col].dataType))
    fitted = F.broadcast(spark.createDataFrame(pa.table({"__id": ids})))  # of rows it would start Python processes on the executors, which stay
    rest = named.filter(F.col("__y").isin(0, 1)).join(fitted, "__id", "left_anti")
    labelled = Filter(rest.select(F.xxhash64("__id").alias("h")), "h", 64)  # lets few others through; the join is exact
    held = spark.sparkContext.broadcast(labelled)
    shipped = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held.value.may_hold(batch.column(0).to_numpy().view(U))))
            data, off = K.flat(batch.column(3))
            for lo, hi in K.pieces(off, 1 << 19):
                row, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                s = shipped.value.score(shipped.value.logits(row, f, hi - lo))
                at = pa.array(np.floor(s * BINS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:3], at], ["__id", "lang", "at"])

    sent = docs.filter(F.col(id_col).isNotNull()).select(F.xxhash64(id_col), F.col(id_col), lang, F.col(text_col))
    bins = sent.mapInArrow(scored, f"__id {id_kind}, lang string, at int").join(rest, "__id")
    with small_batches(spark, BATCH_ROWS, BATCH_MB):
        counts_ = [(r["lang"], r["__y"], r["at"], r["count"]) for r in bins.groupBy("lang", "__y", "at").count().collect()]  # 2 * BINS rows a language at most
    held.destroy()  # the driver and every executor hold their blocks
    shipped.destroy()
    outside = {y: sum(n for _, y_, _, n in counts_ if y_ == y) for y in (0, 1)}
    model.cuts, model.other_cut = thresholds(counts_, {y: counts.get(y, 0) / max(outside[y], 1) for y in (0, 1)})
    del got, words, rest, bins, fitted, labelled
    forget(spark)  # the sample's texts, of which Spark and Python had a copy each in the driver
    return model


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", keep_columns: list[str] | None = None, results: tuple[str, str, str] = ("score", "threshold", "rejected")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``threshold`` of the row's language, and ``rejected``, or what ``results`` calls them.

    The score depends on the text alone; the language only chooses the threshold (0.5 without a language).
    Null text counts as empty; a text without words gets the score of no filter firing. Repeated rows get
    equal results, an empty table an empty one. Columns named like the three results are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    score, threshold, rejected = results
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col in docs.columns else F.lit("")

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        for texts in batches:
            data, off = K.flat(texts)
            got = np.empty(len(texts))
            for lo, hi in K.pieces(off, 1 << 19):
                row, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                got[lo:hi] = model.score(model.logits(row, f, hi - lo))
            yield pa.array(got)

    # only the text goes to Python and only a number comes back; nondeterministic, as a filter on the score would else have it computed again
    of = F.arrow_udf(scored, "double").asNondeterministic()
    cut = F.lit(model.other_cut)
    if model.cuts:
        cut = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(model.cuts.items()) for x in pair]), lang), cut)
    keep = [F.col(f"`{c}`") for c in keep_columns or docs.columns if c not in results]
    out = docs.select(*keep, of(F.col(text_col)).alias(score), F.when(lang == "", 0.5).otherwise(cut).alias(threshold))
    return out.withColumn(rejected, F.col(score) >= F.col(threshold))
