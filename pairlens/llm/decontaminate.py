"""Benchmark decontamination by winnowed k-gram fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, written

U = K.U


def winnow(h: np.ndarray, row: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints: in each run of w k-grams of one row the rightmost smallest.

    Rows with at least k + w - 1 words are covered; two equal runs of k + w - 1 words get the same
    fingerprint at the same place.
    """
    g = K.grams(h, k)
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least = K.window_min(g, w)
    at = np.zeros(m, np.int64)
    for j in range(w):  # later places win ties
        hit = g[j : j + m] == least
        at[hit] = np.flatnonzero(hit) + j
    return np.unique(at[row[:m] == row[k + w - 2 :]])


class Index:
    """Fingerprints and windows of some benchmark items; made on the driver, bounded by ``block_words``."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int) -> None:
        self.window, self.k, self.w = window, k, window - k + 1
        self.ids = [i for i, _ in items]
        data, off = K.flat(pa.array([t for _, t in items], pa.string()))
        row, _, _, h = K.words(data, off, K.ALNUM)
        counts = np.bincount(row, minlength=len(items))
        self.hashes = K.grams(h, window)
        self.of = row[: len(self.hashes)]
        self.hashes = np.where(K.whole(row, window), self.hashes, U(0))
        pos = winnow(h, row, k, self.w)
        f = K.grams(h, k)[pos] if len(pos) else np.zeros(0, U)
        order = np.argsort(f, kind="stable")
        self.prints, self.places = f[order], pos[order]
        # an item of fewer words is one window: looked up at every place of a text
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        first = np.concatenate([[0], np.cumsum(counts)])
        for n in range(1, window):
            which = np.flatnonzero(counts == n)
            if len(which):
                g = K.grams(h, n)[first[which]]
                order = np.argsort(g, kind="stable")
                self.short[n] = g[order], which[order]

    def hits(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and item of every occurrence of a window in the rows."""
        starts, sizes, items = [], [], []
        if len(self.prints):
            pos = winnow(h, row, self.k, self.w)
            f = K.grams(h, self.k)[pos] if len(pos) else np.zeros(0, U)
            which, place = _matches(f, self.prints)
            p, q = pos[which], self.places[place]
            wide, ok = K.grams(h, self.window), K.whole(row, self.window)
            for back in range(self.w):  # extend each hit over the windows that hold its k-gram
                a, b = p - back, q - back
                m = (a >= 0) & (b >= 0) & (a < len(wide)) & (b < len(self.hashes))
                a, b = a[m], b[m]
                m = ok[a] & (wide[a] == self.hashes[b])
                starts.append(a[m])
                sizes.append(np.full(int(m.sum()), self.window))
                items.append(self.of[b[m]])
        for n, (g, which) in self.short.items():
            got = K.grams(h, n)
            a, place = _matches(got, g)
            m = K.whole(row, n)[a] if len(a) else np.zeros(0, bool)
            starts.append(a[m])
            sizes.append(np.full(int(m.sum()), n))
            items.append(which[place[m]])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(starts), cat(sizes), cat(items)


def _matches(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with x[i] == table[j]; table is sorted."""
    if not len(x) or not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.searchsorted(table, x)
    lo_in = np.minimum(lo, len(table) - 1)
    hit = np.flatnonzero(table[lo_in] == x)
    lo, hi = lo[hit], np.searchsorted(table, x[hit], "right")
    n = hi - lo
    return np.repeat(hit, n), np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 4, block_words: int = 1_000_000, carry: list[str] | None = None) -> DataFrame:
    """Per document: ``id, n_words, n_hit, n_items, items, spans``.

    items: ids of the items with occurring windows, as strings, sorted. spans: first word and end (exclusive)
    of each run of hit words, flat. carry: columns of ``docs`` to pass along, in a struct ``carried`` in the id's place.

    Winnowing keeps the smallest k-gram hash of every ``window - k + 1`` consecutive ones, of items and of
    documents; a shared run of ``window`` words therefore has a shared fingerprint. Fingerprint hits are
    extended to every window of ``window`` words around them and compared as hashes of all those words.
    A word inside any occurring window is hit. Items of fewer words than ``window`` are one window each.

    The items' fingerprints go to the workers in blocks of at most ``block_words`` words (the proven bound
    of what is broadcast; an item longer than that is a block of its own); with more than one block the
    documents are passed once a block, each pass adding to the hit words. Documents are never shuffled.

    Null text or item text has no words; a null item id is written as ``null``; equal items count each.
    Empty tables give no hits or no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    carry = carry or []
    along = [f"c{i}" for i in range(len(carry))]
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(a) for a, c in zip(along, carry, strict=True)])
    fields = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    texts = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(item_text_col, F.lit("")).alias("t"))

    def blocks() -> Iterator[tuple[Index, bool]]:
        """Indexes one after another, and whether one is the last; only one block's texts are held at a time."""
        chunk, n = [], 0
        for r in texts.toLocalIterator():
            size = len(r["t"]) // 2 + 1  # a word and its separator take two characters at least
            if chunk and n + size > block_words:
                yield Index(chunk, window, k), False
                chunk, n = [], 0
            chunk.append((r["i"], r["t"]))
            n += size
        yield Index(chunk, window, k), True

    def one(df: DataFrame, index: Index, last: bool) -> DataFrame:
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                data, off = K.flat(batch.column(1))
                for lo, hi in K.pieces(off):
                    row, _, _, h = K.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], K.ALNUM)
                    starts, sizes, which = index.hits(row, h)
                    first = np.searchsorted(row, np.arange(hi - lo + 1))
                    found: list[list[str]] = [[] for _ in range(hi - lo)]
                    for d, i in np.unique(np.stack([row[starts], which], 1), axis=0).tolist() if len(starts) else []:
                        found[d].append(index.ids[i])
                    if batch.num_columns > 2 + len(along):  # what earlier blocks have found
                        for d, (was, i) in enumerate(zip(batch.column("spans").slice(lo, hi - lo).to_pylist(), batch.column("items").slice(lo, hi - lo).to_pylist(), strict=True)):
                            found[d] += i
                            starts = np.append(starts, np.array(was[::2], np.int64) + first[d])
                            sizes = np.append(sizes, np.array(was[1::2], np.int64) - np.array(was[::2], np.int64))
                    cover = np.zeros(len(row) + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + sizes, -1)
                    on = np.cumsum(cover)[:-1] > 0
                    new = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
                    a = np.flatnonzero(on & (new | ~np.append(False, on[:-1])[: len(on)]))
                    e = np.flatnonzero(on & (np.append(new[1:], True)[: len(on)] | ~np.append(on[1:], False)[: len(on)])) + 1
                    in_doc = np.searchsorted(row[a], np.arange(hi - lo + 1))
                    runs = np.stack([a - first[row[a]], e - first[row[a]]], 1).ravel() if len(a) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *batch.slice(lo, hi - lo).columns[: 1 if last else 2],
                            *batch.slice(lo, hi - lo).columns[2 : 2 + len(along)],
                            pa.ListArray.from_arrays(pa.array(2 * in_doc, pa.int32()), pa.array(runs, pa.int64())),
                            pa.array(found, pa.list_(pa.string())),
                            pa.array(np.diff(first), pa.int64()),
                        ],
                        ["id", *["text"] * (not last), *along, "spans", "items", "n_words"],
                    )

        return df.mapInArrow(run, f"id {kind}, {'' if last else 'text string, '}{fields}spans array<long>, items array<string>, n_words long")

    got, before = src, None
    for index, last in blocks():
        got = one(got, index, last)
        if not last:
            got = written(got.drop("n_words"), "hits")
            if before is not None:
                discard(before)
            before = got
    size = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    kept = [F.col(a).alias(c) for a, c in zip(along, carry, strict=True)]
    return got.select(F.struct(*kept).alias("carried") if kept else F.col("id").alias(id_col), "n_words", size.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "spans")


