"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, small_batches, without_shuffles, written

U = K.U
BASE = 1.5  # counts are kept as 1 + floor(log_BASE(count))
END, START = K.mix(np.array([0xE17D, 0x57A7], U))
BLOCK_BITS = 19  # of the filter; all bits of a key lie in one block, neighbouring keys in neighbouring blocks
BLOCK_BYTES = 1 << (BLOCK_BITS - 3)
PROBES = 5
WORK_BYTES, BATCH_ROWS = 1 << 20, 2000  # of text whose n-grams a task has in hand; of texts that it is given at once


def level(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64) + 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every token of every row: its words, then one end."""
    row, _, _, h = K.words(data, offsets)
    n = len(offsets) - 1
    each = np.bincount(row, minlength=n) + 1
    out, end = np.empty(len(h) + n, U), np.cumsum(each) - 1
    is_word = np.ones(len(out), bool)
    is_word[end] = False
    out[is_word], out[end] = h, END
    return np.repeat(np.arange(n), each), out


def pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context (the token before, or the start) and the key of both."""
    before = np.concatenate([[START], h[:-1]]).astype(U)
    before[np.append(True, row[1:] != row[:-1])] = START
    return before, K.mix(before * U(0xD6E8FEB86659FD93) + h)


def bucket_of(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``buckets`` ranges of keys each is in, and where in it, as a fraction of 2**32."""
    x = (key >> U(32)) * U(buckets)
    return (x >> U(32)).astype(np.int64), x & U(0xFFFFFFFF)


def probes(key: np.ndarray, lev: int) -> Iterator[np.ndarray]:
    """Bits of (key, level) within its block."""
    a = K.mix(key ^ U(lev * 0x9E3779B97F4A7C15 % 2**64))
    step = (a >> U(32)) | U(1)
    for _ in range(PROBES):
        yield a & U((1 << BLOCK_BITS) - 1)
        a = a + step


@dataclass
class Model:
    bits: np.ndarray | None
    buckets: int
    first: list[np.ndarray]  # of order 1 and 2: first block of each bucket
    blocks: list[np.ndarray]  # their number
    value: list[np.ndarray]  # of order 1 and 2: mean count of each level
    total: int  # N, training tokens
    distinct: int  # V
    head_keys: np.ndarray
    head_counts: np.ndarray
    weight: float

    def levels(self, key: np.ndarray, order: int) -> np.ndarray:
        bucket, within = bucket_of(key, self.buckets)
        block = self.first[order - 1][bucket] + (within * self.blocks[order - 1][bucket].astype(U) >> U(32)).astype(np.int64)
        return probed(self.bits, block, key, len(self.value[order - 1]))


def probed(bits: np.ndarray, block: np.ndarray, key: np.ndarray, levels: int) -> np.ndarray:
    """Repeated membership probes: the last level whose bits are all set, 0 if the first is not."""
    out = np.zeros(len(key), np.int64)
    alive, base, k = np.arange(len(key)), block * BLOCK_BYTES, key
    for lev in range(1, levels):
        if not len(alive):
            break
        ok = np.ones(len(k), bool)
        at = np.arange(len(k))
        for n, pos in enumerate(probes(k, lev)):
            pos = pos[at]
            hit = (bits[base[at] + (pos >> U(3)).astype(np.int64)] >> (pos & U(7)).astype(np.uint8)) & 1 == 1
            if n == PROBES - 1:
                ok = at[hit]
            else:
                at = at[hit]
        alive, base, k = alive[ok], base[ok], k[ok]
        out[alive] = lev
    return out


def filled(key: np.ndarray, lev: np.ndarray, buckets: int, bits_per_level: int) -> np.ndarray:
    """Packed bits of a bucket that holds these keys, up to their levels; its size follows from their number."""
    blocks = max(1, -(-int(lev.sum()) * bits_per_level >> BLOCK_BITS))
    bits = np.zeros(blocks << BLOCK_BITS, bool)
    block = (bucket_of(key, buckets)[1] * U(blocks)) >> U(32) << U(BLOCK_BITS)
    for j in range(1, int(lev.max(initial=0)) + 1):
        of = lev >= j
        for pos in probes(key[of], j):
            bits[block[of] | pos] = True
    return np.packbits(bits, bitorder="little")


def count_ngrams(docs: DataFrame, used: Column, text_col: str, buckets: int, bits_per_level: int, most: int = 1_000_000) -> DataFrame:
    """Counts of words and word pairs, by ranges of their keys.

    One row for each order and bucket: ``order, bucket, bits`` (its part of the filter), ``keys, ns, least`` (of each
    level: how many n-grams, their counts' sum and minimum); and one row ``key, n`` for each word. Tasks send their
    n-grams combined and packed, a row for each bucket; a bucket's size is bounded as their number follows the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}
        size = {1: 0, 2: 0}

        def combined(order: int) -> None:
            key, n = zip(*held[order], strict=True)
            key, n = np.concatenate(key), np.concatenate(n)
            held[order] = []  # before the sort
            held[order] = [_summed(key, n)]
            size[order] = len(held[order][0][0])

        def out(order: int) -> Iterator[pa.RecordBatch]:
            for key, n in held[order]:
                bucket = bucket_of(key, buckets)[0]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
                ends = np.append(first[1:], len(key))
                for lo in range(0, len(first), 1000):
                    f, e = first[lo : lo + 1000], ends[lo : lo + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(f), order, np.int32)), pa.array(bucket[f]), *[pa.array([x[i:j].tobytes() for i, j in zip(f.tolist(), e.tolist(), strict=True)], pa.binary()) for x in (key, n)]],
                        ["order", "bucket", "keys", "counts"],
                    )
            held[order], size[order] = [], 0

        for batch in batches:
            data, off = K.flat(batch.column(0))
            for lo, hi in K.pieces(off, WORK_BYTES):
                row, h = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for order, key in ((1, h), (2, pairs(row, h)[1])):
                    k, n = np.unique(key, return_counts=True)
                    held[order].append((k, n.astype(np.uint32)))  # of a task's part
                    size[order] += len(k)
                    if size[order] > most:
                        combined(order)
                        if size[order] > most // 2:
                            yield from out(order)
        for order in (1, 2):
            if held[order]:
                combined(order)
                yield from out(order)

    def merge(table: pa.Table) -> pa.Table:
        key, n = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in table.column(c)]) for c, t in (("keys", U), ("counts", np.uint32)))
        key, n = _summed(key, n.astype(np.int64))
        order, bucket, lev = table.column("order")[0].as_py(), table.column("bucket")[0].as_py(), level(n)
        words = len(key) if order == 1 else 0
        many = pa.list_(pa.int64())
        return pa.table(
            {
                "order": pa.array(np.full(1 + words, order, np.int32)),
                "bucket": pa.array(np.full(1 + words, bucket)),
                "bits": pa.array([filled(key, lev, buckets, bits_per_level).tobytes(), *[None] * words], pa.binary()),
                **{c: pa.array([x.tolist(), *[None] * words], many) for c, x in tallied(n, lev).items()},
                "key": pa.array([None, *K.signed(key[:words]).tolist()], pa.int64()),
                "n": pa.array([None, *n[:words].tolist()], pa.int64()),
            }
        )

    packed = docs.filter(used).select(text_col).mapInArrow(run, "order int, bucket long, keys binary, counts binary")
    return packed.groupBy("order", "bucket").applyInArrow(merge, "order int, bucket long, bits binary, keys array<long>, ns array<long>, least array<long>, key long, n long")


def tallied(n: np.ndarray, lev: np.ndarray) -> dict[str, np.ndarray]:
    """Of each level: how many n-grams, the sum of their counts, the least count."""
    each = np.bincount(lev)
    least = np.full(len(each), 1 << 62)
    np.minimum.at(least, lev, n)
    return {"keys": each, "ns": np.bincount(lev, n).astype(np.int64), "least": least}


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sort = np.argsort(key)
    key, n = key[sort], n[sort]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first, dtype=n.dtype) if len(first) else n


def learn(docs: DataFrame, used: Column, text_col: str = "text", bits_per_level: int = 12, most_filter_mb: int | None = None, head: int = 1 << 17, weight: float = 0.3, bucket_bytes: int = 1 << 23) -> tuple[Model, DataFrame]:
    """The model and the table of exact word counts ``key, n``.

    Counts cover the whole training text, every word and every word pair. The filter is laid out in ranges of keys, one
    for each ``bucket_bytes`` of text, and always has ``bits_per_level`` bits for each (n-gram, level). It comes with the model, but for
    one of over ``most_filter_mb``. ``head`` bounds the broadcast table of exact counts of the most frequent words; the others are joined by shuffle.
    """
    buckets = ranges(docs, text_col, bucket_bytes)[1]
    with small_batches(docs.sparkSession, BATCH_ROWS):
        counts = written(count_ngrams(docs, used, text_col, buckets, bits_per_level), "ngrams")
    parts = counts.filter(F.col("bits").isNotNull())
    value, total, distinct, rows = statistics(parts)
    least, words = math.inf, 0
    for r in sorted((r for r in rows if r["order"] == 1), key=lambda r: -r["level"]):
        words += r["keys"]
        if words > head:
            break
        least = r["least"]
    words = counts.filter(F.col("key").isNotNull()).select("key", "n")
    words.written_path = counts.written_path
    blocks = [np.ones(buckets, np.int64) for _ in range(2)]
    for r in parts.select("order", "bucket", F.octet_length("bits").alias("size")).toLocalIterator():  # two numbers for bucket_bytes of text
        blocks[r["order"] - 1][r["bucket"]] = r["size"] // BLOCK_BYTES
    ends = np.cumsum(np.concatenate(blocks))
    first = [(ends - np.concatenate(blocks))[:buckets], (ends - np.concatenate(blocks))[buckets:]]
    model = Model(None, buckets, first, blocks, value, total, distinct, np.zeros(0, U), np.zeros(0, np.int64), weight)
    if most_filter_mb is not None and int(ends[-1]) * BLOCK_BYTES > most_filter_mb << 20:
        return model, words
    top = words.filter(F.col("n") >= (least if least < math.inf else 1 << 62)).toPandas()
    keys = top["key"].to_numpy(np.int64).view(U)
    sort = np.argsort(keys)
    model.head_keys, model.head_counts = keys[sort], top["n"].to_numpy(np.int64)[sort]
    model.bits = np.zeros(int(ends[-1]) * BLOCK_BYTES, np.uint8)
    for r in parts.select("order", "bucket", "bits").toLocalIterator():
        at = int(first[r["order"] - 1][r["bucket"]]) * BLOCK_BYTES
        model.bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return model, words


def ranges(docs: DataFrame, text_col: str, bucket_bytes: int) -> tuple[int, int]:
    """Bytes of all texts, and the number of ranges of keys for them."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return size, max(1, size // bucket_bytes)


def statistics(parts: DataFrame) -> tuple[list[np.ndarray], int, int, list]:
    """Of the ranges' tallies by level: the mean counts of order 1 and 2, the training tokens, the distinct words; the tallies in sum."""
    by_level = parts.select("order", F.posexplode(F.arrays_zip("keys", "ns", "least")).alias("level", "of")).filter("of.keys > 0")
    rows = by_level.groupBy("order", "level").agg(F.sum("of.keys").alias("keys"), F.sum("of.ns").alias("n"), F.min("of.least").alias("least")).collect()  # some dozens
    value = []
    for order in (1, 2):
        of = {r["level"]: r["n"] / r["keys"] for r in rows if r["order"] == order}
        v = np.zeros(max(of, default=0) + 1)
        for j in range(1, len(v)):
            v[j] = of.get(j, BASE ** (j - 1))
        value.append(v)
    return value, int(sum(r["n"] for r in rows if r["order"] == 1)), int(sum(r["keys"] for r in rows if r["order"] == 1)), rows


def fit(docs: DataFrame, used: Column, text_col: str = "text", **settings) -> tuple[Model, DataFrame]:
    """The model and the table of exact word counts of ``learn``."""
    return learn(docs, used, text_col, **settings)


def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and each value's place in them."""
    sort = np.argsort(x)
    s = x[sort]
    new = np.append(True, s[1:] != s[:-1])[: len(s)]
    back = np.empty(len(x), np.int64)
    back[sort] = np.cumsum(new) - 1
    return s[new], back


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows: each token's row, the distinct words (and the start) with the tokens' and their contexts' places in them, the distinct pairs with the tokens' places."""
    row, h = tokens(data, offsets)
    words, back = placed(np.append(h, START))
    before = np.append(back[-1:], back[:-2])
    before[np.append(True, row[1:] != row[:-1])[: len(before)]] = back[-1]
    two, back_two = placed(pairs(row, h)[1])
    return row, before, words, back, two, back_two


NAMES = ["row", "id", "used", "n_tokens", "n_known", "base", "score", "key", "tf"]
PIECE_ROWS, PIECE_BYTES = 1 << 16, 1 << 22  # of a piece whose n-grams are asked together
FILTER_SHARE = 4  # times its filter, at least, is text that is not even counted for a filter to ship


def probability(m: Model, parts: tuple[np.ndarray, ...], lev: np.ndarray, got: np.ndarray, n: int) -> np.ndarray:
    """Scores of ``n`` rows from their n-grams and the levels of the distinct words and pairs."""
    row, before, words, back, _, back_two = parts
    new = m.distinct / (m.total + m.distinct) if m.total else 1.0
    v1, v2 = m.value
    value = v1[lev] if len(v1) else np.zeros(len(words))
    if lev[np.searchsorted(words, START)] == 0:  # as many starts as ends
        value[back[-1]] = value[np.searchsorted(words, END)]
    p = np.where(value > 0, (1 - new) * value / max(m.total, 1), new)[back[:-1]]
    context = value[before]
    seen = (v2[got] if len(v2) else np.zeros(len(got)))[back_two]
    ratio = np.minimum(seen / np.maximum(context, 1), 1)
    return np.bincount(row, np.log10(np.where(context > 0, m.weight * ratio + (1 - m.weight) * p, p)), n)


def score_rows(m: Model, parts: tuple[np.ndarray, ...], lev: np.ndarray, got: np.ndarray, at: int, ids: pa.Array, used: pa.Array) -> Iterator[pa.RecordBatch]:
    """Scores of rows; then the words to be joined."""
    row, _, words, back, _, _ = parts
    n = len(ids)
    types = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    score = probability(m, parts, lev, got, n)
    n_tokens = np.bincount(row, minlength=n)
    # exact counts: frequent words here, the others by join
    signed = K.signed(words)
    where = np.minimum(np.searchsorted(m.head_keys, words), max(len(m.head_keys) - 1, 0))
    known = m.head_keys[where] == words if len(m.head_keys) else np.zeros(len(words), bool)
    value = np.where(known, np.log10(m.head_counts[where] + 1.0), 0.0) if len(m.head_keys) else np.zeros(len(words))
    mine, in_head = back[:-1], known[back[:-1]]
    base = np.bincount(row, value[mine], n)
    n_known = np.bincount(row, in_head, n).astype(np.int64)
    none = lambda t, k: pa.nulls(k, t)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at + np.arange(n)), ids, used, pa.array(n_tokens, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score), none(pa.int64(), n), none(pa.int64(), n)], NAMES
    )
    rest = np.flatnonzero(~in_head)
    if len(rest):
        w = len(words)
        one, tf = np.unique(row[rest] * w + mine[rest], return_counts=True)
        k = len(one)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at + one // w), none(ids.type, k), *[none(t, k) for t in types[2:7]], pa.array(signed[one % w]), pa.array(tf, pa.int64())], NAMES
        )


def planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes together: what is alike in them is compressed where they are sent."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def of_planes(packed: pa.Scalar, kind: type) -> np.ndarray:
    x = np.frombuffer(packed.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(x.T).reshape(-1).view(kind)


def asked(sent: DataFrame, buckets: int, bits_per_level: int, weight: float, kind: str) -> tuple[Model, DataFrame]:
    """The model without bits, and the scores of the rows ``id, used, text`` by a filter that no task holds whole, nor any table.

    Rows are dealt into pieces and written. A piece sends its distinct n-grams, with their counts in what is learned from, to their ranges
    of keys. A range adds the counts, makes its part of the filter, asks it, and sends levels and words' exact counts back,
    by which the piece's rows are scored. So n-grams go one way once and answers back once. Bits, and so scores, are those of the filter shipped whole.
    A piece that the written table's scan cuts is asked by the parts that it is cut into.
    """
    spark = sent.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, size, at = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            _, off = K.flat(batch.column(2))
            for lo, hi in ((a, min(a + PIECE_ROWS, b)) for lo, b in K.pieces(off, PIECE_BYTES) for a in range(lo, b, PIECE_ROWS)):
                more, n = int(off[hi] - off[lo]), hi - lo
                if at and (size + more > PIECE_BYTES or at + n > PIECE_ROWS):
                    piece, size, at = piece + 1, 0, 0
                yield from pa.Table.from_arrays([pa.array(np.full(n, piece)), pa.array(at + np.arange(n)), *batch.slice(lo, n).columns], ["piece", "at", "id", "used", "text"]).to_batches()
                size, at = size + more, at + n

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            row, _, words, back, two, back_two = ngrams(*K.flat(t.column("text").chunk(0)))
            learned = t.column("used").to_numpy()[row]
            for order, key, place in ((1, words, back[:-1]), (2, two, back_two)):  # sorted, so a range's keys stand together
                n = np.bincount(place[learned], minlength=len(key)).astype(np.uint32)
                bucket = bucket_of(key, buckets)[0]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
                ends = np.append(first[1:], len(key))
                gap = np.diff(key, prepend=key[:1])
                gap[first] = key[first]
                for lo in range(0, len(first), 1000):
                    f, e = first[lo : lo + 1000], ends[lo : lo + 1000]
                    same = [pa.array(np.full(len(f), x)) for x in (t.column("piece")[0].as_py(), t.column("at")[0].as_py(), t.num_rows)]
                    packed = [pa.array([planes(x[i:j]) for i, j in zip(f.tolist(), e.tolist(), strict=True)], pa.binary()) for x in (gap, n)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(f), order, np.int32)), pa.array(bucket[f]), pa.array(f), *packed], ["piece", "at", "rows", "order", "bucket", "ask", "keys", "counts"])

        after = None
        for batch in batches:
            where = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.append(True, (where[0][1:] != where[0][:-1]) | (where[1][1:] != where[1][:-1] + 1))[: batch.num_rows]
            cut = np.flatnonzero(new)
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
                if held and after != (where[0][lo], where[1][lo]):
                    yield from out()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                after = (where[0][hi - 1], where[1][hi - 1] + 1)
        if held:
            yield from out()

    def answer(asks: pa.Table) -> pa.Table:
        order, bucket = asks.column("order")[0].as_py(), asks.column("bucket")[0].as_py()
        each = [np.cumsum(of_planes(k, U), dtype=U) for k in asks.column("keys")]
        cut = np.cumsum([0, *map(len, each)]).tolist()
        key, back = placed(np.concatenate(each))
        n = np.concatenate([of_planes(x, np.uint32) for x in asks.column("counts")])
        n = np.bincount(back, n, len(key)).astype(np.int64)
        lev, seen = np.zeros(len(key), np.int64), n > 0
        tally = {}
        if seen.any():
            of = level(n[seen])
            bits = filled(key[seen], of, buckets, bits_per_level)
            tally = tallied(n[seen], of)
            block = (bucket_of(key, buckets)[1] * U(len(bits) // BLOCK_BYTES) >> U(32)).astype(np.int64)
            lev = probed(bits, block, key, 128)
        lev, n = lev.astype(np.uint8)[back], n[back] if order == 1 else n[:0]
        rows = asks.num_rows
        packed = lambda x: pa.array([*(planes(x[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)), None], pa.binary())
        return pa.table(
            {
                **{c: pa.chunked_array([*asks.column(c).chunks, pa.nulls(1, asks.schema.field(c).type)]) for c in ("piece", "at", "rows", "ask")},
                "order": pa.array(np.full(rows + 1, order, np.int32)),
                "levels": packed(lev),
                "counts": packed(n),
                **{c: pa.array([*[None] * rows, tally[c].tolist() if tally else None], pa.list_(pa.int64())) for c in ("keys", "ns", "least")},
            }
        )

    with small_batches(spark, BATCH_ROWS), without_shuffles(spark):
        texts = written(sent.toDF("id", "used", "text").mapInArrow(deal, f"piece long, at long, id {kind}, used boolean, text string"), "pieces")
        asks = texts.mapInArrow(ask, "piece long, at long, rows long, order int, bucket long, ask long, keys binary, counts binary")
        answers = asks.groupBy("order", "bucket").applyInArrow(answer, "piece long, at long, rows long, ask long, order int, levels binary, counts binary, keys array<long>, ns array<long>, least array<long>")
        answers = written(answers, "answers")
        value, total, distinct, _ = statistics(answers.filter(F.col("keys").isNotNull()))
        model = Model(None, buckets, [], [], value, total, distinct, np.zeros(0, U), np.zeros(0, np.int64), weight)
        shipped = spark.sparkContext.broadcast(model)

        def score(rows: pa.Table, told: pa.Table) -> pa.Table:
            m = shipped.value
            rows = rows.sort_by("at").combine_chunks()
            out = []
            at, order, place = (told.column(c).to_numpy() for c in ("at", "order", "ask"))
            for start in np.unique(at).tolist():
                of = np.flatnonzero(at == start).tolist()
                n = told.column("rows")[of[0]].as_py()
                t = rows.slice(start, n).combine_chunks()
                parts = ngrams(*K.flat(t.column("text").chunk(0)))
                row, _, words, back, two, _ = parts
                lev, known = [np.zeros(len(words), np.int64), np.zeros(len(two), np.int64)], np.zeros(len(words), np.int64)
                for i in of:
                    got = np.frombuffer(told.column("levels")[i].as_buffer(), np.uint8)
                    lev[order[i] - 1][place[i] : place[i] + len(got)] = got
                    if order[i] == 1:
                        known[place[i] : place[i] + len(got)] = of_planes(told.column("counts")[i], np.int64)
                lev = [np.minimum(x, len(v) - 1) for x, v in zip(lev, m.value, strict=True)]
                known = known[back[:-1]]
                out.append(
                    pa.table(
                        {
                            "id": t.column("id"),
                            "used": t.column("used"),
                            "n_tokens": pa.array(np.bincount(row, minlength=n), pa.int64()),
                            "n_known": pa.array(np.bincount(row, known > 0, n).astype(np.int64)),
                            "base": pa.array(np.bincount(row, np.log10(known + 1.0), n)),
                            "score": pa.array(probability(m, parts, *lev, n)),
                        }
                    )
                )
            return pa.concat_tables(out)

        told = answers.filter(F.col("piece").isNotNull()).select("piece", "at", "rows", "order", "ask", "levels", "counts")
        scored = texts.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(score, f"id {kind}, used boolean, n_tokens long, n_known long, base double, score double")
        scored = written(scored, "scored")
    shipped.destroy()
    discard(texts, answers)
    return model, scored


def closing(m: Model, base: Column) -> list[Column]:
    return [F.lit(m.total).cast("long").alias("train_tokens"), (base - F.col("n_tokens") * F.lit(math.log10(m.total + m.distinct + 1))).alias("base_score")]


def lm_score(docs: DataFrame, used: Column, id_col: str = "doc_id", text_col: str = "text", bits_per_level: int = 12, most_filter_mb: int = 16, head: int = 1 << 17, weight: float = 0.3, bucket_bytes: int = 1 << 23) -> DataFrame:
    """Scores every whole text: ``id, used, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens: A-Z lower-cased words between ASCII white space, then one end. Texts where ``used`` (a condition on
    ``docs``) is true are learned from. base_score: add-one word model with exact counts (frequent words from
    a broadcast table of bounded size, the others by a shuffle join). score: log10 probability of a word-pair
    model of all pairs whose counts come from the filter alone: P(w|v) = weight * c(vw) / c(v) + (1 - weight) * P(w), where
    P(w) shares out what new words leave (an unknown word has V / (N + V), as one class) by the words' counts.

    Null ``used`` counts as true; null text is empty (one end token). Repeated rows are scored and learned
    once each. With no training text every token is unknown. Other columns are ignored.

    A filter of up to ``most_filter_mb`` is shipped to the tasks. A larger one is made and asked where it lies (``asked``), with the same answers;
    there exact counts come from the same ranges, and no task nor the driver holds a table that grows with the texts.
    """
    spark = docs.sparkSession
    used = F.coalesce(used, F.lit(True))
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col), used.alias("__used"), F.col(text_col))
    size, buckets = ranges(docs, text_col, bucket_bytes)
    model = None
    if size <= most_filter_mb * FILTER_SHARE << 20:
        model, counts = learn(docs, used, text_col, bits_per_level, most_filter_mb, head, weight, bucket_bytes)
        if model.bits is None:
            discard(counts)
    if model is None or model.bits is None:
        model, scored = asked(sent, buckets, bits_per_level, weight, kind)
        return scored.select(F.col("id").alias(id_col), "used", "n_tokens", "n_known", *closing(model, F.col("base")), "score")
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = shipped.value
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = K.flat(batch.column(2))
            for lo, hi in K.pieces(off, WORK_BYTES):
                n = hi - lo
                of = ngrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield from score_rows(m, of, m.levels(of[2], 1), m.levels(of[4], 2), at, batch.column(0).slice(lo, n), batch.column(1).slice(lo, n))
                at += n

    schema = f"row long, id {kind}, used boolean, n_tokens long, n_known long, base double, score double, key long, tf long"
    with small_batches(spark, BATCH_ROWS):
        scored = written(sent.mapInArrow(run, schema), "scored")
    shipped.destroy()  # the filter, of which the driver and every executor hold the blocks
    rest = scored.filter(F.col("key").isNotNull()).select("row", "key", "tf")
    rest = rest.join(counts, "key").groupBy("row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.filter(F.col("key").isNull()).drop("key", "tf").join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        "used",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        *closing(model, F.col("base") + zero("more")),
        "score",
    )
