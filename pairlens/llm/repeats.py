"""Repeated byte strings across documents, by enhanced suffix arrays of the places where texts can agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import kernels as K
from .bloom import Filter
from .common import discard, forget, written

U = K.U
GRAM = 16


def byte_grams(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of each n consecutive bytes, by doubling; the last step overlaps."""
    h, size = K.BYTE[data], 1
    while size < n:
        step = min(size, n - size)
        m = len(h) - step
        if m <= 0:
            return np.zeros(0, U)
        h = h[:m] * K.powers(2 * GRAM)[step] + K.mix(h[step:]) if step < size else h[:m] + h[step:] * K.powers(size + 1)[size]
        size += step
    return K.mix(h)


def segments(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor hash of each segment.

    A window is ``least`` bytes of one row. Its anchor is the smallest of its byte grams, the rightmost if
    several are equal, so equal windows have equal anchors at equal places. A segment is a run of
    windows with one anchor; equal windows are only ever found in segments with equal anchor hashes.
    """
    none = np.zeros(0, np.int64)
    w, n = least - GRAM + 1, len(data) - least + 1
    if n <= 0:
        return none, none, none, none.view(U)
    key = byte_grams(data)
    low = K.window_min(key, w)
    start = np.arange(n, dtype=np.int32)
    at = np.where(key[w - 1 :][:n] == low, start + np.int32(w - 1), np.int32(0))
    lost = np.flatnonzero((at == 0) & np.append(True, low[1:] != low[:-1]))
    for a in range(0, len(lost), 20_000):  # the smallest has left the window: look for the next
        i = lost[a : a + 20_000]
        same = key[i[:, None] + np.arange(w)] == low[i][:, None]
        at[i] = i + w - 1 - same[:, ::-1].argmax(1)
    at = np.maximum.accumulate(at)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[:n]
    ok = np.flatnonzero(row == np.repeat(np.arange(len(size), dtype=np.int32), size)[least - 1 :][:n])
    if not len(ok):
        return none, none, none, none.view(U)
    new = np.append(True, (at[ok[1:]] != at[ok[:-1]]) | (row[ok[1:]] != row[ok[:-1]]))
    first = np.flatnonzero(new)
    return row[ok[first]].astype(np.int64), ok[first], np.diff(np.append(first, len(ok))), key[at[ok[first]]]


def content(data: np.ndarray, start: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """64-bit hash of data[start : start + size] for each, of at least ``least`` bytes: from the hashes of overlapping grams."""
    if not len(start):
        return np.zeros(0, U)
    n = min(2 * GRAM, least)
    h = byte_grams(data, n)
    out = K.mix(size.astype(U))
    for j in range(k := -(-(2 * least - GRAM) // n)):  # no segment is longer
        out = K.mix(out * U(0xD6E8FEB86659FD93) + h[start + (size - n) * j // max(k - 1, 1)])
    return out


class Repeats:
    """Maximal repeats of at least ``least`` bytes among the windows of some texts.

    An enhanced suffix array of the texts (the suffixes that start at a window), cut at the texts' ends, is
    scanned with a stack: each interval of suffixes with a common prefix is a node of the common-prefix interval
    tree. It is a maximal repeat if the bytes before its occurrences differ; a text's start differs from
    every byte, as what stands before it is known to its neighbour segment only. Suffixes whose first ``least`` bytes
    no other one has by hash are in no such interval and are left out before sorting; those with equal
    ones stand together, in the order of what follows. All prefixes are compared byte by byte. An interval whose inner prefixes all have its
    own length needs no stack.
    owner: what texts are compared with each other only (their anchor).

    ``order``: the window of each suffix; repeat i has the suffixes ``lo[i]:hi[i]``, all its occurrences, and ``length[i]`` bytes.
    """

    def __init__(self, texts: list[bytes], windows: np.ndarray, owner: np.ndarray, least: int) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size) - size
        longest = int(size.max(initial=0))
        data = np.frombuffer(b"".join(texts) + bytes(longest + least + 8), np.uint8)
        self.text = np.repeat(np.arange(len(texts)), windows)
        self.offset = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = base[self.text] + self.offset
        left = size[self.text] - self.offset
        key = K.mix(byte_grams(data, least)[at] ^ K.mix(owner.astype(np.int64).view(U))[self.text])
        sort = np.argsort(key)
        same = key[sort][1:] == key[sort][:-1]
        with_other = sort[np.append(False, same) | np.append(same, False)]
        with_other = with_other[left[with_other] >= least]
        width = max(-(-(longest - least) // 8) * 8, 8)
        at, left, key = at[with_other], left[with_other] - least, key[with_other]
        tail = np.lib.stride_tricks.sliding_window_view(data, width)[at + least]  # a copy of the bytes alone
        tail[np.arange(width) >= left[:, None]] = 0
        columns = tail.view(">u8")
        sort = np.lexsort([left, *[columns[:, j].astype(U) for j in range(width // 8 - 1, -1, -1)], key])
        self.order, at, left, key, tail = with_other[sort], at[sort], left[sort], key[sort], tail[sort]
        n = len(self.order)
        lcp = np.zeros(n + 1, np.int64)
        heads = np.lib.stride_tricks.sliding_window_view(data, least)
        for lo in range(0, n - 1, 100_000):
            x = slice(lo, min(lo + 100_000, n - 1))
            y = slice(x.start + 1, x.stop + 1)
            differ = tail[x] != tail[y]
            common = np.where(differ.any(1), differ.argmax(1), width)
            equal = (key[x] == key[y]) & (heads[at[x]] == heads[at[y]]).all(1)
            lcp[1 + x.start : 1 + x.stop] = np.where(equal, least + np.minimum(common, np.minimum(left[x], left[y])), 0)
        before = np.where(self.offset[self.order] > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)
        # an interval is diverse if neighbours in it differ before, or a text starts in it
        change = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0))]) if n else np.zeros(1, np.int64)
        edge = np.flatnonzero(lcp == 0)  # runs of suffixes of one prefix begin here
        begin, end = edge[:-1], edge[1:]
        begin, end = begin[end - begin > 1], end[end - begin > 1]
        changes = np.append(0, np.cumsum(lcp[1:] != lcp[:-1]))
        plain = changes[end - 1] == changes[begin + 1]
        length = lcp[begin + 1]
        lo, hi, deep = [begin[plain]], [end[plain]], [length[plain]]
        for i, j in zip(begin[~plain].tolist(), end[~plain].tolist(), strict=True):
            got = _intervals(lcp[i + 1 : j].tolist())
            lo.append(i + np.array([x for x, _, _ in got]))
            hi.append(i + np.array([x for _, x, _ in got]))
            deep.append(np.array([x for _, _, x in got]))
        lo, hi, deep = (np.concatenate(x).astype(np.int64) for x in (lo, hi, deep))
        diverse = change[hi - 1] > change[lo]
        self.lo, self.hi, self.length = lo[diverse], hi[diverse], deep[diverse]


def _intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(first, end, common prefix) of every node of the interval tree of neighbours' common prefixes, by a stack."""
    starts: list[int] = []
    values: list[int] = []
    out = []
    for i, v in enumerate([*lcp, 0]):
        left_at = i
        while values and values[-1] > v:
            left_at = starts.pop()
            out.append((left_at, i + 1, values.pop()))
        if v and (not values or values[-1] < v):
            starts.append(left_at)
            values.append(v)
    return out


def maximal_repeats(texts: list[bytes], windows: np.ndarray, owner: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each maximal repeat (see Repeats): its length, and the text of each occurrence and its offset there."""
    r = Repeats(texts, windows, owner, least)
    for lo, hi, length in zip(r.lo.tolist(), r.hi.tolist(), r.length.tolist(), strict=True):
        of = r.order[lo:hi]
        yield length, r.text[of], r.offset[of]


def repeat_groups(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", most_filter_mb: int = 64, group_rows: int = 20_000, bucket_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Strings of at least ``least`` bytes that start in several documents, in segments.

    Returns (groups, places): groups has ``seg, f, t, m`` rows: of a segment of text, a range of its windows (``f`` to
    ``t``, end exclusive) and the smallest id in which these windows occur; places has ``seg, id,
    row, at``: where each segment occurs, row being a hash of id and text.

    Anchors that occur under more than one id are found by grouped minima and go to a Bloom filter of bounded
    size, with which a second scan keeps the segments that can agree with another one; with more anchors the
    filter is coarser and more are kept. Segments of equal bytes are one, with their smallest id. Where an
    anchor has different segments, a third scan fetches their bytes, which meet by anchor, in buckets of about
    ``bucket_rows``, each one enhanced suffix array. An anchor with more than
    ``group_rows`` different segments is not one bucket's work: its windows are grouped by their bytes' hash instead,
    as another scan cuts them. No table holds the segments' bytes: they go from the scan to their bucket.
    Texts are told apart by 64-bit hashes of their bytes.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number: ids are compared by size")
    if least < GRAM + 2:
        raise ValueError(f"least must be {GRAM + 2} at least")
    src = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, d = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(h)
                h, d = h[order], d[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                several = np.logical_or.reduceat(d != np.repeat(d[first], np.diff(np.append(first, len(h)))), first)
                h = np.append(h[first], h[first[several]])  # twice where this part has it under several ids
                for lo in range(0, len(h), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(h[lo : lo + 200_000]))], ["anchor"])
                held.clear()

        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = K.flat(batch.column(1))
            for lo, hi in K.pieces(off, 1 << 18):
                row, _, _, anchor = segments(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], least)
                if len(row):
                    held.append((anchor, ids[lo:hi][row]))
                total += len(row)
                if total > 2_000_000:
                    yield from flush()
                    total = 0
        yield from flush()

    # an id whose rows lie in several parts counts as several: its anchors are followed up in vain, no result changes
    shared = src.mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    shared = written(shared, "anchors")
    forget(docs.sparkSession)
    some = docs.sparkSession.sparkContext.broadcast(Filter(shared, "anchor", most_filter_mb))
    discard(shared)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seg", "id", "row", "at", "anchor", "windows"]
        seen: dict[int, int] = {}
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, off = K.flat(batch.column(1))
            for lo, hi in K.pieces(off, 1 << 18):
                part, base = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                row, start, windows, anchor = segments(part, base, least)
                keep = some.value.may_hold(anchor)
                row, start, windows, anchor = row[keep], start[keep], windows[keep], anchor[keep]
                seg = content(part, start, windows + least - 1, least)
                doc = ids[lo:hi][row]
                again = ~_lower(seen, seg, doc)  # a segment is described once a task, or for a smaller id
                for a in range(0, len(seg), 50_000):
                    b = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(K.signed(seg[b])), pa.array(doc[b]), pa.array(keys[lo:hi][row[b]]), pa.array((start[b] - base[row[b]]).astype(np.int32)), pa.array(K.signed(anchor[b]), mask=again[b]), pa.array(windows[b].astype(np.int32), mask=again[b])], names
                    )

    found = written(src.withColumn("row", F.hash("text")).mapInArrow(spots, "seg long, id long, row int, at int, anchor long, windows int"), "segments")
    kinds = found.filter(F.col("anchor").isNotNull()).groupBy("seg").agg(F.min("id").alias("id"), F.first("anchor").alias("anchor"), F.first("windows").alias("windows"))
    kinds = written(kinds, "kinds")
    forget(docs.sparkSession)
    many = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "met")
    forget(docs.sparkSession)
    differ = docs.sparkSession.sparkContext.broadcast(Filter(many, "anchor", most_filter_mb))

    def fetch(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[tuple]:
        """Id, anchor, windows, hash, start and bytes of the segments whose anchor is crowded, or is not."""
        seen: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = K.flat(batch.column(1))
            for lo, hi in K.pieces(off, 1 << 18):
                part, base = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                row, start, windows, anchor = segments(part, base, least)
                keep = np.flatnonzero(np.isin(K.signed(anchor), crowded.value) if hot else differ.value.may_hold(anchor))
                if not hot and len(crowded.value):
                    keep = keep[~np.isin(K.signed(anchor[keep]), crowded.value)]
                seg = content(part, start[keep], windows[keep] + least - 1, least)
                new = _lower(seen, seg, ids[lo:hi][row[keep]])
                keep, seg = keep[new], seg[new]
                yield ids[lo:hi][row[keep]], anchor[keep], windows[keep], seg, start[keep], part

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, anchor, windows, seg, start, part in fetch(batches, False):
            raw = part.tobytes()
            blobs = [raw[a : a + k + least - 1] for a, k in zip(start.tolist(), windows.tolist(), strict=True)]
            for a in range(0, len(seg), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(seg[b])), pa.array(ids[b]), pa.array(K.signed(anchor[b])), pa.array(windows[b].astype(np.int32)), pa.array(blobs[b], pa.binary())], ["seg", "id", "anchor", "windows", "bytes"])

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, windows, seg, start, part in fetch(batches, True):
            for lo in range(0, len(seg), 2000):
                k = windows[lo : lo + 2000].astype(np.int64)
                offset = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                of = np.repeat(np.arange(lo, lo + len(k)), k)
                yield pa.RecordBatch.from_arrays([pa.array(seg[of].view(np.int64)), pa.array(ids[of]), pa.array(offset.astype(np.int32)), pa.array(K.signed(content(part, start[of] + offset, np.full(len(of), least), least)))], ["seg", "id", "f", "window"])

    top = many.filter(F.col("n") > group_rows).select("anchor")  # at most one in group_rows segments
    crowded = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in top.collect()), np.int64))
    met = src.mapInArrow(cold, "seg long, id long, anchor long, windows int, bytes binary")
    size = many.agg(F.sum(F.when(F.col("n") <= group_rows, F.col("n"))).alias("cold")).first()
    buckets = max(1, int(size["cold"] or 0) // bucket_rows)

    def suffixes(table: pa.Table) -> pa.Table:
        seg, ids = table.column("seg").to_numpy(), table.column("id").to_numpy()
        one = np.lexsort((ids, seg))
        one = one[np.append(True, seg[one][1:] != seg[one][:-1])]  # of a segment met in several tasks, its smallest id
        one = one[np.argsort(table.column("anchor").to_numpy()[one], kind="stable")]
        seg, low = seg[one], ids[one]
        texts, windows, owner = table.column("bytes").take(pa.array(one)).to_pylist(), table.column("windows").to_numpy()[one], table.column("anchor").to_numpy()[one]
        windows = windows.astype(np.int64)
        base = np.cumsum(windows) - windows
        m = np.repeat(low, windows)  # of each window, the smallest id of the repeats that cover it
        r = Repeats(texts, windows, owner, least)
        place = base[r.text] + r.offset
        for at in range(0, len(r.lo), 200_000):  # each interval's occurrences, flat
            lo, k, length = r.lo[at : at + 200_000], (r.hi - r.lo)[at : at + 200_000], r.length[at : at + 200_000]
            of = r.order[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            least_id = np.repeat(np.minimum.reduceat(low[r.text[of]], np.cumsum(k) - k), k)
            f, n = place[of], np.repeat(length - least + 1, k)
            better = np.flatnonzero(least_id < m[f])  # what is larger at its start is so all along: the text has it itself
            f, n, least_id = f[better], n[better], least_id[better]
            np.minimum.at(m, np.repeat(f - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(least_id, n))
        of = np.repeat(np.arange(len(seg)), windows)
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (m[1:] != m[:-1])))
        begin = first - base[of[first]]
        stop = begin + np.diff(np.append(first, len(m)))
        return pa.table({"seg": pa.array(seg[of[first]]), "f": pa.array(begin.astype(np.int32)), "t": pa.array(stop.astype(np.int32)), "m": pa.array(m[first])})

    ranges, used = None, [kinds, many]
    if len(crowded.value):
        exploded = written(src.mapInArrow(each_window, "seg long, id long, f int, window long"), "windows")
        used.append(exploded)
        smallest = exploded.groupBy("window").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("window", "m")
        ranges = exploded.join(smallest, "window").select("seg", "f", (F.col("f") + 1).alias("t"), "m").distinct()
        # a crowded segment's own repeats
        own = kinds.join(F.broadcast(top), "anchor", "left_semi").select("seg", F.lit(0).alias("f"), F.col("windows").alias("t"), F.col("id").alias("m"))
        ranges = ranges.unionByName(own)
    by_array = met.withColumn("b", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("b").applyInArrow(suffixes, "seg long, f int, t int, m long")
    ranges = by_array if ranges is None else ranges.unionByName(by_array)
    # a segment alone with its anchor occurs again as a whole
    itself = kinds.join(many, "anchor", "left_anti").select("seg", F.lit(0).alias("f"), F.col("windows").alias("t"), F.col("id").alias("m"))
    groups = written(itself.unionByName(ranges), "ranges")
    discard(*used)
    forget(docs.sparkSession)
    return groups, found


def _lower(seen: dict[int, int], seg: np.ndarray, doc: np.ndarray, most: int = 300_000) -> np.ndarray:
    """Which segments are new to ``seen``, or have a smaller id than there; it is emptied when too large."""
    if len(seen) > most:
        seen.clear()
    out = np.zeros(len(seg), bool)
    for i, (s, d) in enumerate(zip(seg.tolist(), doc.tolist(), strict=True)):
        if seen.get(s, d + 1) > d:
            seen[s] = d
            out[i] = True
    return out


def drop_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Every document without the bytes that a string of ``least`` bytes covers which starts under a smaller id too.

    One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (start and end of each
    removed run, flat, in bytes of the UTF-8 text). Strings are judged on the input; overlaps count; equal
    ids never remove each other's bytes. Null text counts as empty; rows with a null id lose nothing and
    remove nothing; texts shorter than ``least`` lose nothing. An empty table gives an empty result.
    """
    groups, places = repeat_groups(docs, least, id_col, text_col, **settings)
    hit = places.select("seg", "id", "row", "at").join(groups, "seg").filter("m < id").select(F.col("id").alias("doc"), "row", F.struct((F.col("at") + F.col("f")).alias("s"), (F.col("at") + F.col("t") - 1 + least).alias("e")).alias("cut"))
    spans = written(hit.groupBy("doc", "row").agg(F.collect_list("cut").alias("cut")), "spans")
    discard(groups, places)
    forget(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = src.withColumn("doc", F.col("id").cast("long")).withColumn("row", F.hash("text")).join(spans, ["doc", "row"], "left").select("id", "text", F.transform("cut", lambda x: x["s"]).alias("s"), F.transform("cut", lambda x: x["e"]).alias("e"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, shas, spans = [], [], [], [], []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = (text.as_py() or "").encode()
                flat: list[int] = []
                if s.is_valid:
                    s, e = s.values.to_numpy(), e.values.to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    flat = np.stack([s[new], e[np.append(new[1:], len(s)) - 1]], 1).ravel().tolist()
                edges = [0, *flat, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                runs.append(len(flat) // 2)
                shas.append(hashlib.sha256(kept).hexdigest())
                spans.append(flat)
            i = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, i), pa.array(removed, i), pa.array(runs, i), pa.array(shas, pa.string()), pa.array(spans, pa.list_(i))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return whole.mapInArrow(apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>").withColumnRenamed("id", id_col)
