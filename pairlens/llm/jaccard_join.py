"""Near-duplicate classes by an n-gram Jaccard join on parity sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bloom import Filter
from .common import discard, forget, small_batches, together, written
from .components import components

U = K.U
WORDS = 8  # 64-bit words of a set's folded parity sketch
LARGEST = 1 << 31  # no text that Spark can hold has more words
PIECE, BATCH_ROWS, BATCH_MB = 1 << 19, 2000, 8  # bytes of text whose words a task has in hand; what of texts or sets it is given at once


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct n-word shingles, sorted; fewer words are one shingle."""
    row, _, _, h = K.words(data, offsets)
    ok = K.whole(row, n)
    rows, got = [row[: len(ok)][ok]], [K.grams(h, n)[ok]]
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    for m in range(1, n):
        which = np.flatnonzero(count == m)
        if len(which):
            rows.append(which)
            got.append(K.mix(K.grams(h, m)[first[which]] + U(m)))
    r, g = np.concatenate(rows), np.concatenate(got)
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.append(True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])) if len(r) else np.zeros(0, bool)
    return r[new], g[new]


class Bands:
    """Size bands, and how many sketch segments each needs, for similarity p / q.

    Linked sets have sizes whose ratio is at least p / q, so they are in one band or in two neighbouring
    ones; a set also joins the next band if a partner can be there. Linked sets of a band differ in at most
    D elements, which change at most D segments: of D + 1 + slack segments 1 + slack are equal, and more
    for a pair that may differ in less than D. A set with more than ``slack`` empty segments gives these too;
    otherwise an equal segment is not empty.
    """

    def __init__(self, p: int, q: int, most_bits: int = 8192) -> None:
        low = [1, 2]
        while low[-1] <= LARGEST * q // p + 1:
            top = low[-1]
            low.append(max((low[-1] - 1) * q // p + 1, top + 1, int(top * (q / p) ** 3)))
        self.p, self.q = p, q
        self.low = np.array(low, np.int64)
        top = np.append(self.low[1:] - 1, self.low[-1] * 4)
        self.differ = 2 * top * (q - p) // (q + p)
        self.slack = 2 + self.differ // 4
        self.top = top
        self.segments = self.differ + 1 + self.slack
        #: 64-bit words of the sketch by which sets of a band are compared: two bits and more for each element, up to a bound
        self.words = np.array([max(WORDS, min(most_bits, 1 << (2 * t - 1).bit_length()) >> 6) for t in top.tolist()], np.int64)

    def places(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each set size: its band, and whether a set of the next band can be a partner."""
        band = np.searchsorted(self.low, size, "right") - 1
        return band, (size > 0) & (size * self.q // self.p >= self.low[band + 1])


def signatures(row: np.ndarray, g: np.ndarray, docs: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows in ``docs``: (row, key, band, spare) for each segment of the parity sketch.

    spare: one less than the number of keys of the band that the set shares with any set it is linked with there.

    Every shingle flips one bit of a sketch as long as the hash range, cut into segments by the hash's high
    bits. Of a segment only the exclusive or of its flipped positions, scattered, is kept: it is equal for
    equal segments.
    """
    size = np.bincount(row, minlength=int(docs.max(initial=-1)) + 1)
    out_row, out_key, out_band, out_spare = [], [], [], []
    own, reaches = bands.places(size)
    for ahead in (0, 1):
        band = own + ahead
        on = np.zeros(len(size), bool)
        on[docs] = True
        on &= reaches if ahead else size > 0
        mine = on[row]
        r, h = row[mine], g[mine]
        if not len(r):
            continue
        n = bands.segments[band[r]].astype(U)
        segment = ((h >> U(32)) * n) >> U(32)
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (segment[1:] != segment[:-1])))
        flips = np.bitwise_xor.reduceat(K.mix(h), first)
        r, segment = r[first], segment[first]
        name = K.mix(band[r].astype(U) << U(40) | segment)
        out_row.append(r)
        out_key.append(K.mix(flips ^ name))
        out_band.append(band[r])
        filled = np.bincount(r, minlength=len(size))
        most = (size + np.minimum(size * bands.q // bands.p, bands.top[band])) * (bands.q - bands.p) // (bands.q + bands.p)
        spare = np.maximum(bands.segments[band] - most - np.minimum(bands.segments[band] - filled, bands.slack[band]) - 1, 0)
        out_spare.append(spare[r])
        for d in np.flatnonzero(on & (bands.segments[band] - filled > bands.slack[band])):
            empty = np.setdiff1d(np.arange(bands.segments[band[d]]), segment[r == d].astype(np.int64)).astype(U)
            out_row.append(np.full(len(empty), d))
            out_band.append(np.full(len(empty), band[d]))
            out_spare.append(np.full(len(empty), spare[d]))
            out_key.append(K.mix(U(0xE3A7) ^ K.mix(U(int(band[d])) << U(40) | empty)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out_row, np.int64), cat(out_key, U), cat(out_band, np.int64), cat(out_spare, np.int64)


def names(row: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each row's set; 0 for the empty set."""
    out = np.zeros(n, U)
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        count = np.diff(np.append(first, len(row))).astype(U)
        out[row[first]] = K.mix(np.add.reduceat(K.mix(g), first) ^ K.mix(count)) | U(1)
    return out


def dealing(block: int) -> tuple[Callable, Callable]:
    """Over parts of about ``block`` of a number of members: the part of a row's node, and rows for all parts."""
    last = lambda number: F.floor(number / F.lit(block)).cast("int")
    part = lambda number, *seed: F.pmod(F.xxhash64("node", *seed), last(number) + 1).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), last(number)))
    return part, every


def open_pairs(left: DataFrame, facts: DataFrame, p: int, q: int, block: int, each: int = 0, listed: int = 32) -> tuple[DataFrame, DataFrame]:
    """Pairs (b, a) of nodes of different classes that meet in ``left`` and whose sizes and sketches allow a link; also the written table they are made from.

    each: only members of the same part, of about so many members of a key, meet. 0: all members meet, and a pair that shares several keys
    comes from the least of them alone. For that a node lists its ``listed`` least keys; a pair whose lists have none in common comes from each key it shares.
    """
    part, every = dealing(block)
    by_class = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.max("of").alias("of"))
    of_key = by_class.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.sum("m").alias("members"), (F.sum("m") - F.max("m")).alias("outer"), F.max("of").alias("of"))
    least = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, listed).alias("keys"))
    left = left.join(of_key.select("key", "largest", "members", "outer", every(F.col("of")).alias("part")), ["key", "part"]).drop("part", "of")
    left = left.join(facts, "node").withColumn("sketch", F.when(F.col("band") == F.col("own"), F.col("here")).otherwise(F.col("next"))).drop("own", "here", "next", "band")
    left = left.withColumn("inner", F.col("component") == F.col("largest")).drop("largest")
    if each:
        left = left.withColumn("at_l", dealing(each)[0](F.col("members"), F.col("key"))).withColumn("at_r", F.lit(0))
    else:
        left = left.join(least, "node").withColumn("at_l", part(F.col("members"))).withColumn("at_r", part(F.col("outer"), F.lit(1)))
    left = written(left, "open-sketches")

    def side(c: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(x).alias(f"{c}_{x}") for x in left.columns if x not in ("members", "outer")])

    # a member meets the parts of all outer members of its key, each pair of parts where it is dealt to
    outer = left.filter("not inner")  # of the largest class of a key no two members meet
    l = side("l", left if each else left.withColumn("at_r", every(F.col("outer"))))
    r = side("r", outer if each else outer.withColumn("at_l", every(F.col("members"))))
    gap = sum((F.bit_count(F.col(f"l_s{j}").bitwiseXOR(F.col(f"r_s{j}"))) for j in range(WORDS)), F.lit(0))
    whole_gap = F.aggregate(F.zip_with("l_sketch", "r_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    possible = (
        (F.col("l_key") == F.col("r_key"))
        & (F.col("l_at_l") == F.col("r_at_l"))
        & (F.col("l_at_r") == F.col("r_at_r"))
        & (F.col("l_component") != F.col("r_component"))
        & (F.col("l_inner") | (F.col("l_node") < F.col("r_node")))
        & (F.least("l_n", "r_n") * q >= F.greatest("l_n", "r_n") * p)
        & (gap * (q + p) <= (F.col("l_n") + F.col("r_n")) * (q - p))
        & (whole_gap * (q + p) <= (F.col("l_n") + F.col("r_n")) * (q - p))
    )
    if not each:
        possible = possible & (F.coalesce(F.array_min(F.array_intersect("l_keys", "r_keys")), F.col("l_key")) == F.col("l_key"))
    return left, l.join(r, possible).select(F.least("l_node", "r_node").alias("b"), F.greatest("l_node", "r_node").alias("a"))


def similar_classes(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text", most_filter_mb: int = 128, rounds: int = 2, hubs_each: int = 3, most_bits: int = 8192, block: int = 1000, near: int = 64) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least p / q of their word shingles.

    One row per document: ``id, n_shingles, component_id``, the smallest id reachable by links, itself
    included. Rows with equal shingle sets are one node, so copies are never paired. Nodes meet where a segment of
    their parity sketches is equal (see Bands; no linked pair is missed). Meeting nodes are not paired
    among each other: in ``rounds`` rounds one node of each segment is its hub, and each node is compared with
    the ``hubs_each`` hubs of other classes that it meets most often. What then still meets in different classes is
    compared with the members outside the largest class of its segment, and only if sizes and
    the sketches' Hamming distance, which is never more than the sets' difference, allow a link: sketches as long as
    the sets leave hardly more than the pairs close to the threshold. Every
    comparison is of whole sets. But for the first join of keys with their counts, which Spark may split, a segment's members are dealt over parts of about ``block``, what
    is said of the segment goes to every part, and the last comparison is of parts with parts, each pair of parts a group of
    its own; before it, members are compared within parts of about ``near``, so that a large group's many links, of which its class needs
    few, need not all be found. Classes are connected components of the links found; links inside a class
    that could not change it are not looked for.

    A text without words (null, empty) has no shingles, links with nothing and is its own component. A null id
    gives a null component and takes no part. Repeated rows of one id are one node or are linked as their
    texts are. Other columns are ignored. most_bits: the longest sketch; beyond it
    more pairs are compared, no result changes. most_filter_mb: the bound of the broadcast filter of keys that occur more than once; where it
    is too small for them there is no filter and all keys are sent; none is lost.
    """
    bands = Bands(p, q, most_bits)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def written_by_python(df: DataFrame, name: str) -> DataFrame:
        """Written of texts or sets that go to Python: both sides of each task hold a batch, outside Spark's own memory."""
        with small_batches(docs.sparkSession, BATCH_ROWS, BATCH_MB):
            return written(df, name)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of each part of a batch: its rows, and (row, key, band, spare) of the nodes that this task has not met before."""
        done: set[int] = set()
        for batch in batches:
            data, off = K.flat(batch.column(1))
            for lo, hi in K.pieces(off, PIECE):
                row, g = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                n = hi - lo
                size, node = np.bincount(row, minlength=n), names(row, g, n)
                ids = batch.column(0).slice(lo, n)
                if len(done) > 500_000:
                    done.clear()
                real = ids.is_valid().to_numpy(zero_copy_only=False)
                fresh = []
                for d in np.flatnonzero((node != 0) & real).tolist():
                    if (x := int(node[d])) not in done:  # copies met in this task need no second set of keys
                        done.add(x)
                        fresh.append(d)
                yield ids, size, node, *signatures(row, g, np.array(fresh, np.int64), bands)

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, key, _, _ in scan(batches):
            for a in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key[a : a + 200_000]))], ["key"])

    # The keys alone are counted first. Those that occur once, nearly all, are then never sent with their nodes.
    often = written_by_python(src.mapInArrow(all_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "keys")
    forget(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Filter(often, "key", most_filter_mb))
    discard(often)

    def rows_and_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["id", "n", "node", "key", "band", "spare"]
        for ids, size, node, r, key, band, spare in scan(batches):
            n = len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(K.signed(node)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], columns)
            keep = shared.value.may_hold(key)
            r, key, band, spare = r[keep], key[keep], band[keep].astype(np.int32), spare[keep].astype(np.int32)
            for a in range(0, len(r), 200_000):
                b = slice(a, a + 200_000)
                k = len(r[b])
                yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), pa.nulls(k, pa.int64()), pa.array(K.signed(node[r[b]])), pa.array(K.signed(key[b])), pa.array(band[b]), pa.array(spare[b])], columns)

    scanned = written_by_python(src.mapInArrow(rows_and_keys, f"id {kind}, n long, node long, key long, band int, spare int"), "signatures")
    shared.destroy()  # the driver and every executor hold its blocks
    rows = scanned.filter(F.col("key").isNull()).drop("key", "band", "spare")
    keys = scanned.filter(F.col("key").isNotNull()).select("key", "node", "band", "spare")

    # ``of``: how often a key occurs, at least the number of its nodes, by which they are dealt over parts
    part, every = dealing(block)
    met = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("of")).filter("hub < top").select("key", "of")
    met = written(met, "met")  # so the join is of two plain exchanges, which Spark can split
    # A linked pair shares more than ``spare`` keys, so its rarest shared key is among none's ``spare`` most frequent ones:
    # each node leaves these out, the keys of common phrases before all others.
    by_frequency = Window.partitionBy("node", "band").orderBy(F.desc("of"), "key")
    few = keys.join(met, "key").distinct().withColumn("at", F.row_number().over(by_frequency)).filter("at > spare").select("key", "node", "band", "of", part(F.col("of")).alias("part"))
    few = written(few, "rare-keys")
    still = few.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.max("of").alias("of")).filter("hub < top")
    meets = written(few.join(still.select("key", every(F.col("of")).alias("part")), ["key", "part"], "left_semi"), "meetings")
    discard(met, few)
    forget(docs.sparkSession)

    # whole sets and folded sketches of the nodes that meet any other, from one row of each
    smallest = written(rows.filter(F.col("id").isNotNull() & (F.col("node") != 0)).groupBy("node").agg(F.min("id").alias("id")), "nodes")  # copies combine before the shuffle
    some = smallest.join(meets.select("node").distinct(), "node", "left_semi")
    texts = src.join(some, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.flat(batch.column(0))
            want = batch.column(1).to_numpy().view(U)
            for lo, hi in K.pieces(off, PIECE):
                row, g = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                n = hi - lo
                ok = np.flatnonzero(names(row, g, n) == want[lo:hi])  # another row of the same id may differ
                cut = np.searchsorted(row, np.arange(n + 1))
                size = np.diff(cut)
                band, reaches = bands.places(size)

                def sketch(d: int, words: int) -> np.ndarray:
                    out, h = np.zeros(words, U), g[cut[d] : cut[d + 1]]
                    np.bitwise_xor.at(out, (h >> U(6)) & U(words - 1), U(1) << (h & U(63)))
                    return K.signed(out)

                folded = np.array([sketch(d, WORDS) for d in ok], np.int64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(want[lo:hi][ok].view(np.int64)), pa.array(size[ok], pa.int64()), pa.array([g[cut[d] : cut[d + 1]].tobytes() for d in ok], pa.binary())],
                        *[pa.array(folded[:, j].copy()) for j in range(WORDS)],
                        pa.array(band[ok], pa.int32()),
                        *[pa.array([sketch(d, bands.words[band[d] + ahead]) if reaches[d] or not ahead else None for d in ok], pa.list_(pa.int64())) for ahead in (0, 1)],
                    ],
                    ["node", "n", "set", *[f"s{j}" for j in range(WORDS)], "own", "here", "next"],
                )

    fields = "node long, n long, set binary, " + ", ".join(f"s{j} long" for j in range(WORDS)) + ", own int, here array<long>, next array<long>"
    whole = written_by_python(texts.select("text", "node").mapInArrow(sets, fields).dropDuplicates(["node"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                if q * both >= p * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def linked(pairs: DataFrame) -> DataFrame:
        one = lambda c: whole.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"), F.col("n").alias(f"n_{c}"))
        near = pairs.join(one("a"), "a").join(one("b"), "b").filter(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)
        return near.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")

    def open_keys(known: DataFrame, turn: int) -> DataFrame:
        """Meetings whose nodes are in different classes as yet, with the nodes' classes and one of the key's nodes as its hub."""
        placed = meets.join(known, "node", "left").select("key", "part", "node", "band", "of", F.coalesce("component", "node").alias("component"))
        hub = F.min_by(F.struct("node", "component"), F.xxhash64("node", "key", F.lit(turn))).alias("hub")
        apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("of").alias("of"), hub).filter("x < y")
        return placed.join(apart.select("key", "hub", every(F.col("of")).alias("part")), ["key", "part"])

    spark = docs.sparkSession
    nothing = spark.range(0)  # createDataFrame would start Python processes on the executors for it, which stay
    known = nothing.select(F.col("id").alias("node"), F.col("id").alias("component"))
    none = written(nothing.select(F.col("id").alias("a"), F.col("id").alias("b")), "links")
    tried = [none]

    def merged(known: DataFrame, new: DataFrame) -> DataFrame:
        """The classes after new links: those known are stars already, so only they and the new links are gone through."""
        return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))

    for turn in range(rounds):
        forget(spark)  # small tables are broadcast by way of the driver, which else holds those of all steps till it runs out of room
        meet = open_keys(known, turn).filter(F.col("component") != F.col("hub.component")).groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("v"))
        best = Window.partitionBy("node").orderBy(F.desc("v"), F.xxhash64("node", "hub"))
        star = meet.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= hubs_each).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
        star = written(star.join(together(tried), ["a", "b"], "left_anti"), "stars")
        if star.isEmpty():
            break
        tried.append(star)
        new = written_by_python(linked(star), "links")
        if new.isEmpty():
            break
        known = merged(known, new)

    facts = whole.select("node", "n", *[f"s{j}" for j in range(WORDS)], "own", "here", "next")

    def apart(left: DataFrame, each: int) -> DataFrame:
        """Pairs, not tried as yet, of nodes of different classes that meet in ``left`` and whose sizes and sketches allow a link."""
        left, pairs = open_pairs(left, facts, p, q, block, each)
        rest = written(pairs.distinct().join(together(tried), ["a", "b"], "left_anti").select("a", "b"), "pairs")
        discard(left)
        return rest

    # A linked pair mostly shares several keys, and a node needs one link into a class: an eighth of the keys, within
    # parts of ``near`` members, finds most of what changes classes, in rows that grow with the members, not with their square.
    # What that brings into one class is not compared again. Then all keys, parts with parts, whatever is open.
    for share, each in ((8, near), (1, 0)):
        forget(spark)
        left = written(open_keys(known, rounds).filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).drop("hub"), "open")
        if left.isEmpty():  # no key has nodes of two classes: nothing to compare
            discard(left)
            continue
        rest = apart(left, each)
        discard(left)
        tried.append(rest)
        new = written_by_python(linked(rest), "links")
        if not new.isEmpty():
            known = merged(known, new)
    forget(spark)
    # a class's smallest id by way of its nodes, so that rows are joined by node alone and never gathered by class
    nodes = smallest.join(known, "node", "left").withColumn("c", F.coalesce("component", "node"))
    best = nodes.groupBy("c").agg(F.min("id").alias("best"))
    named = written(nodes.select("node", "c").join(best, "c").select("node", "best"), "classes")  # so the last join is of two plain exchanges, which Spark can split
    return rows.join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("best", "id")).alias("component_id")
    )
