"""Two-stage pools ranked again under drawn tie-breaks, left-out pairs and resampled names, by array sorts inside tasks.

A pool is one row: its cluster, category, and four scores for each name pair (both stages, marked and unmarked document). Tasks take
pools in blocks of bounded size, rank every draw of a block by integer sorts, and return sums. No row a (pool, draw, member) exists.
Tie-breaks are MD5 of seed, pool, draw and slot, so every variant replays the same ones, wherever a pool lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import weight_matrix

CELLS = 1 << 15  # members of a block: a dense rank of that many fits above 48 bits of tie-break
MOST_PAIRS = 512


def stacked(pairs: DataFrame, pool: list[str], pair: str, scores: dict[str, Column]) -> DataFrame:
    """One row a pool: ``pool, slots``, an array of (pair, first_m, first_f, second_m, second_f) in the order of the pairs.

    ``pairs`` has one row a pool and pair. A pool that holds a pair twice is an error: its slots would not say which name they hold.
    """
    slot = F.struct(F.col(pair).cast("string").alias("pair"), *[c.cast("double").alias(k) for k, c in scores.items()])
    got = pairs.groupBy(*pool).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    twice = F.size(F.array_distinct(F.transform("slots", lambda s: s["pair"]))) < F.size("slots")
    return got.withColumn("slots", F.when(twice, F.raise_error(F.lit("a pool holds a pair twice"))).otherwise(F.col("slots")))


def pair_names(pools: DataFrame) -> list[str]:
    """The distinct pairs of all pools: a dimension of the design, at most ``MOST_PAIRS``."""
    got = sorted(r[0] for r in pools.select(F.explode("slots.pair")).distinct().limit(MOST_PAIRS + 1).collect())
    if len(got) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} name pairs")
    return got


def tie_breaks(seed: str, names: list[str], repeats: int, n: int) -> np.ndarray:
    """(pools, repeats, n) 48-bit numbers: the same for a pool, draw and slot whenever they are asked for."""
    out = np.empty((len(names), repeats, n), np.int64)
    slots = [f"|{j}".encode() for j in range(n)]
    for i, name in enumerate(names):
        for r in range(repeats):
            begun = md5(f"{seed}|{name}|{r}".encode())
            for j in range(n):
                h = begun.copy()
                h.update(slots[j])
                out[i, r, j] = int.from_bytes(h.digest()[:6], "big")
    return out


def _dense(x: np.ndarray) -> np.ndarray:
    """Places of values among all distinct ones of the block, 0 the largest."""
    return np.unique(-x, return_inverse=True)[1].reshape(x.shape).astype(np.int64) << 48


def average_ranks(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Mean rank within each row, 1 the largest, of those that are ``ok``; others get 0."""
    y = np.where(ok, x, -np.inf)
    order = np.argsort(-y, axis=1, kind="stable")
    s = np.take_along_axis(y, order, 1)
    n = s.shape[1]
    new = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], 1)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0), 1)
    last = np.flip(np.minimum.accumulate(np.flip(np.where(np.concatenate([new[:, 1:], np.ones((len(s), 1), bool)], 1), np.arange(n), n), 1), 1), 1)
    out = np.empty(s.shape)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1, 1)
    return np.where(ok, out, 0.0)


def gap(rank: np.ndarray, marked: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Mean rank of the unmarked less that of the marked, by row; NaN without both."""
    m, f = marked & ok, ~marked & ok
    with np.errstate(invalid="ignore", divide="ignore"):
        return (rank * f).sum(1) / f.sum(1) - (rank * m).sum(1) / m.sum(1)


def two_stages(first: np.ndarray, second: np.ndarray, marked: np.ndarray, ok: np.ndarray, tb: np.ndarray | None, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked members kept, marked members retrieved (means over draws), and each draw's retrieved members (pools, draws, k).

    Both ranks are one integer sort: dense rank of the score above, tie-break below. ``tb`` None takes the slots' order.
    """
    n = first.shape[1]
    tb = np.broadcast_to(np.arange(n), (len(first), 1, n)) if tb is None else tb
    e, r = _dense(np.where(ok, first, -np.inf)), _dense(np.where(ok, second, -np.inf))
    inside = np.argsort(e[:, None, :] | tb, axis=2, kind="stable")[:, :, :k]
    pool = np.arange(len(first))[:, None, None]
    again = np.argsort(r[pool, inside] | np.take_along_axis(np.broadcast_to(tb, (len(first), tb.shape[1], n)), inside, 2), axis=2, kind="stable")[:, :, :s]
    kept = np.take_along_axis(inside, again, 2)
    good = marked & ok
    return good[pool, kept].sum(2).mean(1), good[pool, inside].sum(2).mean(1), inside


def _undecided(first: np.ndarray, second: np.ndarray, marked: np.ndarray, ok: np.ndarray, k: int, s: int) -> np.ndarray:
    """Pools whose shortlist's marked members can depend on the tie-break: unlike members are tied across a cut."""
    x, y = np.where(ok, first, -np.inf), np.where(ok, second, -np.inf)
    n = x.shape[1]
    open_ = np.zeros(len(x), bool)
    order = np.argsort(-x, axis=1, kind="stable")
    if k < n:
        at = np.take_along_axis(x, order[:, k - 1 : k], 1)
        crossing = at == np.take_along_axis(x, order[:, k : k + 1], 1)
        tied = x == at
        unlike = lambda v: np.where(tied, v, -np.inf).max(1) != np.where(tied, v, np.inf).min(1)
        open_ |= crossing[:, 0] & (unlike(y) | unlike(marked.astype(float)))
    inside = order[:, :k]
    y2, m2 = np.take_along_axis(y, inside, 1), np.take_along_axis(marked, inside, 1)
    if s < y2.shape[1]:
        order2 = np.argsort(-y2, axis=1, kind="stable")
        at = np.take_along_axis(y2, order2[:, s - 1 : s], 1)
        crossing = at == np.take_along_axis(y2, order2[:, s : s + 1], 1)
        tied = y2 == at
        open_ |= crossing[:, 0] & (m2 & tied).any(1) & (~m2 & tied).any(1)
    return open_


def shortlisted(first, second, marked, ok, tb, k: int, s: int) -> np.ndarray:
    """Mean over draws of the marked members kept; draws are made only where they can change it."""
    out = two_stages(first, second, marked, ok, None, k, s)[0]
    again = np.flatnonzero(_undecided(first, second, marked, ok, k, s))
    if len(again):
        out[again] = two_stages(first[again], second[again], marked[again], ok[again], tb[again], k, s)[0]
    return out


class Block:
    """Some pools as arrays: slot 2j is the marked document of pair j, slot 2j + 1 the unmarked one; ``ok`` where the pool has the pair."""

    def __init__(self, slots: list, names: list[str], pools: list[str], seed: str, repeats: int) -> None:
        at = {p: j for j, p in enumerate(names)}
        n = 2 * len(names)
        self.first, self.second, self.ok = np.zeros((len(slots), n)), np.zeros((len(slots), n)), np.zeros((len(slots), n), bool)
        for i, pool in enumerate(slots):
            for x in pool:
                j = 2 * at[x["pair"]]
                self.first[i, j : j + 2] = x["first_m"], x["first_f"]
                self.second[i, j : j + 2] = x["second_m"], x["second_f"]
                self.ok[i, j : j + 2] = True
        self.marked = np.broadcast_to(np.arange(n) % 2 == 0, self.ok.shape)
        self.tb = tie_breaks(seed, pools, repeats, n)

    def slotted(self, slots: np.ndarray, k: int, s: int) -> np.ndarray:
        """``shortlisted`` of the pools rebuilt from some slots; a slot taken twice is two documents of equal scores, tie-breaks go by place."""
        return shortlisted(self.first[:, slots], self.second[:, slots], self.marked[:, slots], self.ok[:, slots], self.tb[:, :, : len(slots)], k, s)


def spread(pools: DataFrame, pool: str) -> DataFrame:
    """Few rows, much work each: dealt to all cores, whatever their bytes would suggest."""
    return pools.repartition(2 * pools.sparkSession.sparkContext.defaultParallelism, pool)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def simulate(pools: DataFrame, pool: str, repeats: int, k: int, s: int, seed: str) -> DataFrame:
    """Each pool's ``marked_kept, marked_alone, marked_first, marked_retrieved, pipe_gap, second_gap, first_gap, neutral_gap``.

    kept: of the best s by the second score among the best k by the first; alone and first: of the best s by one score;
    means over ``repeats`` tie-breaks. Gaps are of mean ranks, ties sharing theirs; the neutral gap gives every retrieved
    document the expected place and leaves the rest where the first score has it. A pool of fewer than s or k members gives all it has.
    """
    names = pair_names(pools)
    fields = ["marked_kept", "marked_alone", "marked_first", "marked_retrieved", "pipe_gap", "second_gap", "first_gap", "neutral_gap"]
    others = [c for c in pools.columns if c != "slots"]
    schema = ", ".join([*(f"`{c}` {pools.schema[c].dataType.simpleString()}" for c in others), "members long", *(f"{f} double" for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 2 * len(names)):
            b = Block(batch.column("slots").to_pylist(), names, [str(x) for x in batch.column(pool).to_pylist()], seed, repeats)
            kept, retrieved, inside = two_stages(b.first, b.second, b.marked, b.ok, b.tb, k, s)
            alone = two_stages(b.second, b.second, b.marked, b.ok, b.tb, s, s)[0]
            first = two_stages(b.first, b.first, b.marked, b.ok, b.tb, s, s)[0]
            pipe, neutral = np.zeros((2, *inside.shape[:2]))
            # gaps need only the retrieved set, and draws differ in it only where it was tied
            for r in range(inside.shape[1]):
                got = np.zeros(b.ok.shape, bool)
                np.put_along_axis(got, inside[:, r], True, 1)
                got &= b.ok
                size = got.sum(1, keepdims=True)
                rest = b.ok & ~got
                behind = np.where(rest, size + average_ranks(b.first, rest), 0)
                pipe[:, r] = gap(behind + average_ranks(b.second, got), b.marked, b.ok)
                neutral[:, r] = gap(behind + np.where(got, (size + 1) / 2.0, 0), b.marked, b.ok)
            values = [kept, alone, first, retrieved, pipe.mean(1), gap(average_ranks(b.second, b.ok), b.marked, b.ok), gap(average_ranks(b.first, b.ok), b.marked, b.ok), neutral.mean(1)]
            columns = [batch.column(c) for c in others] + [pa.array(b.ok.sum(1))] + [pa.array(v, pa.float64(), from_pandas=True) for v in values]
            yield pa.RecordBatch.from_arrays(columns, [*others, "members", *fields])

    return spread(pools, pool).mapInArrow(run, schema)


def replayed(pools: DataFrame, pool: str, repeats: int, k: int, s: int, seed: str) -> DataFrame:
    """Does a replay of banked scores give the shortlist that live scores of the retrieved documents give?

    ``pools`` as ``stacked``, whose slots also hold live_m and live_f. Each pool's ``kept_replay, kept_live, identical``: marked
    members kept by either score, and the share of tie-breaks, the same for both, whose shortlists hold the same members.
    """
    names = pair_names(pools)
    others = [c for c in pools.columns if c != "slots"]
    schema = ", ".join([*(f"`{c}` {pools.schema[c].dataType.simpleString()}" for c in others), "members long, kept_replay double, kept_live double, identical double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 2 * len(names)):
            slots = batch.column("slots").to_pylist()
            pool_names = [str(x) for x in batch.column(pool).to_pylist()]
            bank = Block(slots, names, pool_names, seed, repeats)
            live = Block([[{**x, "second_m": x["live_m"], "second_f": x["live_f"]} for x in p] for p in slots], names, pool_names, seed, 0)
            lists = []
            for second in (bank.second, live.second):
                e, r = _dense(np.where(bank.ok, bank.first, -np.inf)), _dense(np.where(bank.ok, second, -np.inf))
                inside = np.argsort(e[:, None, :] | bank.tb, axis=2, kind="stable")[:, :, :k]
                at = np.arange(len(slots))[:, None, None]
                again = np.argsort(r[at, inside] | np.take_along_axis(bank.tb, inside, 2), axis=2, kind="stable")[:, :, :s]
                lists.append(np.sort(np.take_along_axis(inside, again, 2), axis=2))
            good = bank.marked & bank.ok
            kept = [good[np.arange(len(slots))[:, None, None], x].sum(2).mean(1) for x in lists]
            same = (lists[0] == lists[1]).all(2).mean(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(bank.ok.sum(1)), *map(pa.array, kept), pa.array(same)], [*others, "members", "kept_replay", "kept_live", "identical"])

    return spread(pools, pool).mapInArrow(run, schema)


def leave_one_pair_out(pools: DataFrame, pool: str, by: str, repeats: int, k: int, s: int, seed: str) -> DataFrame:
    """``by, pair, pct_marked``: the share kept without each pair, tie-breaks of the documents that are left as before; null pair: nothing left out."""
    names = pair_names(pools)
    kind = pools.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 2 * len(names)):
            b = Block(batch.column("slots").to_pylist(), names, [str(x) for x in batch.column(pool).to_pylist()], seed, repeats)
            groups = batch.column(by).to_pylist()
            rows = []
            for j, name in enumerate([None, *names], -1):
                keep = np.arange(b.ok.shape[1]) // 2 != j
                kept = shortlisted(b.first[:, keep], b.second[:, keep], b.marked[:, keep], b.ok[:, keep], b.tb[:, :, keep], k, s)
                room = np.minimum(s, b.ok[:, keep].sum(1))
                for g in sorted(set(groups), key=str):
                    mine = np.array([x == g for x in groups])
                    rows.append({by: g, "pair": name, "kept": float(kept[mine].sum()), "room": int(room[mine].sum())})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field(by), ("pair", pa.string()), ("kept", pa.float64()), ("room", pa.int64())]))

    sums = spread(pools, pool).mapInArrow(run, f"`{by}` {kind}, pair string, kept double, room long")
    return sums.groupBy(by, "pair").agg((100.0 * F.sum("kept") / F.nullif(F.sum("room"), F.lit(0))).alias("pct_marked"))


def pair_bootstrap(pools: DataFrame, pool: str, cluster: str, draws: int, repeats: int, k: int, s: int, seed: str) -> DataFrame:
    """``cluster, b, kept, room``: sums over each cluster's pools, rebuilt from name pairs drawn with replacement and ranked again.

    ``b`` -1 has the pools as they are. A pair drawn twice is in a pool twice; a pair that a pool lacks leaves its place empty.
    All pools share a draw's pairs. A task returns two arrays a cluster, whatever the number of pools and repeats.
    """
    names = pair_names(pools)
    kind = pools.schema[cluster].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = [drawn_pairs(seed, b, len(names)) for b in range(draws)]
        for batch in _blocks(batches, 2 * len(names)):
            b = Block(batch.column("slots").to_pylist(), names, [str(x) for x in batch.column(pool).to_pylist()], seed, repeats)
            clusters = batch.column(cluster).to_pylist()
            known = sorted(set(clusters), key=str)
            member = np.array([[c == x for c in clusters] for x in known], float)
            kept, room = np.empty((2, draws + 1, len(known)))
            for d, pairs in enumerate([np.arange(len(names)), *times]):
                slots = np.stack([2 * pairs, 2 * pairs + 1], 1).ravel()
                kept[d] = member @ b.slotted(slots, k, s)
                room[d] = member @ np.minimum(s, b.ok[:, slots].sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(known, batch.schema.field(cluster).type), pa.array(kept.T.tolist()), pa.array(room.T.tolist())], [cluster, "kept", "room"])

    got = spread(pools, pool).mapInArrow(run, f"`{cluster}` {kind}, kept array<double>, room array<double>")
    each = got.select(cluster, F.posexplode(F.arrays_zip("kept", "room")).alias("b", "x"))
    return each.groupBy(cluster, (F.col("b") - 1).alias("b")).agg(F.sum("x.kept").alias("kept"), F.sum("x.room").alias("room"))


def drawn_pairs(seed: str, b: int, n: int) -> np.ndarray:
    return np.array([int.from_bytes(md5(f"{seed}-pairs|{b}|{j}".encode()).digest()[:6], "big") % n for j in range(n)], int)


def joint_intervals(sums: DataFrame, cluster: str, category: str, draws: int, seed: str) -> DataFrame:
    """``category, scheme, point, low, high, sd`` of the share kept: names drawn, clusters drawn, or both, a category's own clusters or, for ALL, all.

    ``sums`` is ``pair_bootstrap``'s with its category: clusters x draws rows, which meet a category at a time as two matrices.
    """
    both = sums.select(F.explode(F.array(F.col(category), F.lit("ALL"))).alias("group"), cluster, "b", "kept", "room")

    def run(t: pa.Table) -> pa.Table:
        group = t.column("group")[0].as_py()
        keys = sorted(set(t.column(cluster).to_pylist()), key=str)
        at = {c: i for i, c in enumerate(keys)}
        kept, room = np.zeros((2, draws + 1, len(keys)))
        where = (t.column("b").to_numpy() + 1, np.array([at[c] for c in t.column(cluster).to_pylist()]))
        kept[where], room[where] = t.column("kept").to_numpy(), t.column("room").to_numpy()
        w = weight_matrix(f"{seed}-clusters|{group}", range(draws), len(keys))
        one = np.ones(len(keys))
        schemes = {"names": (kept[1:] @ one, room[1:] @ one), "clusters": (w @ kept[0], w @ room[0]), "both": ((w * kept[1:]).sum(1), (w * room[1:]).sum(1))}
        rows = []
        for name, (x, y) in schemes.items():
            v = 100.0 * x[y > 0] / y[y > 0]
            low, high = np.quantile(v, [0.025, 0.975])
            rows.append({"category": group, "scheme": name, "point": float(100.0 * kept[0].sum() / room[0].sum()), "low": float(low), "high": float(high), "sd": float(np.std(v, ddof=1))})
        return pa.Table.from_pylist(rows)

    return both.groupBy("group").applyInArrow(run, "category string, scheme string, point double, low double, high double, sd double")


def baselines(models: DataFrame, category: str, model: str, s: int, k: int) -> DataFrame:
    """By model and category (ALL too): rank gaps and shortlist shares against the first stage alone and an order-neutral re-ranker.

    ``models`` is ``simulate``'s result with a model column. ``below_*`` says whether the pipeline lies below that baseline.
    """
    g = models.withColumn(category, F.explode(F.array(F.col(category), F.lit("ALL"))))
    pct = lambda c, n: 100.0 * F.sum(c) / F.sum(F.least(F.lit(n), F.col("members")))
    out = g.groupBy(model, category).agg(
        F.count(F.lit(1)).alias("pools"), F.avg("first_gap").alias("first_gap"), F.avg("neutral_gap").alias("neutral_gap"), F.avg("pipe_gap").alias("pipe_gap"), F.avg("second_gap").alias("second_gap"),
        pct("marked_first", s).alias("first_pct"), pct("marked_retrieved", k).alias("neutral_pct"), pct("marked_kept", s).alias("pipe_pct"), pct("marked_alone", s).alias("alone_pct"),
    )
    below = {f"{x}_below_{y}": F.col(f"pipe_{x}") < F.col(f"{y}_{x}") for x in ("gap", "pct") for y in ("first", "neutral")}
    return out.withColumns(below | {"gap_minus_neutral": F.col("pipe_gap") - F.col("neutral_gap")})
