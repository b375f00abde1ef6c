"""Ranks, cut-offs and shortlists. Every order has an explicit last key, so ties never depend on input order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from .blocks import hashed
from .prefix import ranks


SALTS = 64


def average_rank_desc(score: str, *by: str) -> Column:
    """1 is best; tied scores share their mean rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2.0


def ordinal_rank(score: str, tb: str, *by: str) -> Column:
    """1 to n, each once: by score, then the smaller tie-break."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tb))


def target_ranks(pool: DataFrame, targets: DataFrame, score: str = "score", tb: str = "tb", by: str = "pool") -> DataFrame:
    """``pool, rank, members`` for each pool's target, whose row of ``targets`` (one a pool) holds its pool, score and tie-break.

    The rank is one more than the number of members ahead of it, so no pool is sorted: members ahead are counted before the shuffle of the counts,
    and both sides meet by pool and a salt, so a pool with a third of the members lies in many tasks. A null score is behind all others;
    a pool without a target has no row.
    """
    salted = pool.withColumn("salt", F.pmod(F.xxhash64(tb), F.lit(SALTS)))
    t = targets.select(by, F.col(score).alias("of"), F.col(tb).alias("tie"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    above = F.col(score).isNotNull() & (F.col("of").isNull() | (F.col(score) > F.col("of")))
    ahead = above | (F.col(score).eqNullSafe(F.col("of")) & (F.col(tb) < F.col("tie")))
    return salted.join(t, [by, "salt"]).groupBy(by).agg((F.count_if(ahead) + 1).alias("rank"), F.count(F.lit(1)).alias("members"))


def cutoff_ties(pool: DataFrame, depths: list[int], score: str = "score", by: str = "pool") -> DataFrame:
    """By pool and depth k: are the k-th and the next score equal, and how many the average-rank rule would select.

    A pool of at most k members has no tie at the cut-off. Members are counted by score first; of a pool's scores only as many as
    the largest depth needs are ordered, and Spark cuts to those before it shuffles.
    """
    counts = pool.groupBy(by, score).agg(F.count(F.lit(1)).alias("n"))
    top = first_of(counts, max(depths) + 1, [F.desc(score)], by)
    w = Window.partitionBy(by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    places = top.withColumn("last", F.sum("n").over(w)).withColumn("first", F.col("last") - F.col("n") + 1)
    grid = pool.sparkSession.createDataFrame([(k,) for k in depths], "k int")
    g = places.crossJoin(F.broadcast(grid)).groupBy(by, "k").agg(
        F.max((F.col("first") <= F.col("k")) & (F.col("last") > F.col("k"))).alias("tie"),
        F.sum(F.when((F.col("first") + F.col("last")) / 2.0 <= F.col("k"), F.col("n")).otherwise(0)).alias("by_average_rank"),
    )
    return g.select(by, "k", "tie", "by_average_rank")


def two_stage(pool: DataFrame, retrieve: list[int], keep: list[int], by: str = "pool", first: str = "first_score", second: str = "score", tb: str = "tb") -> DataFrame:
    """Retrieve the best by the first score, re-rank them by the second, keep the best: for a grid of both depths.

    Returns ``by, K, S, kept, marked`` (how many of those kept are marked) and the same for the second score alone. Each
    order is cut to the largest depth before it is shuffled, so the size of a pool does not matter.
    """
    spark = pool.sparkSession
    grid = spark.createDataFrame([(k, s) for k in retrieve for s in keep if s <= k], "K int, S int")
    best = lambda order, n, name: pool.withColumn(name, ordinal_rank(order, tb, by)).filter(F.col(name) <= n)
    inside = best(first, max(retrieve), "r1").crossJoin(F.broadcast(grid.select("K").distinct())).filter(F.col("r1") <= F.col("K")).withColumn("r2", ordinal_rank(second, tb, by, "K"))
    both = inside.join(F.broadcast(grid), "K").groupBy(by, "K", "S").agg(F.count_if(F.col("r2") <= F.col("S")).alias("kept"), F.count_if((F.col("r2") <= F.col("S")) & F.col("marked")).alias("marked"))
    alone = best(second, max(keep), "alone").crossJoin(F.broadcast(grid.select("S").distinct())).groupBy(by, "S").agg(F.count_if((F.col("alone") <= F.col("S")) & F.col("marked")).alias("marked_alone"))
    return both.join(alone, [by, "S"])


def two_block_rank(pool: DataFrame, k: int, by: str = "pool", first: str = "first_score", second: str = "score", tb: str = "tb", member: str = "member") -> DataFrame:
    """Final place of every member: retrieved ones by the second score, the rest behind by the first.

    All members are ranked by ``prefix.ranks``, so a pool may lie in many tasks; a window only orders the k retrieved ones of a pool.
    """
    r = ranks(pool, [by], first, [tb, member]).drop("avg_rank").withColumnRenamed("rank", "r1")
    inside = r.filter(F.col("r1") <= k).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(second), tb)).cast("long"))
    rest = r.filter(F.col("r1") > k).withColumn("place", F.col("r1"))
    return inside.withColumn("retrieved", F.lit(True)).unionByName(rest.withColumn("retrieved", F.lit(False)))


def simulate(pool: DataFrame, draws: int, k: int, s: int, seed: str, by: str = "pool", most: int = 4096) -> DataFrame:
    """Two stages with tie-breaks drawn anew: mean number of marked members kept, over draws, and rank gaps.

    A pool of at most ``most`` members is ranked in one task, all its draws by array sorts, and returns three numbers; only a larger
    one is spread as rows of member and draw. Both take the same draws. ``first_score, score, member, marked`` as in ``two_stage``.
    """
    sized = pool.join(pool.groupBy(by).agg(F.count(F.lit(1)).alias("__n")), by)
    small = sized.filter(F.col("__n") <= most).select(by, "member", "first_score", "score", "marked")
    kind = pool.schema[by].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("member")
        first, second = (t.column(c).to_numpy().astype(float) for c in ("first_score", "score"))
        marked = t.column("marked").to_numpy(zero_copy_only=False).astype(bool)
        n, kept, got, gaps = len(marked), 0.0, 0.0, []
        x, y = (np.unique(-v, return_inverse=True)[1].astype(np.int64) << 48 for v in (first, second))
        for b in range(0, draws, 50):
            tb = hashed(seed, range(b, min(draws, b + 50)), t.column("member").to_pylist())
            order = np.argsort(x | tb, axis=1, kind="stable")
            places = np.empty_like(order)
            np.put_along_axis(places, order, np.broadcast_to(np.arange(1, n + 1), order.shape), 1)
            inside = order[:, :k]
            again = np.argsort(y[inside] | np.take_along_axis(tb, inside, 1), axis=1, kind="stable")[:, :s]
            kept += marked[np.take_along_axis(inside, again, 1)].sum()
            got += marked[inside].sum()
            if 0 < marked.sum() < n:
                gaps.append(places[:, ~marked].mean(1) - places[:, marked].mean(1))
        gap = float(np.concatenate(gaps).mean()) if gaps else None
        return pa.table({by: t.column(by).slice(0, 1), "marked": [kept / draws], "retrieved_marked": [got / draws], "gap": pa.array([gap], pa.float64())})

    here = small.groupBy(by).applyInArrow(run, f"`{by}` {kind}, marked double, retrieved_marked double, gap double")
    return here.unionByName(_simulated_rows(sized.filter(F.col("__n") > most), draws, k, s, seed, by))


def _simulated_rows(pool: DataFrame, draws: int, k: int, s: int, seed: str, by: str) -> DataFrame:
    """Rows of member and draw, dealt by pool and draw: a pool's draws lie in as many tasks, which sort and spill."""
    few = pool.select(by, "member", "first_score", "score", "marked")
    d = few.crossJoin(F.broadcast(pool.sparkSession.range(draws).select(F.col("id").alias("b")))).withColumn("t", hash_int(seed, F.col("b"), F.col("member")))
    # said outright: rows dealt by pool alone would do for the windows below, and bring all draws of a pool into one task
    d = d.repartition(max(draws, int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by, "b")
    w = lambda *p: Window.partitionBy(by, "b", *p)
    d = d.withColumn("r1", F.row_number().over(w().orderBy(F.desc("first_score"), "t", "member"))).withColumn("in", F.col("r1") <= k)
    d = d.withColumn("r2", F.row_number().over(w("in").orderBy(F.desc("score"), "t", "member"))).withColumn("kept", F.col("in") & (F.col("r2") <= s))
    each = d.groupBy(by, "b").agg(
        F.count_if(F.col("kept") & F.col("marked")).alias("marked"), F.count_if(F.col("in") & F.col("marked")).alias("retrieved_marked"),
        (F.avg(F.when(~F.col("marked"), F.col("r1"))) - F.avg(F.when(F.col("marked"), F.col("r1")))).alias("gap"),
    )
    return each.groupBy(by).agg(F.avg("marked").alias("marked"), F.avg("retrieved_marked").alias("retrieved_marked"), F.avg("gap").alias("gap"))


def counterfactual_flips(pool: DataFrame, forms: Column, depths: list[int], by: str = "pool", member: str = "member", score: str = "score", tb: str = "tb") -> DataFrame:
    """Would a member's place among the best k change with its other form's score?

    ``forms`` is the counterfactual score. rank' = 1 + the number of others ahead of it: one running count of the
    real rows over real and counterfactual rows in one order of score and tie-break, less the member's own row.
    A member is in its pool once; scores and tie-breaks are not null. A pool is ordered in one task: ``shortlist_flips`` takes larger ones.
    """
    p = pool.withColumn("other", forms).withColumn("rank", ordinal_rank(score, tb, by))
    kinds = F.array(F.struct(F.lit(0).alias("real"), F.col("other").cast("double").alias("at")), F.struct(F.lit(1).alias("real"), F.col(score).cast("double").alias("at")))
    both = p.select(by, tb, "rank", (F.col(score) > F.col("other")).cast("int").alias("own"), F.inline(kinds))
    w = Window.partitionBy(by).orderBy(F.desc("at"), tb, "real").rowsBetween(Window.unboundedPreceding, 0)  # of equal ones the counterfactual comes first
    r = both.withColumn("ahead", F.sum("real").over(w)).filter("real = 0").select("rank", (1 + F.col("ahead") - F.col("own")).cast("int").alias("other_rank"))
    grid = pool.sparkSession.createDataFrame([(k,) for k in depths], "k int")
    x = r.crossJoin(F.broadcast(grid))
    a, b = F.col("rank") <= F.col("k"), F.col("other_rank") <= F.col("k")
    return x.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a != b).alias("flips"), F.count_if(a & ~b).alias("only_original"), F.count_if(b & ~a).alias("only_other"),
        (F.count_if(a & ~b) - F.count_if(b & ~a)).alias("net"), F.count_if(a & b).alias("both_in"), F.count_if(~a & ~b).alias("both_out"),
    )


def shortlist_flips(pool: DataFrame, forms: Column, depths: list[int], by: str = "pool", member: str = "member", score: str = "score", tb: str = "tb") -> DataFrame:
    """As ``counterfactual_flips``, for short lists of pools of any size.

    ``forms`` is the counterfactual score. Whether a member is among the best k is decided by the k others ahead of it, so a pool
    is cut to its best ones, one more than the largest depth, before anything is shuffled, and every member is held against
    that short list, which goes out ``SALTS`` times so that a large pool's members are dealt to as many tasks. A member is in its pool once; scores and tie-breaks are not null.
    """
    most = max(depths)
    entry = F.struct((-F.col(score).cast("double")).alias("s"), F.col(tb).alias("t"), F.col(member).alias("m"))
    best = first_of(pool, most + 1, [F.desc(score), F.col(tb)], by).groupBy(by).agg(F.sort_array(F.collect_list(entry)).alias("best"))
    best = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = pool.select(by, member, F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int").alias("__salt"), F.struct((-F.col(score).cast("double")).alias("s"), F.col(tb).alias("t")).alias("real"), F.struct((-forms.cast("double")).alias("s"), F.col(tb).alias("t")).alias("other")).join(best, [by, "__salt"])
    ahead = lambda x: F.size(F.filter("best", lambda e: (e["m"] != F.col(member)) & ((e["s"] < x["s"]) | ((e["s"] == x["s"]) & (e["t"] < x["t"])))))
    r = p.select(ahead(F.col("real")).alias("a"), ahead(F.col("other")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    grid = pool.sparkSession.createDataFrame([(k,) for k in depths], "k int")
    x = r.crossJoin(F.broadcast(grid))
    a, b = F.col("a") < F.col("k"), F.col("b") < F.col("k")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return x.groupBy("k").agg(
        F.sum("n").alias("n"), count(a != b).alias("flips"), count(a & ~b).alias("only_original"), count(b & ~a).alias("only_other"),
        (count(a & ~b) - count(b & ~a)).alias("net"), count(a & b).alias("both_in"), count(~a & ~b).alias("both_out"),
    )


def rank_metrics(rows: DataFrame, by: str = "pool", score: str = "score", relevant: str = "marked", order: str = "member", k: int = 10) -> DataFrame:
    """By set: top-1 shared among tied leaders, reciprocal average rank of the best relevant one, nDCG at k."""
    w = Window.partitionBy(by)
    r = rows.withColumn("ar", average_rank_desc(score, by)).withColumn("i", F.row_number().over(w.orderBy("ar", order)))
    rel = F.col(relevant)
    r = r.withColumn("best", F.min("ar").over(w))
    g = r.groupBy(by).agg(
        (F.count_if(rel & (F.col("ar") == F.col("best"))) / F.count_if(F.col("ar") == F.col("best"))).alias("top1"),
        F.coalesce(F.max(F.when(rel, 1.0 / F.col("ar"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(rel & (F.col("i") <= k), 1.0 / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count_if(rel).alias("n_rel"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), F.col("n_rel")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return g.select(by, "top1", "mrr", F.when(F.col("n_rel") == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"))


def first_of(df: DataFrame, n: int, order: list[Column], *by: str) -> DataFrame:
    """The first n rows of each group in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def insertion_order_shortlists(pool: DataFrame, order: str, retrieve: int, depths: list[int], by: str = "pool", first: str = "first_score", second: str = "score", marked: str = "marked") -> DataFrame:
    """A diagnostic: what shortlists hold when ties go to whoever was inserted first, re-ranking a retrieved list and all members.

    In the re-ranking of a retrieved list its own order breaks ties.
    """
    w = Window.partitionBy(by)
    r = pool.withColumn("got", F.row_number().over(w.orderBy(F.desc(first), order))).withColumn("alone", F.row_number().over(w.orderBy(F.desc(second), order)))
    r = r.withColumn("kept", F.row_number().over(w.orderBy(F.col("got") > retrieve, F.desc(second), "got")))
    top = [x for k in depths for x in (F.count_if((F.col("kept") <= k) & (F.col("got") <= retrieve) & F.col(marked)).alias(f"pipe_top{k}"), F.count_if((F.col("alone") <= k) & F.col(marked)).alias(f"alone_top{k}"))]
    return r.groupBy(by).agg(*top)
