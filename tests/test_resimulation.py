"""Re-simulation and draws in blocks against plain loops and against the row-by-row plans."""

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import blocks, ranking, resample, resimulate, tests
from pairlens.plans import QUERIES

from .test_queries import SF


def tie(seed, pool, r, j):
    return int(md5(f"{seed}|{pool}|{r}|{j}".encode()).hexdigest()[:12], 16)


def plain_kept(docs, pool, repeats, k, s, places=None):
    """docs: (first, second, marked) or None, in slots; mean marked kept."""
    total = 0
    places = places or list(range(len(docs)))
    for r in range(repeats):
        have = [(d, tie("t", pool, r, j)) for j, d in zip(places, docs, strict=True) if d]
        inside = sorted(have, key=lambda x: (-x[0][0], x[1]))[:k]
        total += sum(d[2] for d, _ in sorted(inside, key=lambda x: (-x[0][1], x[1]))[:s])
    return total / repeats


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(12):
        for name in range(5):
            if rnd.random() < 0.9:
                rows.append((f"p{i}", f"c{i % 4}", "ab"[i % 2], name, *(float(rnd.randint(0, 3)) for _ in range(4))))
    df = spark.createDataFrame(rows, "pool string, cluster string, category string, name int, fm double, ff double, sm double, sf double")
    cols = {"first_m": F.col("fm"), "first_f": F.col("ff"), "second_m": F.col("sm"), "second_f": F.col("sf")}
    slots = {}
    for p, c, g, n, fm, ff, sm, sf in rows:
        slots.setdefault((p, c, g), [None] * 10)[2 * n : 2 * n + 2] = [(fm, sm, True), (ff, sf, False)]
    return resimulate.stacked(df, ["pool", "cluster", "category"], "name", cols), slots


def test_leave_one_out(made):
    pools, slots = made
    got = {(r["category"], r["pair"]): r["pct_marked"] for r in resimulate.leave_one_pair_out(pools, "pool", "category", 30, 4, 2, "t").collect()}
    for g in "ab":
        for j in (None, *range(5)):
            keep = [x for x in range(10) if j is None or x // 2 != j]
            mine = {p: d for p, d in slots.items() if p[2] == g}
            kept = sum(plain_kept([d[x] for x in keep], p[0], 30, 4, 2, keep) for p, d in mine.items())
            assert got[g, None if j is None else str(j)] == pytest.approx(100 * kept / (2 * len(mine)))
    assert len(got) == 12


def test_joint_bootstrap(made):
    pools, slots = made
    sums = resimulate.pair_bootstrap(pools, "pool", "cluster", 40, 10, 4, 2, "t")
    got = {(r["cluster"], r["b"]): (r["kept"], r["room"]) for r in sums.collect()}
    assert len(got) == 4 * 41
    draws = [list(range(5))] + [[int(md5(f"t-pairs|{b}|{j}".encode()).hexdigest()[:12], 16) % 5 for j in range(5)] for b in range(40)]
    kept, room = np.zeros((41, 4)), np.zeros((41, 4))
    for b, pairs in enumerate(draws):
        for (p, c, _), d in slots.items():
            docs = [d[2 * j + x] for j in pairs for x in (0, 1)]
            kept[b, int(c[1])] += plain_kept(docs, p, 10, 4, 2)
            room[b, int(c[1])] += min(2, sum(x is not None for x in docs))
    for (c, b), v in got.items():
        assert v == pytest.approx((kept[b + 1, int(c[1])], room[b + 1, int(c[1])]))
    said = {(r["category"], r["scheme"]): r for r in resimulate.joint_intervals(sums.join(pools.select("cluster", "category").distinct(), "cluster"), "cluster", "category", 40, "t").collect()}
    for g, keys in (("a", [0, 2]), ("b", [1, 3]), ("ALL", [0, 1, 2, 3])):
        w = np.zeros((40, 4))
        for b in range(40):
            for j in range(len(keys)):
                w[b, keys[int(md5(f"t-clusters|{g}|{b}|{j}".encode()).hexdigest()[:12], 16) % len(keys)]] += 1
        want = {"names": 100 * kept[1:, keys].sum(1) / room[1:, keys].sum(1), "clusters": 100 * (w @ kept[0]) / (w @ room[0]), "both": 100 * (w * kept[1:]).sum(1) / (w * room[1:]).sum(1)}
        for scheme, v in want.items():
            r = said[g, scheme]
            assert (r["low"], r["high"], r["sd"]) == pytest.approx((*np.quantile(v, [0.025, 0.975]), np.std(v, ddof=1)))
            assert r["point"] == pytest.approx(100 * kept[0, keys].sum() / room[0, keys].sum())


def test_pairs_twice_and_none(spark):
    cols = {c: F.col("x") for c in ("first_m", "first_f", "second_m", "second_f")}
    df = spark.createDataFrame([("p", 1, 1.0), ("p", 1, 2.0)], "pool string, name int, x double")
    with pytest.raises(Exception, match="twice"):
        resimulate.stacked(df, ["pool"], "name", cols).collect()
    none = resimulate.stacked(df.limit(0), ["pool"], "name", cols)
    assert resimulate.simulate(none, "pool", 3, 2, 1, "t").count() == 0


def test_small_and_large_pools_alike(spark):
    p = QUERIES["w1_w2_ranks"](spark, SF).select("pool", "member")
    pool = p.withColumn("first_score", F.col("member") % 5 / 4.0).withColumn("score", F.col("member") % 3 / 2.0).withColumn("marked", F.col("member") % 2 == 0)
    one, two = ({r["pool"]: tuple(r)[1:] for r in ranking.simulate(pool, 30, 4, 2, "x", most=m).collect()} for m in (4096, 0))
    assert set(one) == set(two)
    for k, v in one.items():
        assert v == pytest.approx(two[k])


def test_blocks_equal_rows(spark):
    rnd = random.Random(4)
    rows = [(m, c, "ab"[int(c[1:]) % 2], n, rnd.randint(0, 20), 10 + rnd.randint(0, 5), rnd.random()) for m in "xy" for c in (f"c{i}" for i in range(7)) for n in range(3)]
    cells = spark.createDataFrame(rows, "model string, cluster string, category string, name int, half long, n long, z double")
    sums = cells.groupBy("model", "cluster", "category").agg(F.sum("half").alias("half"), F.sum("n").alias("n"), F.sum("z").alias("z"))

    def alike(a, b):
        a, b = ({r["model"]: r.asDict() for r in x.collect()} for x in (a, b))
        assert set(a) == set(b)
        for k in a:
            assert {c: a[k][c] for c in b[k]} == pytest.approx(b[k])

    for size in (7, 1000):
        alike(blocks.intervals(blocks.contrast_draws(sums, "cluster", 100, "s", block=size)), resample.interval(resample.draw_contrasts(sums, "cluster", 100, "s"), "value", "model"))
        alike(blocks.intervals(blocks.contrast_draws(cells, "cluster", 100, "s", "name", size)), resample.interval(resample.two_way_contrasts(cells, "cluster", "name", 100, "s"), "value", "model"))
        alike(blocks.label_permutation(sums, "cluster", 100, "s", size), tests.label_permutation(sums, "cluster", 100, "s"))
        alike(blocks.spearman_permutation(sums, "half", "z", "cluster", 100, "s", block=size), tests.spearman_permutation(sums, "half", "z", "cluster", 100, "s"))
        level = resample.ratio_bootstrap(sums, "half", "n", "cluster", 100, "s", "model", scale=50.0)
        alike(blocks.intervals(blocks.level_draws(sums, "cluster", 100, "s", block=size)), level.select("model", "low", "high", "sd", "pct_positive"))
    with pytest.raises(ValueError):
        blocks.collected(spark.range(blocks.MOST_CELLS + 1), "id")


def test_the_draws_of_a_large_pool_lie_in_many_tasks(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("pool"), F.col("id").alias("member"), (F.col("id") % 5 / 4.0).alias("first_score"), (F.col("id") % 7 / 6.0).alias("score"), (F.col("id") % 2 == 0).alias("marked"))
    few, rows = ranking.simulate(df, 12, 10, 3, "t"), ranking.simulate(df, 12, 10, 3, "t", most=10)
    assert sorted(map(str, few.collect())) == sorted(map(str, rows.collect()))
    plan = ranking._simulated_rows(df.join(df.groupBy("pool").agg(F.count(F.lit(1)).alias("__n")), "pool"), 12, 10, 3, "t", "pool")._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(pool" in x and "b#" in x and "REPARTITION_BY_NUM" in x for x in plan.splitlines())
