"""Ranks, running sums and neighbours over many ranges equal those of one window, and a hot group is split."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.operators import prefix, ranking


@pytest.fixture
def split(spark):
    """Ranges stay apart however small they are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def table(spark, n=4000, values=7):
    rnd = random.Random(values)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None, "c"]), None if rnd.random() < 0.02 else rnd.randrange(values), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v int, i long").repartition(5)


@pytest.mark.parametrize("values", [1, 7, 100_000])
@pytest.mark.parametrize("down", [True, False])
def test_ranks(split, values, down):
    df = table(split, values=values)
    w = Window.partitionBy("g").orderBy(F.desc("v") if down else F.asc("v"))
    want = df.select("g", "v", "i", F.row_number().over(w.orderBy(F.desc("v") if down else F.asc("v"), "i")).cast("long"), F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0)
    got = prefix.ranks(df, ["g"], "v", ["i"], down)
    assert Counter(map(tuple, got.select("g", "v", "i", "rank", "avg_rank").collect())) == Counter(map(tuple, want.collect()))


def test_a_hot_group_lies_in_many_ranges(split):
    split.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = table(split, 20_000)
        laid = prefix.ranks(df, ["g"], "v", ["i"])
        held = df.repartitionByRange(F.col("g"), F.desc("v"), F.col("i")).groupBy(F.spark_partition_id().alias("p"), "g").count().collect()
        sizes = Counter()
        for r in held:
            sizes[r["p"]] += r["count"]
        assert len(sizes) == 16 and max(sizes.values()) <= 2 * sorted(sizes.values())[8]
        assert len([r for r in held if r["g"] == "hot"]) >= 5
        assert laid.groupBy("g").agg(F.max("rank").alias("n"), F.count_distinct("rank").alias("d")).filter("n <> d").isEmpty()
    finally:
        split.conf.set("spark.sql.shuffle.partitions", "8")


def test_running_sums(split):
    df = table(split).withColumn("x", (F.col("i") % 11).cast("double"))
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    want = {r["i"]: (r["a"], r["b"]) for r in df.select("i", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("a"), F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("b")).collect()}
    got = {r["i"]: (r["a"], r["b"]) for r in prefix.running(df, ["g"], ["i"], {"a": "v", "b": "x"}).collect()}
    assert got == want
    whole = {r["i"]: r["a"] for r in prefix.running(df, [], ["i"], {"a": "v"}).collect()}
    total = 0
    for r in df.orderBy("i").collect():
        assert whole[r["i"]] == total
        total += r["v"] or 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_nearest(split, by):
    rnd = random.Random(9)
    draw = lambda n: [(rnd.choice("xxxy"), rnd.randrange(500) / 4, i) for i in range(n)]
    left, right = draw(600), [r for r in draw(150) if r[0] == "x"]
    l, r = (split.createDataFrame(t, "g string, v double, k long") for t in (left, right))
    got = {x["k"]: x["n"] for x in prefix.nearest(l, r, "v", "k", "n", *by).collect()}
    for g, v, k in left:
        best = [(abs(v - b), c) for h, b, c in right if not by or g == h]
        assert got[k] == (min(best)[1] if best else None)
    assert len(got) == len(left)


def test_empty_tables(split):
    none = split.createDataFrame([], "g string, v int, i long")
    assert prefix.ranks(none, ["g"], "v", ["i"]).count() == 0 and prefix.running(none, ["g"], ["i"], {"a": "v"}).count() == 0
    assert prefix.nearest(none, none, "v", "i", "n").count() == 0
    one = split.createDataFrame([("a", None, 1)], "g string, v int, i long")
    assert [tuple(r)[3:] for r in prefix.ranks(one, ["g"], "v", ["i"]).collect()] == [(1, 1.0)]
    assert [r["n"] for r in prefix.nearest(one.withColumn("v", F.lit(1)), none, "v", "i", "n").collect()] == [None]


def test_short_lists_are_cut_before_the_shuffle(spark):
    df = table(spark).select(F.col("g").alias("pool"), F.col("i").alias("member"), F.col("v").alias("score"), F.col("v").alias("first_score"), F.col("i").alias("tb"), (F.col("i") % 2 == 0).alias("marked"))
    for got in (ranking.shortlist_flips(df, 7 - F.col("score"), [1, 3]), ranking.two_stage(df, [5], [3]), ranking.cutoff_ties(df, [3])):
        assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_a_group_is_added_from_its_own_first_row(split):
    """SQL's window adds a group's fractions one by one; sums of the groups before leave no rounding in them."""
    rnd = random.Random(3)
    values = [[round(rnd.random() * 100, 2) for _ in range(40)] for _ in range(60)]
    df = split.createDataFrame([(g, i, x) for g, v in enumerate(values) for i, x in enumerate(v)], "g int, i int, x double").repartition(1)
    split.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {(r["g"], r["i"]): r["s"] for r in prefix.running(df, ["g"], ["i"], {"s": "x"}).collect()}
    finally:
        split.conf.set("spark.sql.shuffle.partitions", "8")
    for g, v in enumerate(values):
        total = 0.0
        for i, x in enumerate(v):
            assert got[g, i] == total
            total += x


def test_a_task_holds_a_piece_of_its_range(split, monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"g": [j // 7 for j in range(i, i + 10)], "v": list(range(i, i + 10))}) for i in range(0, 200, 10)]
    cut = list(prefix.pieces(iter(batches), ["g"], 25))
    assert max(t.num_rows for t in cut) < 25 + 10 and [x for t in cut for x in t.column("v").to_pylist()] == list(range(200))
    assert all(a.column("g")[-1] != b.column("g")[0] for a, b in zip(cut[:-1], cut[1:], strict=True))  # small groups stay whole
    assert [t.num_rows for t in prefix.pieces(iter(batches), [], 25)] == [30, 30, 30, 30, 30, 30, 20]
    monkeypatch.setattr(prefix, "PIECE", 50)
    test_running_sums(split)
    test_ranks(split, 7, True)
    test_nearest(split, ["g"])
