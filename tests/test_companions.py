"""Lookups and banks that fail loudly, spans with ties, replays against plain lists."""

import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import companions, embedding, joins, resimulate

from .test_resimulation import tie


def test_labels_and_banks(spark):
    df = spark.createDataFrame([("a",), ("b",)], "model string")
    assert {r["label"] for r in companions.labelled(df, "model", {"a": "A", "b": "B"}).collect()} == {"A", "B"}
    for wrong in ({"a": "A"}, {}):
        with pytest.raises(Exception, match="no label for"):
            companions.labelled(df, "model", wrong).collect()
    bank = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "model string, first double")
    assert joins.banked(df, {"first": bank.limit(1)}, ["model"]).filter("first is null").count() == 1
    with pytest.raises(Exception, match="first is there more than once for a"):
        joins.banked(df, {"first": bank}, ["model"]).collect()


def test_span_and_cross(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), ("d", 2.0)], "m string, v double")
    assert tuple(companions.span(df, "m", "v").collect()[0]) == (4, 1.0, "a", 2.0, "c")
    rnd = random.Random(1)
    l, r = ([(rnd.choice("xyz"), rnd.randint(0, 5)) for _ in range(n)] for n in (40, 30))
    got = {x["g"]: (x["pairs"], x["half"]) for x in joins.cross_half_wins(*(spark.createDataFrame(t, "g string, v int") for t in (l, [x for x in r if x[0] != "z"])), ["g"], "v").collect()}
    want = {}
    for g in "xy":
        pairs = [(a, b) for h, a in l if h == g for k, b in r if k == g]
        want[g] = (len(pairs), sum(2 if a > b else 1 if a == b else 0 for a, b in pairs))
    assert got == want


def test_replay(spark):
    rnd = random.Random(7)
    rows = [(f"p{i}", n, *(float(rnd.randint(0, 3)) for _ in range(6))) for i in range(8) for n in range(4)]
    names = ["first_m", "first_f", "second_m", "second_f", "live_m", "live_f"]
    df = spark.createDataFrame(rows, "pool string, name int, " + ", ".join(f"{n} double" for n in names))
    got = {r["pool"]: r for r in resimulate.replayed(resimulate.stacked(df, ["pool"], "name", {n: F.col(n) for n in names}), "pool", 15, 4, 2, "t").collect()}
    for i in range(8):
        docs = [d for p, n, fm, ff, sm, sf, lm, lf in rows if p == f"p{i}" for d in ((fm, sm, lm, True), (ff, sf, lf, False))]
        kept, same = [0, 0], 0
        for r in range(15):
            t = [tie("t", f"p{i}", r, j) for j in range(8)]
            inside = sorted(range(8), key=lambda j: (-docs[j][0], t[j]))[:4]
            lists = [set(sorted(inside, key=lambda j: (-docs[j][1 + w], t[j]))[:2]) for w in (0, 1)]
            same += lists[0] == lists[1]
            for w in (0, 1):
                kept[w] += sum(docs[j][3] for j in lists[w])
        g = got[f"p{i}"]
        assert (g["kept_replay"], g["kept_live"], g["identical"]) == pytest.approx((kept[0] / 15, kept[1] / 15, same / 15))


def test_vectors_in_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", "c", None]), [rnd.random() for _ in range(5)]) for i in range(50)] + [(50, "a", None), (51, "zz", [1.0] * 5), (52, "a", [1.0])]
    df = spark.createDataFrame(rows, "k long, label string, v array<double>")
    q = df.filter("k < 50 and label is not null").groupBy("label").agg(F.min_by("v", "k").alias("v"))
    queries = {r["label"]: r["v"] for r in q.collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    for block in (2, 100):
        got = {r["k"]: (r["own_score"], r["best_score"], r["queries"]) for r in embedding.scored_against(df, q, "k", "label", block=block).collect()}
        for k, label, v in rows:
            good = v is not None and len(v) == 5
            own = dot(v, queries[label]) if good and label in queries else None
            best = max(dot(v, x) for x in queries.values()) if good else None
            assert got[k] == (pytest.approx(own) if own is not None else None, pytest.approx(best) if best is not None else None, 3)
    assert embedding.scored_against(df, q.limit(0), "k", "label").filter("best_score is not null").isEmpty()
