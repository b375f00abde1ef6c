"""Exact tests against every sign pattern and plain integrals; names of a table against one alternation; JSON of two layouts."""

import gzip
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import dictionary, exact
from pairlens.sources import layouts

from .test_queries import SF


def test_tails():
    # I_x(a, b) by a fine sum over a substitution that has no poles for a, b >= 1/2
    for x, a, b in [(0.3, 0.5, 0.5), (0.9, 2.5, 7.0), (0.01, 30.0, 2.0), (0.5, 0.5, 40.0), (0.999, 1.0, 1.0)]:
        t = (np.arange(400_000) + 0.5) / 400_000 * math.asin(math.sqrt(x))
        v = 2 * (np.sin(t) ** (2 * a - 1) * np.cos(t) ** (2 * b - 1)).sum() * math.asin(math.sqrt(x)) / 400_000
        want = v * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        assert exact.beta_tail(x, a, b) == pytest.approx(want, rel=1e-5)
    # textbook values: t(0.975; 10) = 2.228139, F(0.95; 3, 20) = 3.098391, F(0.99; 1, 8) = 11.258624
    for f, d1, d2, p in [(2.228138852**2, 1, 10, 0.05), (3.098391224, 3, 20, 0.05), (11.25862414, 1, 8, 0.01)]:
        assert exact.beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) == pytest.approx(p, rel=1e-6)


def test_tail_columns(spark):
    df = spark.createDataFrame([(2.228138852, 10.0), (0.0, 4.0), (None, 3.0), (3.0, 0.0)], "t double, n double")
    got = [r[0] for r in df.select(exact.t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert got[:2] == pytest.approx([0.05, 1.0]) and got[2:] == [None, None]


@pytest.mark.parametrize("seed", range(6))
def test_signed_ranks(spark, seed):
    rnd = random.Random(seed)
    groups = {g: [rnd.choice([-3, -2, -1, 0, 1, 2, 3, 5]) for _ in range(rnd.randint(0, 12))] for g in range(4)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g int, d double")
    got = {r["g"]: r for r in exact.wilcoxon_exact(df, "d", "g").collect()}
    for g, v in groups.items():
        v = [x for x in v if x]
        if not v:
            assert g not in got
            continue
        rank = [sum(abs(y) < abs(x) for y in v) + (sum(abs(y) == abs(x) for y in v) + 1) / 2 for x in v]
        w = sum(r for r, x in zip(rank, v, strict=True) if x > 0)
        low = min(w, sum(rank) - w)
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(v))]
        p = min(1.0, 2 * sum(s <= low + 1e-9 for s in sums) / len(sums))
        assert (got[g]["n"], got[g]["w_plus"]) == (len(v), w) and got[g]["p"] == pytest.approx(p)
    assert all(r["p"] is None for r in exact.wilcoxon_exact(df, "d", "g", most=0).collect())


def test_least_squares(spark):
    rnd = np.random.default_rng(5)
    x, z = rnd.normal(size=60) + 1e6, rnd.normal(size=60)
    y = 3 + 0.5 * (x - 1e6) - 2 * z + rnd.normal(size=60)
    rows = [("a", float(i), float(j), float(k)) for i, j, k in zip(x, z, y, strict=True)] + [("b", 1.0, 2.0, 3.0), ("b", 1.0, 2.5, 4.0), ("a", None, 1.0, 1.0), ("c", 2.0, 4.0, 1.0), ("c", 3.0, 6.0, 2.0), ("c", 4.0, 8.0, 2.0), ("c", 5.0, 10.0, 4.0)]
    got = {r["g"]: r for r in exact.least_squares(spark.createDataFrame(rows, "g string, x double, z double, y double"), "y", ["x", "z"], "g").collect()}
    design = np.column_stack([np.ones(60), x - 1e6, z])
    beta, left, *_ = np.linalg.lstsq(design, y, rcond=None)
    cov = left[0] / 57 * np.linalg.inv(design.T @ design)
    a = got["a"]
    assert a["n"] == 60 and a["coefficients"][1:] == pytest.approx(beta[1:], rel=1e-6) and a["errors"][1:] == pytest.approx(np.sqrt(np.diag(cov))[1:], rel=1e-6)
    tss = ((y - y.mean()) ** 2).sum()
    assert a["r2"] == pytest.approx(1 - left[0] / tss) and a["f"] == pytest.approx((tss - left[0]) / 2 / (left[0] / 57))
    assert 0 <= a["p_f"] < 1e-6 and all(0 <= p <= 1 for p in a["p"])
    assert got["b"]["coefficients"] is None and got["c"]["coefficients"] is None  # too few rows, dependent columns
    d = exact.cohens_d(spark.createDataFrame([(float(v),) for v in y], "y double"), "y").collect()[0]
    size = y.mean() / y.std(ddof=1)
    se = math.sqrt(1 / 60 + size**2 / 120)
    assert (d["d"], d["d_low"], d["d_high"], d["t"]) == pytest.approx((size, size - 1.96 * se, size + 1.96 * se, size * math.sqrt(60)))


def test_dictionary_equals_alternation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rnd, names = random.Random(1), set()
    words = [re.findall(r"[A-Za-z]+", t or "") for _, t in texts]
    while len(names) < 1000:
        w = rnd.choice(words)
        if len(w) > 4:
            i = rnd.randrange(len(w) - 3)
            names.add(" ".join(w[i : i + rnd.choice([1, 1, 2, 3])]))
    extra = [(-1, "O'Brien and Anne-Marie met ANNE-MARIE O'Brien-Smith"), (-2, None), (-3, ""), (-4, "ann lee ann lee smith"), (-4, "Ann Lee"), (None, "ann"), (-5, "annlee ann_lee ann  lee")]
    listed = sorted(names) + ["O'Brien", "Anne-Marie", "Ann Lee", "ann", "Lee Smith", "'x", "", None]
    pattern = re.compile(r"\b(" + "|".join(re.escape(n) for n in sorted((n for n in listed if n and n != "'x"), key=lambda n: -len(n))) + r")\b", re.IGNORECASE)
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = dictionary.found_names(df, spark.createDataFrame([(n,) for n in listed], "name string"))
    want = sorted(((i, sorted(set(pattern.findall(t or "")), key=lambda n: (-len(n), n))) for i, t in texts + extra), key=str)
    assert sorted(((r["doc_id"], r["names"]) for r in got.collect()), key=str) == want
    none = dictionary.found_names(df, spark.createDataFrame([], "name string"))
    assert none.count() == df.count() and none.filter("size(names) > 0").isEmpty()


def test_names_meet_texts_without_a_shuffle_of_words(spark):
    long = "Ann met the old Lee Smith and " * 20_000  # a row of all parts for each word would be some 50 GB
    df = spark.createDataFrame([(1, long), (2, "ann ANN lee"), (3, "nobody"), (4, "Lee Smith ann")], "doc_id long, text string")
    want = {"ann lee": {1: ["Ann", "Lee"], 2: ["ANN", "ann", "lee"], 3: [], 4: ["Lee", "ann"]}, "ann/lee smith": {1: ["Lee Smith", "Ann"], 2: ["ANN", "ann"], 3: [], 4: ["Lee Smith", "ann"]}}
    for listed, by_doc in want.items():
        names = spark.createDataFrame([(n,) for n in listed.split("/" if "/" in listed else " ")], "name string")
        texts = df if "/" not in listed else df.filter("doc_id > 1").unionByName(spark.createDataFrame([(1, long[:3000])], df.schema))
        for most in (200_000, 0):
            got = dictionary.found_names(texts, names, most_shipped=most)
            assert {r["doc_id"]: r["names"] for r in got.collect()} == by_doc
            plan = got._jdf.queryExecution().sparkPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (most > 0)


def test_layouts(spark, tmp_path):
    old = {"pool_membership_sha256": "h1", "models": {"m/a": {"rows": [{"pool_id": "p1", "focal_index": 0, "score_male": 0.5, "score_female": 0.25}]}, "m/b": {"rows": []}}}
    new = {"provenance": {"pools": "h2"}, "model": "c", "comparisons": [{"pool": "p2", "index": 3, "scores": [1, 2]}, {"pool": "p3", "focal": 1, "scores": {"male": 3, "female": 4}, "extra": None}]}
    with gzip.open(tmp_path / "old.json.gz", "wt") as f:
        json.dump(old, f)
    (tmp_path / "new.json").write_text(json.dumps(new, indent=1))
    rows = layouts.documents(spark, f"{tmp_path}/old.json.gz", f"{tmp_path}/new.json")
    got = sorted(tuple(r)[1:] for r in layouts.scored_rows(rows).collect())
    assert got == [("h1", "m/a", "p1", 0, 0.5, 0.25), ("h2", "c", "p2", 3, 1.0, 2.0), ("h2", "c", "p3", 1, 3.0, 4.0)]
    runs = {"s1.json": {"provenance": {"sampling": {"pool_membership_sha256": "h1"}}, "models": {"m/a": {"rows_file": "results/old.json.gz"}}}, "s2.json": {"pool_membership_sha256": "h2", "models": [{"model": "c", "rows": "x/new.json"}]}}
    bad = {"pools.json": {"pool_membership_sha256": "other", "models": {"c": {"rows_file": "new.json"}}}, "gone.json": {"pool_membership_sha256": "h2", "models": {"c": {"rows_file": "no.json"}}}, "path.json": {"models": {"c": {"rows_file": "new.json"}}}}
    for name, d in {**runs, **bad}.items():
        (tmp_path / name).write_text(json.dumps(d))
    good = layouts.run(layouts.documents(spark, *(f"{tmp_path}/{n}" for n in runs)), rows)
    assert sorted((r["model"], r["pool_id"], r["score_male"]) for r in good.collect()) == [("c", "p2", 1.0), ("c", "p3", 3.0), ("m/a", "p1", 0.5)]
    for name, said in (("pools.json", "different pools"), ("gone.json", "no rows"), ("path.json", "unresolved path")):
        with pytest.raises(Exception, match=said):
            layouts.run(layouts.documents(spark, f"{tmp_path}/{name}"), rows).collect()
    (tmp_path / "odd.json").write_text(json.dumps({"model": "c", "rows": [{"pool_id": "p"}]}))
    with pytest.raises(Exception, match="odd.json"):
        layouts.scored_rows(layouts.documents(spark, f"{tmp_path}/odd.json")).collect()
    (tmp_path / "cond.json").write_text(json.dumps({"config": {"cut_words": 100, "owner_line": True}, "canary_limit_pools": None}))
    c = layouts.documents(spark, f"{tmp_path}/cond.json")
    assert layouts.condition(c, config__cut_words=100, config__owner_line=True, canary_limit_pools=None, config__female_first=False).count() == 1
    for wrong in ({"config__cut_words": 50}, {"config__owner_line": False}, {"config__missing": "x"}):
        with pytest.raises(Exception, match="not the condition"):
            layouts.condition(c, **wrong).collect()


def test_large_groups_list_no_ranks(spark):
    df = spark.createDataFrame([(g, float(i)) for g, n in ((1, 6), (2, 7), (3, 400)) for i in range(1, n + 1)], "g int, d double")
    got = {r["g"]: (r["n"], r["w_plus"], r["p"]) for r in exact.wilcoxon_exact(df, "d", "g", most=6).collect()}
    assert got == {1: (6, 21.0, 2 / 64), 2: (7, 28.0, None), 3: (400, 80200.0, None)}
    plan = exact.wilcoxon_exact(df, "d", "g", most=6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("collect_list") :].index("LeftSemi") > 0  # the size is known before a list is made
