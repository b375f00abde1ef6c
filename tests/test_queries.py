"""Every query with SQL gives the rows of that SQL on the small tables; entry and registries are whole."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pairlens import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{v + 0.0:.8g}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None))
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(plans.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_package():
    root = os.path.dirname(entry.__file__)
    for d, _, files in os.walk(os.path.join(root, "pairlens")):
        if "/llm" not in d:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(d, f)).read()
