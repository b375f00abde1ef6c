"""Licence scan and revisit resolution: literal cases, brute force, and their SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pairlens.llm import licenses, registry, revisits

from .cases import SF, empty, hard


def cosine(text):
    rows, idf, other = licenses.weights()
    tf = Counter(re.findall("[a-z0-9]+", text.lower()))
    x = {t: n * idf.get(t, other) for t, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    s = Counter()
    for k, i, t, w in rows:
        if t in x:
            s[k, i] += x[t] * w / norm
    return {k: round(max(v for (of, _), v in s.items() if of == k), 6) for k in {k for k, _ in s}}


def named(text):
    return max(sorted(cosine(text).items()), key=lambda x: x[1])


@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
def test_each_licence_is_itself(name):
    for text in licenses.TEMPLATES[name]:
        assert named(f"/* Copyright (c) 2020 Jane Roe */ {text}" if len(text) > 300 else text)[0] == name
    assert named(f"# SPDX-License-Identifier: {name}") == (name, 1.0)


def test_lines_of_the_tables():
    for text, name in (
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ):
        got = named(text)
        assert got[0] == name and got[1] > 0.5
    for text in ("SPDX-License-Identifier: LicenseRef-mine", "You need a driving licence for this", "Copyright 2020 Jane Roe"):
        assert named(text)[1] < 0.5


def test_broken_notice(spark):
    """A notice over several comment lines is compared as one block, below other code too."""
    body = licenses.TEXTS["LGPL-3.0"][0].split()
    lines = ["/*", " * Copyright 2020 Jane Roe", " *", *[" * " + " ".join(body[i : i + 9]) for i in range(0, len(body), 9)], " */", "", "int x;"]
    mit = "MIT\n\nCopyright (c) 2020 Jane Roe\n\n" + licenses.TEXTS["MIT"][0]
    files = [(1, "a/x.c", "\n".join(lines)), (2, "b/LICENSE", mit), (3, "b/c/y.c", "int y;")]
    got = {r["doc_id"]: (r["licence"], r["via"]) for r in licenses.licence_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("LGPL-3.0", "header") and got[2][0] == "MIT" and got[3] == ("MIT", "b")


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License"), (2, "a/b/x.py", "print()"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0\nx"), (4, "c/z.py", "nothing here"), (5, None, None),
        (6, "top.py", "# Copyright me. All rights reserved. Unauthorized copying is prohibited"), (7, "a/b/c/COPYING", "This program is free software under the GNU General Public License, GPL version 3"), (8, "a/b/c/d/e.py", ""), (9, "a/b/c.py", None),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("licence", F.lit(1)).withColumn("own", F.lit(2))
    got = {r["doc_id"]: (r["licence"], r["via"]) for r in licenses.licence_scan(df).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "a"), 3: ("Apache-2.0", "header"), 4: (None, None), 5: (None, None), 6: ("Proprietary", "header"), 7: ("GPL-3.0", "file"), 8: ("GPL-3.0", "a/b/c"), 9: ("MIT", "a")}
    line = "released UNDER the mit license, or so"
    best = licenses.best_template(spark.createDataFrame([(line,)], "line string"), "line", 0.1).first()
    assert max(cosine(line).items(), key=lambda x: x[1]) == (best["licence"], best["score"])
    h = hard(spark).withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    assert licenses.licence_scan(h).count() == h.count()
    assert licenses.licence_scan(empty(spark).withColumn("path", F.lit("x"))).count() == 0


SCHEMA = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>"


def brute(rows, canon):
    out = Counter()
    for i, kind, url, ts, etag, mod, head in rows:
        if kind != "revisit":
            continue
        past = [r for r in rows if r[1] == "response" and url and ts is not None and r[2] and r[3] is not None and canon[r[2]] == canon[url] and r[3] <= ts]
        of = max(past, key=lambda r: (r[3], r[0]), default=None)
        if of is None:
            out[(i, None, "missing", None)] += 1
            continue
        same = etag == of[4] if etag is not None and of[4] is not None else mod == of[5] if mod is not None and of[5] is not None else True
        merged = tuple(sorted({**(of[6] or {}), **{k: v for k, v in (head or {}).items() if k in revisits.PERMITTED}}.items()))
        out[(i, of[0] if same else None, "resolved" if same else "stale", merged if same else None)] += 1
    return out


@pytest.mark.parametrize("chunk", [50_000, 7])
def test_revisits(spark, chunk):
    rnd = random.Random(chunk)
    urls = ["http://www.A.com/x/", "https://a.com/x#top", "a.com:443/x?ref=1", "http://b.org/?q=1&ref=2", "https://m.b.org?q=1", "http://hot.net/", None, ""]
    rows = [
        (i, rnd.choice(["response", "revisit", "revisit", None]), "http://hot.net/" if rnd.random() < 0.4 else rnd.choice(urls), rnd.choice([None, *range(60)]), rnd.choice([None, "e1", "e2"]), rnd.choice([None, "d1", "d2"]), rnd.choice([None, {}, {"date": str(i), "x": "y"}, {"etag": "z"}]))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    canon = {r["url"]: r["c"] for r in df.select("url", revisits.canonical(F.col("url")).alias("c")).distinct().collect()}
    assert canon["http://www.A.com/x/"] == canon["https://a.com/x#top"] == canon["a.com:443/x?ref=1"] == "a.com/x" and canon["http://b.org/?q=1&ref=2"] == canon["https://m.b.org?q=1"]
    rows = [(i, k, u or None, *r) for i, k, u, *r in rows] if not canon.get("") else rows
    got = Counter((r["record_id"], r["response_id"], r["outcome"], None if r["headers"] is None else tuple(sorted(r["headers"].items()))) for r in revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA).withColumn("of", F.lit(1)), chunk).collect())
    assert got == brute(rows, canon)
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(registry.ORACLES[name])
    names = [d[0] for d in res.description]
    want = Counter(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert Counter(tuple(str(r[c]) for c in cols) for r in df.collect()) == want and sorted(names) == cols


def test_work_grows_with_a_texts_length(spark):
    """One paragraph of 200,000 words that names a licence; the time of a tenth of it bounds it."""
    import time

    def took(n):
        files = spark.createDataFrame([(1, "a/x.txt", " ".join(f"w{i % 50_000}" for i in range(n)) + " license Released under the MIT License")], "doc_id long, path string, text string")
        began = time.perf_counter()
        assert licenses.licence_scan(files).collect()[0]["licence"] is None  # a line in a sea of other words
        return time.perf_counter() - began

    took(1000)
    small = took(20_000)
    assert took(200_000) < 10 * small + 20


def test_rights_reserved_alone_is_no_licence():
    assert named("All rights reserved.")[1] < 0.5
    assert named("All rights reserved. Unauthorized copying is prohibited.")[0] == "Proprietary" and named("All rights reserved. Unauthorized copying is prohibited.")[1] > 0.5
