"""Placeholders, orders read back, collapsed cells, paired changes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import placeholders
from pairlens.functions.text import latex
from pairlens.operators import channels, resample
from pairlens.sinks import render
from pairlens.sources import rendered


def test_placeholders(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2.5]}, "n": "x", "z": -0.001}',)], "j string").select(F.parse_json("j").alias("doc"))
    said = lambda t: df.select(placeholders.filled("doc", t)).collect()[0][0]
    assert said("no slot") == "no slot" and said("{{[n]}} {{[a.b.1]}}") == "x 2.5"
    assert said("{{([a.b.0] + [a.b.1]) * 100 / 2|.1f}}% {{[a.b.1] * 3|d}} {{-[a.b.0]|d}} {{[z]|.1f}}") == "175.0% 8 -1 0.0"
    for bad, why in (("{{[a.c]|d}}", "unresolved path a.c"), ("{{[n] + 1|d}}", "unresolved path n"), ("{{[a.b.7]}}", "unresolved path a.b.7")):
        with pytest.raises(Exception, match=why):
            said(bad)
    for bad in ("{{[a.b.0]; drop|d}}", "{{exp([z])|d}}", "{{[a'b]|d}}", "{{[z]|x}}", "{{[z] + 1}}"):
        with pytest.raises(ValueError):
            said(bad)


def test_order_of_a_rendered_table(spark, tmp_path):
    rows = [("m1", "A & B", 3.0), ("m2", "C_d", 1.0), ("m3", "50% x", 2.0)]
    df = spark.createDataFrame(rows, "model string, label string, contrast double")
    escaped = df.withColumn("label", latex(F.col("label"))).withColumn("o", F.when(F.col("model") == "m2", 0).otherwise(F.col("contrast")))
    (tmp_path / "t.tex").write_text("% made & by a script\n\\hline\n" + render.tabular(escaped, ["label", "contrast", "o"], 1, "o") + "\nAll of \\& it\n")
    table = rendered.table_rows(spark, str(tmp_path / "t.tex"))
    assert [r["cells"][0] for r in table.orderBy("place").collect()][-3:] == ["C_d", "50% x", "A & B"]
    order = lambda t, m=df: [(r["model"], r["source"]) for r in rendered.ordered_as(m, t, "model", "label", "contrast").orderBy("place").collect()]
    assert order(table) == [("m2", "table"), ("m3", "table"), ("m1", "table")]
    more = df.unionByName(spark.createDataFrame([("m4", "unseen", 2.5)], df.schema))
    assert order(table, more) == [("m1", "contrast"), ("m4", "contrast"), ("m3", "contrast"), ("m2", "contrast")]
    assert order(None) == [("m1", "contrast"), ("m3", "contrast"), ("m2", "contrast")]
    (tmp_path / "twice.tex").write_text("A \\& B & 1 \\\\\nC\\_d & 2 \\\\\nC\\_d & 2 \\\\\n50\\% x & 3 \\\\\n")
    assert order(rendered.table_rows(spark, str(tmp_path / "twice.tex")))[0] == ("m1", "contrast")


def test_collapsed(spark):
    df = spark.createDataFrame([("c", "q", n, "t") for n in range(3)] + [("d", "q", 0, "t"), ("d", "q", 1, None)], "unit string, query string, name int, text string").withColumn("category", F.lit("a"))
    c = channels.collapsed(df, ["category", "unit", "query"], "name", "text")
    assert {r["unit"]: (r["n_items"], r["ok"]) for r in c.collect()} == {"c": (3, True), "d": (2, False)}
    r = channels.design_checks(c, "unit", "category", ["query"], 3).collect()[0]
    assert (r["comparisons"], r["requests"], r["not_collapsed"], r["incomplete"], r["units"], r["holds"]) == (2, 1, 1, 1, 2, False)


def test_paired_changes(spark):
    rnd = random.Random(3)
    rows = [(m, arm, "ab"[i % 2], f"c{i}", rnd.randint(0, 20), 10) for m in "xy" for arm in ("original", "alone") for i in range(8) if rnd.random() < 0.9]
    sums = spark.createDataFrame(rows, "model string, arm string, category string, cluster string, half long, n long")
    levels, changes = channels.paired_contrasts(sums, "arm", "cluster", 60, "s", block=7)
    joined = sums.withColumn("model", F.concat_ws("/", "model", "arm"))
    drawn = {}
    for r in resample.draw_contrasts(joined, "cluster", 60, "s").collect():
        drawn.setdefault(r["model"], {})[r["b"]] = r["value"]
    for r in levels.collect():
        v = [x for x in drawn[f"{r['model']}/{r['arm']}"].values() if x is not None]
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))
    for r in changes.collect():
        one, two = drawn[f"{r['model']}/{r['arm']}"], drawn[f"{r['model']}/{r['against']}"]
        v = [one[b] - two[b] for b in one if b in two and one[b] is not None and two[b] is not None]
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(v, [0.025, 0.975])))
    assert changes.count() == 4
