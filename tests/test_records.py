"""Checks that stop a job: layouts, spans; conditions on literal pairs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairlens.functions import text as T
from pairlens.operators import records


def test_layouts(spark):
    m = spark.createDataFrame([("a",), ("b",)], "model string")
    lay = spark.createDataFrame([("a", "x", 8), ("b", "y", 1)], "model string, route string, chunk int")
    rec = spark.createDataFrame([("a", "x", 4), ("b", "y", 2)], "model string, route string, batch_size int")
    assert sorted(tuple(r) for r in records.checked_layouts(m, lay, rec).collect()) == [("a", "x", 8, 4), ("b", "y", 1, 2)]
    for l, r, why in ((lay.limit(1), rec, "b: no request layout"), (lay, rec.limit(1), "b: no run record"), (lay, rec.withColumn("route", F.lit("x")), "b: its record has another route")):
        with pytest.raises(Exception, match=why):
            records.checked_layouts(m, l, r).collect()


def test_checked_spans(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kind = "text string, spans array<struct<start:int,end:int,by:string,sha256:string>>"
    said = lambda *spans: spark.createDataFrame([("Jane met him.", list(spans) or None)], kind).select(T.checked_spans(F.col("text"), F.col("spans"))).collect()[0][0]
    assert said((0, 4, "John Roe", sha("Jane")), (9, 12, "her", sha("him"))) == "John Roe met her."
    assert said() == "Jane met him."
    with pytest.raises(Exception, match="not where its label says"):
        said((1, 5, "x", sha("Jane")))
    with pytest.raises(Exception, match="overlap"):
        said((0, 4, "x", sha("Jane")), (3, 6, "y", sha("e m")))


def test_conditions(spark):
    pair = [("He said THE boss praised him and his work.", "She said THE boss praised her and her work.")]
    got = {r["condition"]: r for r in records.condition_effect(spark.createDataFrame(pair, "m string, f string"), "m", "f", F.array(F.lit("boss"))).collect()}
    assert set(got) == set(records.CONDITIONS)
    assert {c for c, r in got.items() if r["identical"] == 1} >= {"full", "pronouns_only"}  # one token for every gendered pronoun
    assert {c for c, r in got.items() if r["identical"] == 0} >= {"original", "lowercase_only", "names_only"}
    assert got["original"]["changed"] == 0 and got["names_only"]["changed"] == got["lowercase_only"]["changed"] == 2
    assert got["original"]["distinct_texts"] == 2 and got["full"]["distinct_texts"] == 1 and got["original"]["gap"] == -1.0


def test_conditions_are_those_of_each_text_alone_in_one_pass(spark):
    texts = ["He gave HER the thing; her is hers, himself", "no such word, The THING", "She: her\u2028own", "her \u017fhe", "the-she thing he", "", "herself Her her", None, "THE"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in (a, texts[0], texts[6])], "m string, f string")
    names = F.array(F.lit("the"), F.lit("thing"))
    got = records.condition_effect(pairs, "m", "f", names)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # the texts' rules run once, not for each sum
    rows = {r["condition"]: r for r in got.collect()}
    assert set(rows) == set(records.CONDITIONS)
    for c in records.CONDITIONS:
        form = lambda t, c=c: t if c == "original" else T.deidentify(t, "none" if c == "lowercase_only" else c, names, lowercase=c == "lowercase_only")
        made = pairs.select("m", "f", form(F.col("m")), form(F.col("f"))).collect()
        gaps = [len(a) - len(b) for *_, a, b in made if a is not None and b is not None]
        want = (len(made), sum(a == b and a is not None for *_, a, b in made), len({x for r in made for x in r[2:]} - {None}), sum(x != y for m, f, a, b in made for x, y in ((m, a), (f, b))))
        assert (rows[c]["pairs"], rows[c]["identical"], rows[c]["distinct_texts"], rows[c]["changed"]) == want and abs(rows[c]["gap"] - sum(gaps) / len(gaps)) < 1e-9
    assert records.condition_effect(pairs.limit(0), "m", "f", names).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        records.condition_effect(pairs, "m", "f", names, ("other",))


def test_precision(spark):
    rows = [("auto", "4.1", "BF16", "bf16"), (None, "4.1", "BF16", "fp32"), (None, "5.0", "F32", "fp32"), (None, "5.0", None, "unverified"), ("float16", None, None, "fp16"), ("int8", "9", None, "int8"), ("auto", None, None, "unverified")]
    df = spark.createDataFrame(rows, "e string, v string, s string, want string")
    assert all(r[0] == r[1] for r in df.select(records.precision(F.col("e"), F.col("v"), F.col("s")), "want").collect())
