"""Statistics of runs, tallies of marks, precision and layout of runs, spans checked by digest, effect of all conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records
from .fixtures import PAIRS, pairs, table
from .registry import query
from .shares import rounded

SHARE = "50.0 * sum(half) FILTER ({0}) / count(*) FILTER ({0})"


@query(f"""WITH {PAIRS}, r AS (SELECT *, quantity < 40 AS i, template = 'O' AS o FROM w)
SELECT model, count(*) AS n, count(*) FILTER (NOT i) AS n_outside, round(100.0 * count(*) FILTER (a = b) / count(*), 6) AS pct_ties, round(50.0 * sum(half) / count(*), 6) AS share, round({SHARE.format("category = 'a'")} - {SHARE.format("category = 'b'")}, 6) + 0.0 AS contrast,
round({SHARE.format('i')}, 6) AS share_inside, round(avg(abs(a - b)) FILTER (i), 6) AS mean_gap_inside, count(*) FILTER (o) AS n_own, round({SHARE.format('o')}, 6) AS share_own, round({SHARE.format("o AND category = 'a'")} - {SHARE.format("o AND category = 'b'")}, 6) + 0.0 AS contrast_own FROM r GROUP BY model""")
def a15_run_statistics(spark, sf):
    got = records.run_statistics(pairs(spark, sf), "a", "b", F.col("quantity") < 40, F.col("template") == "O", "model")
    return rounded(got, "pct_ties", "share", "contrast", "share_inside", "mean_gap_inside", "share_own", "contrast_own")


@query("""WITH m AS (SELECT conv_id AS doc, CASE WHEN turn % 2 = 0 THEN 'name' ELSE 'pronoun' END AS kind, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS ref FROM conversations), e AS (SELECT kind, doc, count(*) AS n, count(*) FILTER (ref = 'user') AS own, count(*) FILTER (ref IS NULL) AS none FROM m GROUP BY ALL)
SELECT kind, count(*) AS docs, sum(n)::BIGINT AS n, sum(own)::BIGINT AS n_owner, sum(n - own - none)::BIGINT AS n_other, sum(none)::BIGINT AS n_none, count(*) FILTER (own > 0) AS docs_with_owner FROM e GROUP BY kind""")
def z8_mark_tally(spark, sf):
    """Turns as marks, roles as whom they mean."""
    c = table(spark, sf, "conversations")
    marks = c.select(F.col("conv_id").alias("doc"), F.when(F.col("turn") % 2 == 0, "name").otherwise("pronoun").alias("kind"), F.when(F.col("turn") % 5 != 4, F.col("role")).alias("ref"))
    return records.mark_tally(marks, "doc", "kind", "ref", "user")


RUN = "SELECT p_partkey AS model, CASE p_size % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'bfloat16' WHEN 2 THEN 'int8' END AS explicit, (p_size % 3 + 3) || '.1.0' AS version, CASE p_partkey % 3 WHEN 0 THEN 'F16' WHEN 1 THEN 'float32' END AS stored FROM part"


@query(f"""WITH r AS ({RUN}), s AS (SELECT model, CASE WHEN explicit <> 'auto' THEN CASE explicit WHEN 'bfloat16' THEN 'bf16' ELSE explicit END WHEN explicit IS NULL AND split_part(version, '.', 1)::INTEGER < 5 THEN 'fp32' ELSE coalesce(CASE stored WHEN 'F16' THEN 'fp16' WHEN 'float32' THEN 'fp32' END, 'unverified') END AS p FROM r)
SELECT p AS precision, count(*) AS runs, min(model) AS first FROM s GROUP BY p""")
def z44_precision(spark, sf):
    """The precision that each run's loader ran at, by its own dtype, its version and its checkpoint."""
    p = table(spark, sf, "part")
    k = F.col("p_size") % 4
    explicit = F.when(k == 0, "auto").when(k == 1, "bfloat16").when(k == 2, "int8")
    version = F.concat((F.col("p_size") % 3 + 3).cast("string"), F.lit(".1.0"))
    stored = F.when(F.col("p_partkey") % 3 == 0, "F16").when(F.col("p_partkey") % 3 == 1, "float32")
    return p.select("p_partkey", records.precision(explicit, version, stored).alias("precision")).groupBy("precision").agg(F.count(F.lit(1)).alias("runs"), F.min("p_partkey").alias("first"))


@query("""WITH l AS (SELECT c_custkey AS model, CASE WHEN c_nationkey % 2 = 0 THEN 'local' ELSE 'hosted' END AS route, 8 + c_nationkey % 3 AS chunk FROM customer), r AS (SELECT o_custkey AS model, count(*) AS batch_size FROM orders GROUP BY o_custkey)
SELECT route, chunk, count(*) AS models, sum(batch_size)::BIGINT AS batches FROM l JOIN r USING (model) GROUP BY ALL""")
def z34_layouts(spark, sf):
    """Models with orders, their layouts checked against the routes of their records."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("model"), F.when(F.col("c_nationkey") % 2 == 0, "local").otherwise("hosted").alias("route"), (8 + F.col("c_nationkey") % 3).alias("chunk"))
    batch = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("model")).agg(F.count(F.lit(1)).alias("batch_size"))
    got = records.checked_layouts(batch, c, batch.join(c.select("model", "route"), "model"))
    return got.groupBy("route", "chunk").agg(F.count(F.lit(1)).alias("models"), F.sum("batch_size").alias("batches"))


@query("""WITH d AS (SELECT doc_id, text, instr(text, ' the ') AS i FROM documents) SELECT doc_id, md5(CASE WHEN i > 0 THEN '#' || substr(text, 2, i - 1) || 'THE' || substr(text, i + 4) ELSE text END) AS edited FROM d""")
def f10_checked_spans(spark, sf):
    """Two edits of each text at places that the digests of what stands there confirm."""
    d = table(spark, sf, "documents").withColumn("at", F.instr("text", " the "))
    cut = lambda s, e: F.sha2(F.substring(F.col("text"), s + 1, e - s), 256)
    span = lambda s, e, by: F.struct(s.alias("start"), e.alias("end"), F.lit(by).alias("by"), cut(s, e).alias("sha256"))
    spans = F.when(F.col("at") > 0, F.array(span(F.col("at"), F.col("at") + 3, "THE"), span(F.lit(0), F.lit(1), "#")))
    return d.select("doc_id", F.md5(T.checked_spans(F.col("text"), spans)).alias("edited"))


@query()
def z11_z12_conditions(spark, sf):
    """All eight conditions on each document's masculine and feminine form."""
    d = table(spark, sf, "documents")
    forms = d.filter(F.col("text").isNotNull()).select(T.swap_pronouns(F.col("text"), "masculine").alias("male"), T.swap_pronouns(F.col("text"), "feminine").alias("female"))
    return rounded(records.condition_effect(forms, "male", "female", F.array(F.lit("the"), F.lit("thing"))), "gap")
