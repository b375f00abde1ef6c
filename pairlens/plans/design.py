"""Queries on the design of an audit: trial runs, draws, forms, slates, label sets, cut-offs and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import band, hash_int, six
from ..operators import joins, ranking, reconcile, resample, sampling, shares, tests
from .fixtures import BAND, H, PAIRS, POOLS, labels, pairs, pools, table
from .registry import query
from .shares import DRAWS, interval_sql, rounded

CUTS = {20: (20, 80), 30: (30, 70), 35: (35, 65)}
CUT_BAND = "CASE WHEN pct < cut THEN 'b' WHEN pct > 100 - cut THEN 'a' ELSE 'drop' END"


@query(f"""WITH {PAIRS}, k AS (SELECT cluster, pct, sum(half)::BIGINT AS half, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT *, {CUT_BAND} AS category, cut || '/' || {CUT_BAND} AS stratum FROM k, (SELECT unnest([20, 30, 35]) AS cut)),
t AS (SELECT * FROM c WHERE category <> 'drop'), {interval_sql('cluster', 'stratum', 't', DRAWS, 'cutoff', 'stratum')},
v AS (SELECT cut, b, 50.0 * sum(times * half) FILTER (category = 'a') / sum(times * n) FILTER (category = 'a') - 50.0 * sum(times * half) FILTER (category = 'b') / sum(times * n) FILTER (category = 'b') AS value FROM times JOIN t USING (stratum, cluster) GROUP BY ALL),
p AS (SELECT cut, 50.0 * sum(half) FILTER (category = 'a') / sum(n) FILTER (category = 'a') - 50.0 * sum(half) FILTER (category = 'b') / sum(n) FILTER (category = 'b') AS contrast FROM t GROUP BY cut),
i AS (SELECT cut, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY cut)
SELECT cut, round(contrast, 6) AS contrast, round(low, 6) AS low, round(high, 6) AS high, low > 0 AS above_zero, high < 0 AS below_zero FROM p JOIN i USING (cut)""")
def b7_cutoff_contrast(spark, sf):
    sums = shares.cluster_sums(pairs(spark, sf), "cluster", "pct")
    cuts = F.explode(F.array(*map(F.lit, CUTS))).alias("cut")
    sums = sums.select("*", cuts).withColumn("category", F.when(F.col("pct") < F.col("cut"), "b").when(F.col("pct") > 100 - F.col("cut"), "a").otherwise("drop"))
    return rounded(resample.cutoff_contrasts(sums, "cluster", DRAWS, "cutoff", "cut"), "contrast", "low", "high")


@query(f"""WITH {PAIRS}, s AS (SELECT model, query, count(*) AS n, sum(b) AS x, sum(a) AS y, avg(a - b) AS d, count(*) FILTER (a - b > 1e-12) AS up, count(*) FILTER (a - b < -1e-12) AS down FROM pairs GROUP BY ALL), {interval_sql('query', 'model', 's', DRAWS, 'change', 'model')},
v AS (SELECT t.model, b, sum(times * d) / sum(times) AS value FROM times t JOIN s USING (model, query) GROUP BY ALL), i AS (SELECT model, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY model),
l AS (SELECT model, sum(x) / sum(n) AS before, sum(y) / sum(n) AS after, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down, avg(d) AS change FROM s GROUP BY model)
SELECT model, round(before, 6) AS before, round(after, 6) AS after, up, down, round(change, 6) AS change, round(low, 6) AS low, round(high, 6) AS high FROM l JOIN i USING (model)""")
def b10_change_by_query(spark, sf):
    return rounded(resample.mean_change(pairs(spark, sf), "query", "b", "a", DRAWS, "change", "model"), "before", "after", "change", "low", "high")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category = 'neutral' GROUP BY ALL), {interval_sql('cluster', 'model', 'c', DRAWS, 'neutral', 'model')},
v AS (SELECT t.model, b, 50.0 * sum(times * half) / sum(times * n) AS value FROM times t JOIN c USING (model, cluster) GROUP BY ALL), i AS (SELECT model, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY model)
SELECT (SELECT count(DISTINCT model) FROM pairs) AS models, (SELECT count(*) FROM i WHERE low <= 50 AND 50 <= high) AS indeterminate, (SELECT count(DISTINCT cluster) FROM pairs WHERE category <> 'drop') AS clusters, (SELECT count(DISTINCT pct) FROM pairs WHERE category <> 'drop') AS titles""")
def a20_indeterminate(spark, sf):
    p = pairs(spark, sf)
    c = shares.cluster_sums(p.filter("category = 'neutral'"), "model", "cluster")
    got = shares.indeterminate(resample.ratio_bootstrap(c, "half", "n", "cluster", DRAWS, "neutral", "model", scale=50.0), p, "model")
    return got.crossJoin(p.filter("category <> 'drop'").agg(F.count_distinct("cluster").alias("clusters"), F.count_distinct("pct").alias("titles")))


@query(f"""WITH {PAIRS}, p AS (SELECT model, 100.0 * count(*) FILTER (a = b AND quantity < 25) / count(*) AS same, 100.0 * count(*) FILTER (a > b) / count(*) AS win, 100.0 * count(*) FILTER (a = b) / count(*) AS tie, 100.0 * count(*) FILTER (a < b) / count(*) AS loss FROM pairs GROUP BY model)
SELECT model, round(100 - same, 6) AS pct_of_pairs, round(100 * win / (100 - same), 6) AS pct_a, round(100 * (tie - same) / (100 - same), 6) AS pct_tie, round(100 * loss / (100 - same), 6) AS pct_b, round(100 * (win + 0.5 * (tie - same)) / (100 - same), 6) AS share_a FROM p""")
def c11_residue_only(spark, sf):
    a, b = F.col("a"), F.col("b")
    pct = lambda x: 100.0 * F.count_if(x) / F.count(F.lit(1))
    p = pairs(spark, sf).groupBy("model").agg(pct((a == b) & (F.col("quantity") < 25)).alias("same"), pct(a > b).alias("win"), pct(a == b).alias("tie"), pct(a < b).alias("loss"))
    return p.select("model", *[six(v).alias(k) for k, v in shares.residue(*map(F.col, ("same", "win", "tie", "loss"))).items()])


@query(f"""WITH {POOLS}, r AS (SELECT pool, lang, marked, row_number() OVER (PARTITION BY pool, lang ORDER BY score DESC, tb) AS rank FROM pools)
SELECT lang, count(*) AS members, round(100.0 * count(*) FILTER (marked) / count(*), 6) AS pct_all, round(100.0 * count(*) FILTER (rank <= 1 AND marked) / count(*) FILTER (rank <= 1), 6) AS pct_top1, round(100.0 * count(*) FILTER (rank <= 5 AND marked) / count(*) FILTER (rank <= 5), 6) AS pct_top5 FROM r GROUP BY ROLLUP (lang)""")
def a9_z21_slates(spark, sf):
    r = pools(spark, sf).select("pool", "lang", "marked", ranking.ordinal_rank("score", "tb", "pool", "lang").alias("rank"))
    return rounded(shares.slates(r, [1, 5], "marked", "lang"), "pct_all", "pct_top1", "pct_top5")


@query(f"""WITH {POOLS}, g AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY first_score DESC, member) AS got, row_number() OVER (PARTITION BY pool ORDER BY score DESC, member) AS alone FROM pools),
k AS (SELECT pool, member, row_number() OVER (PARTITION BY pool ORDER BY score DESC, got) AS kept FROM g WHERE got <= 10)
SELECT pool, count(*) FILTER (kept <= 1 AND marked) AS pipe_top1, count(*) FILTER (alone <= 1 AND marked) AS alone_top1, count(*) FILTER (kept <= 5 AND marked) AS pipe_top5, count(*) FILTER (alone <= 5 AND marked) AS alone_top5 FROM g LEFT JOIN k USING (pool, member) GROUP BY pool""")
def w13_insertion_order(spark, sf):
    return ranking.insertion_order_shortlists(pools(spark, sf), "member", 10, [1, 5])


@query(f"""WITH {POOLS} SELECT pool, lang, count(score) AS n_scores, count(DISTINCT member) AS n_docs, true AS finite, count(DISTINCT score) AS n_distinct, count(score) = count(DISTINCT member) AND count(DISTINCT score) > 1 AS passed FROM pools GROUP BY ALL""")
def p16_canary(spark, sf):
    return reconcile.canary(pools(spark, sf), "score", "member", "pool", "lang")


@query("SELECT doc_id, substr(text, 1, 200) <> substr(regexp_replace(text, ' (the|de|die) ', ' that ', 'g'), 1, 200) AS inside, text <> regexp_replace(text, ' (the|de|die) ', ' that ', 'g') AS differs FROM documents")
def p14_marker_in_window(spark, sf):
    t, u = F.col("text"), F.regexp_replace("text", " (the|de|die) ", " that ")
    return table(spark, sf, "documents").select("doc_id", T.differs_in_window(t, u, 200).alias("inside"), (t != u).alias("differs"))


@query("SELECT event_type AS condition, CASE WHEN event_type = 'purchase' THEN 'none' ELSE event_type END AS variant, event_type = 'purchase' AS lowercase, count(*) AS n FROM events GROUP BY ALL")
def p19_variant_and_case(spark, sf):
    c = F.col("condition")
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("condition")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("condition", T.variant_and_case(F.when(c == "purchase", "lowercase_only").otherwise(c)).alias("v"), "n").select("condition", "v.variant", "v.lowercase", "n")


NAMED = "('0x' || substr(md5('gender|' || name), 1, 12))::BIGINT"


@query(f"""WITH t AS (SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(substr(text, 1, 1500), '[A-Z][a-z]+') AS x FROM documents)), names AS (SELECT DISTINCT lower(token) AS name FROM t),
n AS (SELECT name, CASE WHEN {NAMED} % 40 = 0 THEN 'M' ELSE 'F' END AS gender FROM names WHERE {NAMED} % 40 < 2), g AS (SELECT doc_id, arg_min(token, pos) AS carried, arg_min(gender, pos) AS by_name FROM t JOIN n ON lower(token) = name GROUP BY doc_id),
c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(he|him|his|himself)\\b')) AS m, len(regexp_extract_all(text, '(?i)\\b(she|her|hers|herself)\\b')) AS f FROM documents), p AS (SELECT doc_id, CASE WHEN m - f >= 2 THEN 'M' WHEN f - m >= 2 THEN 'F' END AS by_pronoun FROM c)
SELECT doc_id, carried, coalesce(by_name, by_pronoun) AS gender, CASE WHEN carried IS NOT NULL THEN 'name' WHEN by_pronoun IS NOT NULL THEN 'pronoun' END AS source FROM p LEFT JOIN g USING (doc_id)""")
def f8_carried_gender(spark, sf):
    """The detector is a pattern over the first 1,500 characters; the name table is some of the words that it finds, by hash."""
    spans = lambda p: F.regexp_extract_all(F.substring("text", 1, 1500), F.lit(p), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", "text")
    found = d.select(F.explode(spans("[A-Z][a-z]+")).alias("name")).select(F.lower("name").alias("name")).distinct()
    h = F.pmod(hash_int("gender", F.col("name")), F.lit(40))
    names = found.filter(h < 2).withColumn("gender", F.when(h == 0, "M").otherwise("F"))
    return joins.carried_gender(d, names, "doc_id", spans("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.col("text"))


HAND = "('0x' || substr(md5('hand|' || doc_id || '|' || kind || '|' || ref), 1, 12))::BIGINT"


@query(f"""WITH i AS (SELECT doc_id, unnest(['quality', 'toxic']) AS kind, unnest([quality, toxic]) AS ref FROM labels), h AS (SELECT *, {HAND} AS h FROM i), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, kind, ref) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, ref ORDER BY h, doc_id) - 1 AS place FROM o)
SELECT doc_id, kind, ref, (place // 5 + 1)::INTEGER AS round FROM r WHERE place < 15""")
def g6_handcheck(spark, sf):
    items = table(spark, sf, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (kind, ref)"))
    return sampling.handcheck(items, "doc_id", ["kind", "ref"], 5, 3, "hand")


@query("""SELECT lang, source, count(*) AS n, count(quality) AS decided, count(*) FILTER (quality <> toxic) AS agree FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def z18_handcheck_tally(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("decided"), F.count_if(F.col("quality") != F.col("toxic")).alias("agree"))


L = f"l AS (SELECT DISTINCT p_brand AS cluster, ({H.format('p_brand')} % 100)::INTEGER AS pct FROM part)"


@query(f"WITH {L}, o AS (SELECT cluster, {BAND} AS old_label, CASE WHEN pct < 20 THEN 'b' WHEN pct > 80 THEN 'a' WHEN pct BETWEEN 40 AND 60 THEN 'neutral' ELSE 'drop' END AS new_label FROM l) SELECT * FROM o WHERE old_label <> new_label")
def z42_changed_labels(spark, sf):
    old = labels(spark, sf)
    return reconcile.changed_labels(old, old.select("cluster", band(F.col("pct"), 20, 80).alias("category")), "cluster", "category")


@query(f"WITH {L}, k AS (SELECT cluster, {BAND} AS category FROM l) SELECT cluster, category, row_number() OVER (ORDER BY CASE category WHEN 'a' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END, lower(cluster), cluster)::INTEGER AS place FROM k WHERE category <> 'drop'")
def t7_label_order(spark, sf):
    """Labels are few whatever the corpus: one row a cluster."""
    order = F.when(F.col("category") == "a", 0).when(F.col("category") == "neutral", 1).otherwise(2)
    return labels(spark, sf).filter("category <> 'drop'").select("cluster", "category", F.row_number().over(Window.orderBy(order, F.lower("cluster"), "cluster")).alias("place"))


@query(f"WITH {L}, k AS (SELECT {BAND} AS category, list(cluster) AS clusters FROM l GROUP BY ALL) SELECT unnest(clusters) AS cluster, category FROM k")
def s3_inverted_labels(spark, sf):
    lists = labels(spark, sf).groupBy("category").agg(F.collect_list("cluster").alias("clusters"))
    return lists.select(F.explode("clusters").alias("cluster"), "category")


@query("SELECT event_type AS model, count(*) AS requests, round(sum(value), 4) AS tokens, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(DISTINCT user_id) AS served_by FROM events GROUP BY ALL")
def a29_z9_ledger(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("model"))
    return g.agg(F.count(F.lit(1)).alias("requests"), (F.round(F.sum("value"), 4)).alias("tokens"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"), F.count_distinct("user_id").alias("served_by"))


SECOND = "(quantity % 7 - 3)"


@query(f"""WITH {PAIRS}, g AS (SELECT category, count(*) AS n, count(*) FILTER (d > 0) / count(*) AS p, count(*) FILTER ({SECOND} > 0) / count(*) AS q, count(*) FILTER ((d > 0) = ({SECOND} > 0)) AS same FROM pairs WHERE category <> 'drop' GROUP BY category),
o AS (SELECT sum(n)::BIGINT AS n, sum(same) / sum(n) AS agreement, sum(n * (p * q + (1 - p) * (1 - q))) / sum(n) AS baseline FROM g),
r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS x, rank() OVER (ORDER BY {SECOND}) + (count(*) OVER (PARTITION BY {SECOND}) - 1) / 2.0 AS y FROM (SELECT round(d, 2) AS d, quantity FROM pairs WHERE category <> 'drop'))
SELECT n, round(agreement, 6) AS agreement, round(baseline, 6) AS baseline, round(agreement - baseline, 6) AS excess, round((SELECT corr(x, y) FROM r), 6) AS rho FROM o""")
def r5_item_level(spark, sf):
    """Ranks of values, by counts of the values, so that no task orders all pairs."""
    p = pairs(spark, sf).filter("category <> 'drop'").withColumn("d2", F.col("quantity") % 7 - 3)
    ranked = p.select(F.round("d", 2).alias("x"), F.col("d2").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    for c in ("x", "y"):
        of = ranked.groupBy(c).agg(F.sum("n").alias("k"))  # one row a value
        below = F.sum("k").over(Window.orderBy(c)) - F.col("k")
        ranked = ranked.join(of.select(c, (below + (F.col("k") + 1) / 2.0).alias(f"r{c}")), c)
    n, s = F.col("n"), F.sum
    x, y = F.col("rx"), F.col("ry")
    cov = lambda a, b: s(n * a * b) - s(n * a) * s(n * b) / s(n)
    rho = ranked.agg(s(n).alias("n"), (cov(x, y) / F.sqrt(cov(x, x) * cov(y, y))).alias("rho"))
    same = tests.independence_baseline(p.withColumn("up", F.col("d") > 0).withColumn("up2", F.col("d2") > 0), "up", "up2", "category")
    return rounded(same.crossJoin(rho).withColumn("excess", F.col("agreement") - F.col("baseline")), "agreement", "baseline", "excess", "rho")


@query(f"""WITH p AS (SELECT DISTINCT p_brand AS model, ({H.format("'e|' || p_brand")} % 2001 - 1500) / 1000.0 AS effect, ({H.format("'p|' || p_brand")} % 1000) / 20000.0 AS p FROM part),
r AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p) AS raw FROM p), h AS (SELECT *, max(raw) OVER (ORDER BY p, model) AS adj FROM r)
SELECT count(*) AS n_models, count(*) FILTER (effect < 0) AS n_negative, count(*) FILTER (p < 0.04) AS n_low, count(*) FILTER (adj < 0.04) AS n_adjusted_low, count(*) FILTER (p < 0.04 AND effect < 0) AS n_negative_low, count(*) FILTER (p < 0.04 AND effect > 0) AS n_positive_low,
count(*) FILTER (adj < 0.04 AND effect < 0) AS n_negative_adjusted_low, round(median(effect), 6) AS median, round(min(effect), 6) AS least, round(max(effect), 6) AS most, coalesce(string_agg(model, ',' ORDER BY model) FILTER (effect >= 0), '') AS not_negative, coalesce(string_agg(model, ',' ORDER BY model) FILTER (adj >= 0.04), '') AS not_adjusted_low FROM h""")
def z10_significance_overview(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_brand").alias("model")).distinct()
    m = m.withColumn("effect", (F.pmod(hash_int("e", F.col("model")), F.lit(2001)) - 1500) / 1000.0).withColumn("p", F.pmod(hash_int("p", F.col("model")), F.lit(1000)) / 20000.0)
    return rounded(shares.significance_overview(tests.holm(m, "p", "model"), "model", "effect", "p", "p_holm", 0.04), "median", "least", "most")


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS model, o_orderkey % 50 AS query FROM lineitem, orders WHERE o_orderkey % 97 < 60 AND l_orderkey = o_orderkey), r AS (SELECT l_returnflag AS model, l_orderkey % 50 AS query, l_quantity::INTEGER AS pos, l_linestatus AS server FROM lineitem WHERE l_linenumber <= 2 AND NOT (l_returnflag = 'A' AND l_orderkey % 50 = 3)),
q AS (SELECT model, query, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT coalesce(d.model, q.model) AS model, d.query AS dq, n FROM d FULL JOIN q ON d.model = q.model AND d.query = q.query),
g AS (SELECT model, count(dq) AS wanted, count(n) AS done, bool_and(dq IS NOT NULL AND n IS NOT NULL) AS complete, coalesce(sum(n), 0)::BIGINT AS records FROM b GROUP BY model), s AS (SELECT model, min(pos) AS scored_from, max(pos) AS scored_to, string_agg(DISTINCT server, ',' ORDER BY server) AS served_by FROM r GROUP BY model)
SELECT * FROM g LEFT JOIN s USING (model)""")
def z29_completed(spark, sf):
    line, key = table(spark, sf, "lineitem"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    model, q = F.col("l_returnflag").alias("model"), (F.col("l_orderkey") % 50).alias("query")
    design = line.join(key.filter("l_orderkey % 97 < 60"), "l_orderkey").select(model, q)
    done = line.filter("l_linenumber <= 2 and not (l_returnflag = 'A' and l_orderkey % 50 = 3)")
    return reconcile.completed(design, done.select(model, q, F.col("l_quantity").cast("int").alias("at"), F.col("l_linestatus").alias("server")), "model", "query", "at", "server")


@query("""SELECT event_id, coalesce(status, CASE WHEN banked THEN 'checked' ELSE 'skipped' END) AS status, CASE WHEN status IS NOT NULL OR banked THEN value END AS diff
FROM (SELECT event_id, value, CASE WHEN event_id % 4 = 0 THEN 'checked' END AS status, coalesce(CASE WHEN event_id % 5 > 0 THEN event_type END = 'error', false) AS banked FROM events)""")
def z13_check_status(spark, sf):
    e = table(spark, sf, "events")
    base = F.when(F.col("event_id") % 5 > 0, F.when(F.col("event_type") == "error", "banked scores").otherwise("own"))
    status, diff = reconcile.check_status(F.when(F.col("event_id") % 4 == 0, "checked"), base, F.col("value"))
    return e.select("event_id", status.alias("status"), diff.alias("diff"))


@query("""SELECT 'm' || c_nationkey AS model, 'r' || (c_nationkey % 5) AS revision, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS roles FROM customer GROUP BY ALL""")
def z45_manifest(spark, sf):
    k = F.col("c_nationkey")
    runs = table(spark, sf, "customer").select(F.concat(F.lit("m"), k).alias("model"), F.concat(F.lit("r"), k % 5).alias("revision"), F.col("c_mktsegment").alias("role"))
    return reconcile.manifest(runs, "model", "revision", "role")


@query(f"""WITH {PAIRS}, u AS (SELECT cluster, min((orderkey, partkey)) AS x FROM pairs GROUP BY cluster), o AS (SELECT cluster, x[1] AS orderkey, x[2] AS partkey FROM u ORDER BY {H.format("'canary|' || cluster")}, cluster LIMIT 12)
SELECT a.cluster AS asked, a.orderkey, b.cluster AS shown, b.partkey, a.cluster = b.cluster AS own FROM o a, o b""")
def g8_canaries(spark, sf):
    return sampling.canaries(pairs(spark, sf), "cluster", "orderkey", "partkey", 12, "canary")


@query("""WITH d AS (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS doc FROM lineitem), a AS (SELECT l_orderkey, doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY doc)::INTEGER - 1 AS at_ FROM (SELECT DISTINCT * FROM d))
SELECT l.l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, x.at_ AS l_partkey_at, y.at_ AS l_suppkey_at FROM lineitem l JOIN a x ON l.l_orderkey = x.l_orderkey AND l.l_partkey = x.doc JOIN a y ON l.l_orderkey = y.l_orderkey AND l.l_suppkey = y.doc""")
def z28_request_layout(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sampling.positions(rows, "l_orderkey", ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_partkey_at", "l_suppkey_at")


@query("""WITH t AS (SELECT lower(c_mktsegment) AS k, arg_min(c_acctbal, c_custkey) AS pct FROM customer WHERE c_custkey % 3 > 0 GROUP BY ALL), n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT c_mktsegment FROM customer)
SELECT name, coalesce(printf('%.2f%%', pct), 'n/a') AS shown FROM n LEFT JOIN t ON lower(trim(name)) = k""")
def z43_name_lookup(spark, sf):
    """The first entry of a name in any case, or ``n/a``."""
    c = table(spark, sf, "customer")
    t = c.filter("c_custkey % 3 > 0").groupBy(F.lower("c_mktsegment").alias("k")).agg(F.min_by("c_acctbal", "c_custkey").alias("pct"))
    n = table(spark, sf, "part").select(F.col("p_brand").alias("name")).union(c.select("c_mktsegment")).distinct()
    return n.join(t, F.lower(F.trim("name")) == F.col("k"), "left").select("name", F.when(F.col("pct").isNotNull(), F.format_string("%.2f%%", "pct")).otherwise("n/a").alias("shown"))


@query()
def f9_forms(spark, sf):
    """Two forms of every document; rules with look-ahead, held by the tests."""
    d = f8_carried_gender(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    names = d.filter("carried is not null").groupBy(F.lower("carried").alias("name")).agg(F.min("gender").alias("gender"), F.count(F.lit(1)).alias("count")).withColumn("twin", F.reverse("name"))
    got = joins.forms(d, names, ["Reed", "Stone", "Lake"], "forms")
    return got.select("doc_id", "mode", F.md5("male_text").alias("male"), F.md5("female_text").alias("female"))
