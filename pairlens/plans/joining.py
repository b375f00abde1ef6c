"""Joins, dimensions, generators, reconciliation of runs, evidence and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import band, decimal, hash_int, significant, six, stars
from ..operators import embedding, joins, prefix, reconcile, sampling
from .fixtures import BAND, H, PAIRS, POOLS, labels, pairs, pools, table
from .registry import query
from .shares import rounded

# ---------------------------------------------------------------- joins


@query(f"""WITH {PAIRS}, l AS (SELECT DISTINCT cluster, category FROM pairs WHERE category <> 'drop') SELECT model, l.category AS kind, count(*) AS n FROM pairs JOIN l USING (cluster) GROUP BY ALL""")
def j1_p1_relabelled(spark, sf):
    lab = labels(spark, sf).filter("category <> 'drop'").select("cluster", F.col("category").alias("kind"))
    return joins.relabelled(pairs(spark, sf), lab, "cluster", "kind").groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"))


RUNS = f"""{POOLS}, one AS (SELECT pool, member, score - first_score AS d FROM pools), two AS (SELECT pool, member, CASE WHEN {H.format("'run|' || member")} % 10 < 8 THEN score - first_score ELSE first_score - score END AS d FROM pools WHERE {H.format("'lost|' || member")} % 50 <> 0)"""


def runs(spark, sf):
    p = pools(spark, sf).withColumn("d", F.col("score") - F.col("first_score"))
    one = p.select("pool", "member", "d")
    two = p.filter(F.pmod(hash_int(F.lit("lost"), F.col("member")), F.lit(50)) != 0).select("pool", "member", F.when(F.pmod(hash_int(F.lit("run"), F.col("member")), F.lit(10)) < 8, F.col("d")).otherwise(F.col("first_score") - F.col("score")).alias("d"))
    return one, two


@query(f"WITH {RUNS} SELECT pool, member, count(o.d)::BIGINT AS left_rows, NULL::BIGINT AS right_rows FROM one o WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.pool = o.pool AND t.member = o.member) GROUP BY ALL")
def j3_unmatched_between_runs(spark, sf):
    return joins.one_to_one(*runs(spark, sf), "pool", "member")


AGREE = """count(*) AS n, round(100.0 * count(*) FILTER (sign(x) = sign(y)) / count(*), 6) AS pct_same_winner, round(100.0 * count(*) FILTER (x = y) / count(*), 6) AS pct_identical, round(max(abs(x - y)), 6) AS max_diff, round(avg(abs(x - y)), 6) AS mean_diff,
count(*) FILTER (x = 0 AND y = 0) AS ties_in_both, round(100.0 * count(*) FILTER (sign(x) = sign(y) AND x <> 0) / nullif(count(*) FILTER (x <> 0 AND y <> 0), 0), 6) AS pct_same_without_ties"""


@query(f"WITH {RUNS} SELECT pool, {AGREE} FROM (SELECT pool, o.d AS x, t.d AS y FROM one o JOIN two t USING (pool, member)) GROUP BY pool")
def c7_z30_j4_agreement(spark, sf):
    one, two = runs(spark, sf)
    both = one.withColumnRenamed("d", "x").join(two.withColumnRenamed("d", "y"), ["pool", "member"])
    return rounded(reconcile.agreement(both, "x", "y", "pool"), "pct_same_winner", "pct_identical", "max_diff", "mean_diff", "pct_same_without_ties")


@query(f"""WITH {RUNS}, b AS (SELECT o.d AS x, t.d AS y FROM one o JOIN two t USING (pool, member)) SELECT count(*) AS n, count(*) FILTER (NOT (abs(x) > 0.3 AND abs(y) > 0.3)) AS undetermined,
round(100.0 * count(*) FILTER (abs(x) > 0.3 AND abs(y) > 0.3 AND sign(x) = sign(y)) / count(*), 6) AS lower_bound FROM b""")
def c8_bounded_agreement(spark, sf):
    one, two = runs(spark, sf)
    both = one.withColumnRenamed("d", "x").join(two.withColumnRenamed("d", "y"), ["pool", "member"])
    return rounded(reconcile.bounded_agreement(both, "x", "y", 0.15), "lower_bound")


@query(f"""WITH {RUNS}, b AS (SELECT pool, o.d AS x, t.d AS y, (o.d + t.d) / 2 AS m FROM one o JOIN two t USING (pool, member)) SELECT pool, count(*) AS n, round(avg(m), 6) + 0.0 AS mean_gap, round(100.0 * count(*) FILTER (m > 0) / count(*), 6) AS pct_a, count(*) FILTER (sign(x) <> sign(y)) AS changed FROM b GROUP BY pool""")
def c10_r10_counterbalanced(spark, sf):
    one, two = runs(spark, sf)
    return rounded(reconcile.counterbalanced(one, two, ["member"], "d", "pool"), "mean_gap", "pct_a")


@query(f"""WITH {RUNS}, c AS (SELECT pool, round(avg(o.d) - avg(t.d), 6) + 0.0 AS change, substr(pool, 4, 1) AS grp FROM one o JOIN two t USING (pool, member) GROUP BY pool), m AS (SELECT grp, max(abs(change)) AS max_change, count(*) AS n FROM c GROUP BY grp)
SELECT grp, max_change, n, list_sort(list(DISTINCT pool)) AS at FROM m JOIN c USING (grp) WHERE abs(change) = max_change GROUP BY ALL""")
def a31_drift(spark, sf):
    one, two = runs(spark, sf)
    c = one.withColumnRenamed("d", "x").join(two.withColumnRenamed("d", "y"), ["pool", "member"]).groupBy("pool").agg(six(F.avg("x") - F.avg("y")).alias("change"))
    return reconcile.drift(c.withColumn("grp", F.substring("pool", 4, 1)), "grp", "pool", "change")


@query(f"""WITH {PAIRS} SELECT model, count(*) AS n, sum(('0x' || substr(sha256(orderkey || '|' || cluster), 1, 12))::BIGINT)::DOUBLE AS f1, sum(('0x' || substr(sha256(orderkey || '|' || cluster), 13, 12))::BIGINT)::DOUBLE AS f2 FROM pairs GROUP BY model""")
def a26_fingerprint(spark, sf):
    f = reconcile.fingerprint(pairs(spark, sf), ["orderkey", "cluster"], "model")
    return f.select("model", "n", F.col("f1").cast("double").alias("f1"), F.col("f2").cast("double").alias("f2"))


@query("""WITH m AS (SELECT 'x' AS model, * FROM supplier UNION ALL SELECT 'y', * FROM supplier UNION ALL SELECT 'z', * FROM supplier WHERE s_suppkey > 5), k AS (SELECT model, md5(string_agg(s_suppkey || '|' || s_name, ';' ORDER BY s_suppkey, s_name)) AS k FROM m GROUP BY model)
SELECT min(model) AS stays, count(*) AS members FROM k GROUP BY k HAVING count(*) > 1""")
def a27_duplicates(spark, sf):
    s = table(spark, sf, "supplier")
    m = s.withColumn("model", F.lit("x")).unionByName(s.withColumn("model", F.lit("y"))).unionByName(s.filter("s_suppkey > 5").withColumn("model", F.lit("z")))
    return reconcile.duplicates(reconcile.fingerprint(m, ["s_suppkey", "s_name"], "model"), "model")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, sum(a::DECIMAL(18,4)) AS sa, sum(b::DECIMAL(18,4)) AS sb FROM pairs GROUP BY ALL) SELECT model, count(*) AS clusters, count(*) FILTER (sa > sb) AS a_higher, count(*) FILTER (sa = sb) AS equal FROM c GROUP BY model""")
def c9_exact_decimal_means(spark, sf):
    c = pairs(spark, sf).groupBy("model", "cluster").agg(F.sum(decimal(F.col("a"))).alias("sa"), F.sum(decimal(F.col("b"))).alias("sb"))
    return c.groupBy("model").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("sa") > F.col("sb")).alias("a_higher"), F.count_if(F.col("sa") == F.col("sb")).alias("equal"))


@query("""WITH t AS (SELECT lpad((n_nationkey * 7 % 10)::VARCHAR, 2, '1') || '-10' || lpad((n_nationkey % 12)::VARCHAR, 2, '0') || CASE n_nationkey % 3 WHEN 0 THEN '.00' WHEN 1 THEN '.01' ELSE '.07' END AS f FROM nation), p AS (SELECT DISTINCT '1' || (x % 10) || '-10' || lpad((x % 14)::VARCHAR, 2, '0') AS code FROM range(40) r(x)),
m AS (SELECT code, 0 AS p, f FROM p JOIN t ON f = code UNION ALL SELECT code, 1, f FROM p JOIN t ON f = code || '.00' UNION ALL SELECT code, 2, f FROM p JOIN t ON f = code || '.01' UNION ALL SELECT code, 3, f FROM p JOIN t ON starts_with(f, code))
SELECT code, arg_min(f, (m.p, f)) AS found, min(m.p)::INTEGER AS step FROM p LEFT JOIN m USING (code) GROUP BY code""")
def j6_prefix_codes(spark, sf):
    k = F.col("n_nationkey")
    ext = F.when(k % 3 == 0, ".00").when(k % 3 == 1, ".01").otherwise(".07")
    t = table(spark, sf, "nation").select(F.concat(F.lpad((k * 7 % 10).cast("string"), 2, "1"), F.lit("-10"), F.lpad((k % 12).cast("string"), 2, "0"), ext).alias("f"))
    x = F.col("id")
    p = spark.range(40).select(F.concat(F.lit("1"), (x % 10).cast("string"), F.lit("-10"), F.lpad((x % 14).cast("string"), 2, "0")).alias("code")).distinct()
    return joins.by_prefix(p, "code", t, "f")


@query("""WITH r AS (SELECT p_retailprice AS v, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY v), l AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_partkey % 2 = 1),
lo AS (SELECT l.k, l.v, r.v AS rv, r.k AS rk FROM l ASOF LEFT JOIN r ON l.v >= r.v), hi AS (SELECT l.k, r.v AS rv, r.k AS rk FROM l ASOF LEFT JOIN r ON l.v <= r.v)
SELECT lo.k AS p_partkey, lo.v AS p_retailprice, CASE WHEN lo.rk IS NULL THEN hi.rk WHEN hi.rk IS NULL THEN lo.rk WHEN lo.v - lo.rv < hi.rv - lo.v THEN lo.rk WHEN hi.rv - lo.v < lo.v - lo.rv THEN hi.rk ELSE least(lo.rk, hi.rk) END AS nearest FROM lo JOIN hi USING (k)""")
def j13_nearest_value(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return prefix.nearest(p.filter("p_partkey % 2 = 1"), p.filter("p_partkey % 2 = 0"), "p_retailprice", "p_partkey", "nearest").select("p_partkey", "p_retailprice", "nearest")


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 3 = 0), m AS (SELECT n_nationkey AS k, upper(n_name) AS v FROM nation WHERE n_nationkey % 2 = 0), q AS (SELECT n_nationkey AS k FROM nation)
SELECT q.k, coalesce(n.v, m.v) AS v, CASE WHEN n.v IS NOT NULL THEN 0 WHEN m.v IS NOT NULL THEN 1 END::INTEGER AS source FROM q LEFT JOIN n USING (k) LEFT JOIN m USING (k)""")
def j7_j16_j18_priority_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return joins.by_priority(n.select("k"), "k", [(n.filter("k % 3 = 0"), F.col("v")), (n.filter("k % 2 = 0").withColumn("v", F.upper("v")), F.col("v"))], "v")


@query("SELECT o_custkey FROM orders ANTI JOIN customer ON o_custkey = c_custkey GROUP BY ALL UNION SELECT c_custkey FROM customer ANTI JOIN nation ON c_nationkey = n_nationkey")
def j8_j9_unresolved(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").select("o_custkey").union(c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_anti").select("c_custkey")).distinct()


@query(f"""WITH {PAIRS}, c AS (SELECT model, name, sum(half)::BIGINT AS half FROM w GROUP BY ALL) SELECT l.model, count(*) AS n, count(*) FILTER (l.half = r.half) AS equal, max(abs(l.half - r.half))::BIGINT AS most FROM c l JOIN c r ON l.model = r.model AND l.name < r.name GROUP BY l.model""")
def j10_j12_j15_within_cell_pairs(spark, sf):
    from ..operators.shares import cluster_sums

    p = joins.within_pairs(cluster_sums(pairs(spark, sf), "model", "name"), ["model"], "name", "half")
    gap = F.abs(F.col("half_x") - F.col("half_y"))
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap == 0).alias("equal"), F.max(gap).alias("most"))


@query("""WITH r AS (SELECT conv_id, role, text, length(text) % 7 AS score FROM conversations) SELECT role, count(*) AS requests, count(DISTINCT text) AS scored, sum(score)::BIGINT AS total FROM r GROUP BY role""")
def j17_score_once(spark, sf):
    c = table(spark, sf, "conversations")
    got = joins.scored_once(c, ["text"], lambda keys: keys.withColumn("score", F.length("text") % 7))
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("text").alias("scored"), F.sum(F.col("score").cast("long")).alias("total"))


# ---------------------------------------------------------------- dimensions and evidence


@query(f"SELECT DISTINCT p_brand AS cluster, ({H.format('p_brand')} % 100)::INTEGER AS pct, {BAND.replace('pct', '(' + H.format('p_brand') + ' % 100)')} AS category FROM part")
def p6_bands(spark, sf):
    return labels(spark, sf).select("cluster", "pct", band(F.col("pct")).alias("category"))


@query("""WITH g AS (SELECT c_mktsegment AS name, count(*) FILTER (c_nationkey % 2 = 0) AS f, count(*) AS n FROM customer GROUP BY name), d AS (SELECT c_mktsegment AS name, c_nationkey - c_nationkey % 10 AS decade, count(*) AS k FROM customer GROUP BY ALL)
SELECT name, round(100.0 * f / n, 6) AS pct_f, n, arg_max(decade, (k, -decade))::INTEGER AS peak FROM g JOIN d USING (name) WHERE n >= 100 GROUP BY ALL""")
def a21_a23_p13_name_table(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("k"))
    d = c.groupBy("name", (F.col("k") - F.col("k") % 10).alias("decade")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") % 2 == 0).alias("f"))
    g = d.groupBy("name").agg(six(100.0 * F.sum("f") / F.sum("n")).alias("pct_f"), F.sum("n").alias("n_all"), F.max_by("decade", F.struct("n", -F.col("decade"))).alias("peak"))
    return g.filter("n_all >= 100").select("name", "pct_f", F.col("n_all").alias("n"), "peak")


@query("""WITH v AS (SELECT doc_id, unnest(['quality', 'toxic']) AS question, unnest([quality, toxic]) AS answer FROM labels) SELECT question, answer, count(*) AS docs, count(DISTINCT source) AS sources FROM v JOIN documents USING (doc_id) GROUP BY ALL""")
def a22_z40_tally(spark, sf):
    v = table(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "question", "answer")
    return v.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("question", "answer").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"))


@query(f"""WITH {POOLS} SELECT count(DISTINCT pool) AS pools, count(*) AS comparisons, count(DISTINCT member) AS members, count(DISTINCT (lang, member)) AS query_members FROM pools""")
def a25_sampling_summary(spark, sf):
    return pools(spark, sf).agg(F.count_distinct("pool").alias("pools"), F.count(F.lit(1)).alias("comparisons"), F.count_distinct("member").alias("members"), F.count_distinct("lang", "member").alias("query_members"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def k12_json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k is not null")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def integrity_duplicate_keys(spark, sf):
    return joins.unique(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, count(DISTINCT name) AS names FROM pairs GROUP BY ALL) SELECT model, cluster, names, 10 - names AS missing FROM c WHERE names <> 10 UNION ALL SELECT model, cluster, names, 10 - names FROM c WHERE names < 5""")
def integrity_incomplete_cells(spark, sf):
    c = pairs(spark, sf).groupBy("model", "cluster").agg(F.count_distinct("name").alias("names")).withColumn("missing", 10 - F.col("names"))
    return c.filter("names <> 10").unionByName(c.filter("names < 5"))


# ---------------------------------------------------------------- sets, sorts, sampling


@query("(SELECT c_nationkey AS k, 'only_customers' AS side FROM customer EXCEPT SELECT s_nationkey, 'only_customers' FROM supplier) UNION ALL (SELECT s_nationkey, 'only_suppliers' FROM supplier EXCEPT SELECT c_nationkey, 'only_suppliers' FROM customer) UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)")
def u1_u2_u3_u4_sets(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).withColumn("side", F.lit("only_customers")).union(s.subtract(c).withColumn("side", F.lit("only_suppliers"))).union(c.intersect(s).withColumn("side", F.lit("both")))


@query(f"""WITH {POOLS}, r AS (SELECT pool, member, row_number() OVER (PARTITION BY pool ORDER BY score DESC, tb) AS a, row_number() OVER (PARTITION BY pool ORDER BY first_score DESC, tb) AS b FROM pools), l AS (SELECT pool, list_sort(list(member) FILTER (a <= 3)) AS x, list_sort(list(member) FILTER (b <= 3)) AS y FROM r GROUP BY pool)
SELECT pool, x = y AS same, len(list_intersect(x, y))::INTEGER AS shared FROM l""")
def u6_r6_shortlist_equality(spark, sf):
    from ..operators.ranking import ordinal_rank

    r = pools(spark, sf).select("pool", "member", ordinal_rank("score", "tb", "pool").alias("a"), ordinal_rank("first_score", "tb", "pool").alias("b"))
    l = r.filter("a <= 3 or b <= 3").groupBy("pool").agg(F.sort_array(F.collect_set(F.when(F.col("a") <= 3, F.col("member")))).alias("x"), F.sort_array(F.collect_set(F.when(F.col("b") <= 3, F.col("member")))).alias("y"))
    return l.select("pool", (F.col("x") == F.col("y")).alias("same"), F.size(F.array_intersect("x", "y")).alias("shared"))


@query(f"""WITH o AS (SELECT o_orderpriority AS stratum, o_orderkey AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H.format("'draw|' || o_orderkey")}, o_orderkey) AS place FROM orders) SELECT stratum, key, place::INTEGER AS place FROM o WHERE place <= 8""")
def g3_g4_g7_stratified_sample(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("key"))
    return sampling.per_stratum(o, 8, "draw", "key", "stratum")


@query(f"""WITH q AS (SELECT DISTINCT source AS query, lang AS qc FROM documents), m AS (SELECT query, doc_id AS member, lang = qc AS on_category FROM documents, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query, qc, on_category ORDER BY {H.format("'pool|' || query || '|' || member")}, member) AS r FROM (SELECT query || '-' || qc AS query, qc, member, on_category FROM (SELECT query, qc, doc_id AS member, lang = qc AS on_category FROM documents, q))),
n AS (SELECT *, least(max(CASE WHEN on_category THEN r ELSE 0 END) OVER (PARTITION BY query), 5) AS n_on FROM r)
SELECT query, member, on_category FROM n WHERE (on_category AND r <= 5) OR (NOT on_category AND r <= 20 - n_on)""")
def g2_filled_pools(spark, sf):
    d = table(spark, sf, "documents")
    q = d.select(F.concat_ws("-", "source", "lang").alias("query"), F.col("lang").alias("query_category")).distinct()
    m = d.select(F.col("doc_id").alias("member"), F.col("lang").alias("category"))
    return sampling.filled_pools(q, m, 20, 5, "pool")


@query("""WITH i(item) AS (SELECT DISTINCT p_type FROM part), t(style, template) AS (VALUES ('bare', '{name} is a {item}.'), ('long', '{name} sells {item}; {pronoun} likes {possessive} work.')), n(name_a, name_b) AS (VALUES ('Adam', 'Eve'), ('Tom', 'Ann'))
SELECT item, style, name_a || '/' || name_b AS name_pair, replace(replace(replace(replace(template, '{name}', name_a), '{pronoun}', 'he'), '{possessive}', 'his'), '{item}', item) AS doc_a, replace(replace(replace(replace(template, '{name}', name_b), '{pronoun}', 'she'), '{possessive}', 'her'), '{item}', item) AS doc_b FROM i, t, n""")
def g1_s22_corpus(spark, sf):
    i = table(spark, sf, "part").select(F.col("p_type").alias("item")).distinct()
    t = spark.createDataFrame([("bare", "{name} is a {item}."), ("long", "{name} sells {item}; {pronoun} likes {possessive} work.")], "style string, template string")
    n = spark.createDataFrame([("Adam", "Eve", "he", "she", "his", "her"), ("Tom", "Ann", "he", "she", "his", "her")], "name_a string, name_b string, pronoun_a string, pronoun_b string, poss_a string, poss_b string")
    return sampling.corpus(i, t, n)


@query(f"SELECT c_custkey, ['red', 'green', 'blue'][1 + {H.format("'choice|' || c_custkey")} % 3] AS choice FROM customer")
def g5_choice(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (1 + F.pmod(hash_int(F.lit("choice"), F.col("c_custkey")), F.lit(3))).cast("int")).alias("choice"))


@query("WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT s_suppkey FROM r WHERE i % 9 = 0 AND i < 45")
def t6_every_nth(spark, sf):
    return sampling.every_nth(table(spark, sf, "supplier").select("s_suppkey"), 9, 5, ["s_suppkey"])


@query(f"""WITH o AS (SELECT o_orderkey, {H.format("'g10|' || o_orderkey")} AS h FROM orders ORDER BY h, o_orderkey LIMIT 50) SELECT o_orderkey FROM o""")
def g9_g10_hash_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", hash_int(F.lit("g10"), F.col("o_orderkey")).alias("h"))
    return o.orderBy("h", "o_orderkey").limit(50).select("o_orderkey")


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS l FROM conversations)
SELECT conv_id, max(role) FILTER (f = 1) AS first_role, max(role) FILTER (l = 1) AS last_role, count(*) AS turns FROM c GROUP BY conv_id""")
def w8_first_and_last(spark, sf):
    k = F.struct("turn", "role", "text")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", k).alias("first_role"), F.max_by("role", k).alias("last_role"), F.count(F.lit(1)).alias("turns"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) SELECT o_custkey, o_orderkey, (i // 4)::BIGINT AS unit, (i % 4)::BIGINT AS place FROM o""")
def w12_units(spark, sf):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", i.alias("i")).select("o_custkey", "o_orderkey", F.floor(F.col("i") / 4).alias("unit"), (F.col("i") % 4).cast("long").alias("place"))


@query("""WITH s AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity AS start_, l_quantity + l_linenumber AS end_ FROM lineitem), n AS (SELECT *, lead(start_) OVER (PARTITION BY l_partkey ORDER BY start_, l_orderkey, l_linenumber, l_suppkey) AS nxt FROM s) SELECT l_partkey, count(*) FILTER (nxt < end_) AS overlaps FROM n GROUP BY l_partkey""")
def w9_overlapping_spans(spark, sf):
    w = Window.partitionBy("l_partkey").orderBy("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey")
    n = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linenumber", F.lead("l_quantity").over(w).alias("nxt"))
    return n.groupBy("l_partkey").agg(F.count_if(F.col("nxt") < F.col("l_quantity") + F.col("l_linenumber")).alias("overlaps"))


@query("SELECT p_partkey, round(p_retailprice / 997, 6) AS x, CASE WHEN p_retailprice / 99999 < 0.001 THEN '***' WHEN p_retailprice / 99999 < 0.01 THEN '**' WHEN p_retailprice / 99999 < 0.05 THEN '*' ELSE '' END AS stars, round(round(p_retailprice * pow(10.0, 3 - floor(log10(p_retailprice)))) / pow(10.0, 3 - floor(log10(p_retailprice))), 6) AS sig4 FROM part")
def math_rounding(spark, sf):
    x = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", six(x / 997).alias("x"), stars(x / 99999).alias("stars"), six(significant(x)).alias("sig4"))


@query("""WITH f AS (SELECT p_partkey, p_retailprice AS x, p_retailprice::FLOAT::DOUBLE AS f, pow(2.0, floor(log2(p_retailprice::FLOAT::DOUBLE)) - 7) AS unit FROM part) SELECT p_partkey, round_even(f / unit, 0) * unit AS rounded, round_even(f / unit, 0) * unit = x AS exact FROM f""")
def z4_p15_bf16(spark, sf):
    from ..functions.scalars import bf16

    x = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", bf16(x).alias("rounded"), (bf16(x) == x).alias("exact"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT label, arg_min(v, vec_id) AS q FROM e WHERE label IS NOT NULL GROUP BY label), s AS (SELECT vec_id, e.label AS own, q.label, list_dot_product(v, q.q) AS score FROM e, q)
SELECT vec_id, round(max(score) FILTER (label = own), 5) AS own_score, round(max(score), 5) AS best_score, count(*) AS queries FROM s GROUP BY vec_id""")
def s27_embedding_scores(spark, sf):
    """Every vector against the query of each label, its first vector: own label's score, and the best."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    queries = e.filter("label is not null").groupBy("label").agg(F.min_by("v", "vec_id").alias("v"))
    got = embedding.scored_against(e, queries, "vec_id", "label")
    return got.select("vec_id", F.round("own_score", 5).alias("own_score"), F.round("best_score", 5).alias("best_score"), "queries")


@query(f"""WITH {PAIRS} SELECT model, category, count(*) FILTER (template = 'F') AS f, count(*) FILTER (template = 'O') AS o FROM pairs GROUP BY ALL""")
def a10_pivot(spark, sf):
    return pairs(spark, sf).groupBy("model", "category").pivot("template", ["F", "O"]).agg(F.count(F.lit(1))).select("model", "category", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, query, a, count(*) AS n FROM pairs GROUP BY ALL), d AS (SELECT model, cluster, query, b, count(*) AS n FROM pairs GROUP BY ALL)
SELECT model, cluster, query, sum(c.n * d.n)::BIGINT AS pairs, sum(c.n * d.n * CASE WHEN a > b THEN 2 WHEN a = b THEN 1 ELSE 0 END)::BIGINT AS half FROM c JOIN d USING (model, cluster, query) GROUP BY ALL""")
def j11_cross_in_cells(spark, sf):
    """Every a of a cell against every b of it: half wins over the whole cross product, from counts of values."""
    p = pairs(spark, sf)
    cell = ["model", "cluster", "query"]
    return joins.cross_half_wins(p.select(*cell, F.col("a").alias("v")), p.select(*cell, F.col("b").alias("v")), cell, "v").select(*cell, "pairs", "half")


KEYS = "o_custkey % 50 AS occupation, o_orderpriority AS query_type, o_orderkey % 7 AS name_pair, o_orderstatus AS template"


@query(f"""WITH k AS (SELECT {KEYS}, o_orderkey, o_totalprice FROM orders), t AS (SELECT DISTINCT occupation, query_type, name_pair, template FROM k), one AS (SELECT occupation, query_type, name_pair, template, max(o_totalprice) AS first FROM k WHERE o_orderkey % 97 <> 0 GROUP BY ALL), two AS (SELECT occupation, query_type, name_pair, template, min(o_totalprice) AS second FROM k WHERE o_orderkey % 89 <> 0 GROUP BY ALL)
SELECT template, count(*) AS triples, count(*) FILTER (first IS NULL) AS no_first, count(*) FILTER (second IS NULL) AS no_second, count(*) FILTER (first > second) AS higher, count(*) FILTER (first = second) AS identical FROM t LEFT JOIN one USING (occupation, query_type, name_pair, template) LEFT JOIN two USING (occupation, query_type, name_pair, template) GROUP BY template""")
def j2_j5_two_banks(spark, sf):
    """Triples with the scores of two banks by their key of four columns: what each lacks, and where both say the same."""
    key = ["occupation", "query_type", "name_pair", "template"]
    k = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("occupation"), F.col("o_orderpriority").alias("query_type"), (F.col("o_orderkey") % 7).alias("name_pair"), F.col("o_orderstatus").alias("template"), "o_orderkey", "o_totalprice")
    one = k.filter("o_orderkey % 97 <> 0").groupBy(*key).agg(F.max("o_totalprice").alias("first"))
    two = k.filter("o_orderkey % 89 <> 0").groupBy(*key).agg(F.min("o_totalprice").alias("second"))
    banks = joins.banked(k.select(*key).distinct(), {"first": one, "second": two}, key)
    return banks.groupBy("template").agg(
        F.count(F.lit(1)).alias("triples"), F.count_if(F.col("first").isNull()).alias("no_first"), F.count_if(F.col("second").isNull()).alias("no_second"),
        F.count_if(F.col("first") > F.col("second")).alias("higher"), F.count_if(F.col("first") == F.col("second")).alias("identical"),
    )


@query(f"""WITH {RUNS}, b AS (SELECT pool, o.d AS x, t.d * 1.02 + 0.01 AS y FROM one o JOIN two t USING (pool, member)), s AS (SELECT pool, count(*) AS n, regr_slope(y, x) AS slope, corr(x, y) AS r, median(y) - median(x) AS shift, max(x) - min(x) AS range FROM b GROUP BY pool)
SELECT pool, n, round(slope, 6) AS slope, round(r, 6) AS r, slope BETWEEN 0.8 AND 1.25 AND r >= 0.9 AND abs(shift) <= 0.1 * range AS same_scale FROM s""")
def c6_scale_match(spark, sf):
    """Are two runs of a pool on one scale?"""
    one, two = runs(spark, sf)
    both = one.withColumnRenamed("d", "x").join(two.select("pool", "member", (F.col("d") * 1.02 + 0.01).alias("y")), ["pool", "member"])
    return rounded(reconcile.scale_statistics(both, "x", "y", "pool").withColumn("same_scale", reconcile.scale_match()).select("pool", "n", "slope", "r", "same_scale"), "slope", "r")
