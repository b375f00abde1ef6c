"""Text: de-identification and its effect, tokens, detectors, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import six
from .fixtures import table
from .registry import query

def low(*words: str) -> str:
    """(from, to) word rules in RE2, applied in turn."""
    out = "text"
    for w, by in zip(words[::2], words[1::2], strict=True):
        out = f"regexp_replace({out}, '\\b{w}\\b', '{by}', 'gi')"
    return out


FIXED = ("he", "they", "she", "they", "him", "them", "his", "their", "hers", "theirs", "himself", "themselves", "herself", "themselves")
UNIFORM = "regexp_replace(text, '\\b(himself|herself|hers|him|her|his|she|he)\\b', 'they', 'gi')"


@query(f"SELECT doc_id, md5(lower({UNIFORM})) AS full_text, md5(lower({low('her', 'their', *FIXED)})) AS her_their, md5(lower({low('her', 'them', *FIXED)})) AS her_them, md5(lower(text)) AS plain FROM documents")
def f1_f3_f4_deidentify(spark, sf):
    t = F.col("text")
    v = lambda k: F.md5(T.deidentify(t, k))
    return table(spark, sf, "documents").select("doc_id", v("full").alias("full_text"), v("gram_her_their").alias("her_their"), v("gram_her_them").alias("her_them"), v("none").alias("plain"))


@query()
def f5_f6_next_word_rules(spark, sf):
    """Rules with look-ahead; literal fixtures in the tests hold them."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.deidentify(t, "gram_pos")).alias("by_next"), F.md5(T.swap_pronouns(t, "feminine")).alias("feminine"), F.md5(T.swap_pronouns(t, "masculine")).alias("masculine"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\bthing\\b', 'the candidate', 'gi'), '\\bthe\\b', 'the candidate', 'gi')) AS names_only FROM documents")
def f2_replace_names(spark, sf):
    names = F.array(F.lit("the"), F.lit(" thing "), F.lit(""), F.lit("the"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.deidentify(F.col("text"), "names_only", names, lowercase=False)).alias("names_only"))


@query(f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(he|him|his|himself)\\b')) AS m, len(regexp_extract_all(text, '(?i)\\b(she|her|hers|herself)\\b')) AS f FROM documents)
SELECT doc_id, CASE WHEN m - f >= 2 THEN 'M' WHEN f - m >= 2 THEN 'F' END AS gender FROM c""")
def f7_pronoun_gender(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.pronoun_gender(F.col("text")).alias("gender"))


@query("""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, md5(c) AS collapsed, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END::INTEGER AS words, md5(regexp_extract(text, '^([ \\t\\n\\r\\f\\v]*[^ \\t\\n\\r\\f\\v]+(?:[ \\t\\n\\r\\f\\v]+[^ \\t\\n\\r\\f\\v]+){0,29})', 1)) AS first_30 FROM t""")
def f11_f12_words(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.collapse(t)).alias("collapsed"), T.n_words(t).alias("words"), F.md5(T.cut_words(t, 30)).alias("first_30"))


@query("""SELECT doc_id, i::INTEGER AS chunk, md5(substr(text, 1100 * i + 1, 1200)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(1 + greatest(length(text) - 1, 0) // 1100)) AS i FROM documents)""")
def f14_chunked(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunked(F.col("text"))).alias("chunk", "c"))
    return c.select("doc_id", "chunk", F.md5("c").alias("chunk_md5"))


@query("""SELECT doc_id, ((CASE WHEN 400 - 320 > 0 AND length(text) >= 0 THEN '…' ELSE '' END) || substr(text, 81, least(400 + 5 + 320, length(text)) - 80) || (CASE WHEN 725 < length(text) THEN '…' ELSE '' END)) AS window FROM documents WHERE length(text) > 400""")
def f20_context(spark, sf):
    return table(spark, sf, "documents").filter(F.length("text") > 400).select("doc_id", T.context(F.col("text"), F.lit(400), 5).alias("window"))


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text_md5 FROM pages")
def f19_strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


@query("""SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN upper(w) = w THEN w ELSE upper(w[1]) || w[2:] END), 'string_agg', ' ') AS title, replace(replace(replace(replace(replace(p_type, '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_') AS tex, replace(replace('{name} is {type}', '{name}', p_name), '{type}', p_type) AS filled FROM part""")
def f16_f17_f18_templates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("title"), T.latex(F.col("p_type")).alias("tex"), T.fill(F.lit("{name} is {type}"), {"name": F.col("p_name"), "type": F.col("p_type")}).alias("filled"))


@query()
def f10_span_edits(spark, sf):
    """Right-to-left edits of found spans; held by literal fixtures and by length arithmetic in the tests."""
    d = table(spark, sf, "documents").withColumn("at", F.instr("text", " the "))
    spans = F.when(F.col("at") > 0, F.array(F.struct(F.col("at").alias("start"), (F.col("at") + 3).alias("end"), F.lit("THE").alias("by")), F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("#").alias("by"))))
    return d.select("doc_id", F.md5(T.apply_spans(F.col("text"), spans)).alias("edited"), F.length(T.apply_spans(F.col("text"), spans)).alias("length"))


TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Z][A-Za-z]+'), lambda p: lower(regexp_replace(p, '[^A-Za-z]', '', 'g'))), lambda p: length(p) > 1))"


@query(f"""WITH d AS (SELECT doc_id, lang, {TOKENS} AS found FROM documents), r AS (SELECT doc_id, lang, found, list_filter(found, lambda x: length(x) > 4) AS long_ones, list_filter(found, lambda x: x[1] IN ('t', 'a')) AS listed FROM d)
SELECT count(*) AS docs, sum(len(long_ones))::BIGINT AS long_tokens, sum(len(list_intersect(long_ones, listed)))::BIGINT AS both, round(sum(len(list_intersect(long_ones, listed))) / sum(len(long_ones)), 6) AS recall, round(sum(len(list_intersect(long_ones, listed))) / sum(len(listed)), 6) AS precision,
round(avg(CASE WHEN len(found) > 0 THEN len(list_intersect(long_ones, listed)) / len(list_distinct(list_concat(long_ones, listed, ['zz']))) END), 6) AS jaccard FROM r""")
def f13_f15_u5_z16_z17_coverage(spark, sf):
    """Two name detectors against each other: token sets, recall, precision, overlap."""
    found = T.name_tokens(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]+"), F.lit(0)))
    d = table(spark, sf, "documents").select("doc_id", found.alias("found"))
    r = d.select("found", F.filter("found", lambda x: F.length(x) > 4).alias("long_ones"), F.filter("found", lambda x: F.substring(x, 1, 1).isin("t", "a")).alias("listed"))
    r = r.withColumn("both", F.size(F.array_intersect("long_ones", "listed"))).withColumn("any", F.size(F.array_union(F.array_union("long_ones", "listed"), F.array(F.lit("zz")))))
    return r.agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("long_ones")).alias("long_tokens"), F.sum("both").alias("both"), six(F.sum("both") / F.sum(F.size("long_ones"))).alias("recall"),
        six(F.sum("both") / F.sum(F.size("listed"))).alias("precision"), six(F.avg(F.when(F.size("found") > 0, F.col("both") / F.col("any")))).alias("jaccard"),
    )


@query(f"""WITH t AS (SELECT unnest({TOKENS}) AS token FROM documents) SELECT token, count(*) AS docs FROM t GROUP BY token ORDER BY docs DESC, token LIMIT 40""")
def t3_most_common_tokens(spark, sf):
    found = T.name_tokens(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]+"), F.lit(0)))
    return table(spark, sf, "documents").select(F.explode(found).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "token").limit(40)


@query(f"""WITH v AS (SELECT doc_id, source, unnest(['none', 'full', 'gram']) AS variant, unnest([lower(text), lower({UNIFORM}), lower({low('her', 'their', *FIXED)})]) AS t, lower(text) AS base FROM documents)
SELECT variant, count(*) AS docs, round(100.0 * count(*) FILTER (t = base) / count(*), 6) AS pct_identical, count(DISTINCT md5(t)) AS distinct_texts, sum(length(t) - length(base))::BIGINT AS grown FROM v GROUP BY variant""")
def z12_a28_deid_effect(spark, sf):
    t = F.col("text")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), T.deidentify(t, k).alias("t")) for n, k in (("none", "none"), ("full", "full"), ("gram", "gram_her_their"))])).alias("v")
    v = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("base"), each).select("doc_id", "base", "v.*")
    return v.groupBy("variant").agg(
        F.count(F.lit(1)).alias("docs"), six(100.0 * F.count_if(F.col("t") == F.col("base")) / F.count(F.lit(1))).alias("pct_identical"), F.count_distinct(F.md5("t")).alias("distinct_texts"),
        F.sum((F.length("t") - F.length("base")).cast("long")).alias("grown"),
    )


@query("""SELECT page_id, len(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>'))::INTEGER AS items, len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>'))::INTEGER AS paragraphs, md5(coalesce(list_aggregate(regexp_extract_all(html, '(?s)<(?:p|h1|h2|title)[^>]*>(.*?)</', 1), 'string_agg', '|'), '')) AS cells FROM pages""")
def s16_html_scan(spark, sf):
    cells = F.regexp_extract_all("html", F.lit("(?s)<(?:p|h1|h2|title)[^>]*>(.*?)</"), F.lit(1))
    n = lambda t: F.size(F.regexp_extract_all("html", F.lit(f"(?s)<{t}[^>]*>(.*?)</{t}>"), F.lit(0)))
    return table(spark, sf, "pages").select("page_id", n("li").alias("items"), n("p").alias("paragraphs"), F.md5(F.array_join(cells, "|")).alias("cells"))


@query("""WITH k AS (SELECT doc_id, source, length(text) AS n FROM documents) SELECT source, round(quantile_cont(n, 0.0), 6) AS least, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3, round(quantile_cont(n, 1.0), 6) AS most FROM k GROUP BY source""")
def a32_length_quartiles(spark, sf):
    q = F.percentile(F.length("text"), F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return table(spark, sf, "documents").groupBy("source").agg(*[six(q[i]).alias(n) for i, n in enumerate(("least", "q1", "median", "q3", "most"))])


@query("""SELECT doc_id, upper(source) AS source, substr(text, 1, 20000) AS text FROM documents WHERE text IS NOT NULL AND len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) >= 60""")
def s7_s8_load_corpus(spark, sf):
    from ..sources.readers import corpus

    return corpus(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), F.col("category").alias("source"), "text")
