"""The provided tables in the shape the operators take: scored pairs, pools, ranked sets, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import band, hash_int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster (brand), pct, category."""
    pct = F.pmod(hash_int(F.col("p_brand")), F.lit(100)).cast("int")
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("cluster"), pct.alias("pct"), band(pct).alias("category"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs: discount against tax of a line, by brand; every line has its part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    pct = F.pmod(hash_int(F.col("p_brand")), F.lit(100)).cast("int")
    part = part.withColumn("pct", pct).withColumn("category", band(F.col("pct")))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    return joined.select(
        F.col("l_returnflag").alias("model"), F.col("p_brand").alias("cluster"), "pct", "category", F.col("l_linenumber").alias("query"), F.col("l_linestatus").alias("template"),
        F.pmod("p_size", F.lit(10)).alias("name"), F.col("p_type").alias("kind"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_discount") - F.col("l_tax")).alias("d"),
        F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
    )


H = "('0x' || substr(md5({}), 1, 12))::BIGINT"
BAND = "CASE WHEN pct < 30 THEN 'b' WHEN pct > 70 THEN 'a' WHEN pct BETWEEN 40 AND 60 THEN 'neutral' ELSE 'drop' END"
HALF = "CASE WHEN a > b THEN 2 WHEN a = b THEN 1 ELSE 0 END"
#: The same in SQL.
PAIRS = f"""brand AS (SELECT p_partkey, p_brand, p_type, p_size, ({H.format('p_brand')} % 100)::INTEGER AS pct FROM part),
pairs AS (SELECT l_returnflag AS model, p_brand AS cluster, pct, {BAND} AS category, l_linenumber AS query, l_linestatus AS template, p_size % 10 AS name, p_type AS kind,
  l_discount AS a, l_tax AS b, l_discount - l_tax AS d, l_quantity AS quantity, l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey
  FROM lineitem JOIN brand ON l_partkey = p_partkey),
w AS (SELECT *, {HALF} AS half FROM pairs)"""


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of documents: one a source, members with a score (few values, so ties occur) and a tie-break."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("pool"), F.col("doc_id").alias("member"), "lang",
        (F.pmod(hash_int(F.lit("rr"), F.col("doc_id")), F.lit(21)) / 20.0).alias("score"), (F.pmod(hash_int(F.lit("emb"), F.col("doc_id")), F.lit(11)) / 10.0).alias("first_score"),
        F.sha2(F.concat_ws("|", F.lit("seed"), F.col("source"), F.col("doc_id").cast("string")), 256).alias("tb"), (F.pmod(hash_int(F.lit("m"), F.col("doc_id")), F.lit(2)) == 0).alias("marked"),
    )


POOLS = f"""pools AS (SELECT source AS pool, doc_id AS member, lang, ({H.format("'rr|' || doc_id")} % 21) / 20.0 AS score, ({H.format("'emb|' || doc_id")} % 11) / 10.0 AS first_score,
  sha256('seed|' || source || '|' || doc_id) AS tb, ({H.format("'m|' || doc_id")} % 2) = 0 AS marked FROM documents)"""
