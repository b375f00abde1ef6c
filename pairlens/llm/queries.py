"""Thin queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .common import table
from .conversations import audit_conversations, damaged, repaired_digests
from .decontaminate import benchmark_hits
from .exact_dedup import exact_dedup
from .jaccard_join import similar_classes
from .lm_score import lm_score
from .licenses import licence_scan
from .packing import pack
from .quality import quality
from .repeats import drop_repeats
from .revisits import resolve_revisits
from .secret_scan import secret_scan, written_spans
from .toxicity import toxicity
from .toxicity import train as train_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("markov").cast("long").alias("n_markov"),
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"),
        written_spans(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, remainder("doc_id", 5) != 0)
    return toxicity(docs, model, keep_columns=["doc_id"]).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected"
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm_score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return got.select("doc_id", (~F.col("used")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), words=3, p=90, q=100)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), least=50).drop("spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from source and language; short English or other documents that name a licence stand for licence files."""
    d = table(spark, sf_dir, "documents")
    short = F.length("text") <= 200
    name = F.when(short & F.col("text").rlike("(?i)licen[cs]e"), F.when(F.col("lang") == "en", F.concat("source", F.lit("/LICENSE"))).otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/LICENSE"))))
    path = F.coalesce(name, F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return licence_scan(d.select("doc_id", path.alias("path"), "text"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is a response; a revisit follows it, one in five with another ETag, and some come before any response."""
    p = table(spark, sf_dir, "pages")
    i, tag = F.col("page_id"), F.md5("html")
    both = F.explode(
        F.array(
            F.struct((3 * i).alias("record_id"), F.lit("response").alias("kind"), (10 * i).alias("ts"), tag.alias("etag"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), (10 * i).cast("string")).alias("headers")),
            F.struct((3 * i + 1).alias("record_id"), F.lit("revisit").alias("kind"), (10 * i + 25).alias("ts"), F.when(i % 5 == 0, F.lit("other")).otherwise(tag).alias("etag"), F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), (10 * i + 25).cast("string")).alias("headers")),
            F.struct((3 * i + 2).alias("record_id"), F.when(i % 7 == 0, "revisit").alias("kind"), (10 * i - 5).alias("ts"), F.lit(None).cast("string").alias("etag"), F.create_map(F.lit("vary"), F.lit("accept")).alias("headers")),
        )
    ).alias("r")
    records = p.select("url", both).select("url", "r.*").withColumn("last_modified", F.lit(None).cast("string"))
    got = resolve_revisits(records)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return got.select("record_id", "url", "response_id", "outcome", said.alias("headers"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality(table(spark, sf_dir, "documents"))
    failed = F.array_contains("failed", "few_words") | F.array_contains("failed", "repeats")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size("host_failed") == 0)).alias("kept"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations, then audits and repairs what is left; a conversation without rows left has zeros."""
    rows = table(spark, sf_dir, "conversations")
    bad = damaged(rows)
    return repaired_digests(bad, audit_conversations(bad), known=rows)
