"""Corpus preparation: five stages, one after another, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import discard, table, written
from pairlens.llm.decontaminate import benchmark_hits
from pairlens.llm.exact_dedup import drop_copies
from pairlens.llm.jaccard_join import similar_classes
from pairlens.llm.packing import pack
from pairlens.llm.toxicity import toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score reaches their language's threshold; learns from the labels of these documents.

    A null or empty text is judged as a text without words; a null language has the threshold 0.5. A row with a null id
    has no label and is judged like any other. Repeated rows go or stay together. Without labels nothing is
    rejected below a half; an empty table stays empty. Columns of any name pass unchanged.
    """
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    results = ["score", "threshold", "rejected"]
    while set(results) & {c.lower() for c in docs.columns}:
        results = [f"_{c}" for c in results]
    return toxicity(docs, model, results=tuple(results)).filter(~F.col(results[2])).select([F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the smallest id.

    Null counts as the empty text; an id goes before a null id; of repeated rows one stays. Long texts are told
    apart like others, an empty table stays empty, other columns pass unchanged.
    """
    return drop_copies(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each class linked by a similarity of 0.8 of five-word shingles.

    Texts without words (null, empty) and rows with a null id always stay. Rows of one id stay or go together.
    An empty table stays empty, other columns pass unchanged.
    """
    classes = similar_classes(docs, words=5, p=80, q=100)
    gone = classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts hold none and stay; an item without words is in no document. Repeated rows stay or go together, an
    empty table stays empty, other columns pass unchanged.
    """
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return hits.filter("n_hit = 0").select("carried.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.

    Null and empty texts are one piece of the end id alone; only longer texts are cut. Repeated rows, and rows with a null
    id, are packed once each. An empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier and a packing heuristic are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
