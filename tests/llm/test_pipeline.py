"""The stages, one by one, against brute force on what each got."""

from collections import Counter

import corpus_pipeline
from pairlens.llm import common

from .cases import HARD, SF, hard, rows
from .test_jaccard import brute as brute_classes
from .test_text_queries import brute_hits, check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in rows("benchmark")]
    for name, stage in corpus_pipeline.STAGES:
        had = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = common.written(stage(spark, docs, SF), f"test-{name}")
        if name == "packing":
            used, least = check_packing(after.collect(), had)
            assert used <= least + 1
            break
        assert after.columns == columns
        got = Counter(r["doc_id"] for r in after.collect())
        if name == "toxicity":
            assert 0.75 * len(had) < sum(got.values()) <= len(had)
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(had):
                first.setdefault(t, i)
            assert got == Counter(first.values())
        elif name == "near_dedup":
            assert got == Counter(i for i, _, c in brute_classes(had, 5, 80, 100) if i == c)
        else:
            assert got == Counter(x[0] for x in brute_hits(had, items).elements() if not x[2])
        docs = after


def test_run_and_hard_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    for name, stage in corpus_pipeline.STAGES:
        extra = hard(spark)
        out = stage(spark, extra, SF)
        assert name == "packing" or out.columns == extra.columns
        got = out.collect()
        kept = [r["doc_id"] for r in got]
        assert name == "packing" or all(r[c] == 7 for r in got for c in extra.columns if c not in ("doc_id", "text"))
        if name == "exact_dedup":
            assert Counter(kept) == Counter([1, 3, 4, 6, 7, 8, 9, 10, 11, None, 12, 13, 14])
        else:
            assert 0 < len(kept) <= 3 * len(HARD)
