"""Quality rules against plain loops, host rates against their formula."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlens.llm import quality, queries

from .cases import HARD, SF, empty, hard, rows


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    hit = {i + k for where in at.values() if len(where) > 1 for i in where for k in range(5)}
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, again, len(hit))


def test_query(spark):
    got = {r["doc_id"]: r for r in queries.op12_quality_rules(spark, SF).collect()}
    docs = rows("documents")
    assert len(got) == len(docs)
    for d in docs:
        n, chars, symbols, _, again, hit = plain(d["text"])
        r = got[d["doc_id"]]
        assert tuple(r)[1:6] == (n, chars, symbols, again, hit)
        assert r["base_failed"] == (n < 10 or 100 * hit > 20 * n) and (not r["kept"] or not r["base_failed"])
    fine = [r for r in got.values() if not r["base_failed"]]
    assert sum(r["kept"] for r in fine) > 0.9 * len(fine)  # ordinary hosts stay


@pytest.mark.parametrize("piece", [1 << 21, 10])
def test_hard_rows(spark, piece, monkeypatch):
    whole = quality.K.pieces
    monkeypatch.setattr(quality.K, "pieces", lambda off: whole(off, piece))
    more = ["a b c d e f a b c d e", "a  b\tc\nd e a b c d e", "x\n x\nx\n\n \nx", "#*$%&|<>", "é é é é é é", "a b c d e", "\n".join(["same line"] * 5)]
    texts = [t for _, t in HARD] + more
    import pyarrow as pa

    got = quality.counts(pa.array(texts))
    assert [tuple(int(got[c][i]) for c in quality.COUNTS) for i in range(len(texts))] == [plain(t) for t in texts]


def test_hosts(spark):
    assert quality.quality(empty(spark).withColumn("source", F.lit("x"))).count() == 0
    df = hard(spark).withColumn("source", F.lit(None).cast("string")).withColumn("host_failed", F.lit(1))
    got = quality.quality(df).collect()
    assert len(got) == len(HARD) and all(r["host_failed"] == [] for r in got)
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in got) == Counter((i, plain(t)[0], plain(t)[5]) for i, t in HARD)
    good, bad = " ".join(f"word{i}" for i in range(30)), "too short"
    docs = [(h * 100 + i, f"h{h}", bad if i < k else good) for h, (n, k) in enumerate([(50, 2), (40, 1), (60, 58), (3, 3), (1, 1), (30, 0)]) for i in range(n)]
    said = quality.quality(spark.createDataFrame(docs, "doc_id long, source string, text string")).select(F.floor(F.col("doc_id") / 100).alias("h"), "host_failed").distinct().collect()
    verdict = {r["h"]: r["host_failed"] for r in said}
    assert verdict[2] == ["few_words"] and verdict[0] == verdict[1] == verdict[5] == []
    rates = {r["source"]: r for r in quality.host_rates(quality.text_counts(spark.createDataFrame(docs, "doc_id long, source string, text string"), ["doc_id", "source"]).withColumnRenamed("__1", "source"), "source", {"few": F.expr("n_words < 10")}).collect()}
    ns, ks = [50, 40, 60, 3, 1, 30], [2, 1, 58, 3, 1, 0]
    n, m = sum(ns), sum(ks) / sum(ns)
    s = sum(x * (k / x - m) ** 2 for x, k in zip(ns, ks, strict=True))
    r = (s - m * (1 - m) * 5) / (m * (1 - m) * (n - sum(x * x for x in ns) / n - 5))
    w = 1 / min(0.999, max(0.001, r)) - 1
    for h, (x, k) in enumerate(zip(ns, ks, strict=True)):
        assert rates[f"h{h}"]["rate_few"] == pytest.approx((k + w * m) / (x + w))
    kept = quality.keep_good(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    assert kept.columns == ["doc_id", "source", "text"]
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert {d[0] for d in docs if d[1] in ("h0", "h1", "h5") and d[2] == good} <= ids and not ids & {d[0] for d in docs if d[2] == bad or d[1] == "h2"}
