"""Language-model scores and the toxicity classifier."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.llm import lm_score, queries, toxicity

from .cases import HARD, SF, documents, empty, hard, rows


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end> "]


def check_base(got, docs):
    """Exact columns, by brute force; docs: (id, text, learned from)."""
    c = Counter(w for _, t, u in docs if u for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, u in docs:
        w = toks(t)
        want[(i, not u, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((r[0], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want


def test_lm_scores(spark):
    got = queries.op3_lm_scoring(spark, SF).collect()
    check_base(got, [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in documents().items()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in got)
    for head in (1 << 17, 0, 5):  # exact counts by broadcast, by join, by both
        got = lm_score.lm_score(hard(spark), F.expr("doc_id % 5 != 4"), head=head)
        got = got.withColumn("held_out", ~F.col("used")).collect()
        check_base(got, [(i, t, i is None or i % 5 != 4) for i, t in HARD])
    assert lm_score.lm_score(empty(spark), F.lit(True)).count() == 0
    none = lm_score.lm_score(hard(spark), F.lit(False)).collect()
    assert len(none) == len(HARD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


def test_texts_come_in_small_batches(spark):
    """A task's working memory follows a batch, and a batch was ten thousand texts; a model that was shipped is let go."""
    sizes, shipped = [], []
    ship = spark.sparkContext.broadcast
    write = lm_score.written

    def spied(df, name):
        sizes.append((name, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return write(df, name)

    def kept(value):
        shipped.append(ship(value))
        return shipped[-1]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        lm_score.written, spark.sparkContext.broadcast = spied, kept
        assert lm_score.lm_score(hard(spark), F.lit(True)).count() == len(HARD)
    finally:
        lm_score.written = write
        del spark.sparkContext.broadcast
    assert dict(sizes) == {"ngrams": lm_score.BATCH_ROWS, "scored": lm_score.BATCH_ROWS} and lm_score.BATCH_ROWS <= 2000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(shipped) == 1 and shipped[0]._jbroadcast is None or not shipped[0]._jbroadcast.isValid()


def test_filter_holds_quantised_counts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(400) if i % (j // 4 + 1) == 0)) for i in range(300)], "doc_id long, text string")
    model, counts = lm_score.fit(docs, F.lit(True))
    exact = {r["key"]: r["n"] for r in counts.collect()}
    key = np.array(list(exact), np.int64).view(np.uint64)
    got = model.levels(key, 1)
    want = np.array([1 + math.floor(math.log(n) / math.log(lm_score.BASE) + 1e-9) for n in exact.values()])
    assert (got >= want).all() and (got == want).mean() > 0.97  # errors are one-sided and rare
    stranger = lm_score.K.mix(np.arange(1, 20_001, dtype=np.uint64))
    assert (model.levels(stranger, 1) > 0).mean() < 0.02


def test_all_pairs_count_and_a_filter_of_any_size_scores_alike(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i % 3} d") for i in range(50)], "doc_id long, text string")
    model, *_ = lm_score.fit(docs, F.lit(True))
    row, h = lm_score.tokens(*lm_score.K.flat(pa.array([r["text"] for r in docs.collect()])))
    assert (model.levels(lm_score.pairs(row, h)[1], 2) >= 1).all()  # most of them are seen once
    for d, used in ((spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), F.expr("doc_id % 7 != 2")), (hard(spark), F.expr("doc_id % 5 != 4")), (empty(spark), F.lit(True)), (hard(spark), F.lit(False))):
        whole, asked = (Counter(map(tuple, lm_score.lm_score(d, used, most_filter_mb=mb).select("doc_id", "used", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6)).collect())) for mb in (512, 0))
        assert whole == asked and whole.total() == d.count()


def test_ngrams_of_a_large_filter_go_once(spark, monkeypatch):
    """Texts are written alone, levels come back with exact counts, and pieces that a scan cuts score alike; ranges are for all texts, learned from or not."""
    names, write = [], lm_score.written
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(2).cache()
    score = lambda **k: Counter(map(tuple, lm_score.lm_score(d, F.expr("doc_id % 7 = 2"), bucket_bytes=10_000, **k).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6)).collect()))
    whole = score()

    def spied(df, name):
        out = write(df, name)
        names.append((name, out.columns, {r[0] for r in out.select("order").distinct().collect()} if name == "answers" else out.count()))
        if name == "pieces":  # each row group becomes a task's
            out.repartition(7).sortWithinPartitions("piece", "at").write.parquet(out.written_path + "-cut")
            cut = spark.read.schema(out.schema).parquet(out.written_path + "-cut")
            cut.written_path = out.written_path
            return cut
        return out

    monkeypatch.setattr(lm_score, "written", spied)
    assert score(most_filter_mb=0) == whole and whole.total() == d.count()
    assert [n for n, *_ in names] == ["pieces", "answers", "scored"] and names[0][1] == ["piece", "at", "id", "used", "text"] and names[0][2] == d.count()
    size, buckets = lm_score.ranges(d, "text", 10_000)
    assert size == sum(len((r["text"] or "").encode()) for r in d.collect()) and buckets == size // 10_000
    d.unpersist()


def test_words_take_little_memory():
    """The same hashes as byte by byte; what is held beside the text does not grow by tens of bytes a byte."""
    K = lm_score.K  # noqa: N806
    texts = ["Some words, AND é", "", None, "x" * (K.CUT + 7) + " b", "a " * K.CUT, "y" * K.CUT]
    row, starts, stops, h = K.words(*K.flat(pa.array(texts)))
    data, mask = K.flat(pa.array(texts))[0], (1 << 64) - 1
    power = [1]
    for _ in range(K.CUT + 7):
        power.append(power[-1] * int(K._P) & mask)
    plain = [sum(int(K.BYTE[K.LOWER[b]]) * power[i] for i, b in enumerate(data[a:e].tolist())) + int(e - a) & mask for a, e in zip(starts[:9].tolist(), stops[:9].tolist(), strict=True)]
    assert (h[:9] == K.mix(np.array(plain, np.uint64))).all() and (stops - starts)[-1] == K.CUT
    assert Counter(row.tolist()) == {0: 4, 3: 2, 4: K.CUT, 5: 1}
    data, offsets = K.flat(pa.array(["some plain words of a text " * 40_000]))
    tracemalloc.start()
    K.words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)


def test_scores_are_those_of_a_plain_model(spark):
    """Every score by dictionaries of the levels that the filter tells, token by token."""
    docs = {i: t for i, t in documents().items() if t is None or len(t) < 3000}
    docs[10**6], docs[10**6 + 1] = "never seen Before never", None
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    used = F.expr("doc_id % 3 != 0 and doc_id < 1000000")
    m, _ = lm_score.fit(df, used)
    words, both = Counter(), Counter()
    for i, t in docs.items():
        if i % 3 and i < 10**6:
            w = toks(t)
            words.update(w)
            both.update(zip(["<start> ", *w], w))  # noqa: B905
    lev = lambda n: 1 + math.floor(math.log(n) / math.log(lm_score.BASE) + 1e-9) if n else 0
    mean = [{k: sum(v) / len(v) for k in {lev(n) for n in c.values()} for v in [[n for n in c.values() if lev(n) == k]]} for c in (words, both)]
    for order in (0, 1):
        assert all(abs(m.value[order][k] - v) < 1e-9 for k, v in mean[order].items())
    n, v = sum(words.values()), len(words)
    one = lambda w: mean[0].get(lev(words["<end> " if w == "<start> " else w]), 0)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_score(df, used).collect()}
    alike = 0
    for i, t in docs.items():
        w, want = toks(t), 0.0
        for a, b in zip(["<start> ", *w], w):  # noqa: B905
            p = (1 - v / (n + v)) * one(b) / n if one(b) else v / (n + v)
            if one(a):
                p = m.weight * min(mean[1].get(lev(both[a, b]), 0) / max(one(a), 1), 1) + (1 - m.weight) * p
            want += math.log10(p)
        alike += abs(got[i] - want) < 1e-6
        assert abs(got[i] - want) < 0.02 * abs(want) + 1e-6  # a probe in some hundred errs
    assert alike > 0.3 * len(docs)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0, per_class=1500)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.join(labels, "doc_id"), model, keep_columns=["doc_id", "toxic"]).collect()}
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    s, y = np.array([r["score"] for r in held]), np.array([r["toxic"] for r in held])
    rank = s.argsort().argsort()
    n1, n0 = y.sum(), (1 - y).sum()
    assert (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.9
    assert y[s >= 0.5].mean() > 0.85
    result = toxicity.toxicity(hard(spark), model)
    assert result.columns == [*[c for c in hard(spark).columns if c not in ("score", "threshold", "rejected")], "score", "threshold", "rejected"]
    rows_ = result.collect()
    assert len(rows_) == len(HARD) and all(0 <= r["score"] <= 1 and r["threshold"] == 0.5 for r in rows_)
    beside = toxicity.toxicity(hard(spark), model, results=("s", "t", "r"))
    assert beside.columns == [*hard(spark).columns, "s", "t", "r"] and all(r["score"] == 7 and 0 <= r["s"] <= 1 for r in beside.collect())
    assert toxicity.toxicity(empty(spark), model).count() == 0
    none = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.toxicity(hard(spark), none).collect()} == {0.5}


def test_vocabulary():
    texts = ["a b a longerword", "", "b longerword2 B"]
    words = toxicity.Vocabulary(texts)
    for text, places in zip(texts, words.texts, strict=True):
        assert (words.features[places] == toxicity.features(*toxicity.K.flat(pa.array([text])))[1]).all()
    assert len(words.features) == 4 and toxicity.Vocabulary([]).texts == []


def test_thresholds_come_from_all_labelled_rows(spark):
    rows_ = [(i, "fr" if i % 20 == 7 else "es" if i % 100 == 3 else "en", f"w{i % 11} {'vile' if i % 3 == 0 else 'kind'} w{i % 7}", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows_, "doc_id long, lang string, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True), per_class=20)
    assert set(model.cuts) == {"en", "fr"}  # es has six rows only, and the threshold of all
    got = toxicity.toxicity(docs.unionByName(docs.limit(1).withColumn("lang", F.lit(None).cast("string"))), model).collect()
    assert {r["lang"]: r["threshold"] for r in got} == {**model.cuts, "es": model.other_cut, None: 0.5}
    low = [("a", 1, b, 2) for b in range(60, 70)] + [("a", 0, b, 3) for b in range(40, 62)] + [("b", 1, 900, 3), ("b", 0, 10, 90)]
    cuts, other = toxicity.thresholds(low, {0: 1.0, 1: 0.5})

    def f1(rows_, c):
        tp, fp = (sum(n * w for _, y, b, n in rows_ if y == k and b >= c) for k, w in ((1, 0.5), (0, 1.0)))
        return 2 * tp / (sum(n * 0.5 for _, y, _, n in rows_ if y) + tp + fp)

    for c, of in ((cuts["a"], [r for r in low if r[0] == "a"]), (other, low)):
        assert f1(of, c * toxicity.BINS) == max(f1(of, b) for b in range(toxicity.BINS + 1)) and c < 0.25
    assert set(cuts) == {"a"}


def test_toxicity_query(spark):
    got = queries.op5_toxicity(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert rows("labels")
