"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairlens.llm import queries, repeats

from .cases import HARD, SF, documents, empty, hard


def brute(docs, least=50):
    docs = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in docs:
        if i is not None:
            for p in range(len(b) - least + 1):
                w = b[p : p + least]
                first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - least + 1):
                if first[b[p : p + least]] < i:
                    gone[p : p + least] = True
        runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[(i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def family(seed):
    rnd = random.Random(seed)
    part = lambda n: "".join(rnd.choice("abcd efg\n") for _ in range(n))
    shared = [part(rnd.randrange(45, 200)) for _ in range(8)]
    return [(rnd.randrange(1000), "".join(rnd.choice([rnd.choice(shared), rnd.choice(shared)[rnd.randrange(20) :], part(rnd.randrange(30))]) for _ in range(rnd.randrange(6)))) for _ in range(60)]


@pytest.mark.parametrize("rows", [20_000, 3])
def test_repeats(spark, rows):
    docs = [*family(rows), (5000, "ab" * 300), (5001, "ab" * 200), (5002, "é" * 60), (5003, "é" * 90)]
    got = repeats.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"), group_rows=rows, bucket_rows=50).drop("spans").collect()
    assert Counter(map(tuple, got)) == brute(docs)


def test_query_and_hard_rows(spark):
    assert Counter(map(tuple, queries.op4_repeats(spark, SF).collect())) == brute(documents().items())
    assert Counter(map(tuple, repeats.drop_repeats(hard(spark)).drop("spans").collect())) == brute(HARD)
    assert repeats.drop_repeats(empty(spark)).count() == 0


def test_maximal_repeats():
    """All occurrences of every maximal repeat, by comparing every pair of places."""
    rnd = random.Random(4)
    shared = "".join(rnd.choice("abc") for _ in range(30)).encode()
    texts = [("".join(rnd.choice("abc") for _ in range(rnd.randrange(10)))).encode() + shared[rnd.randrange(3) :] + bytes(rnd.choices(b"xyz", k=rnd.randrange(6))) for _ in range(12)]
    least = 20
    windows = np.array([max(len(t) - least + 1, 1) for t in texts])
    got = {(length, tuple(sorted(zip(a.tolist(), b.tolist(), strict=True)))) for length, a, b in repeats.maximal_repeats(texts, windows, np.zeros(len(texts), int), least)}
    want = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for e in range(a + least, len(t) + 1):
                want[t[a:e]].add((i, a))
    full = set()
    for s, of in want.items():
        if len(of) < 2:
            continue
        after = {texts[i][a + len(s) : a + len(s) + 1] or (i, "end") for i, a in of}
        before = {texts[i][a - 1 : a] if a else (i, "start") for i, a in of}
        if len(after) > 1 and len(before) > 1:
            full.add((len(s), tuple(sorted(of))))
    assert got == full


def test_a_filter_with_too_many_hashes_is_coarser_but_there(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pairlens.llm import bloom

    monkeypatch.setattr(bloom, "GROUP", 300_000)
    hashes = spark.range(2_000_000).select(F.xxhash64("id").alias("h"))  # 12 bits each would be 2.9 MB
    some = bloom.Filter(hashes, "h", 1)
    ask = np.array([r[0] for r in spark.range(3_000_000).filter("id % 1000 = 0").select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    held = some.may_hold(ask)
    assert held[:2000].all() and held[2000:].mean() < 0.3 and len(some.bits) == 1 << 20
    assert bloom.Filter(hashes, "h", 0).may_hold(ask).all()
