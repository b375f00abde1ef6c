"""Near-duplicate classes against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import components, jaccard_join, queries

from .cases import HARD, SF, documents, empty, hard


def sets(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, p, q):
    docs = list(docs)
    s = [sets(t, n) for _, t in docs]
    of = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            of[g].append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(s):
        if docs[i][0] is None:
            continue
        shared = Counter(j for g in x for j in of[g] if j < i and docs[j][0] is not None)
        for j, k in shared.items():
            if q * k >= p * (len(x) + len(s[j]) - k):
                root[find(i)] = find(j)
    best = defaultdict(list)
    for i in range(len(docs)):
        best[find(i)].append(docs[i][0])
    return Counter((d, len(x), None if d is None else min(y for y in best[find(i)] if y is not None)) for i, ((d, _), x) in enumerate(zip(docs, s, strict=True)))


def family(seed, n=150):
    rnd = random.Random(seed)
    out, words = [], [f"w{i}" for i in range(3000)]
    base = [rnd.choices(words, k=rnd.choice([3, 8, 20, 60, 200])) for _ in range(6)]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.2:
            w += rnd.choices(words, k=rnd.randrange(4))
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("n", "p"), [(3, 90), (5, 80)])
def test_classes(spark, n, p):
    docs = family(n)
    got = jaccard_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"), n, p, 100).collect()
    assert Counter(map(tuple, got)) == brute(docs, n, p, 100)


def test_a_thousand_near_texts_without_links(spark):
    """One phrase in all of them, so that they meet, but hardly any link: parts meet parts, none is left out."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = rnd.choices(words, k=60)
    docs = [(i, " ".join(base[: rnd.choice([38, 40])] + rnd.choices(words, k=rnd.choice([12, 14])))) for i in range(1000)]
    docs += [(1000 + i, docs[17 * i][1] + " " + rnd.choice(words)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 5, 80, 100)
    assert 900 < len({c for _, _, c in want}) <= 1010
    for block in (1000, 64):
        assert Counter(map(tuple, jaccard_join.similar_classes(df, block=block).collect())) == want


def test_a_dense_group_is_not_paired_by_the_square(spark, monkeypatch):
    """Links are many but each node has few, and pairs share many keys: the join's rows grow with the group, and a pair comes from one key."""
    made, real = [], jaccard_join.open_pairs

    def counted(*args, **more):
        left, pairs = real(*args, **more)
        made.append((pairs.count(), pairs.distinct().count()))
        return left, pairs

    monkeypatch.setattr(jaccard_join, "open_pairs", counted)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for n in (300, 600):
        docs = []
        for i in range(n):
            w = list(base)
            for at in rnd.sample(range(2, 118), 3):
                w[at] = f"x{i}-{at}"
            docs.append((i, " ".join(w)))
        made.clear()
        got = jaccard_join.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"), near=16).collect()
        assert Counter(map(tuple, got)) == brute(docs, 5, 80, 100)
        assert len(made) < 2 or made[-1][0] == made[-1][1]
        rows[n] = sum(m for m, _ in made)
    assert rows[600] <= max(3 * rows[300], 6000), rows


def test_pairs_come_from_one_key(spark):
    """Two nodes that share 40 keys are one pair, of whatever keys the lists hold; lists without a common key lose none."""
    s = [0] * jaccard_join.WORDS
    facts = spark.createDataFrame([(i, 50, *s, 3, s, s) for i in range(4)], "node long, n long, " + ", ".join(f"s{j} long" for j in range(8)) + ", own int, here array<long>, next array<long>")
    # 0 and 1 share 40 keys, 2 and 3 only their greatest one
    meets = [(k, 0, n, 3, n, 2) for k in range(40) for n in (0, 1)] + [(k + 40 * n, 0, n, 3, n, 2) for n in (2, 3) for k in range(0, 40)] + [(900, 0, n, 3, n, 2) for n in (2, 3)]
    left = spark.createDataFrame(meets, "key long, part int, node long, band int, component long, of long")
    for listed, most in ((32, 2), (1, 2), (0, 41)):
        pairs = jaccard_join.open_pairs(left, facts, 80, 100, 1000, listed=listed)[1].collect()
        assert {tuple(r) for r in pairs} == {(0, 1), (2, 3)} and len(pairs) == most


def test_query_and_hard_rows(spark):
    assert Counter(map(tuple, queries.op9_jaccard_join(spark, SF).collect())) == brute(documents().items(), 3, 90, 100)
    assert Counter(map(tuple, jaccard_join.similar_classes(hard(spark), 3, 90).collect())) == brute(HARD, 3, 90, 100)
    assert jaccard_join.similar_classes(empty(spark)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for p in (80, 90):
        bands = jaccard_join.Bands(p, 100)
        for _ in range(300):
            size = int(rng.integers(1, 400))
            most = size * (100 - p) // (100 + p)
            a = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
            cut = int(rng.integers(0, most + 1))
            x, y = np.unique(a[:size]), np.unique(np.concatenate([a[cut:size], a[size : size + cut]]))
            both = len(np.intersect1d(x, y))
            if 100 * both < p * (len(x) + len(y) - both):
                continue
            row = np.repeat([0, 1], [len(x), len(y)])
            r, k, band, spare = jaccard_join.signatures(row, np.concatenate([x, y]), np.array([0, 1]), bands)
            shared = np.intersect1d(k[r == 0], k[r == 1])
            assert shared.size
            for j in set(band[r == 0]) & set(band[r == 1]):
                assert np.isin(shared, k[band == j]).sum() > spare[band == j].max()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(140)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(got[x] == find(x) for x in root if x in got) and all(x in got for a, b in edges if a != b for x in (a, b))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1_000_000])
def test_components_of_small_chunks(spark, chunk):
    """Long paths in either order, a hub, a clique and repeated edges, where tasks alone can finish nothing and where they finish all."""
    rnd = random.Random(5)
    path = rnd.sample(range(1000, 2000), 200)
    edges = [(i, i + 1) for i in range(100)] + list(zip(path, path[1:])) + [(5000, i) for i in range(4900, 5000)] + [(6000 + i, 6000 + j) for i in range(12) for j in range(12)] * 2
    rnd.shuffle(edges)
    got = components.components(spark.createDataFrame([*edges, (8000, 8000), (None, 3), (4, None)], "a long, b long"), chunk).collect()
    want = {i: 0 for i in range(101)} | {i: min(path) for i in path} | {i: 4900 for i in range(4900, 5001)} | {6000 + i: 6000 for i in range(12)}
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_forest():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        a, b = rnd.integers(-40, 40, (2, rnd.integers(1, 60)))
        node, least = components.forest(a, b)
        label = {int(x): int(x) for x in [*a, *b]}
        for _ in range(len(a)):
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
        assert dict(zip(node.tolist(), least.tolist())) == {k: v for k, v in label.items() if k != v}


def test_texts_and_sets_reach_python_in_small_batches(spark, monkeypatch):
    """What a task holds outside Spark's own memory is bounded: batches, words in hand, and no Python processes beside those of the scans."""
    given, real = {}, jaccard_join.written

    def seen(df, name):
        given.setdefault(name, []).append((int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), "MapInArrow" in df._jdf.queryExecution().toString()))
        return real(df, name)

    monkeypatch.setattr(jaccard_join, "written", seen)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("starts Python processes on the executors"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert jaccard_join.similar_classes(docs).count() == docs.count()
    assert {"keys", "signatures", "sets", "links"} <= {name for name, of in given.items() for _, python in of if python}
    assert all(rows <= 2000 for of in given.values() for rows, python in of if python)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_words_in_hand_are_bounded():
    """A task's arrays are of a piece of its texts, some 60 bytes for each byte."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(3000)], k=400)) for _ in range(2000)]
    data, off = jaccard_join.K.flat(pa.array(texts))
    tracemalloc.start()
    for lo, hi in jaccard_join.K.pieces(off, jaccard_join.PIECE):
        row, g = jaccard_join.shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], 5)
        jaccard_join.signatures(row, g, np.arange(hi - lo), jaccard_join.Bands(80, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
