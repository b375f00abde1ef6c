"""Alignment of two tokenizers: groups of tokens that cover the same bytes, links inside them, and their counts in the corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: How a byte-level file splits texts when it names no pattern of its own, and its marks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
SPACE_MARK = "▁"
SETTLED = "Ͱ"  # below it, letters, numbers and white space are the same to all Unicode tables
CHUNK = 1 << 21  # bytes of text at a time
LONG = 2000  # characters of a word


class BytePairs:
    """Tokenizer A: ids of texts, and the bytes of each id.

    The ranks of the file's merges go to the faster of the two installed encoders where the file's splitter and model are
    those it relies on; other files, and texts with characters on which Unicode tables may differ, go to the file's own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(map(letter.__getitem__, token))
        self.fast = None
        model = {k: spec["model"].get(k) for k in MERGES}
        split = {k: (spec.get("pre_tokenizer") or {}).get(k) for k in BYTE_LEVEL}
        merged = [bytes(map(letter.__getitem__, m.replace(" ", "") if isinstance(m, str) else "".join(m))) for m in spec["model"]["merges"]]
        in_order = all(self.bytes[256 + i] == m for i, m in enumerate(merged))
        if {**model, "ignore_merges": bool(model["ignore_merges"])} == MERGES and split == BYTE_LEVEL and spec["pre_tokenizer"].get("use_regex", True) and not spec.get("normalizer") and in_order:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b and i < 256 + len(merged)}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.fast and (t.isascii() or max(t) < SETTLED):
                out[i] = self.fast.encode_ordinary(t)
            elif self.fast and len(t) > LONG and max(map(len, t.split()), default=0) > LONG:
                # the file's own tokenizer takes time with the square of a word's length; its splitter does not
                out[i] = [x for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(t) for x in self.piece.encode_ordinary(t[a:b])]
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out


class Pieces:
    """Tokenizer B: ids of texts, to which it puts a space in front itself, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = self.model.id_to_piece(list(range(size)))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token, both numbered from 0.

    B's tokens are a static index of intervals, sorted by end and by start at once. Each A token is a stabbing query: by
    bisection, the first B token that ends behind its start and the last that starts before its end. Where no B token is stabbed by
    two neighbouring A tokens the gap between them is spanned by nothing, and a group ends.
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_starts = np.concatenate([[0], a_ends[:-1]])
    b_starts = np.concatenate([[0], b_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left") - 1
    of_a = np.concatenate([[0], np.cumsum(last[:-1] < first[1:])])
    size = np.zeros(len(b_ends), np.int64)
    opens = np.concatenate([[True], of_a[1:] != of_a[:-1]])
    size[first[opens]] = 1  # the first B token of each group
    return of_a, np.cumsum(size) - 1


def links(of_a: np.ndarray, of_b: np.ndarray, a: np.ndarray, b: np.ndarray, wide: int, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked id pairs as ``group, a * wide + b, times``: all A-B pairs of each group.

    A group of more than ``most`` pairs is first brought to its distinct ids with their numbers, so a long stretch
    that the tokenizers cut at different places costs its distinct pairs, not the product of its lengths.
    """
    if not len(a):
        z = np.zeros(0, np.int64)
        return z, z, z
    n = int(of_a[-1]) + 1
    na, nb = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    large = na * nb > most
    out = []

    def product(g_a, x, nx, g_b, y, ny):
        """Of rows sorted by group: every x with every y of its group."""
        size = np.bincount(g_b, minlength=n)
        begin = np.cumsum(size) - size
        times = size[g_a]
        at = np.repeat(np.arange(len(x)), times)
        step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        other = begin[g_a[at]] + step
        out.append((g_a[at], x[at] * wide + y[other], nx[at] * ny[other]))

    sa, sb = ~large[of_a], ~large[of_b]
    product(of_a[sa], a[sa], np.ones(int(sa.sum()), np.int64), of_b[sb], b[sb], np.ones(int(sb.sum()), np.int64))
    if large.any():
        span = 1 << 32
        ka, ca = np.unique(of_a[~sa] * span + a[~sa], return_counts=True)
        kb, cb = np.unique(of_b[~sb] * span + b[~sb], return_counts=True)
        product(ka // span, ka % span, ca, kb // span, kb % span, cb)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Written:
    """Ids as decimal text with the mark behind each, for many ids at once."""

    MARKS = b",|;"

    def __init__(self, n: int) -> None:
        self.size = np.array([len(str(i)) + 1 for i in range(n)], np.int64)
        width = int(self.size.max())
        self.table = np.array([[f"{i}{m}".encode() for m in ",|;"] for i in range(n)], f"S{width}")

    def __call__(self, ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        said = np.frombuffer(self.table[ids, mark].tobytes(), np.uint8)
        return said[said != 0], np.cumsum(self.size[ids])


_loaded: dict[tuple[str, str], tuple] = {}


def loaded(a_path: str, b_path: str) -> tuple:
    if (a_path, b_path) not in _loaded:
        a, b = BytePairs(a_path), Pieces(b_path)
        sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)]
        _loaded[a_path, b_path] = (a, b, *sizes, Written(max(len(a.bytes), len(b.bytes))))
    return _loaded[a_path, b_path]


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys by their steps, and numbers, byte by byte of equal place, compressed."""
    import zstandard

    steps = np.diff(keys, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    numbers = times.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes() + numbers.tobytes())


def unpack_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps.astype(np.int64)), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def aligned(texts: list[str], a_path: str, b_path: str) -> list[tuple[int, int, int, int, str, bytes]]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, packed distinct pairs."""
    A, B, a_size, b_size, written_ids = loaded(a_path, b_path)
    spaced = [f" {t}" for t in texts]
    ids_a, ids_b = A(spaced), B(texts)
    wanted = [s.encode() for s in spaced]
    ok = [
        bool(t) and b"".join(map(A.bytes.__getitem__, x)) == w and b"".join(map(B.bytes.__getitem__, y)) == w for t, x, y, w in zip(texts, ids_a, ids_b, wanted, strict=True)
    ]
    good = [i for i, k in enumerate(ok) if k]
    out: list = [(0, 0, 0, 0, "", b"")] * len(texts)
    if not good:
        return out
    n_a, n_b = np.array([len(ids_a[i]) for i in good]), np.array([len(ids_b[i]) for i in good])
    a = np.fromiter((x for i in good for x in ids_a[i]), np.int64, int(n_a.sum()))
    b = np.fromiter((x for i in good for x in ids_b[i]), np.int64, int(n_b.sum()))
    # All texts one after another: each ends a token of both, so groups never cross texts.
    of_a, of_b = groups(np.cumsum(a_size[a]), np.cumsum(b_size[b]))
    n = int(of_a[-1]) + 1
    in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    text_of = np.repeat(np.arange(len(good)), n_a)[np.cumsum(in_a) - 1]  # of each group
    n_groups = np.bincount(text_of, minlength=len(good))
    n_links = np.bincount(text_of, weights=in_a * in_b, minlength=len(good)).astype(np.int64)
    # the groups in writing: A's ids, then B's, of each group
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    both = np.empty(len(a) + len(b), np.int64)
    mark = np.zeros(len(both), np.int64)
    both[np.arange(len(a)) + before_b[of_a]] = a
    both[np.arange(len(b)) + (before_a + in_a)[of_b]] = b
    mark[before_a + before_b + in_a - 1] = 1
    mark[before_a + before_b + in_a + in_b - 1] = 2
    said, ends = written_ids(both, mark)
    last = ends[np.cumsum(n_a + n_b) - 1]
    # the distinct pairs of each text
    wide = len(B.bytes)
    group, key, times = links(of_a, of_b, a, b, wide)
    at = text_of[group]
    span = len(A.bytes) * wide
    order = np.argsort(at * span + key, kind="stable")
    at, key, times = at[order], key[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])]))
    times, key, at = np.add.reduceat(times, new), key[new], at[new]
    cut = np.searchsorted(at, np.arange(len(good) + 1))
    begin = 0
    for j, i in enumerate(good):
        sha = hashlib.sha256(said[begin : last[j] - 1].tobytes()).hexdigest()
        begin = last[j]
        out[i] = (int(n_a[j]), int(n_b[j]), int(n_groups[j]), int(n_links[j]), sha, pack_pairs(key[cut[j] : cut[j + 1]], times[cut[j] : cut[j + 1]]))
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters, one text at least."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > CHUNK:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def token_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id, __row, n_a, n_b, n_groups, n_links, groups_sha256, pairs``: each text's alignment and its distinct linked id pairs, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                got = aligned(texts[lo:hi], a_path, b_path)
                numbers = [pa.array([g[k] for g in got], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo)), *numbers, pa.array([g[4] for g in got], pa.string()), pa.array([g[5] for g in got], pa.binary())],
                    ["__id", "__row", *FACTS, "groups_sha256", "pairs"],
                )
                row += hi - lo

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"__id {kind}, __row long, {', '.join(f'{f} long' for f in FACTS)}, groups_sha256 string, pairs binary")


def pair_counts(linked: DataFrame, most: int = 1 << 21) -> DataFrame:
    """``key, n``: in how many documents each id pair is linked. Tasks add up ``most`` pairs before they send any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for packed in batch.column(0):
                if p := packed.as_py():
                    key, _ = unpack_pairs(p)
                    held.append(key)
                    size += len(key)
                    if size >= most:
                        yield sent()
                        size = 0
        if held:
            yield sent()

    return linked.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = 1 << 22) -> DataFrame:
    """Per document: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Texts are tokenised once, in the tasks that read them; what is kept of each is a row with its counts and its distinct
    linked pairs. Those are counted over all documents, and the counts, with the mark of each A id's highest,
    go to the tasks in blocks of about ``block_pairs`` pairs of neighbouring A ids: a broadcast of at most some 17 bytes a pair, one
    block after another. The number of blocks is bounded by the product of the vocabularies, not by the corpus. Counts of a document from
    several blocks are added up.

    A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens and
    zeros. Repeated rows are documents of their own. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8"):
        pass  # a wrong path fails here, not in the tasks
    wide = len(Pieces(b_path).bytes)
    linked = written(token_links(docs, a_path, b_path, id_col, text_col), "alignment-links")
    counted = written(pair_counts(linked), "alignment-counts")
    a = F.floor(F.col("key") / wide)
    best = counted.groupBy(a.cast("int").alias("a")).agg(F.max("n").alias("best"), F.count(F.lit(1)).alias("pairs"))
    # blocks of neighbouring A ids; there are no more of them than the vocabulary has
    ids = best.select("a", "pairs").orderBy("a").collect()
    ends, size = [], 0
    for r in ids:
        if size and size + r["pairs"] > block_pairs:
            ends.append(r["a"])
            size = 0
        size += r["pairs"]
    block = F.lit(0)
    for e in ends:
        block = block + (F.col("a") >= e).cast("int")
    marked = counted.withColumn("a", a.cast("int")).join(best.select("a", "best"), "a").select("key", "n", (F.col("n") == F.col("best")).alias("top"), block.alias("block"))

    def build(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key)
        n = table.column("n").to_numpy()[order]
        top = table.column("top").to_numpy(zero_copy_only=False)[order]
        data = key[order].astype("<i8").tobytes() + n.astype("<i8").tobytes() + top.astype(np.uint8).tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([data], pa.binary())})

    built = written(marked.groupBy("block").applyInArrow(build, "block int, data binary"), "alignment-blocks")
    sums = []
    for i in range(len(ends) + 1):
        data = built.filter(F.col("block") == i).select("data").head()
        if data is None:  # no pairs at all
            continue
        shipped = spark.sparkContext.broadcast(bytes(data[0]))
        sums.append(_sums(linked, shipped))
        if ends:
            sums[-1] = written(sums[-1], "alignment-sums")
            shipped.unpersist()
    facts = linked.select("__row", F.col("__id").alias(id_col), *FACTS, "groups_sha256")
    if not sums:
        out = facts.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    elif len(sums) == 1:
        out = sums[0].withColumnRenamed("__id", id_col)
    else:
        both = sums[0]
        for s in sums[1:]:
            both = both.unionByName(s)
        same = [F.first(c).alias(c) for c in ("__id", *FACTS, "groups_sha256")]
        out = both.groupBy("__row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).withColumnRenamed("__id", id_col)
    discard(counted, built)
    return out.select(id_col, *FACTS, "n_best", "count_sum", "groups_sha256")


def _sums(linked: DataFrame, block) -> DataFrame:
    """Each document's links that are its A id's most frequent, and the sum of its links' counts, as far as the block has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.value) // 17
        key = np.frombuffer(block.value, "<i8", n)
        count = np.frombuffer(block.value, "<i8", n, 8 * n)
        top = np.frombuffer(block.value, np.uint8, n, 16 * n)
        for batch in batches:
            best, total = [], []
            for packed in batch.column(batch.num_columns - 1):
                mine, times = unpack_pairs(packed.as_py()) if packed.as_py() else (key[:0], key[:0])
                lo, hi = np.searchsorted(mine, [key[0], key[-1] + 1])
                mine, times = mine[lo:hi], times[lo:hi]
                at = np.searchsorted(key, mine)
                best.append(int((times * top[at]).sum()))
                total.append(int((times * count[at]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*batch.schema.names[:-1], "n_best", "count_sum"])

    columns = ["__row", "__id", *FACTS, "groups_sha256", "pairs"]
    schema = ", ".join(f"{c} {linked.schema[c].dataType.simpleString()}" for c in columns[:-1])
    return linked.select(*columns).mapInArrow(run, f"{schema}, n_best long, count_sum long")
