"""Best-fit packing of token sequences by linear grouping.

The driver plans on the histogram of lengths alone (at most ``capacity`` numbers, whatever the input's
size); the pieces are numbered within their length and find their place on the workers.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ODD_SPACE = tuple(map(chr, range(0x1C, 0x20)))  # white space to str.split, not to the tokenizer


# The normaliser, splitter and model settings of a tokenizer file for which words can be encoded one by one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
WORD_BY_WORD = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
]


class Encoder:
    """Texts to little-endian 32-bit ids, with a bounded memory of the words met before.

    The tokenizer drops white space and never lets a token cross it, so a text's ids are those of its
    white-space-separated words, one after another. Texts with characters that Python alone holds for
    white space are encoded whole. So is every text where the file's own normaliser, splitter or model is not what
    the shortcut relies on (WORD_BY_WORD): any tokenizer file gives its own ids.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer_file(path))
        model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
        self.by_word = (
            [spec["normalizer"], spec["pre_tokenizer"], model] == WORD_BY_WORD
            and spec.get("post_processor") is None
            and all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
        )
        self.tokenizer, self.most, self.known, self.before, self.parts = Tokenizer.from_file(path), most, {}, {}, {}
        # The file's own split pattern, for words of Latin letters (no composition, one-to-one lower case).
        self.split = regex.compile(WORDS).findall
        self.split_ascii = re.compile(ASCII_WORDS).findall  # the same pieces of ASCII words in lower case
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in plain]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    @staticmethod
    def tokenizer_file(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def part(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letter.__getitem__, piece.encode()))
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()
        self.parts[piece] = ids
        return ids

    def learn(self, words: list[str]) -> None:
        rare, parts = [], self.parts
        if len(parts) > self.most:
            parts.clear()
        for w in words:
            if w.isascii() and "<|" not in w:
                x = w.lower()
                self.known[w] = (parts.get(x) or self.part(x)) if w.isalpha() else b"".join([parts.get(x) or self.part(x) for x in self.split_ascii(x)])
            elif max(w) < "\u0250" and "\u0130" not in w and "<|" not in w:
                self.known[w] = b"".join([parts.get(x) or self.part(x) for x in self.split(w.lower())])
            else:
                rare.append(w)
        for i in range(0, len(rare), 20_000):
            some = rare[i : i + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in ODD_SPACE):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most // 2:  # of the words met before, those that still occur stay
                self.before, self.known = self.known, {}
                new = set(words)
            before, unmet = self.before, []
            for w in new:
                if (ids := before.get(w)) is None:
                    unmet.append(w)
                else:
                    self.known[w] = ids
            self.learn(unmet)
        return b"".join(map(self.known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: ``__id, piece, start, length, ids_crc32``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        encode = _encoders.setdefault(tokenizer, None) or Encoder(tokenizer)
        _encoders[tokenizer] = encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                which, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = encode(text.as_py() or "") + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        which.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["__id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"__id {kind}, piece int, start long, length long, ids_crc32 long")


def _configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """Few sizes, each needed some times: (times, how many of each size) rows that cover every need.

    Column generation: the linear relaxation of the cutting-stock problem by a revised simplex method,
    whose new columns are best knapsacks by the current prices. Whole parts of the solution are taken;
    what is left over is packed first-fit, largest first.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    want, size = np.array(need, float), np.array(sizes)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            worth = np.where(size <= c, value[c - size] + prices, -1.0)
            j = int(np.argmax(worth))
            if worth[j] > value[c - 1] + 1e-12:
                value[c], took[c] = worth[j], j
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[took[c]] += 1
                c -= sizes[took[c]]
        x, d = np.linalg.solve(basis, want), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.maximum(np.linalg.solve(basis, want), 0)
    left, out = list(need), []
    for j in np.argsort(-x):
        column = [int(round(v)) for v in basis[:, j]]
        times = min([int(x[j] + 1e-6), *(left[i] // v for i, v in enumerate(column) if v)])
        if times > 0:
            out.append((times, column))
            left = [n - times * v for n, v in zip(left, column, strict=True)]
    while any(left):  # each round makes as many equal sequences as the needs allow
        column, room = [0] * k, capacity
        for i in sorted(range(k), key=lambda i: -sizes[i]):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        times = min(left[i] // v for i, v in enumerate(column) if v)
        out.append((times, column))
        left = [n - times * v for n, v in zip(left, column, strict=True)]
    return out


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = 24, large: float = 1 / 3) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first, count, sequence, offset) rows.

    The pieces ``first`` to ``first + count - 1`` of a length go to ``sequence`` and the following
    sequences, at ``offset`` of each. Everything is run-length coded, so time and memory depend on the
    number of different lengths, not on the number of pieces.

    Pieces over ``large * capacity`` are dealt, longest first, into ``groups`` groups of equal cardinality
    and rounded up to the longest of their group; the few sizes are packed by ``_configurations``; the real
    pieces take their group's slots; smaller pieces then go, largest first, where they fit best.
    """
    out: list[tuple[int, int, int, int, int]] = []
    next_sequence, first = 0, dict.fromkeys(histogram, 0)

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        out.append((length, first[length], count, sequence, offset))
        first[length] += count

    full = histogram.get(capacity, 0)
    if full:
        put(capacity, full, 0, 0)
        next_sequence = full
    big = [(s, n) for s, n in sorted(histogram.items(), reverse=True) if capacity > s > large * capacity and n]
    small = [(s, n) for s, n in sorted(histogram.items(), reverse=True) if s <= large * capacity and n]
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> (sequence, count) runs
    rooms: list[int] = []  # its keys, sorted

    def leave(room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((sequence, count))

    if big:
        total = sum(n for _, n in big)
        k = min(groups, total)
        dealt: list[list[list[int]]] = [[] for _ in range(k)]
        g, room = 0, total // k + (total % k > 0)
        for s, n in big:
            while n:
                take = min(n, room)
                dealt[g].append([s, take])
                n, room = n - take, room - take
                if not room:
                    g += 1
                    room = total // k + (g < total % k)
        sizes: list[int] = []
        stock: list[list[list[int]]] = []
        for part in filter(None, dealt):  # groups of the same largest length are one size
            if sizes and sizes[-1] == part[0][0]:
                stock[-1] += part
            else:
                sizes.append(part[0][0])
                stock.append(part)
        for times, column in _configurations(sizes, [sum(n for _, n in part) for part in stock], capacity):
            slots = [i for i, v in enumerate(column) for _ in range(v)]
            # each slot takes its own run of the group's pieces; the sequences are split where lengths change
            runs: list[list[list[int]]] = []
            for i in slots:
                want, mine = times, []
                while want:
                    take = min(want, stock[i][0][1])
                    mine.append([stock[i][0][0], take])
                    stock[i][0][1] -= take
                    want -= take
                    if not stock[i][0][1]:
                        stock[i].pop(0)
                runs.append(mine)
            done = 0
            while done < times:
                step = min(r[0][1] for r in runs)
                at = 0
                for r in runs:
                    put(r[0][0], step, next_sequence + done, at)
                    at += r[0][0]
                    r[0][1] -= step
                    if not r[0][1]:
                        r.pop(0)
                leave(capacity - at, next_sequence + done, step)
                done += step
            next_sequence += times
    for s, n in small:
        at = bisect.bisect_left(rooms, s)
        while n and at < len(rooms):
            room = rooms[at]
            sequence, count = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(at)
            each = room // s
            whole = min(count, n // each)
            for j in range(each):
                if whole:
                    put(s, whole, sequence, capacity - room + j * s)
            n -= whole * each
            leave(room - each * s, sequence, whole)
            if whole < count:
                for j in range(n):  # fewer than one sequence takes
                    put(s, 1, sequence + whole, capacity - room + j * s)
                leave(room - n * s, sequence + whole, 1)
                leave(room, sequence + whole + 1, count - whole - 1)
                n = 0
            at = bisect.bisect_left(rooms, s)
        if n:
            each = capacity // s
            whole, rest = divmod(n, each)
            for j in range(each):
                if whole:
                    put(s, whole, next_sequence, j * s)
            leave(capacity - each * s, next_sequence, whole)
            next_sequence += whole
            if rest:
                for j in range(rest):
                    put(s, 1, next_sequence, j * s)
                leave(capacity - rest * s, next_sequence, 1)
                next_sequence += 1
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, groups: int = 24, bucket_rows: int = 5_000) -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` tokens; one row per piece.

    Returns ``id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids followed by
    ``end_id``; only longer ones are cut, into pieces of ``capacity`` and a last shorter one. Equal lengths
    are numbered in hash buckets of about ``bucket_rows`` pieces, so a length that most documents share is
    not one task's work. The plan that is broadcast has at most some thousand rows a group of lengths,
    whatever the input's size.

    Null and empty texts are one piece, the end id. Repeated rows are packed once each. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(tokenised(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return pieces.select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = sorted(plan(histogram, capacity, groups))
    length, first, _, sequence, offset = (np.array(x, np.int64) for x in zip(*places, strict=True))
    shipped = spark.sparkContext.broadcast((length, first, sequence, offset))
    buckets = 1 + sum(histogram.values()) // bucket_rows
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.lit(buckets))
    keyed = pieces.withColumn("__b", bucket)
    before = keyed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "__b", (F.sum("n").over(Window.partitionBy("length").orderBy("__b")) - F.col("n")).alias("__before"))
    numbered = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__b").orderBy("__id", "piece")) - 1)
    ranked = (numbered.join(before, ["length", "__b"]) if buckets > 1 else numbered.withColumn("__before", F.lit(0).cast("long"))).select(
        "__id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__n")).alias("__rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = shipped.value
        key = length << 44 | first
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, size << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["__id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(place, f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("__id", id_col)
