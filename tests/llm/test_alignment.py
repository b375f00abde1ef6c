"""Token alignment against a plain loop over byte positions."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pairlens.llm import alignment, queries

from .cases import HARD, SF, documents, empty, hard

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a▁b", "▁", "naïve café <|endoftext|> <s> </s> <unk>", "-" * 3001, "x-" * 700, "日本語のテキスト", "𝄞" * 50, "  two  spaces ", "tab\tnew\nline", "\u0085  ² ½ 12 345 it's I'LL", "ẞ͸"]


def plain(texts):
    """What the contract says, from the tokenizers' own calls and one loop over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # the same vocabulary: only for words so long that the first takes minutes
    of_text = lambda t: fast.encode_ordinary(t) if max(map(len, t.split()), default=0) > 1500 else tok.encode(t, add_special_tokens=False).ids
    marks = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in marks} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in marks)}
    of_a = lambda i: bytes(letter[c] for c in tok.id_to_token(i))

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    out, linked = [], []
    for t in texts:
        a, b = (of_text(f" {t}"), sp.encode(t)) if t else ([], [])
        wanted = f" {t}".encode()
        if not t or b"".join(map(of_a, a)) != wanted or b"".join(map(of_b, b)) != wanted:
            out.append(None)
            linked.append({})
            continue
        ends_a, ends_b = np.cumsum([len(of_a(i)) for i in a]), np.cumsum([len(of_b(i)) for i in b])
        cuts = np.intersect1d(ends_a, ends_b)
        groups = defaultdict(lambda: ([], []))
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends.tolist(), strict=True):
                groups[int(np.searchsorted(cuts, e))][side].append(i)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for _, (x, y) in sorted(groups.items()))
        pairs = Counter()
        for x, y in groups.values():
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    pairs[i, j] += n * m
        out.append((len(a), len(b), len(groups), sum(pairs.values()), hashlib.sha256(said.encode()).hexdigest()))
        linked.append(pairs)
    n = Counter(p for pairs in linked for p in pairs)
    best = defaultdict(int)
    for (i, _), k in n.items():
        best[i] = max(best[i], k)
    rows = []
    for o, pairs in zip(out, linked, strict=True):
        top = sum(m for p, m in pairs.items() if n[p] == best[p[0]])
        total = sum(m * n[p] for p, m in pairs.items())
        rows.append((*o[:4], top, total, o[4]) if o else (0, 0, 0, 0, 0, 0, ""))
    return rows


def test_query(spark):
    docs = documents()
    want = dict(zip(docs, plain(docs.values()), strict=True))
    got = queries.op11_token_alignment(spark, SF).collect()
    assert len(got) == len(docs) and {r["doc_id"]: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_hard_rows(spark, block):
    texts = [*HARD, *((100 + i, t) for i, t in enumerate(MORE))]
    df = hard(spark).select("doc_id", "text", "spans").unionByName(spark.createDataFrame([(i, t, 7) for i, t in texts[len(HARD) :]], "doc_id long, text string, spans int"))
    got = alignment.alignment(df, A, B, block_pairs=block).collect()
    assert Counter(map(tuple, got)) == Counter((i, *r) for (i, _), r in zip(texts, plain([t for _, t in texts]), strict=True))
    assert alignment.alignment(empty(spark), A, B).count() == 0
    one = alignment.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert [tuple(r)[1:] for r in one] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_fast_encoder_equals_the_files_own():
    enc = alignment.BytePairs(A)
    assert enc.fast is not None
    texts = [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2\n{chr(c)} \n {chr(c)}'s" for c in range(0x370)]
    texts += [t or "" for t in documents().values() if max(map(len, (t or "").split()), default=0) < 1500]
    texts += ["日本語" * 800 + " ab。" + "𝄞é" * 1100, " " * 2100 + "語" * 2001 + "1" * 2001 + "'s\n\n x"]
    slow = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc(texts) == slow


@pytest.mark.parametrize("seed", range(20))
def test_groups_and_links_of_random_cuts(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 200))
    ends = [np.unique(np.append(rnd.integers(1, n + 1, rnd.integers(1, n + 1)), n)) for _ in range(2)]
    of_a, of_b = alignment.groups(*ends)
    cuts = np.intersect1d(*ends)
    assert (of_a == np.searchsorted(cuts, ends[0])).all() and (of_b == np.searchsorted(cuts, ends[1])).all()
    a, b = rnd.integers(0, 5, len(of_a)), rnd.integers(0, 5, len(of_b))
    want = Counter((g, int(x) * 10 + int(y)) for g, x in zip(of_a, a, strict=True) for h, y in zip(of_b, b, strict=True) if g == h)
    for most in (0, 4, 1 << 30):
        got = Counter()
        for g, k, t in zip(*alignment.links(of_a, of_b, a, b, 10, most), strict=True):
            got[g, int(k)] += int(t)
        assert got == want
    keys, times = np.unique(rnd.integers(0, 1 << 40, 50)), rnd.integers(1, 1 << 31, 50)
    back = alignment.unpack_pairs(alignment.pack_pairs(keys, times[: len(keys)]))
    assert (back[0] == keys).all() and (back[1] == times[: len(keys)]).all()
