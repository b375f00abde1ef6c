"""Conversation repair against a plain search over whole strings, and the trie's sharing."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pairlens.llm import conversations as C
from pairlens.llm import queries

from .cases import rows

WHITE = " \t\n\x0b\x0c\r"
FOLLOWS = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}


def damage(all_rows):
    out = []
    for c, t, r, x in all_rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(taken, faults):
    """Every state's least (cost, edits), whole strings compared."""

    def inserted(best):
        best, again = dict(best), True
        while again:
            again = False
            for q, (c, s) in list(best.items()):
                if (c + 2, s + "I") < best.get(FOLLOWS[q], (10**9, "")):
                    best[FOLLOWS[q]], again = (c + 2, s + "I"), True
        return best

    best = {0: (0, "")}
    for (_, _, r, _), k in zip(taken, faults, strict=True):
        now, after = inserted(best), defaultdict(list)
        for q, (c, s) in now.items():
            after[q].append((c + 3, s + "D"))
            if k in ("blank", "duplicate"):
                continue
            more = int(k == "truncated")
            if q == 0 and r[:1] == "s":
                after[1].append((c + more, s + "K"))
            n = FOLLOWS[q]
            after[n].append((c + more, s + "K") if r[:1] == NAMES[n][0] else (c + more + 2, s + "R"))
        best = {q: min(x) for q, x in after.items()}
    now = inserted(best)
    return min(now[q] for q in (0, 3) if q in now)


def answer(taken):
    taken = sorted(taken, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).digest()))
    seen, faults = set(), []
    for _, _, r, x in taken:
        bare = x.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((r, x))
    cost, audit = cheapest(taken, faults) if taken else (0, "")
    state, out, left = 0, [], iter(taken)
    for e in audit:
        r, x = next(left)[2:] if e != "I" else ("", "")
        if e == "D":
            continue
        if e == "K":
            state = {"s": 1, "u": 2, "a": 3}[r[0]]
            out.append((e, r, x))
        else:
            state = FOLLOWS[state]
            out.append((e, NAMES[state], x))
    turns = [r[1] for r in taken if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(taken, taken[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in out).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def brute(all_rows):
    left = defaultdict(list)
    for r in damage(all_rows):
        left[r[0]].append(r)
    return {c: answer(left[c])[0] for c in {r[0] for r in all_rows}}


def test_query(spark):
    from .cases import SF

    got = queries.op13_structure_repair(spark, SF).collect()
    want = brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows("conversations")])
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def odd(spark, seed=3):
    rnd, out = random.Random(seed), []
    for c in [*range(40), None]:
        for t in range(rnd.choice([0, 1, 2, 5, 9, 30])):
            role = rnd.choice(["user", "assistant", "system", "tool", None, "", "u"])
            out.append((c, rnd.choice([None, t, t, t, t, t + 1]), role, rnd.choice([None, "", " \n", "a.", "b", "hello!", "x? ", "dup.", "dup.", "é" * 9000])))
    return out, spark.createDataFrame([(*r, 7, 7) for r in out], "conv_id long, turn long, role string, text string, audit long, __c long")


@pytest.mark.parametrize("most", [256, 3, 1])
def test_hard_rows_in_blocks_of_any_size(spark, most):
    all_rows, df = odd(spark)
    bad = C.damaged(df)
    got = C.repaired_digests(bad, C.audit_conversations(bad, block_rows=most), known=df).collect()
    want = brute(all_rows)
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want
    back = defaultdict(list)
    for r in C.repaired_rows(bad, C.audit_conversations(bad, block_rows=most)).orderBy("conv_id", "place").collect():
        assert r["place"] == len(back[r["conv_id"]])
        back[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    left = defaultdict(list)
    for r in damage(all_rows):
        left[r[0]].append(r)
    assert back == {c: answer(x)[1] for c, x in left.items() if answer(x)[1]}


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repaired_digests(none, C.audit_conversations(none), known=none).count() == 0
    assert C.repaired_rows(none, C.audit_conversations(none)).count() == 0
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "x.")], "conv_id long, turn long, role string, text string")
    bad = C.damaged(df)
    got = C.repaired_digests(bad, C.audit_conversations(bad), known=df).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_shared_prefixes_are_stepped_once():
    trie = C.Trie(C.BEGIN)
    for s in ("suau", "suaua", "suaua", "suauad", "uaua"):
        trie.answer(s)
    assert trie.steps == 4 + 1 + 0 + 1 + 4
    rnd = random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice("dsuaoSUAO") for _ in range(rnd.randint(0, 9)))
        taken = [(0, i, {"s": "system", "u": "user", "a": "assistant", "o": "x", "d": "user"}[c.lower()], "") for i, c in enumerate(s)]
        faults = ["blank" if c == "d" else "truncated" if c.isupper() else "" for c in s]
        cost, state, closing = C.ended(trie.answer(s))
        assert (cost, trie.edits(state) + closing) == cheapest(taken, faults)
