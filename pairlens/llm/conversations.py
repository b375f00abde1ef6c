"""Conversation structure: faults of rows, and the cheapest edits that give ``(s?(ua)+)?``, by a DP on a prefix trie."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

WHITE = " \t\n\x0b\x0c\r"
# States of the wanted form: nothing yet, after the system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserted rows that lead from a state to others at least cost; longer runs come back to a state that a shorter one reaches.
INSERTS = {BEGIN: ((BEGIN, ""), (USER, "I"), (ASSISTANT, "II")), SYSTEM: ((SYSTEM, ""), (USER, "I"), (ASSISTANT, "II")), USER: ((USER, ""), (ASSISTANT, "I")), ASSISTANT: ((ASSISTANT, ""), (USER, "I"))}
#: Inserted rows that end a conversation in a legal state.
ENDING = {BEGIN: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1


def _moves(symbol: str) -> list[tuple[int, int, str, int]]:
    """For one row: from state, to state, edits (insertions before it, then its own), cost."""
    out = []
    for source in range(4):
        for state, inserted in INSERTS[source]:
            cost = INSERT * len(inserted)
            out.append((source, state, inserted + "D", cost + DELETE))
            if symbol == "d":
                continue
            role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
            if role == "s" and state == BEGIN:
                out.append((source, SYSTEM, inserted + "K", cost + KEEP + extra))
            same = role == ("a" if NEXT[state] == ASSISTANT else "u")
            out.append((source, NEXT[state], inserted + ("K" if same else "R"), cost + (KEEP if same else REROLE) + extra))
    return out


#: d: has to be deleted; s u a o: role by initial, o any other; capital: truncated.
MOVES = {c: _moves(c) for c in "dsuaoSUAO"}


class Trie:
    """Layers of the DP along the path of the last signature; sorted signatures share those of their common prefix.

    A layer holds for each state the least cost, the rank of its edits among the layer's (by ASCII), and the move that
    led there. At a layer no state's edits are a prefix of another's: all end with a row's own edit. So comparing the
    ranks before, then the move's edits, compares the whole strings.
    """

    def __init__(self, start: int) -> None:
        self.signature, self.layers = "", [{start: (0, 0, -1, "")}]
        self.steps = 0

    def answer(self, signature: str) -> dict[int, tuple[int, int]]:
        """Least cost and rank of edits for each state at the signature's end."""
        shared, most = 0, min(len(signature), len(self.signature))
        while shared < most and signature[shared] == self.signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(self.step(self.layers[-1], symbol))
            self.steps += 1
        self.signature = signature
        return {state: entry[:2] for state, entry in self.layers[-1].items()}

    @staticmethod
    def step(layer: dict, symbol: str) -> dict:
        best: dict[int, tuple] = {}
        for source, target, edits, cost in MOVES[symbol]:
            if source in layer:
                found = (layer[source][0] + cost, layer[source][1], edits, source)
                if target not in best or found < best[target]:
                    best[target] = found
        order = sorted(best, key=lambda state: best[state][1:3])
        return {state: (best[state][0], rank, best[state][3], best[state][2]) for rank, state in enumerate(order)}

    def edits(self, state: int) -> str:
        parts = []
        for layer in reversed(self.layers[1:]):
            _, _, source, edits = layer[state]
            parts.append(edits)
            state = source
        return "".join(reversed(parts))


def ended(ends: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """Cost, last state and closing insertions of the best way to end."""
    cost, _, closing, state = min((cost + INSERT * len(ENDING[q]), rank, ENDING[q], q) for q, (cost, rank) in ends.items())
    return cost, state, closing


def faulty_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``__c, __has, __t, __role, __text, __h, __blank, __cut``: null roles and texts are one space; no duplicates told yet."""
    said = F.coalesce(F.col(role), F.lit(" "))
    words = F.coalesce(F.col(text), F.lit(" "))
    bare = F.rtrim(words, F.lit(WHITE))
    blank = bare == ""
    return rows.select(
        F.col(conv).alias("__c"), F.col(turn).isNotNull().alias("__has"), F.col(turn).alias("__t"), said.alias("__role"), words.alias("__text"),
        F.unhex(F.md5(F.concat(said, F.lit("\0"), words))).alias("__h"), blank.alias("__blank"), (~blank & ~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("__cut"),
    )


ORDER = ["__c", "__has", "__t", "__role", "__h"]  # rows of a conversation by turn, nulls first, then role and content


def _signatures(rows: DataFrame, most: int) -> DataFrame:
    """Conversations cut into blocks of at most ``most`` rows, in order: signature, counts, and what the next block has to know."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"__c {kinds['__c']}, pid int, seq long, open boolean, sig string, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, lo {kinds['__t']}, hi {kinds['__t']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq = TaskContext.get().partitionId(), 0
        out: list[dict] = []
        now: dict | None = None
        before = None

        def close(open_: bool) -> None:
            nonlocal now, seq
            if now:
                now |= {"open": now["open"] or open_, "sig": "".join(now["sig"]), "seq": seq}
                seq += 1
                out.append(now)
                now = None

        def sent() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return got

        arrow = None
        for batch in batches:
            if arrow is None:
                c, t = batch.schema.field("__c").type, batch.schema.field("__t").type
                i, s = pa.int64(), pa.string()
                arrow = pa.schema([("__c", c), ("pid", pa.int32()), ("seq", i), ("open", pa.bool_()), ("sig", s), ("blank", i), ("duplicate", i), ("truncated", i), ("illegal", i), ("first", s), ("last", s), ("turns", i), ("lo", t), ("hi", t)])
            for r in batch.to_pylist():
                key = (r["__c"], r["__t"], r["__h"])
                new = before is None or before[0] != r["__c"]
                if new or len(now["sig"]) == most:
                    first_here = before is None
                    going_on = not new
                    if going_on:
                        close(True)
                    else:
                        close(False)
                    # the first conversation of a partition may have begun in the one before
                    now = {"__c": r["__c"], "pid": pid, "open": first_here or going_on, "sig": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None, "turns": 0, "lo": None, "hi": None}
                initial = r["__role"][:1]
                duplicate = not r["__blank"] and (r["__again"] or before == key)
                now["blank"] += r["__blank"]
                now["duplicate"] += duplicate
                truncated = r["__cut"] and not duplicate
                now["truncated"] += truncated
                if now["last"] is None:
                    now["first"] = initial
                elif now["last"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = initial
                if r["__t"] is not None and r["__t"] != now["hi"]:
                    now["turns"] += 1
                    now["lo"] = r["__t"] if now["lo"] is None else now["lo"]
                    now["hi"] = r["__t"]
                symbol = initial if initial in ("s", "u", "a") else "o"
                now["sig"].append("d" if r["__blank"] or duplicate else symbol.upper() if truncated else symbol)
                before = key
            if len(out) >= 5000:
                yield sent()
        close(True)  # the last one may go on in the next partition
        if out:
            yield sent()

    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("__c", "__has", "__t", "__role", "__h", "__blank", "__cut", "__again").mapInArrow(run, schema)


def _solved(blocks: DataFrame) -> DataFrame:
    """Blocks in the order of their signatures, with ``ends``: (start state, end state, cost, rank, edits) at the trie's terminal nodes.

    The range includes the conversation, so a signature that many share is dealt to several tasks. A block that holds its
    whole conversation starts at the beginning only.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in blocks.schema)}, ends array<struct<start:int,state:int,cost:long,rank:int,edits:string>>"
    order = ["sig", "__c", "pid", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie(start) for start in range(4)]
        known: dict[str | bool, object] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))

        def solve(signature: str, open_: bool) -> list[dict]:
            if not open_:
                cost, state, closing = ended(tries[BEGIN].answer(signature))
                return [{"start": BEGIN, "state": state, "cost": cost, "rank": 0, "edits": tries[BEGIN].edits(state) + closing}]
            return [{"start": s, "state": q, "cost": cost, "rank": rank, "edits": tries[s].edits(q)} for s in range(4) for q, (cost, rank) in tries[s].answer(signature).items()]

        for batch in batches:
            ends = []
            for signature, open_ in zip(batch.column("sig").to_pylist(), batch.column("open").to_pylist(), strict=True):
                if known.get("sig") != signature:
                    known.clear()
                    known["sig"] = signature
                if open_ not in known:
                    known[open_] = solve(signature, open_)
                ends.append(known[open_])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, kind)], [*batch.schema.names, "ends"])

    return blocks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def folded(blocks: list[dict]) -> dict:
    """One answer from a conversation's blocks in order: the edits that are cheapest over all of them, and the sums.

    A block's answers from each start state to each end state compose like the steps inside it.
    """
    out = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for one, two in zip(blocks, blocks[1:], strict=False):
        out["illegal"] += one["last"] + two["first"] not in ("su", "ua", "au")
        out["turns"] -= one["hi"] is not None and one["hi"] == two["lo"]
    seen = [b for b in blocks if b["hi"] is not None]
    out |= {"lo": seen[0]["lo"] if seen else None, "hi": seen[-1]["hi"] if seen else None}
    if not blocks[0]["open"]:
        return out | {"cost": blocks[0]["ends"][0]["cost"], "audit": blocks[0]["ends"][0]["edits"]}
    now, steps = {BEGIN: (0, 0)}, []
    for b in blocks:
        best: dict[int, tuple] = {}
        for e in b["ends"]:
            if e["start"] in now:
                cost, rank = now[e["start"]]
                found = (cost + e["cost"], rank, e["rank"], e["start"])
                if e["state"] not in best or found < best[e["state"]]:
                    best[e["state"]] = found
        order = sorted(best, key=lambda q: best[q][1:3])
        steps.append({q: best[q][3] for q in best})
        now = {q: (best[q][0], i) for i, q in enumerate(order)}
    cost, state, closing = ended(now)
    parts = [closing]
    for b, back in zip(reversed(blocks), reversed(steps), strict=True):
        start = back[state]
        parts.append(next(e["edits"] for e in b["ends"] if e["start"] == start and e["state"] == state))
        state = start
    return out | {"cost": cost, "audit": "".join(reversed(parts))}


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _answers(solved: DataFrame) -> DataFrame:
    """A row a conversation: its id, the facts and the audit."""
    conv = solved.schema["__c"].dataType.simpleString()
    schema = f"__c {conv}, {', '.join(f'{f} long' for f in FACTS)}, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, blocks in zip(batch.column("__c").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                got = folded(sorted(blocks, key=lambda b: (b["pid"], b["seq"])))
                gaps = 0 if got["lo"] is None else got["hi"] - got["lo"] + 1 - got["turns"]
                rows.append({"__c": c, "gaps": gaps, "audit": got["audit"]} | {k: got[k] for k in FACTS if k != "gaps"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("__c", batch.schema.field("__c").type), *[(f, pa.int64()) for f in FACTS], ("audit", pa.string())]))

    block = F.struct(*[c for c in solved.columns if c != "__c"])
    whole = solved.filter(~F.col("open")).select("__c", F.array(block).alias("blocks"))
    cut = solved.filter("open").groupBy("__c").agg(F.collect_list(block).alias("blocks"))
    return whole.mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))


def audit_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = 256) -> DataFrame:
    """``__c, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation that has rows.

    Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then content. ``audit`` holds the
    initials of the cheapest edits (Keep, Rerole, Delete, Insert) in order, of equal cost the ASCII-least.

    Only ids, roles and 128-bit digests travel. Rows are dealt by ranges of (conversation, turn), so a conversation that
    holds a third of all rows lies in many tasks, in blocks of at most ``block_rows`` rows; what repeats inside it is found by
    counting, not by gathering. Blocks are solved in the order of their signatures on a trie, and put together by the
    few numbers that each has for its start and end states.

    Null role and text count as one space, a null conversation id is a conversation of its own, a null turn is before all
    others and in no gap. Repeated rows are duplicates after the first. A role without a known initial (the empty one too) can't be kept.
    Other columns are ignored; an empty table gives no rows.
    """
    narrow = faulty_rows(rows, conv, turn, role, text)
    at = F.struct("__has", "__t")
    again = narrow.filter(~F.col("__blank")).groupBy(F.col("__c").alias("c"), F.col("__h").alias("h")).agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    told = narrow.drop("__text").join(again, F.col("__c").eqNullSafe(F.col("c")) & (F.col("__h") == F.col("h")), "left")
    told = told.withColumn("__again", F.coalesce(at > F.col("at"), F.lit(False)))
    blocks = written(_signatures(told, block_rows), "conversation-blocks")
    answers = written(_answers(_solved(blocks)), "conversation-answers")
    discard(blocks)
    return answers


def _walk(rows: DataFrame, answers: DataFrame, schema: str, begin: Callable, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every conversation's edits and rows meet in order, as a stream; ``begin`` makes what takes the repaired rows."""
    have = faulty_rows(rows, conv, turn, role, text).withColumn("kind", F.lit(1))
    facts = ["audit", *FACTS]
    have = have.withColumns({f: F.lit(None).cast(answers.schema[f].dataType) for f in facts})
    said = answers.withColumns({c: F.lit(None).cast(have.schema[c].dataType) for c in ("__has", "__t", "__role", "__text", "__h")}).withColumn("kind", F.lit(0))
    columns = ["__c", "kind", "__has", "__t", "__role", "__h", "__text", *facts]
    both = said.select(*columns).unionByName(have.select(*columns))
    order = ["__c", "kind", "__has", "__t", "__role", "__h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, current, started = None, None, False
        edits, state = iter(""), BEGIN
        for batch in batches:
            for r in batch.to_pylist():
                if not started or r["__c"] != current:
                    if started:
                        for e in edits:
                            state = NEXT[state]
                            sink.take(e, ROLE[state], "")
                        yield from sink.end()
                    sink, current, started, state, edits = begin(r, batch.schema), r["__c"], True, BEGIN, iter(r["audit"] or "")
                if r["kind"] == 0:
                    continue
                for e in edits:
                    if e == "I":
                        state = NEXT[state]
                        sink.take(e, ROLE[state], "")
                        continue
                    if e == "K":
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[r["__role"][0]]
                        sink.take(e, r["__role"], r["__text"])
                    elif e == "R":
                        state = NEXT[state]
                        sink.take(e, ROLE[state], r["__text"])
                    break
                yield from sink.ready()
        if started:
            for e in edits:
                state = NEXT[state]
                sink.take(e, ROLE[state], "")
            yield from sink.end()
            yield from sink.flush()

    return both.repartition("__c").sortWithinPartitions(*order).mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, answers: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``conv, place (from 0), edit, role, text``; a conversation with no rows left has none.

    A conversation is a sequence, so its rows pass one task, as a sorted stream that is never held whole.
    """
    kind = rows.schema[conv].dataType.simpleString()

    class Rows:
        held: list[dict] = []

        def __init__(self, r: dict, schema: pa.Schema) -> None:
            self.c, self.place = r["__c"], 0
            self.schema = pa.schema([(conv, schema.field("__c").type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        def take(self, edit: str, role: str, text: str) -> None:
            self.held.append({conv: self.c, "place": self.place, "edit": edit, "role": role, "text": text})
            self.place += 1

        def ready(self) -> Iterator[pa.RecordBatch]:
            if len(self.held) >= 1000:
                yield from self.flush()

        def end(self) -> Iterator[pa.RecordBatch]:
            return self.ready()

        def flush(self) -> Iterator[pa.RecordBatch]:
            if self.held:
                yield pa.RecordBatch.from_pylist(self.held, schema=self.schema)
                self.held.clear()

    return _walk(rows, answers, f"`{conv}` {kind}, place long, edit string, role string, text string", Rows, conv, turn, role, text)


def repaired_digests(rows: DataFrame, answers: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``conv``, the facts and audit, and ``repaired_sha256`` of the repaired ``role:text`` lines; ids only in ``known`` have zeros.

    The digest takes the rows as they stream by, so no conversation is held in memory.
    """
    kind = rows.schema[conv].dataType.simpleString()
    if known is not None:
        none = known.select(F.col(conv)).distinct()
        seen = answers.select(F.col("__c"))
        extra = none.join(seen, F.col(conv).eqNullSafe(F.col("__c")), "left_anti").select(F.col(conv).alias("__c"), *[F.lit(0).cast("long").alias(f) for f in FACTS], F.lit("").alias("audit"))
        answers = answers.unionByName(extra)

    class Digests:
        held: list[dict] = []

        def __init__(self, r: dict, schema: pa.Schema) -> None:
            self.row = {conv: r["__c"], **{f: r[f] for f in FACTS}, "audit": r["audit"]}
            self.sum, self.first = hashlib.sha256(), True
            self.schema = pa.schema([(conv, schema.field("__c").type), *[(f, pa.int64()) for f in FACTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def take(self, edit: str, role: str, text: str) -> None:
            self.sum.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

        def ready(self) -> Iterator[pa.RecordBatch]:
            return iter(())

        def end(self) -> Iterator[pa.RecordBatch]:
            self.held.append(self.row | {"repaired_sha256": self.sum.hexdigest()})
            if len(self.held) >= 5000:
                yield from self.flush()

        def flush(self) -> Iterator[pa.RecordBatch]:
            if self.held:
                yield pa.RecordBatch.from_pylist(self.held, schema=self.schema)
                self.held.clear()

    return _walk(rows, answers, f"`{conv}` {kind}, {', '.join(f'{f} long' for f in FACTS)}, audit string, repaired_sha256 string", Digests, conv, turn, role, text)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by CRC32(``conv:turn``) % 20: dropped, emptied, without end marks, repeated, or made a user's. Nulls count as one space, in the key too."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    d = rows.select(F.col(conv), F.col(turn), F.coalesce(F.col(role), space).alias(role), F.coalesce(F.col(text), space).alias(text), (F.crc32(key) % 20).alias("__k"))
    k = F.col("__k")
    d = d.filter(k != 0).withColumn(text, F.when(k == 1, "").when(k == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text))).withColumn(role, F.when(k == 4, "user").otherwise(F.col(role)))
    return d.withColumn("__copy", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__k", "__copy")
