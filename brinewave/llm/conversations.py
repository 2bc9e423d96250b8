"""Conversations whose turns are damaged, repaired at the least cost of edits by divide and conquer.

A repaired conversation is empty or has an optional system turn, then user and assistant in turn: four states
(START, after system, after user, after assistant). Edits of a row: keep (K, 0), give it the role that is due (R, 3), delete
(D, 4; the only edit of blank and repeated rows); before any row and at the end rows with an empty text
may be inserted (I, 3). A truncated row that stays costs 3 more. Of the cheapest edits those whose letters come first in
ASCII order are taken.

`audit` follows Hirschberg: costs forward from the start and backward from the end meet in the middle, the best crossing
state is fixed, and both halves are done alike; memory is two vectors of four costs beside the letters. A letter string
up to a row ends with that row's letter, so that the strings of different states at a crossing differ before either ends:
their order (`ranks`) goes along with the costs and settles ties.

Rows are sorted by conversation over range partitions, so a conversation of any length lies in as many tasks as it needs.
One that fits in a task and a piece is done there. Of the others, a piece gives its least costs between any two states;
one pass backward over the pieces' costs and one forward fix the states at their edges, each piece is then edited
on its own, and the digest streams the edited pieces in order. Marks of repeated rows cross pieces as digests.

Rows: null role and text count as one space, null turns come first, rows of one turn are ordered by role, then text; rows of one
conversation, turn and role beginning are sorted, with spill, in one task. A null conversation id is a conversation. A role must
begin with s, u or a to be kept, so an empty or other role is given a new one or deleted. A conversation without rows gives
zeros, an empty audit and the digest of the empty string; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.llm.rows import named
from brinewave.session import cut_lineage

# Costs of the edits, white space, ends of sentences, adjacent role initials that are right.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = ("su", "ua", "au")

START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40
#: The state after the row that is due in each state, and that row's role.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What the rest of a conversation costs after its last row, and the letters for it.
END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: Rows are coded in a byte: the state that keeping leads to (0: it can't be kept), plus these.
CUT, GONE = 4, 8

PIECE_ROWS, PIECE_BYTES = 1 << 14, 4 << 20

Vector = tuple[int, int, int, int]
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# ---- edits of one stretch of coded rows


@functools.cache
def moves(code: int, state: int) -> dict[int, tuple[int, str]]:
    """From a state over one row, with the inserts before it: the state after it, and the least cost and letters."""
    best: dict[int, tuple[int, str]] = {}

    def offer(after: int, cost: int, letters: str) -> None:
        best[after] = min(best.get(after, (INF, "")), (cost, letters))

    for inserts in range(3):
        begun, spent = "I" * inserts, INSERT * inserts
        offer(state, spent + DELETE, begun + "D")
        if code != GONE:
            extra = TRUNCATED if code & CUT else 0
            kept = code & 3
            if kept and (kept == SYSTEM and state == START or kept == DUE[state]):
                offer(kept, spent + extra, begun + "K")
            offer(DUE[state], spent + extra + REROLE, begun + "R")
        state = DUE[state]
    return best


@functools.cache
def _ahead(costs: Vector, ranks: Vector, code: int) -> tuple[Vector, Vector]:
    """Least costs and the order of their letters, one row later."""
    best: dict[int, tuple[int, int, str]] = {}
    for state in range(4):
        if costs[state] < INF:
            for after, (cost, letters) in moves(code, state).items():
                found = (costs[state] + cost, ranks[state], letters)
                best[after] = min(best.get(after, found), found)
    order = sorted(best, key=lambda s: best[s][1:])
    return tuple(best[s][0] if s in best else INF for s in range(4)), tuple(order.index(s) if s in best else 4 for s in range(4))


@functools.cache
def _back(costs: Vector, code: int) -> Vector:
    """Least costs to the end, one row earlier."""
    return tuple(min(min(cost + costs[after] for after, (cost, _) in moves(code, s).items()), INF) for s in range(4))


def _lowered(costs: Vector) -> tuple[int, Vector]:
    """The least of the costs, and what each has above it: few such vectors exist, so steps are looked up."""
    least = min(costs)
    return (least, tuple(c - least if c < INF else INF for c in costs)) if least else (0, costs)


def forward(codes: bytes, first: int, end: int, state: int) -> tuple[Vector, Vector]:
    """Costs from a state before row `first` to each state before row `end`, and the order of their letters."""
    base, costs, ranks = 0, tuple(0 if s == state else INF for s in range(4)), (0, 0, 0, 0)
    for i in range(first, end):
        costs, ranks = _ahead(costs, ranks, codes[i])
        more, costs = _lowered(costs)
        base += more
    return tuple(c + base if c < INF else INF for c in costs), ranks


def backward(codes: bytes, first: int, end: int, after: Vector) -> Vector:
    """Costs from each state before row `first` to the end, given those before row `end`."""
    base, costs = _lowered(after)
    for i in range(end - 1, first - 1, -1):
        more, costs = _lowered(_back(costs, codes[i]))
        base += more
    return tuple(c + base if c < INF else INF for c in costs)


def crossing(costs: Vector, ranks: Vector, after: Vector) -> int:
    """The state to meet in: least cost, then least letters."""
    return min((costs[s] + after[s], ranks[s], s) for s in range(4) if costs[s] < INF and after[s] < INF)[2]


def audit(codes: bytes, first: int, end: int, state: int, after: Vector) -> tuple[str, int]:
    """The letters of the best edits of rows first..end-1, and the state after them."""
    if first == end:
        return "", state
    if end - first == 1:
        found = moves(codes[first], state)
        best = min(found, key=lambda s: (found[s][0] + after[s], found[s][1]))
        return found[best][1], best
    middle = (first + end) // 2
    meet = crossing(*forward(codes, first, middle, state), backward(codes, middle, end, after))
    left, _ = audit(codes, first, middle, state, tuple(0 if s == meet else INF for s in range(4)))
    right, last = audit(codes, middle, end, meet, after)
    return left + right, last


def cost_of(letters: str, codes: bytes) -> int:
    """What the edits cost."""
    rows = iter(codes)
    each = {"I": INSERT, "D": DELETE, "R": REROLE, "K": 0}
    return sum(each[x] + (TRUNCATED if x != "I" and next(rows) & CUT and x != "D" else 0) for x in letters)


def edited(letters: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits leave."""
    i = 0
    for x in letters:
        if x == "I":
            state = DUE[state]
            yield ROLE[state], ""
            continue
        if x == "K":
            state = "?sua".index(roles[i][0])
            yield roles[i], texts[i]
        elif x == "R":
            state = DUE[state]
            yield ROLE[state], texts[i]
        i += 1


# ---- rows of one conversation, or a piece of it


@dataclass
class Rows:
    """Consecutive rows of a conversation."""

    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    held: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.held += len(role) + len(text)

    def names(self) -> list[bytes | None]:
        """Digests of role and text; None where the row is blank."""
        return [None if not t.strip(BLANKS) else hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(self.roles, self.texts)]

    def coded(self, seen: set[bytes]) -> tuple[bytes, dict[str, int]]:
        """A byte for each row, given what came earlier, and the counts of faults."""
        codes, found = bytearray(), dict.fromkeys(COUNTS, 0)
        for name, role, text in zip(self.names(), self.roles, self.texts):
            if name is None or name in seen:
                found["blank" if name is None else "duplicate"] += 1
                codes.append(GONE)
                continue
            seen.add(name)
            cut = text.rstrip(BLANKS)[-1] not in ENDS
            found["truncated"] += cut
            codes.append(max(0, "?sua".find(role[:1] or "?")) + CUT * cut)
        found["illegal"] = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:]))
        return bytes(codes), found

    def known_turns(self) -> list[int]:
        return [t for t in self.turns if t is not None]


def _sorted_gaps(turns: list[int]) -> int:
    return turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0


def _lines(pairs: Iterator[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in pairs)


LONG, STR = pa.int64(), pa.string()
LINE = pa.list_(pa.struct([("role", STR), ("text", STR)]))


def _table(columns: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(columns.items()))


# ---- the job


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies: each row's fault follows from the CRC-32 of conversation and turn. A dropped row has
    no copies; it stays so that its conversation is known."""
    said = [F.coalesce(named(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    fault = F.crc32(F.concat_ws(":", said[0], said[1]).cast("binary")) % 20
    return rows.select(
        named(conv).alias("conv"),
        named(turn).cast("long").alias("turn"),
        F.when(fault == 0, "").when(fault == 4, "user").otherwise(said[2]).alias("role"),
        F.when(fault <= 1, "").when(fault == 2, F.translate(said[3], ENDS, "")).otherwise(said[3]).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same columns of rows as they are."""
    said = [F.coalesce(named(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    return rows.select(named(conv).alias("conv"), named(turn).cast("long").alias("turn"), *said, F.lit(1).alias("copies"))


PIECE = "at long, whole boolean, {}, audit string, digest string, turns array<long>, roles array<string>, texts array<string>, lines array<struct<role: string, text: string>>"
RESULT = {c: LONG for c in COUNTS}


def _pieces(most_rows: int, most_bytes: int, lines: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to one row for each conversation that is whole here, done, or for each piece of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        out: list[dict] = []
        held, schema = 0, None
        # the first conversation of a task may have begun, and the last may go on, in another one
        conv, rows, open_, known = None, Rows(), True, False

        def finish(whole: bool) -> None:
            nonlocal at, held
            done: dict = dict.fromkeys(schema.names) | {"conv": conv, "at": at, "whole": whole}
            if whole:
                codes, found = rows.coded(set())
                letters, state = audit(codes, 0, len(codes), START, END)
                letters += TAIL[state]
                kept = list(edited(letters, rows.roles, rows.texts, START))
                found["gaps"], found["cost"] = _sorted_gaps(rows.known_turns()), cost_of(letters, codes)
                done |= found | {"audit": letters, "digest": hashlib.sha256(_lines(kept).encode()).hexdigest()}
                if lines:
                    done["lines"] = [{"role": r, "text": t} for r, t in kept]
            else:
                done |= {"turns": rows.turns, "roles": rows.roles, "texts": rows.texts}
            out.append(done)
            held += 200 + (rows.held if lines or not whole else 0)
            at += 1

        for batch in batches:
            if schema is None:
                plain = {"audit": STR, "digest": STR, "turns": pa.list_(LONG), "roles": pa.list_(STR), "texts": pa.list_(STR), "lines": LINE}
                schema = _table({"conv": batch.schema.field("conv").type, "at": LONG, "whole": pa.bool_()} | RESULT | plain)
            for now, turn, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies"))):
                if known and now != conv:
                    finish(not open_)
                    rows, open_ = Rows(), False
                conv, known = now, True
                for _ in range(copies):
                    if len(rows.roles) >= most_rows or rows.held >= most_bytes:
                        open_ = True
                        finish(False)
                        rows = Rows()
                    rows.add(turn, role, text)
                if held > most_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if known:
            finish(False)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _marked(pieces: DataFrame) -> DataFrame:
    """at, earlier: for each piece the digests of its rows that an earlier piece of the conversation has as well."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, conv, roles, texts in zip(*(batch.column(c) for c in ("at", "conv", "roles", "texts"))):
                rows = Rows(roles=roles.as_py(), texts=texts.as_py())
                # the conversation is part of the name, so that the name alone is the key
                mine = repr(conv.as_py()).encode()
                found = [(n, hashlib.md5(mine + b":" + n).digest()) for n in {n for n in rows.names() if n}]
                yield pa.RecordBatch.from_pydict(
                    {"at": [at.as_py()] * len(found), "name": [n for n, _ in found], "key": [k for _, k in found]},
                    schema=_table({"at": LONG, "name": pa.binary(), "key": pa.binary()}),
                )

    sent = cut_lineage(pieces.select("at", "conv", "roles", "texts").mapInArrow(names, "at long, name binary, key binary"))
    firsts = sent.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = sent.join(firsts, "key").where(F.col("at") > F.col("first"))
    return later.groupBy("at").agg(F.collect_list("name").alias("earlier"))


EDGES = "turn_first long, turn_last long, distinct_turns long, initial_first string, initial_last string, n long"
COSTS = "costs array<long>, ranks array<long>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece: its codes, counts, edges, and the costs and ranks between any two states."""
    schema = None
    for batch in batches:
        if schema is None:
            edges = {"turn_first": LONG, "turn_last": LONG, "distinct_turns": LONG, "initial_first": STR, "initial_last": STR, "n": LONG}
            lists = {"costs": pa.list_(LONG), "ranks": pa.list_(LONG)}
            schema = _table({"conv": batch.schema.field("conv").type, "at": LONG, "codes": pa.binary()} | RESULT | edges | lists)
        done = []
        for row in batch.to_pylist():
            rows = Rows(row["turns"], row["roles"], row["texts"])
            codes, found = rows.coded(set(row["earlier"] or ()))
            known = rows.known_turns()
            done.append(
                found
                | {
                    "conv": row["conv"], "at": row["at"], "codes": codes, "n": len(codes),
                    "turn_first": known[0] if known else None, "turn_last": known[-1] if known else None, "distinct_turns": len(set(known)),
                    "initial_first": rows.roles[0][:1] if rows.roles else None, "initial_last": rows.roles[-1][:1] if rows.roles else None,
                    "costs": [], "ranks": [],
                }
            )
            for state in range(4):
                costs, ranks = forward(codes, 0, len(codes), state)
                done[-1]["costs"] += costs
                done[-1]["ranks"] += ranks
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def _to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from last to first: `after`, the costs from each state behind the piece to the end of the conversation."""
    conv, after, started = None, END, False
    for batch in batches:
        found = []
        for now, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist()):
            if not started or now != conv:
                conv, after, started = now, END, True
            found.append(list(after))
            after = tuple(min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4))
        yield batch.append_column("after", pa.array(found, pa.list_(LONG)))


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from first to last: the states at their edges, and on the last of a conversation its counts (cost aside)."""
    pending: dict | None = None
    state, total = START, {}
    edge: tuple[int | None, int | None, int, str | None] = (None, None, 0, None)
    schema = None
    for batch in batches:
        if schema is None:
            schema = _table({"at": LONG, "state": LONG, "until": LONG, "last": pa.bool_()} | RESULT)
        out = []
        for row in batch.to_pylist():
            if pending is None or row["conv"] != pending["conv"]:
                if pending:
                    out.append(pending | {"last": True})
                state, total, edge = START, dict.fromkeys(COUNTS, 0), (None, None, 0, None)
            else:
                out.append(pending | {"last": False})
            first, last, distinct, initial = edge
            for c in COUNTS:
                total[c] += row[c]
            if initial is not None and row["initial_first"] is not None:
                total["illegal"] += initial + row["initial_first"] not in LEGAL
            distinct += row["distinct_turns"] - (last is not None and last == row["turn_first"])
            first, last = (row["turn_first"] if first is None else first), (last if row["turn_last"] is None else row["turn_last"])
            edge = (first, last, distinct, row["initial_last"] if row["n"] else initial)
            total["gaps"] = last - first + 1 - distinct if first is not None else 0
            costs, ranks = (tuple(row[c][4 * state : 4 * state + 4]) for c in ("costs", "ranks"))
            until = crossing(costs, ranks, tuple(row["after"]))
            pending = {"conv": row["conv"], "at": row["at"], "state": state, "until": until} | total
            state = until
        yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "conv"} for r in out], schema=schema)
    if pending:
        yield pa.RecordBatch.from_pylist([{k: v for k, v in pending.items() if k != "conv"} | {"last": True}], schema=schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece: its letters, what they cost, and the rows they leave."""
    for batch in batches:
        letters, costs, lines = [], [], []
        for row in batch.select(["codes", "state", "until", "last", "roles", "texts"]).to_pylist():
            codes = row["codes"]
            done, state = audit(codes, 0, len(codes), row["state"], tuple(0 if s == row["until"] else INF for s in range(4)))
            done += TAIL[state] if row["last"] else ""
            letters.append(done)
            costs.append(cost_of(done, codes))
            lines.append([{"role": r, "text": t} for r, t in edited(done, row["roles"], row["texts"], row["state"])])
        kept = [c for c in batch.schema.names if c in ("conv", "at", "last", *COUNTS) and c != "cost"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(costs, LONG), pa.array(letters, STR), pa.array(lines, LINE)], [*kept, "cost", "audit", "lines"]
        )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited pieces in order to one row for each conversation; only its letters are held."""
    seen, cost, letters, any_ = hashlib.sha256(), 0, [], False
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            for line in row["lines"]:
                seen.update(f"{chr(10) if any_ else ''}{line['role']}:{line['text']}".encode())
                any_ = True
            cost += row["cost"]
            letters.append(row["audit"])
            if row["last"]:
                done.append({c: row[c] for c in ("conv", *COUNTS)} | {"cost": cost, "audit": "".join(letters), "digest": seen.hexdigest()})
                seen, cost, letters, any_ = hashlib.sha256(), 0, [], False
        yield pa.RecordBatch.from_pylist(done, schema=_table({"conv": batch.schema.field("conv").type} | RESULT | {"audit": STR, "digest": STR}))


def _in_order(df: DataFrame, descending: bool = False) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", F.col("at").desc() if descending else "at")


@dataclass
class Repaired:
    """conversations: conv, the counts, audit and digest. lines: conv, at, lines (only if asked for): the rows left, a
    conversation's in the order of `at`."""

    conversations: DataFrame
    lines: DataFrame | None


def repair(rows: DataFrame, lines: bool = False, most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> Repaired:
    """Repair the rows that `damage` or `undamaged` gives."""
    kind = rows.schema["conv"].dataType.simpleString()
    counted = ", ".join(f"{c} long" for c in COUNTS)
    ordered = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), F.substring("role", 1, 16))
    ordered = ordered.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    schema = f"conv {kind}, " + PIECE.format(counted)
    found = cut_lineage(ordered.mapInArrow(_pieces(most_rows, most_bytes, lines), schema))
    whole, pieces = found.where("whole"), found.where("not whole").select("conv", "at", "turns", "roles", "texts")

    marked = pieces.join(_marked(pieces), "at", "left").select(*pieces.columns, "earlier")
    sums = cut_lineage(marked.mapInArrow(_summed, f"conv {kind}, at long, codes binary, {counted}, {EDGES}, {COSTS}"))
    small = sums.drop("codes")
    behind = _in_order(small, descending=True).mapInArrow(_to_the_end, f"{small.schema.simpleString()[7:-1]}, after: array<bigint>")
    states = _in_order(behind).mapInArrow(_fixed, f"at long, state long, until long, last boolean, {counted}")
    ready = sums.select("conv", "at", "codes").join(states, "at").join(pieces.select("at", "roles", "texts"), "at")
    edits = f"lines array<struct<role: string, text: string>>"
    others = ", ".join(f"{c} long" for c in COUNTS if c != "cost")
    ready = ready.select("conv", "at", "last", *[c for c in COUNTS if c != "cost"], "codes", "state", "until", "roles", "texts")
    done = cut_lineage(ready.mapInArrow(_edited, f"conv {kind}, at long, last boolean, {others}, cost long, audit string, {edits}"))
    joined = _in_order(done).mapInArrow(_streamed, f"conv {kind}, {counted}, audit string, digest string")
    columns = ["conv", *COUNTS, "audit", "digest"]
    all_lines = whole.select("conv", "at", "lines").unionByName(done.select("conv", "at", "lines")) if lines else None
    return Repaired(whole.select(*columns).unionByName(joined.select(*columns)), all_lines)
