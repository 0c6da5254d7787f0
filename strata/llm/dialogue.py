"""Repair of conversations by a rank-compressed dynamic program (operator 11).

Every row of a conversation is kept, given another role or deleted, and turns
may be inserted, so that the roles' initials read ``(s?(ua)+)?`` at the least
cost. What happens between two rows is one macro edit: a run of inserts and the
turn behind it. Runs that a cheapest repair can need are empty or one insert,
and none stands before a deletion (behind it costs the same and sorts lower), so
the macro edits are the five codes ``D IK IR K R``. No code is a prefix of
another and they are in order, hence two audits over the same rows compare as
the sequences of their codes. A layer of the program has a row's four states; each
keeps its cost and the rank of its audit among the layer's instead of the audit,
and the next layer compares (cost, parent's rank, code). Parent pointers give
the audit afterwards. Differences of costs and ranks take few values, so layers
that were met before come from a table.

Rows are sorted by range, not gathered by conversation: an identical row's place
among its like is no matter, so even those are spread. A task packs its sorted
rows into pieces of one conversation, of ``rows`` rows at most. A piece that holds a
whole conversation is repaired at once. Pieces of a longer one are repaired by
their transfer: cost and rank from each state to each, composed along the
conversation (a row a piece), which gives every piece its first and last state;
each then finds its own audit.

Defined results: null roles and texts count as one space; rows are taken by turn
(nulls first), then by role, the text's first 64 characters and its hash; a null
conversation id is a conversation; a conversation whose rows are all absent has
zeros, no audit and no turns; an empty role is never kept; text that isn't UTF-8
has its wrong bytes replaced; repeated rows are duplicates; texts are whole,
whatever their length; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CODES = ("D", "IK", "IR", "K", "R")
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_INSERTED = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_TAIL = {EMPTY: 0, USER: 1, SYSTEM: 2, ASSISTANT: 0}
_FAR = 1 << 60
_WORDS = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
_NAMES = {"u": "user", "a": "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@functools.cache
def _macros(kind: str) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, cost, code) of what can be done with a row. ``kind``: "-" for a row to delete, else its role's initial, and "t" if it is truncated."""
    out = [(s, s, DELETE, 0) for s in STATES]
    if kind != "-":
        more = TRUNCATED if kind.endswith("t") else 0
        for run in (0, 1):
            for s in STATES:
                at = _INSERTED[s] if run else s
                if at in _NEXT.get(kind[0], {}):
                    out.append((s, _NEXT[kind[0]][at], run * INSERT + KEEP + more, 1 if run else 3))
                out += [(s, _NEXT[r][at], run * INSERT + REROLE + more, 2 if run else 4) for r in "ua" if at in _NEXT[r]]
    return tuple(out)


@functools.lru_cache(maxsize=1 << 16)
def _layer(kind: str, costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...], tuple[tuple[int, int], ...]]:
    """The next layer: least cost, costs above it, ranks, and (parent, code) of each state."""
    best: list[tuple[int, int, int, int]] = [(_FAR, 0, 0, 0)] * 4
    for s, t, cost, code in _macros(kind):
        if costs[s] < _FAR:
            best[t] = min(best[t], (costs[s] + cost, ranks[s], code, s))
    order = sorted({(r, c) for cost, r, c, _ in best if cost < _FAR})
    low = min(b[0] for b in best)
    return (
        low, tuple(b[0] - low if b[0] < _FAR else _FAR for b in best),
        tuple(order.index((r, c)) if cost < _FAR else 0 for cost, r, c, _ in best), tuple((s, c) for _, _, c, s in best),
    )


def forward(kinds: list[str], start: int = EMPTY) -> tuple[list[int], list[int], list[tuple[tuple[int, int], ...]]]:
    """Costs and ranks of the last layer, and every layer's parents and codes."""
    costs, ranks, total, layers = tuple(0 if s == start else _FAR for s in STATES), (0, 0, 0, 0), 0, []
    for kind in kinds:
        low, costs, ranks, parents = _layer(kind, costs, ranks)
        total += low
        layers.append(parents)
    return [c + total if c < _FAR else _FAR for c in costs], list(ranks), layers


def codes_of(layers: list[tuple[tuple[int, int], ...]], end: int) -> list[int]:
    """The codes that lead to a state, by parent pointers."""
    out = []
    for parents in reversed(layers):
        end, code = parents[end]
        out.append(code)
    return out[::-1]


def last_state(costs: list[int], ranks: list[int]) -> int:
    """The state from which the cheapest repair ends; of equal costs the one with the least audit."""
    return min((costs[s] + _TAIL[s] * INSERT, ranks[s], s) for s in STATES if costs[s] < _FAR)[2]


def applied(codes: list[int], roles: list[str], texts: list[str], start: int, tail: bool) -> tuple[str, list[str], list[str]]:
    """Audit, and the repaired turns' roles and texts."""
    state, audit, out_roles, out_texts = start, [], [], []

    def put(role: str, text: str) -> None:
        nonlocal state
        state = _NEXT[role[0]][state]
        out_roles.append(role)
        out_texts.append(text)

    for code, role, text in zip(codes, roles, texts, strict=True):
        audit.append(CODES[code])
        if code in (1, 2):
            put("assistant" if state == USER else "user", "")
        if code in (1, 3):
            put(role, text)
        elif code in (2, 4):
            put("assistant" if state == USER else "user", text)
    for _ in range(_TAIL[state] if tail else 0):
        audit.append("I")
        put("assistant" if state == USER else "user", "")
    return "".join(audit), out_roles, out_texts


def fault(text: str, seen: bool) -> str:
    """A row's first fault: blank, duplicate, truncated or none."""
    if not _WORDS.search(text):
        return "blank"
    return "duplicate" if seen else "truncated" if _LAST.search(text)[1] not in ".!?" else ""


def kind_of(role: str, found: str) -> str:
    if found in ("blank", "duplicate"):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial + "t" * (found == "truncated")


def counts(turns: list[int | None], roles: list[str], faults: list[str], turn_before: int | None = None, role_before: str | None = None) -> dict[str, int]:
    """What a piece adds to its conversation's counts; ``_before`` are of the row before it (the last turn that isn't null)."""
    out = {"gaps": 0, "illegal": 0} | {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    for t in turns:
        if t is not None:
            out["gaps"] += max(0, t - turn_before - 1) if turn_before is not None else 0
            turn_before = t
    for r in roles:
        out["illegal"] += role_before is not None and role_before[:1] + r[:1] not in ("su", "ua", "au")
        role_before = r
    return out


def row_key(role: str, text: str) -> bytes:
    """Digest of a role and a text."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(f"{len(role)}:{role}{text}".encode())


def _piece(kind: str) -> str:
    return f"conv_id {kind}, piece long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, roles array<string>, texts array<string>"


def _packed(rows: DataFrame, kind: str, most: int, most_bytes: int = 1 << 22) -> DataFrame:
    """Sorted rows as pieces: repaired where a piece is a whole conversation, else ``open`` with its turns, roles and texts as they are. A written table."""
    schema = f"{_piece(kind)}, open boolean, turns array<long>"
    types = {"conv_id": None, "piece": pa.int64(), **{c: pa.int64() for c in COUNTS}, "audit": pa.string(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "open": pa.bool_(), "turns": pa.list_(pa.int64())}

    def whole(turns, roles, texts):
        seen, faults = set(), []
        for r, t in zip(roles, texts, strict=True):
            faults.append(fault(t, (r, t) in seen))
            seen.add((r, t))
        costs, ranks, layers = forward([kind_of(r, f) for r, f in zip(roles, faults, strict=True)])
        end = last_state(costs, ranks)
        audit, out_roles, out_texts = applied(codes_of(layers, end), roles, texts, EMPTY, True)
        return counts(turns, roles, faults) | {"cost": costs[end] + _TAIL[end] * INSERT, "audit": audit, "roles": out_roles, "texts": out_texts}

    def run(batches):
        base, n, first = TaskContext.get().partitionId() << 33, 0, True
        out: list[dict] = []
        conv, held, size, is_open = None, ([], [], []), 0, True

        def close(open_: bool) -> None:
            nonlocal n, held, size
            turns, roles, texts = held
            row = dict.fromkeys(COUNTS, 0) | {"audit": "", "turns": turns, "roles": roles, "texts": texts} if open_ else whole(turns, roles, texts) | {"turns": []}
            out.append(row | {"conv_id": conv, "piece": base + n, "open": open_})
            n, held, size = n + 1, ([], [], []), 0

        def flush(kind_: pa.DataType) -> pa.RecordBatch:
            got = pa.record_batch([pa.array([r[c] for r in out], t or kind_) for c, t in types.items()], names=list(types))
            out.clear()
            return got

        id_type = None
        for b in batches:
            id_type = b.schema.field("conv_id").type
            for c, there, turn, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "there", "turn", "role", "text")), strict=True):
                if first or c != conv:
                    if not first:
                        close(is_open)
                    # the first conversation of a task may have begun in the one before
                    is_open, conv, first = first, c, False
                elif len(held[0]) >= most or size >= most_bytes:
                    is_open = True
                    close(True)
                if there:
                    for x, v in zip(held, (turn, role, text), strict=True):
                        x.append(v)
                    size += len(text)
                if len(out) >= 256:
                    yield flush(id_type)
        if not first:
            close(True)  # and the last one may go on in the next
            yield flush(id_type)

    return written(rows.mapInArrow(run, schema), "packed")


def _kinds(raw: DataFrame, kind: str) -> DataFrame:
    """(conv_id, piece, kinds, faults, first and last turn and role) of open pieces: duplicates are found by each digest's first place."""

    def keys(batches):
        for b in batches:
            for c, piece, roles, texts in zip(*(b.column(x).to_pylist() for x in ("conv_id", "piece", "roles", "texts")), strict=True):
                yield pa.record_batch([pa.array([c] * len(roles), b.schema.field("conv_id").type), pa.array([row_key(r, t) for r, t in zip(roles, texts, strict=True)], pa.binary()), pa.array([piece] * len(roles), pa.int64()), pa.array(range(len(roles)), pa.int32())], names=["conv_id", "key", "piece", "at"])

    firsts = raw.select("conv_id", "piece", "roles", "texts").mapInArrow(keys, f"conv_id {kind}, key binary, piece long, at int")
    firsts = firsts.groupBy("conv_id", "key").agg(F.min(F.struct("piece", "at")).alias("f")).groupBy(F.col("f.piece").alias("piece")).agg(F.collect_list("f.at").alias("firsts"))

    def mark(batches):
        for b in batches:
            out = []
            for turns, roles, texts, new in zip(*(b.column(x).to_pylist() for x in ("turns", "roles", "texts", "firsts")), strict=True):
                new = set(new or ())
                faults = [fault(t, i not in new) for i, t in enumerate(texts)]
                known = [t for t in turns if t is not None]
                out.append(([kind_of(r, f) for r, f in zip(roles, faults, strict=True)], counts(turns, roles, faults), known[0] if known else None, known[-1] if known else None, roles[0] if roles else None, roles[-1] if roles else None))
            columns = [pa.array([x[0] for x in out], pa.list_(pa.string()))]
            columns += [pa.array([x[1][c] for x in out], pa.int64()) for c in COUNTS[:-1]]
            columns += [pa.array([x[i] for x in out], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.string()), (5, pa.string()))]
            yield pa.record_batch([b.column("conv_id"), b.column("piece"), *columns], names=["conv_id", "piece", "kinds", *COUNTS[:-1], "turn_a", "turn_z", "role_a", "role_z"])

    schema = f"conv_id {kind}, piece long, kinds array<string>, " + ", ".join(f"{c} long" for c in COUNTS[:-1]) + ", turn_a long, turn_z long, role_a string, role_z string"
    return written(raw.join(firsts, "piece", "left").select("conv_id", "piece", "turns", "roles", "texts", "firsts").mapInArrow(mark, schema), "kinds")


def _ends(marked: DataFrame, kind: str) -> DataFrame:
    """(piece, start, end, last, counts): the states between which each open piece is repaired."""

    def transfer(batches):
        for b in batches:
            costs, ranks = [], []
            for kinds in b.column("kinds").to_pylist():
                found = [forward(kinds, s) for s in STATES]
                costs.append([c for f in found for c in f[0]])
                ranks.append([r for f in found for r in f[1]])
            rest = [c for c in b.schema.names if c != "kinds"]
            yield pa.record_batch([*(b.column(c) for c in rest), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], names=[*rest, "costs", "ranks"])

    narrow = f"conv_id {kind}, piece long, " + ", ".join(f"{c} long" for c in COUNTS[:-1]) + ", turn_a long, turn_z long, role_a string, role_z string"
    moved = marked.select("conv_id", "piece", *COUNTS[:-1], "turn_a", "turn_z", "role_a", "role_z", "kinds").mapInArrow(transfer, f"{narrow}, costs array<long>, ranks array<int>")

    def compose(rows: list[dict]) -> Iterator[dict]:
        costs, ranks, layers, turn, role = [0 if s == EMPTY else _FAR for s in STATES], [0] * 4, [], None, None
        for r in rows:
            best = [min(((costs[s] + r["costs"][4 * s + t], ranks[s], r["ranks"][4 * s + t], s) for s in STATES if costs[s] < _FAR and r["costs"][4 * s + t] < _FAR), default=(_FAR, 0, 0, 0)) for t in STATES]
            order = sorted({x[1:3] for x in best if x[0] < _FAR})
            costs, ranks = [x[0] for x in best], [order.index(x[1:3]) if x[0] < _FAR else 0 for x in best]
            layers.append([x[3] for x in best])
            if turn is not None and r["turn_a"] is not None:
                r["gaps"] += max(0, r["turn_a"] - turn - 1)
            if role is not None and r["role_a"] is not None:
                r["illegal"] += role[:1] + r["role_a"][:1] not in ("su", "ua", "au")
            turn, role = (turn if r["turn_z"] is None else r["turn_z"]), (role if r["role_z"] is None else r["role_z"])
        end = last_state(costs, ranks)
        tail = _TAIL[end] * INSERT
        for i in reversed(range(len(rows))):
            start = layers[i][end]
            yield rows[i] | {"start": start, "end": end, "last": i == len(rows) - 1, "cost": rows[i]["costs"][4 * start + end] + tail}
            end, tail = start, 0

    names = ["conv_id", "piece", *COUNTS, "start", "end", "last"]

    def run(batches):
        held: list[dict] = []

        def flush(id_type):
            found = list(compose(held))
            types = [id_type, *[pa.int64()] * (len(COUNTS) + 3), pa.bool_()]
            return pa.record_batch([pa.array([r[c] for r in found], t) for c, t in zip(names, types, strict=True)], names=names)

        id_type = None
        for b in batches:
            id_type = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if held and held[0]["conv_id"] != r["conv_id"]:
                    yield flush(id_type)
                    held = []
                held.append(r)
        if held:
            yield flush(id_type)

    dealt = moved.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = f"conv_id {kind}, piece long, " + ", ".join(f"{c} long" for c in COUNTS) + ", start long, end long, last boolean"
    return written(dealt.mapInArrow(run, schema), "ends")


def repair(rows: DataFrame, there: Column | None = None, most: int = 4096) -> DataFrame:
    """Repaired conversations in pieces: (conv_id, piece, counts, audit, roles, texts), from (conv_id, turn, role, text).

    A conversation's pieces follow each other by ``piece``: its audit and turns are theirs joined, its
    counts (gaps, blank, duplicate, truncated, illegal, cost) their sums. ``piece`` is the only one of its
    conversation unless this has more than ``most`` rows or lies at a border of the sort's ranges. Rows for
    which ``there`` is false are no turns and only name their conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit(" ")))
    role = F.make_valid_utf8(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(True) if there is None else there).alias("there"))
    # equal rows may stand in any order, so a number of the row's own spreads them over ranges
    source = source.withColumns({"_head": F.left("text", F.lit(64)), "_hash": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "_hash", "_n"]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = _packed(ordered.select("conv_id", "there", "turn", "role", "text"), kind, most)
    raw = packed.where("open").select("conv_id", "piece", "turns", "roles", "texts")
    marked = _kinds(raw, kind)
    ends = _ends(marked, kind)
    wanted = ends.select("piece", *COUNTS, "start", "end", "last").join(marked.select("piece", "kinds"), "piece")

    def solve(batches):
        for b in batches:
            audits, all_roles, all_texts = [], [], []
            for kinds, start, end, last, roles, texts in zip(*(b.column(c).to_pylist() for c in ("kinds", "start", "end", "last", "roles", "texts")), strict=True):
                audit, out_roles, out_texts = applied(codes_of(forward(kinds, start)[2], end), roles, texts, start, last)
                audits.append(audit)
                all_roles.append(out_roles)
                all_texts.append(out_texts)
            yield pa.record_batch([b.column("conv_id"), b.column("piece"), *(b.column(c) for c in COUNTS), pa.array(audits, pa.string()), pa.array(all_roles, pa.list_(pa.string())), pa.array(all_texts, pa.list_(pa.string()))], names=["conv_id", "piece", *COUNTS, "audit", "roles", "texts"])

    opened = raw.select("conv_id", "piece", "roles", "texts").join(wanted, "piece").select("conv_id", "piece", *COUNTS, "kinds", "start", "end", "last", "roles", "texts").mapInArrow(solve, _piece(kind))
    closed = packed.where("not open").select("conv_id", "piece", *COUNTS, "audit", "roles", "texts")
    return closed.withColumn("whole", F.lit(True)).unionByName(opened.withColumn("whole", F.lit(False)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults: (conv_id, turn, role, text, there), by crc32 of "conv_id:turn" modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), h.alias("h"))
    rows = rows.withColumns({
        "role": F.when(F.col("h") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "there": F.col("h") != 0,
        "copy": F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("conv_id", "turn", "role", "text", "there")


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256) of every conversation, from :func:`repair`'s pieces.

    Whole conversations need no shuffle. A digest runs through its conversation in order, so the pieces of a
    long one stream through one task, which holds one piece and the audit.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, held = None, None

        def row():
            return [conv, *held[:-2], "".join(held[-2]), held[-1].hexdigest()]

        for b in batches:
            out = []
            for c, *numbers, audit, roles, texts in zip(*(b.column(x).to_pylist() for x in ("conv_id", *COUNTS, "audit", "roles", "texts")), strict=True):
                if held is None or c != conv:
                    if held:
                        out.append(row())
                    conv, held, empty = c, [*[0] * len(COUNTS), [], hashlib.sha256()], True
                for i, v in enumerate(numbers):
                    held[i] += v
                held[-2].append(audit)
                for role, text in zip(roles, texts, strict=True):
                    held[-1].update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield made(out, b.schema.field("conv_id").type)
            id_type = b.schema.field("conv_id").type
        if held:
            yield made([row()], id_type)

    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def made(out: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    found = pieces.select("conv_id", "piece", *COUNTS, "audit", "roles", "texts", "whole")
    split = found.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return found.where("whole").mapInArrow(run, schema).unionByName(split.mapInArrow(run, schema))
