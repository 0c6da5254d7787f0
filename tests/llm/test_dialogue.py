"""Conversation repair against plain dynamic programs over whole audit strings."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from strata.llm import dialogue, queries
from strata.llm.dialogue import COUNTS

BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, turns): the least of all edits, by whole audits; inserts anywhere, up to three at a place."""
    best = {"": (0, "", ())}  # by the automaton's state
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def with_inserts(best):
        for _ in range(3):
            more = dict(best)
            for state, (cost, audit, turns) in best.items():
                for role in ("user", "assistant"):
                    if to := step.get((state, role[0])):
                        put(more, to, (cost + 5, audit + "I", (*turns, (role, ""))))
            best = more
        return best

    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        # audits of one state may extend each other, so the states before and after inserts are kept apart
        found = {}
        for state, (cost, audit, turns) in with_inserts(best).items():
            options = [(cost + 2, audit + "D", turns, state)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options += [(cost + more, audit + "K", (*turns, (role, text)), step.get((state, role[:1])))]
                options += [(cost + 1 + more, audit + "R", (*turns, (r, text)), step.get((state, r[0]))) for r in ("user", "assistant")]
            for c, a, t, to in options:
                if to is not None:
                    put(found, to, (c, a, t))
        best = {s: v for s, v in found.items()}
        # what a deletion behind an insert gives is never less than the insert behind the deletion
    ends = [v for s, v in with_inserts(best).items() if s in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def every_repair(rows):
    """The same by trying all edits, with up to two inserts at a place."""
    faults, found = faults_of(rows), []
    inserts = ["", "I", "II"]
    for runs in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits, strict=True)):
                continue
            cost = 5 * sum(map(len, runs)) + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, faults, strict=True))
            slots = []
            for i, run in enumerate(runs):
                slots += ["?"] * len(run)
                if i < len(rows) and edits[i] != "D":
                    slots.append(rows[i][0][:1] if edits[i] == "K" else "?")
            want = None
            for first in ("", "s"):
                ideal = first + "ua" * ((len(slots) - len(first)) // 2)
                if len(ideal) == len(slots) and (ideal != "s") and all(s == i or s == "?" and i != "s" for s, i in zip(slots, ideal, strict=True)):
                    want = ideal
            if want is not None:
                found.append((cost, "".join(r + e for r, e in itertools.zip_longest(runs, edits, fillvalue=""))))
    return min(found)


def expected(rows):
    """The whole query over (conv_id, turn, role, text)."""
    damaged = {}
    for conv, turn, role, text in rows:
        damaged.setdefault(conv, [])
        plain = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        if h:
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            damaged[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, found in damaged.items():
        found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain = [(r, t) for _, r, t in found]
        faults, turns = faults_of(plain), [t for t, _, _ in found if t is not None]
        cost, audit, repaired = plain_repair(plain)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    found = df.select("conv_id", *COUNTS, "audit", "repaired_sha256").collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r[1:]) for r in found}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, piece int")


ROLES, TEXTS = ["user", "assistant", "system", "tool", "unknown", "User", " ", None], ["Yes.", "No", "Why? ", "", " \n", None, "Fine!", "a", "x" * 3000 + "."]


def random_rows(rng, conversations, most):
    return [(c, rng.choice([t, t, t + 3, None]), rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), rng.choice([rng.choice(TEXTS), f"Text {rng.randrange(99)}."])) for c in [*range(conversations), None] for t in range(rng.randrange(1, most))]


def test_program_against_all_edits(rng):
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", f"{rng.random()}."])) for _ in range(rng.randrange(0, 4))]
        kinds = [dialogue.kind_of(r, f) for (r, _), f in zip(rows, faults_of(rows), strict=True)]
        costs, ranks, layers = dialogue.forward(kinds)
        end = dialogue.last_state(costs, ranks)
        audit, _, _ = dialogue.applied(dialogue.codes_of(layers, end), [r for r, _ in rows], [t for _, t in rows], 0, True)
        assert (costs[end] + 5 * dialogue._TAIL[end], audit) == every_repair(rows), rows


@pytest.mark.parametrize("most", [1, 2, 7, 4096])
def test_pieces_of_any_size_give_the_plain_repair(spark, rng, most):
    rows = random_rows(rng, 40, 30)
    found = dialogue.digests(dialogue.repair(dialogue.damaged(frame(spark, rows)), F.col("there"), most=most))
    assert result(found) == expected(rows)


def test_a_conversation_of_a_third_of_all_rows(spark, rng):
    rows = [(7, t, rng.choice(ROLES[:3]), f"{rng.randrange(400)}.") for t in range(3000)] + [(7, 5000, "user", "Again.")] * 1500 + random_rows(rng, 300, 30)
    df = frame(spark, rows).repartition(16)
    pieces = dialogue.repair(dialogue.damaged(df), F.col("there"), most=256).persist()
    assert pieces.where("conv_id = 7").count() > 8
    assert result(dialogue.digests(pieces)) == expected(rows)
    pieces.unpersist()


def test_edges(spark):
    empty = frame(spark, [])
    assert result(dialogue.digests(dialogue.repair(dialogue.damaged(empty), F.col("there")))) == {}
    # 0 drops a row: a conversation of which nothing is left
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None), (-5, None, "user", "Hi."), (-6, 2**40, "assistant", "Ünï 😀."), (-6, -3, "user", "Ünï 😀?")]
    got = result(dialogue.digests(dialogue.repair(dialogue.damaged(frame(spark, rows)), F.col("there"))))
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_text_that_is_not_utf8(spark):
    df = spark.sql("select 1L conv_id, 0L turn, 'user' role, cast(x'4F6BFF2E' as string) text union all select 1L, 1L, 'assistant', 'Yes.'")
    pieces = dialogue.repair(df).collect()
    assert [t for p in sorted(pieces, key=lambda p: p.piece) for t in p.texts] == ["Ok�.", "Yes."]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.queries()["op11_dialogue_repair"](spark, sf)) == expected(rows)
