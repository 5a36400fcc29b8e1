import hashlib
import random
import re
import zlib

import pytest

from tallycast.llm import turn_repair as T

GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = BLANK.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, found):
    """All edits of all rows, the cheapest path by roles written so far kept with its complete audit."""
    paths = {"": (0, "", [])}

    def offer(into, state, path):
        if not re.fullmatch(r"s?(ua)*u?", state):
            return None
        turns = state.lstrip("s")
        if len(turns) > 2:  # what may follow depends on the last role only
            state = state[: len(state) - len(turns)] + ("ua" if len(turns) % 2 == 0 else "u")
        if state in into and into[state][:2] <= path[:2]:
            return None
        into[state] = path
        return state

    def inserted(paths):
        todo = list(paths)
        while todo:
            state = todo.pop()
            cost, audit, lines = paths[state]
            for role in ("user", "assistant"):
                changed = offer(paths, state + role[0], (cost + 2, audit + "I", lines + [f"{role}:"]))
                if changed is not None:
                    todo.append(changed)

    for (_, _, role, text), fault in zip(rows, found):
        inserted(paths)
        after = {}
        for state, (cost, audit, lines) in paths.items():
            offer(after, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    offer(after, state + role[0], (cost + more, audit + "K", lines + [f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    offer(after, state + other[0], (cost + 2 + more, audit + "R", lines + [f"{other}:{text}"]))
        paths = after
    inserted(paths)
    return min(p for s, p in paths.items() if GRAMMAR.fullmatch(s))


def brute(original):
    def place(r):
        return r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()

    rows, out = damage(original), []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=place)
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = best_edits(own, found)
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, conversations, longest):
    draw, rows = random.Random(seed), []
    for conv in range(conversations):
        roles = draw.choice([["system", "user", "assistant"], ["user"], ["system"], ["assistant"], ["user", "assistant", "tool", None, ""]])
        for turn in range(draw.randint(1, longest)):
            clean = draw.random() < 0.6
            role = ("system" if turn == 0 and draw.random() < 0.3 else "user" if turn % 2 else "assistant") if clean else draw.choice(roles)
            text = draw.choice(["a.", "b", "", " \t", "é! ", f"{draw.random()}.", f"{draw.random()}?", None])
            rows.append((conv if conv else None, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rows[:5]


SCHEMA = "conv_id long, turn int, role string, text string"


def answer(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cost int, audit string")
    return sorted(map(tuple, T.repair(frame, T.damaged(frame)).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rows = random_rows(seed, 150, 14)
    assert answer(spark, rows) == brute(rows)


def test_conversations_cut_between_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in (3, 4):
            rows = random_rows(seed, 3, 120)
            assert answer(spark, rows) == brute(rows)
        pieces = T._pieces(T._judged(T.damaged(spark.createDataFrame(rows, SCHEMA))))
        assert pieces.filter("NOT whole").select("part").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audit_is_the_least_of_all_edit_sequences():
    """Exhaustive: every string of edits that gives a legal sequence, not only the best per state."""
    draw = random.Random(5)
    for _ in range(300):
        rows = [(1, t, draw.choice(["system", "user", "assistant"]), draw.choice(["x.", f"{t}.", f"{t}", ""])) for t in range(draw.randint(0, 5))]
        found = faults(rows)
        best = [(99, "")]

        def walk(at, state, cost, audit):
            if (cost, audit) >= best[0] and cost >= best[0][0]:
                return
            if at == len(rows) and GRAMMAR.fullmatch(state):
                best[0] = min(best[0], (cost, audit))
            if not re.fullmatch(r"s?(ua)*u?", state) or cost > 3 * len(rows):
                return
            for c in "ua":
                if not audit.endswith("II"):
                    walk(at, state + c, cost + 2, audit + "I")
            if at < len(rows):
                walk(at + 1, state, cost + 3, audit + "D")
                if found[at] not in ("blank", "duplicate"):
                    more = found[at] == "truncated"
                    walk(at + 1, state + rows[at][2][0], cost + more, audit + "K")
                    for c in "ua":
                        walk(at + 1, state + c, cost + 2 + more, audit + "R")

        walk(0, "", 0, "")
        run = T.Survivors(0)
        for (_, _, role, _), fault in zip(rows, found):
            run.repeat_deleted(1) if fault in ("blank", "duplicate") else run.step(T.OPTIONS[role[0], int(fault == "truncated")])
        got = min((c + 2 * len(T.ENDING[s]), a + T.ENDING[s]) for s, c, _, a in run.ends())
        assert got == best[0] == best_edits(rows, found)[:2]


def test_edits_are_emitted_and_memory_is_bounded():
    run = T.Survivors(0)
    for k in range(5000):
        run.step(T.OPTIONS["ua"[k % 2], 0])
    size = [0]

    def count(node):
        size[0] += 1
        for kid in node.kids:
            count(kid)

    count(run.root)
    assert size[0] < 10 and len(run.done) > 4990
    run.repeat_deleted(10**6)
    assert len(run.ends()[0][3]) > 10**6


def test_empty_tables_and_dropped_conversations(spark):
    assert T.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    assert answer(spark, dropped) == sorted(((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in dropped), key=str)


def test_plain_repair_without_damage(spark):
    long = "w " * 500_000 + "."
    rows = [("c", 1, "user", "Hi."), ("c", 2, "user", long), ("d", 5, "assistant", "A.")] + [("e", 0, "user", "same.")] * 50
    got = {r.conv_id: (r.audit, r.cost, r.duplicate, r.repaired_sha256) for r in T.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got["c"] == ("KR", 2, 0, sha("user:Hi.", "assistant:" + long))
    assert got["d"] == ("IK", 2, 0, sha("user:", "assistant:A."))
    assert got["e"] == ("K" + "D" * 49 + "I", 149, 49, sha("user:same.", "assistant:"))
