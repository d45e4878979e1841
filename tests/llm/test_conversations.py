import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from chartloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_edits(rows):
    """(cost, audit, repaired lines) by trying every edit: the least cost, then the least string of letters."""

    @lru_cache(None)
    def best(t, state, inserts):
        found = []
        if t == len(rows) and state in "ea":
            found.append((0, "", ()))
        step = lambda cost, letter, line, rest: found.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        if inserts < 3:
            new = "a" if state == "u" else "u"
            step(2, "I", ("assistant" if new == "a" else "user") + ":", best(t, new, inserts + 1))
        if t < len(rows):
            role, text, fault = rows[t]
            step(3, "D", None, best(t + 1, state, 0))
            if fault in ("fine", "truncated"):
                stays, i = fault == "truncated", role[:1]
                if i == "s" and state == "e" or i == "u" and state != "u" or i == "a" and state == "u":
                    step(stays, "K", f"{role}:{text}", best(t + 1, i, 0))
                new = "a" if state == "u" else "u"
                step(2 + stays, "R", ("assistant" if new == "a" else "user") + f":{text}", best(t + 1, new, 0))
        return min(found) if found else (10**9, "", ())

    return best(0, "e", 0)


def brute(data, damage=True):
    groups = {}
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        rows = groups.setdefault(conv, [])
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "fine")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = brute_edits(tuple((r[1], r[2], f) for r, f in zip(rows, faults, strict=True)))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = ((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), lines)
    return out


def random_rows(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why?", "é!", "so\t", "a.b", None, "漢字。", "x" * 300 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher", "s"]
    out = []
    for conv in range(n):
        turns = rng.randrange(longest)
        flow = rng.random() < 0.5
        for t in range(turns):
            role = ("user", "assistant")[t % 2] if flow and rng.random() < 0.8 else rng.choice(roles)
            text = f"{rng.choice('abc')} line {t}." if rng.random() < 0.5 else rng.choice(texts)
            out.append((conv, None if rng.random() < 0.04 else rng.choice([t, t, t, t + 1, t + 3]), role, text))
            if rng.random() < 0.05:
                out.append(out[-1])
    out += [(None, 1, "user", "Hi."), (None, 2, "assistant", None), (-3, None, None, None)]
    rng.shuffle(out)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_digest_is_that_of_brute_force(spark):
    data = random_rows(1, 250, 14)
    frame = spark.createDataFrame([(*r, "k", 1) for r in data], SCHEMA + ", audit string, conv int")
    want = sorted((x for x, _ in brute(data).values()), key=str)
    assert rows_of(C.digest(frame)) == want
    assert C.digest(frame.limit(0)).collect() == []
    assert {c for w in want for c in w[7]} == set("DIKR")


@pytest.mark.parametrize("most", [0, 5])
def test_long_conversations_in_chunks_give_the_same(spark, most):
    data = random_rows(2, 30, 40)
    frame = spark.createDataFrame(data, SCHEMA).repartition(7)
    assert rows_of(C.digest(frame, most_rows=most, chunk=4)) == sorted((x for x, _ in brute(data).values()), key=str)


def test_conversations_that_are_long_by_bytes(spark):
    data = [(1, t, ("user", "assistant")[t % 2], "long text. " * 5000) for t in range(6)] + [(2, 0, "user", "Hm"), (2, 1, "assistant", "Ok.")]
    frame = spark.createDataFrame(data, SCHEMA)
    assert rows_of(C.digest(frame, most_bytes=100_000)) == rows_of(C.digest(frame)) == sorted((x for x, _ in brute(data).values()), key=str)


@pytest.mark.parametrize("most", [C.MOST_ROWS, 3])
def test_repaired_rows(spark, most):
    data = random_rows(3, 40, 12)
    found = C.repair(spark.createDataFrame(data, SCHEMA), most_rows=most, chunk=4).orderBy("conv_id", "place").collect()
    for conv, (_, lines) in brute(data, damage=False).items():
        mine = [r for r in found if r.conv_id == conv]
        assert tuple(f"{r.role}:{r.text}" for r in mine) == lines
        assert all((r.edit == "I") == (r.text == "" and r.turn is None) or r.edit != "I" for r in mine)


def test_string_ids_and_one_conversation_with_most_rows(spark):
    rng = random.Random(5)
    data = [("hot", t, rng.choice(["user", "assistant", "system"]), rng.choice(["Ok.", "Ok", f"{t}."])) for t in range(3000)] + [("cold", 0, "user", "a"), ("", None, "user", "a")]
    frame = spark.createDataFrame(data, SCHEMA.replace("conv_id long", "conv_id string"))
    assert rows_of(C.digest(frame, most_rows=1000, chunk=256)) == rows_of(C.digest(frame))


def test_many_copies_of_one_row_are_counted_not_kept(spark):
    frame = spark.range(50_000).selectExpr("7L AS conv_id", "3L AS turn", "'user' AS role", "'Same.' AS text")
    (got,) = C.digest(frame).collect()
    kept = zlib.crc32(b"7:3") % 20
    n = 50_000 * (0 if kept == 0 else 2 if kept == 3 else 1)
    assert (got.duplicate, got.illegal, len(got.audit)) == (n - 1, n - 1, n + 1) and got.cost == 3 * (n - 1) + 2
