import hashlib
import random
import re
import time

import pytest

from chartloom.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def windows(items):
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            found.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    return found


def hits(text, found):
    w, at, items = words(text), set(), set()
    for size in {len(g) for g in found}:
        for i in range(len(w) - size + 1):
            if (own := found.get(tuple(w[i : i + size]))) is not None:
                at |= set(range(i, i + size))
                items |= own
    return w, at, items


def brute(text, found):
    w, at, items = hits(text, found)
    return (len(w), len(at), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(at) and 20 * len(at) >= len(w))


def tables():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choices("alpha Beta gamma d1 é ñu X y2 zeta".split(), k=n))
    items = [(1, some(20)), (2, some(13)), (3, "Short item, of six words only"), (12, some(30)), (4, None), (5, "  .,; "), (6, "short ITEM of six words only")]
    items += [(7, items[0][1]), (None, "null id item")]
    texts = [None, "", "...", "a", items[0][1], items[1][1].upper(), "say: SHORT item of six, words only! and more", some(400) + ". " + items[3][1] + " " + some(300), "null id item"]
    texts += [some(rng.randrange(1, 60)) + " " + " ".join(items[rng.choice((0, 1, 3))][1].split()[: rng.randrange(8, 20)]) + " " + some(9) for _ in range(40)]
    texts.append(" ".join([some(50), items[0][1]] * 300))
    return items, texts


@pytest.mark.parametrize("most", [50_000, 1, 0])
def test_both_ways_are_brute_force(spark, most):
    items, texts = tables()
    rows = [(i, t, 7, "x", "y") for i, t in enumerate(texts)] + [(4, texts[4], 7, "x", "y"), (None, texts[5], 1, None, "z")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _j string, contaminated string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = windows([(i, t) for i, t in items if i is not None] + [("", t) for i, t in items if i is None])
    got = decontaminate.match(documents, benchmark, max_windows=most)
    assert got.columns == ["doc_id", "text", "_j", *decontaminate.ADDED]
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    seen = sorted(str((r.doc_id, r.n_words, r.n_hit, sha(r.item_ids), r.contaminated)) for r in got.collect())
    named = windows([(i, t) for i, t in items if i is not None])
    whole = {g: named.get(g, set()) for g in found}
    want = []
    for r in rows:
        w, at, ids = hits(r[1], whole)
        want.append(str((r[0], len(w), len(at), sha(sorted(ids)), bool(at) and 20 * len(at) >= len(w))))
    assert seen == sorted(want)


@pytest.mark.parametrize("most", [50_000, 1])
def test_removal_leaves_other_columns_alone(spark, most):
    items, texts = tables()
    names = ("_j", "judged", "key", "hits", "n_words", "contaminated", "hash")
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    benchmark = spark.createDataFrame(items[:4], "item_id long, text string")
    found = windows(items[:4])
    kept = decontaminate.remove(documents, benchmark, max_windows=most)
    assert kept.schema == documents.schema
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if not brute(r[1], found)[-1])
    cleared = decontaminate.remove(documents, benchmark, "spans", max_windows=most)
    assert cleared.schema == documents.schema
    for r in cleared.collect():
        text = texts[r.doc_id]
        w, at, _ = hits(text, found)
        n = iter(range(len(w)))
        want = text and re.sub(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), lambda m: "" if next(n) in at else m[0], text)  # noqa: B023
        assert r.text == want and r.judged == f"judged{r.doc_id}" and len(words(r.text)) == len(w) - len(at)


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    for most in (50_000, -1):
        got = decontaminate.match(documents, nothing, max_windows=most).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert decontaminate.match(documents.limit(0), spark.createDataFrame([(1, "one two")], "item_id long, text string")).collect() == []


def test_each_window_stands_once_in_the_plan(spark):
    items = spark.range(13_000).selectExpr("id AS item_id", "array_join(transform(sequence(1, CAST(id % 13 AS int) + 1), i -> concat('w', hex(id * 31 + i * 7919))), ' ') AS text")
    first = items.where("item_id = 12").first().text
    documents = spark.createDataFrame([(1, "x " * 30), (2, None), (3, "a " + first + " b")], "doc_id long, text string")
    began = time.time()
    found = decontaminate.digest(documents, items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in found.collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (13, True)} and time.time() - began < 60
    # a word stands in one table of constants, a window's first one also in the list of first words
    assert all(len(re.findall(rf"\b{w}\b", plan)) <= 2 for w in first.split())
