import random

import pytest

from chartloom.llm import base, similar, simhash
from tests.llm.test_simhash import brute_fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> least doc_id reachable over two bits or a Jaccard similarity of 0.8."""
    root, sets, fps = list(range(len(rows))), [shingles(t) for t in rows], [brute_fingerprint(t) for t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    wide = 0
    for i in range(len(rows)):
        for j in range(i):
            near = bin(fps[i] ^ fps[j]).count("1") <= 2
            both = len(sets[i] & sets[j])
            alike = both > 0 and 5 * both >= 4 * len(sets[i] | sets[j])
            wide += alike and not near
            if near or alike:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(rows))}, wide


@pytest.mark.parametrize(("common", "most", "levels"), [(20, 256, 4), (3, 256, 4), (3, 1, 3), (10**6, 4, 2)])
def test_pairs_of_five_words_are_those_of_brute_force(spark, monkeypatch, common, most, levels):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "LIST", most)
    monkeypatch.setattr(similar, "LEVELS", levels)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(vocabulary, k=12))
    rows = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randrange(6, 150))
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy) + (f" {line}" if rng.random() < 0.5 else ""))
    rows += [rows[0], rows[0].upper(), None, "", "one", "one two three", line]
    want, wide = brute(rows)
    assert wide > 10
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = simhash.keep_first(documents, similar_shingle=5)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_sketches_differ_in_no_more_bits_than_the_sets():
    rng = random.Random(2)
    for size in (1, 30, 400, 5000):
        a = similar.shingle_set(" ".join(str(rng.randrange(999)) for _ in range(size)))
        b = similar.shingle_set(" ".join(str(rng.randrange(999)) for _ in range(size)))
        for x, y in ((a, b), (a, a[: len(a) // 2]), (a, a)):
            bits = sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(similar.sketch(x), similar.sketch(y), strict=True))
            assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_a_long_list_is_not_compared_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "COMMON", 10**9)  # no shingle counts as frequent, so one list has all texts
    monkeypatch.setattr(similar, "LIST", 256)
    made = []

    def counted(rows, keys, f=similar._pairs):
        found = f(rows, keys)
        made.append(found.count())
        return found

    monkeypatch.setattr(similar, "_pairs", counted)
    rng = random.Random(5)
    # five words whose hash comes first in every prefix
    line = next(x for x in (f"the same five words {i}" for i in range(10**6)) if similar.shingle_set(x)[0] < -(1 << 63) + (1 << 52))
    rows = [f"{line} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(4000)]
    rows.append(rows[7] + " end")
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    assert simhash.keep_first(documents, similar_shingle=5).count() == 4000
    assert len(made) > 1 and sum(made) < 4000


def test_texts_and_shingles_are_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(self, df, f=base.Scratch.store):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(self, df)

    monkeypatch.setattr(base.Scratch, "store", seen)
    monkeypatch.setattr(similar, "COMMON", 10**9)
    monkeypatch.setattr(similar, "LIST", 4)  # long lists are split, so all joins occur
    rng = random.Random(7)
    rows = [" ".join(f"w{rng.randrange(40)}" for _ in range(60)) for _ in range(20)]
    rows += [" ".join([*r.split()[3:], "end"]) for r in rows]
    rows += [f"{line} w{i}" for line in ("one and the same long line", "of six words") for i in range(12)]
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    simhash.keep_first(documents, similar_shingle=5).count()
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)


def test_the_sample_grows_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", 20)
    monkeypatch.setattr(similar, "COMMON", 2)
    made = []

    def counted(rows, keys, f=similar._pairs):
        found = f(rows, keys)
        made.append(found.count())
        return found

    monkeypatch.setattr(similar, "_pairs", counted)
    rng = random.Random(9)
    lines = [" ".join(f"v{i}w{j}" for j in range(10)) for i in range(20)]
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [" ".join([*(f"{word()} {x} {word()}" for x in rng.sample(lines, 2)), *(word() for _ in range(20))]) for _ in range(1500)]
    rows.append(rows[3] + " end")
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    assert simhash.keep_first(documents, similar_shingle=5).count() == 1500
    assert sum(made) < 150  # a sample of 20 texts doesn't know the lines: 29,717 pairs
