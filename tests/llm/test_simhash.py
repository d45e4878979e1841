import random

import numpy as np
import pytest
import xxhash

from chartloom.llm import base, components, covering, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """doc_id -> least doc_id reachable over links of at most two bits."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_every_near_word_reaches_the_own_anchor():
    random_words = np.random.default_rng(1)
    x = random_words.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    own = covering.anchor(x)
    y = x.copy()
    for _ in range(2):
        y ^= np.uint64(1) << random_words.integers(0, 64, len(x)).astype(np.uint64)
    rows, anchors = covering.anchors_within(y, 2)
    met = np.zeros(len(x), bool)
    met[rows[anchors == own[rows]]] = True
    assert met.all()


def test_fingerprint_is_that_of_brute_force():
    for text in (None, "", "  \n", "One", "a b", "A b c", "Ärger der SOUL soul x y z q", "x " * 5000, "w1 w2 w3 w4 w5 w6"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [1000, 3])
def test_components_of_a_random_graph(spark, monkeypatch, hot):
    monkeypatch.setattr(base, "HOT", hot)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)] + [(1000, 1001 + i) for i in range(300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        root.setdefault(u, u), root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(root[u], root[v])
            changed |= root[u] != m or root[v] != m
            root[u] = root[v] = m
    touched = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {k: root[k] for k in touched}


@pytest.mark.parametrize("hot", [1000, 4])
def test_groups_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(base, "HOT", hot)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for group in range(12):
        words = [rng.choice(vocabulary) for _ in range(220)]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy), f"s{group}"))
    rows += [(len(rows) + i, t, "s") for i, t in enumerate([None, "", "one", "one", "ONE"])]
    rows.append(rows[0])
    documents = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.digest(documents).collect()
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((r[0], f"{fps[r[0]]:016x}", want[r[0]]) for r in rows)
    named = documents.selectExpr("*", "fp AS id", "fp AS hash", "fp AS _id", "fp AS root")
    kept = simhash.keep_first(named)
    assert kept.schema == named.schema and all(r.id == r.hash == r._id == r.root == r.fp for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_replicas_are_not_broadcast(spark):
    rng = random.Random(4)
    nodes = base.cut(spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)] + [(8,), (9,)], "fp long"))
    edges = simhash.links(nodes)
    assert [tuple(r) for r in edges.collect()] == [(8, 9)]
    plan = edges._jdf.queryExecution().executedPlan().toString()  # the one that ran
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_an_empty_table_has_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.digest(empty).collect() == [] and simhash.keep_first(empty).collect() == []
