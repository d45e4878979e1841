import math
import random
import zlib

import numpy as np

from chartloom.llm import ngrams, toxicity


def sample(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 120))
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(["zwurst", "Zwursten", "qivolle"])
        rows.append((i, " ".join(text), "k", int(i % 4 == 0)))
    return rows


def test_hashes_of_slices_are_equal_exactly_where_texts_are():
    texts = ["ab ab  abc", "", None, "ÄB\n\tab", "x" * 50]
    seen = {}
    for first, points, starts in ngrams.chunks(texts):
        assert first == 0 and len(starts) == len(texts)
        text = "".join(map(chr, points))
        hasher = ngrams.Hasher(points)
        for n in (2, 3, 4):
            for at, bucket in zip(*(a.tolist() for a in hasher.grams(n, 1 << 40)), strict=True):
                gram = text[at : at + n]
                assert " " not in gram[1:-1]
                assert seen.setdefault(gram, bucket) == bucket
        start, end, bucket = hasher.words(1 << 40)
        assert [text[a:b] for a, b in zip(start, end, strict=True)] == " ".join(map(ngrams.normal, texts)).split()
    assert len(set(seen.values())) == len(seen)


def test_counts_are_those_of_brute_force(spark):
    rows = [(1, "abcd abcd"), (1, "xabcdef"), (0, "abcd"), (0, None)]
    got = {r.bucket: (r.positive, r.negative) for r in toxicity.class_counts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, label int, text string")).collect()}
    want = {}
    for label, text in rows:
        norm = ngrams.normal(text)
        points = np.frombuffer(norm.encode("utf-32-le"), np.uint32)
        for n in toxicity.ORDERS:
            for b in set(ngrams.Hasher(points).grams(n, toxicity.BUCKETS)[1].tolist()):
                want.setdefault(b, [0, 0])[1 - label] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def grams_of(text):
    """How often each bucket occurs in a text."""
    points = np.frombuffer(ngrams.normal(text).encode("utf-32-le"), np.uint32)
    counts = {}
    for n in toxicity.ORDERS:
        for b in ngrams.Hasher(points).grams(n, toxicity.BUCKETS)[1].tolist():
            counts[b] = counts.get(b, 0) + 1
    return counts


def test_scores_are_those_of_plain_loops(spark):
    rows = sample(160) + [(700, None, "k", 0), (701, "", "k", 0), (702, "zwurst " + "abc " * 3000, "k", 1)]
    documents = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.digest(documents, labels).collect()}
    places = {r.doc_id: r.place for r in documents.selectExpr("doc_id", "xxhash64(doc_id) AS place").collect()}
    learnt = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: places[r[0]])
    counted = {r[0]: grams_of(r[1]) for r in rows}
    size = [sum(r[3] == c for r in learnt) for c in (0, 1)]
    have = [{}, {}]
    for r in learnt:
        for b in counted[r[0]]:
            have[r[3]][b] = have[r[3]].get(b, 0) + 1
    scale = {}
    for b in have[0].keys() | have[1].keys():
        p, q = have[1].get(b, 0) + 1, have[0].get(b, 0) + 1
        ratio = math.log((p / (size[1] + 2)) / (q / (size[0] + 2)))
        if abs(ratio) >= toxicity.LEAST_RATIO and abs(ratio) / math.sqrt(1 / p + 1 / q) >= toxicity.LEAST_SURE:
            scale[b] = ratio
    order = sorted(scale)
    triples = [(i, order.index(b), math.log(1 + n) * scale[b]) for i, r in enumerate(learnt) for b, n in counted[r[0]].items() if b in scale]
    row, x, value = (np.array(c) for c in zip(*triples, strict=True))
    w, b0 = toxicity.logistic(row, x, value, np.array([float(r[3]) for r in learnt]), len(order))
    for r in rows:
        z = b0 + sum(w[order.index(b)] * scale[b] * math.log(1 + n) for b, n in counted[r[0]].items() if b in scale)
        assert abs(got[r[0]] - 1 / (1 + math.exp(-z))) < 1e-4


def test_partitions_change_nothing(spark):
    rows = sample(200)
    documents = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = [{r.doc_id: r.score for r in toxicity.digest(d, labels).collect()} for d in (documents.coalesce(1), documents.repartition(7), documents.union(documents))]
    assert got[0] == got[1] == got[2]


def test_held_out_rows_are_told_apart(spark):
    rows = sample()
    documents = spark.createDataFrame([r[:3] for r in rows] + [(9000, None, "k"), (9001, "", "k"), (None, "zwurst", "k"), rows[0][:3], (9002, "word " * 60_000, "k")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.digest(documents, labels).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = {r.doc_id: r for r in got if r.held_out}
    assert set(held) == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1} | {i for i in (9000, 9001, 9002) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [held[r[0]].predicted == r[3] for r in rows if r[0] in held]
    assert np.mean(right) > 0.9
    assert toxicity.digest(documents.limit(0), labels.limit(0)).collect() == []
    assert all(r.predicted == 0 for r in toxicity.digest(documents, labels.limit(0)).collect())
