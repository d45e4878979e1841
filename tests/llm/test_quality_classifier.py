import random
import zlib

import numpy as np

from chartloom.llm import ngrams, quality_classifier


def sample(n=300, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(10, 90))
        if i % 3 == 0:
            text = [w + "%%" for w in text] if i % 2 else [text[0]] * 40
        rows.append((i, " ".join(text), "k", int(i % 3 != 0)))
    return rows


def forward(text, vectors, output, bias):
    """A document's chance of class 1, feature by feature through the unfolded network."""
    hidden, n = np.zeros(quality_classifier.WIDTH), 0
    for _, points, starts in ngrams.chunks([text]):
        for _, bucket in quality_classifier.features(points, starts):
            for b in bucket.tolist():
                hidden, n = hidden + vectors[b], n + 1
    z = output.astype(float) @ (hidden / max(n, 1)) + bias
    e = np.exp(z - z.max())
    return e[1] / e.sum()


def test_folded_scores_are_those_of_the_network(spark):
    """The whole query against plain loops: sample, order, training and the network's own forward pass."""
    rows = sample(120) + [(500, None, "k", 0), (501, "", "k", 1), (502, "x " * 3000, "k", 1)]
    documents = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.digest(documents, labels).collect()}
    places = {r.doc_id: r.place for r in documents.selectExpr("doc_id", "xxhash64(doc_id) AS place").collect()}
    learnt = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0), key=lambda r: places[r[0]])
    seen = []
    for r in learnt:
        counts = {}
        for _, points, starts in ngrams.chunks([r[1]]):
            for _, bucket in quality_classifier.features(points, starts):
                for b in bucket.tolist():
                    counts[b] = counts.get(b, 0) + 1
        ids = sorted(counts)
        seen.append((np.array(ids, np.int64), np.array([counts[i] for i in ids], np.float32) / max(1, sum(counts.values()))))
    net = quality_classifier.network(seen, np.array([r[3] for r in learnt]))
    for r in rows:
        assert abs(got[r[0]] - forward(r[1], *net)) < 1e-4


def test_partitions_and_repeated_rows_change_nothing(spark):
    rows = sample(150)
    documents = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    got = [{r.doc_id: r.score for r in quality_classifier.digest(d, labels).collect()} for d in (documents.coalesce(1), documents.repartition(7), documents.union(documents))]
    assert got[0] == got[1] == got[2]
    many = documents.union(documents).union(documents)
    from chartloom.llm.base import labelled_sample, labelled_texts

    assert labelled_texts(many, labelled_sample(labels, "quality", 20)).count() == 20


def test_features_are_whole_words_pairs_and_grams():
    (_, points, starts), = ngrams.chunks(["aa aa b", "", "c"])
    kinds = [list(zip(*(x.tolist() for x in kind), strict=True)) for kind in quality_classifier.features(points, starts)]
    assert [t for t, _ in kinds[0]] == [0, 0, 0, 2]
    assert kinds[0][0] == kinds[0][1] != kinds[0][2]
    assert kinds[1] == [(0, quality_classifier.PAIR_SAME), (0, quality_classifier.PAIR_OTHER)]
    assert sum(t == 0 for t, _ in kinds[2]) == 2 + 2 + 1  # " aa", "aa ", twice, " b "


def test_held_out_rows_are_told_apart(spark):
    rows = sample()
    extra = [(9000, None, "k"), (9001, "", "k"), (None, "ab cd", "k"), rows[0][:3], (9002, "word " * 60_000, "k")]
    documents = spark.createDataFrame([r[:3] for r in rows] + extra, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_classifier.digest(documents, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = {r.doc_id: r for r in got if r.held_out}
    assert {i for i in held if i < 9000} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert np.mean([held[r[0]].predicted == r[3] for r in rows if r[0] in held]) > 0.9
    assert quality_classifier.digest(documents.limit(0), labels.limit(0)).collect() == []
    assert all(r.predicted == 1 for r in quality_classifier.digest(documents, labels.limit(0)).collect())
