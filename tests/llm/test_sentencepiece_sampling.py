import math
from collections import Counter

import numpy as np
import pytest

from chartloom.llm import sentencepiece_sampling as sampling

TEXTS = ["Hello  world", "  a\n\tb ", "é€x　y", "a▁b", "\u0000x", "x" * 300, " ", "1", "naïve façade, ﬁ ①!", "word " * 3000, "▁▁ ▁", "\udc80".encode("utf-8", "replace").decode()]


@pytest.fixture(scope="module")
def words():
    return sampling.vocabulary(sampling.model_path())


def segmentations(words, text):
    """Every segmentation of a text as {ids: probability}, by plain recursion."""
    marked = sampling.SPACE + text.replace(" ", sampling.SPACE)
    found = {}

    def go(at, ids, log):
        if at == len(marked):
            found[ids] = math.exp(log)
        for end in range(at + 1, len(marked) + 1):
            piece = marked[at:end]
            if piece in words.score:
                go(end, (*ids, words.id[piece]), log + words.score[piece])

    go(0, (), 0.0)
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


def draw(words, text, n, k):
    lattices = sampling.Lattices(words)
    return [found for _, found in sampling.encode_texts([text] * n, [str(i) for i in range(n)], lattices, k)]


def test_every_sample_decodes_to_its_text(words):
    lattices = sampling.Lattices(words)
    for i, found in sampling.encode_texts(TEXTS, [str(i) for i in range(len(TEXTS))], lattices, 4):
        assert found and all(words.decode(s["ids"]) == TEXTS[i] for s in found)
        assert len({tuple(s["ids"]) for s in found}) == len(found)
        values = [s["perturbed"] for s in found]
        assert values == sorted(values, reverse=True)


def test_log_probabilities_are_those_of_brute_force(words):
    for text in ("the cat", "ab", "no on"):
        every = segmentations(words, text)
        for found in draw(words, text, 20, 3):
            for s in found:
                assert math.isclose(math.exp(s["log_prob"]), every[tuple(s["ids"].tolist())], rel_tol=1e-6)


def test_all_segmentations_come_out_if_k_is_their_number(words):
    every = segmentations(words, "cat")
    for found in draw(words, "cat", 5, len(every) + 3):
        assert {tuple(s["ids"].tolist()) for s in found} == set(every)
        assert all(s["inclusion"] == 1 for s in found)


def test_first_samples_follow_the_probabilities_and_scores_weigh_back(words):
    # a flat model, so that several segmentations are likely
    flat = sampling.Vocabulary(sampling.model_path())
    flat.score = {p: -3.0 + 0.2 * (len(p) % 3) for p in flat.score}
    flat.id_score = np.array([flat.score.get(p, 0.0) for p in flat.pieces])
    every = segmentations(flat, "note")
    n = 6000
    got = draw(flat, "note", n, 2)
    first = Counter(tuple(f[0]["ids"].tolist()) for f in got)
    for ids, p in every.items():
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    pairs = Counter((tuple(f[0]["ids"].tolist()), tuple(f[1]["ids"].tolist())) for f in got)
    (a, b), count = pairs.most_common(1)[0]
    p = every[a] * every[b] / (1 - every[a])
    assert abs(count / n - p) < 4 * math.sqrt(p / n) + 1e-3
    # Horvitz and Thompson's estimate of the total probability
    estimate = np.mean([sum(math.exp(s["log_prob"]) / s["inclusion"] for s in f) for f in got])
    assert abs(estimate - 1) < 0.05


def test_rows_do_not_depend_on_partitions(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (50, None, "x"), (51, "", "x"), (0, TEXTS[0], "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sampling.encode(documents.repartition(5), k=2).collect()
    again = sampling.encode(documents.coalesce(1), k=2).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids)
    got, again = sorted(got, key=key), sorted(again, key=key)
    assert list(map(key, got)) == list(map(key, again))
    for x, y in zip(got, again, strict=True):  # numbers up to rounding
        assert np.allclose((x.log_prob, x.perturbed, x.inclusion), (y.log_prob, y.perturbed, y.inclusion), rtol=1e-6)
    assert sorted((str(r.doc_id), r.n_pieces, r.ids) for r in got if r.doc_id in (50, 51)) == [("50", 0, []), ("51", 0, [])]
    text = dict((r[0], r[1]) for r in rows)
    decoded = sampling.decode(sampling.encode(documents, k=2)).collect()
    assert all(r.text == (text[r.doc_id] or "") for r in decoded) and key(got[0])
    assert sampling.encode(documents.limit(0)).collect() == []
    restored = sampling.encode(documents, restore=True).collect()
    assert len(restored) == len(got) and all(r.restored for r in restored)
