import random
import re
import time

from chartloom.llm import licenses as L
from chartloom.llm.licenses import PASSAGES, PHRASES, index, plain_words


def brute(doc_id, text):
    """Every passage compared at every place of the text."""
    passages, postings = index()
    w = plain_words(text or "")
    base = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for n, p in enumerate(passages):
        rare = {at for places in postings.values() for a, at in places if a == n}
        for start in range(-len(p["words"]) + 1, len(w)):
            same = [0 <= start + k < len(w) and w[start + k] == x for k, x in enumerate(p["words"])]
            total = sum(weight for weight, s in zip(p["weights"], same, strict=True) if s)
            if sum(same[k] for k in rare) >= p["needed"] and all(same[p["first"] : p["last"] + 1]) and 100 * total >= L.LEAST_SCORE * sum(p["weights"]):
                found.append((p["label"], total / sum(p["weights"])))
    starts = [i for i, _ in base]
    labels = lambda some: ",".join(sorted(set(some)))
    own = [label for _, label in base]
    score = 1.0 if base else max((s for _, s in found), default=0.0)
    return (doc_id, len(w), len(base), min(starts, default=None), max(starts, default=None), labels(own), labels(own + [label for label, _ in found]), score)


def texts():
    rng = random.Random(13)
    whole = [re.sub(r"[\[\]]", "", t) for some in PASSAGES.values() for t in some]
    out = [None, "", " \n", "MIT License", "the mit\n\n license; Apache-License general PUBLIC license", "mit", "license mit", "General Public Licence", "Überlicense mit license"]
    out += whole
    words = sorted({w for t in whole for w in plain_words(t)})
    for _ in range(150):
        t = rng.choice(whole).split()
        for _ in range(rng.randrange(0, 5)):
            kind, at = rng.randrange(3), rng.randrange(len(t))
            t[at : at + (kind > 0)] = [] if kind == 1 and len(t) > 1 else [rng.choice(words)]
        out.append(" ".join(rng.choices(words, k=rng.randrange(0, 30)) + t * rng.randrange(1, 3) + rng.choices(words, k=rng.randrange(0, 9))).upper())
    out += [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(60)]
    return out


def test_the_digest_is_that_of_brute_force(spark):
    data = list(enumerate(texts()))
    data += [data[5], (None, "the MIT License"), (10**12, "word é " * 20_000 + re.sub(r"[\[\]]", "", PASSAGES["zlib"][1]))]
    documents = spark.createDataFrame([(*r, 1.0, "z") for r in data], "doc_id long, text string, Score double, w string")
    got = [tuple(r) for r in L.digest(documents).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in data), key=str)
    assert L.digest(documents.limit(0)).collect() == []
    assert L.scan(documents).columns == ["doc_id", "text", "w", *L.ADDED]


def test_every_passage_is_found_as_its_licence(spark):
    data = [(label, "Some words before. " + re.sub(r"[\[\]]", "", t) + ". And some behind.") for label, some in PASSAGES.items() for t in some]
    got = L.scan(spark.createDataFrame(data, "label string, text string")).collect()
    assert all(r.label in r.labels.split(",") and r.score == 1.0 for r in got)


def test_ordinary_words_get_no_label(spark):
    data = ["In no event will the party be held, so the public domain is released to any person without restriction or fee.", "Permission is hereby granted to use the garden.", "The software is provided by the office."]
    assert [r.labels for r in L.scan(spark.createDataFrame([(t,) for t in data], "text string")).collect()] == ["", "", ""]


def test_time_grows_with_the_text(spark):
    took = []
    for n in (300, 3000):
        documents = spark.createDataFrame([(1, (re.sub(r"[\[\]]", "", PASSAGES["mit"][1]) + " mit license ") * n)], "doc_id long, text string").cache()
        documents.count()
        began = time.time()
        row = L.digest(documents).first()
        took.append(time.time() - began)
        assert row.n_base == n and row.labels == "mit"
    assert took[1] < 20 * took[0] + 5
