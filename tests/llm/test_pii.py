import hashlib
import random
import re
import time

import numpy as np

from chartloom.llm import pii

PYTHON = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        twice = [int(c) * 2 for c in digits[-2::-2]]
        return 14 <= len(digits) <= 19 and (sum(map(int, digits[::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    text = text or ""
    base = [(k, m.start(), m.end()) for k, p in PYTHON.items() for m in re.finditer(p, text) if passes(k, m[0])]
    trees, threshold = pii.model()
    more = []
    for k, p in pii.GENERATORS.items():
        p = p.replace(r"\G", r"(?!)")
        for m in re.finditer(p, text):
            x = np.array([pii.features(m[0], text[max(0, m.start() - pii.BEFORE) : m.start()])])
            if trees.margin(x)[0] >= threshold and not any(a < m.end() and b > m.start() for _, a, b in base):
                more.append((k, m.start(), m.end()))
    added = len(more)
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2])))
    return (*(sum(s[0] == k for s in base) for k in PYTHON), hashlib.sha256(say(base).encode()).hexdigest(), say(base + more), len(base) + added)


def texts():
    rng = random.Random(4)
    out = [None, "", "a@b.co_x@c.de %a@b..c a@b.c. ü@x.y", "1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1 999999999999999999999.1.1.1 1.2.3", "4111 1111-1111 1111 4111111111111112 4111-1111--1111", "+1 (988) 555-2485 +12 +1-2 ()()(1", "9" * 30_000, "a" * 30_000 + "@", "1 " * 20_000]
    out += ["my ssn is 123-45-6789 ok", "born 12.3.1980 in x", "call me: (415) 555-0199 now", "IBAN DE44 5001 0517 5407 3249 31.", "jane.doe (at) mail (dot) com", "order 12.3.1980", "version 10.20.301", "meet at noon.today"]
    parts = ["a", "b.c", "@", ".", "1", "23", "255", "-", " ", "+", "(", ")", "4111111111111111", "ü", "\n", "x@y.z", "1.2.3.4", "+1 (988) 555-2485", "ssn "]
    out += ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(250)]
    return out


def test_spans_are_those_of_brute_force(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "x@y.z", 2, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_ip int, base string")
    got = {str(tuple(r)) for r in pii.digest(documents).collect()}
    want = {str((r[0], *brute(r[1]))) for r in rows}
    assert got == want
    assert pii.digest(documents).count() == len(rows)
    assert pii.digest(documents.limit(0)).collect() == []


def test_selected_spans_have_the_calibrated_precision():
    """Trees of one half of the sentences, judged on samples of the other half that calibration didn't see."""
    trees, threshold = pii.model()
    rows, classes = pii.labelled_samples(4000, 77, part=1)
    chosen = trees.margin(np.array([pii.features(*r) for r in rows])) >= threshold
    truth = np.array(classes, bool)
    assert truth[chosen].mean() > 0.98 and chosen[truth].mean() > 0.5


def test_redaction(spark):
    names = ("_r", "_f", "n_ip", "base", "scanned", "found", "personal")
    documents = spark.createDataFrame([(1, "ü x@y.z and my ssn is 123-45-6789.", *names), (2, None, *names), (3, "clean", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = pii.redact(documents)
    assert got.schema == documents.schema
    assert {r.doc_id: r.text for r in got.collect()} == {1: "ü <personal> and my ssn is <personal>.", 2: None, 3: "clean"}
    assert all(tuple(r)[2:] == names for r in got.collect())


def test_time_grows_with_the_matches(spark):
    took = []
    for n in (3_000, 30_000):
        documents = spark.createDataFrame([(1, "é call (415) 555-0199 or a@b.co " * n)], "doc_id long, text string").cache()
        documents.count()
        began = time.time()
        row = pii.digest(documents).first()
        assert row.n_email == n and row.n_spans == 2 * n
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 5
