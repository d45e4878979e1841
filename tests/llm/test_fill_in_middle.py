import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from chartloom.llm import fill_in_middle as fim


def brute(doc_id, text):
    """The contract by slices of code points."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b, c = text[:i], text[i:j], text[j:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}"
    return (doc_id, n, form, i, j - i, sha(out), sha(text))


def rows():
    rng = random.Random(12)
    texts = [None, "", "a", "é", "<", "<P", "x<P>y", "<S>", "a<M>", "<<S", "P>S>M>", "\U0001f600" * 9, "\r\n\n", "日本語 text́"]
    texts += ["".join(rng.choices("ab <PSM>é\n漢\U0001f9ea", k=rng.randrange(1, 400))) for _ in range(300)]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[20], (None, "no id"), (-5, "negative")]


def test_the_digest_is_that_of_brute_force(spark):
    data = [*rows(), (10**12, "漢字 and a tail\n" * 60_000)]
    documents = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, output string, N int")
    got = [tuple(r) for r in fim.digest(documents).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in data), key=str)
    assert fim.digest(documents.limit(0)).collect() == []
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_cut_where_units_begin_and_texts_come_back(spark, unit):
    plan = fim.Plan(seed="7", plain_from=100, spm_below=50, prefix="[a.b]", suffix="$s", middle="(m)", unit=unit)
    documents = spark.createDataFrame([(*r, "k") for r in rows()], "doc_id long, text string, other string")
    made = fim.transform(documents, plan)
    assert made.columns == ["doc_id", "text", "other", *fim.ADDED]
    back = fim.restore(made.withColumn("was", F.coalesce("text", F.lit(""))).drop("text"), plan).collect()
    assert all(r.text == r.was and r.other == "k" for r in back)
    for r in back:
        units = len(r.was.split("\n")) - r.was.endswith("\n") if unit == "line" else len(__import__("re").findall(r"[^ \t\n\x0b\x0c\r]+", r.was))
        assert r.n == (units if r.was else 0)
        if r.form != "plain":
            for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
                before, after = r.was[:at], r.was[at:]
                assert not before or not after or (before[-1] == "\n" if unit == "line" else before[-1] in " \n\r" and after[0] not in " \n\r")


def test_ranked_bits_against_a_scan():
    rng = random.Random(3)
    for width in (1, 63, 64, 65, 200, 5000):
        bits = rng.getrandbits(width) | 1 << (width - 1)
        places = [i for i in range(width) if bits >> i & 1]
        assert [fim.select(bits, k, width) for k in range(len(places))] == places


def test_time_is_linear_in_a_text():
    took = []
    for n in (1_000_000, 8_000_000):
        text = ("é漢a " * (n // 4)).encode()
        began = time.time()
        fim.transform_text(text, b"3", fim.Plan(plain_from=100))
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 1


def test_marks_must_differ(spark):
    with pytest.raises(ValueError):
        fim.restored(F.lit("x"), F.lit("psm"), fim.Plan(prefix="<S>"))
    with pytest.raises(ValueError):
        fim.Plan(unit="page")
