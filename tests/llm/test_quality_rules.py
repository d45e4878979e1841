import random
import re

import numpy as np

from chartloom.llm import gbdt, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def some_texts():
    rng = random.Random(2)
    texts = [None, "", "  \n\t", "a", "a b c d e", "a a a a a a", "ä b c \x1c d", "one\n\none\n one\n|#|"]
    for n in (4, 8, 40, 200):
        texts += ["".join(rng.choice(["a ", "b ", "c\n", "dé ", "<|> "]) for _ in range(n)) for _ in range(12)]
    texts.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(6000)) + " x y z u v w x y z u v")
    return texts


def test_base_counts_are_those_of_brute_force():
    for text in some_texts():
        if text and len(text) > 10_000:
            assert quality_rules.statistics(text)[0][4] == 10
        else:
            assert quality_rules.statistics(text)[0] == brute(text)


def test_long_names_and_packed_names_agree():
    rng = np.random.default_rng(4)
    for _ in range(20):
        ids = rng.integers(0, 3, 60)
        assert quality_rules.repeated(ids, 3) == quality_rules.repeated(ids, 5000)


def test_trees_learn_and_keep_their_signs():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (4000, 3))
    y = (rng.uniform(0, 1, 4000) < np.where(x[:, 0] > 0.6, 0.1, 0.8)).astype(float)
    model = gbdt.train(x, y, monotone=np.array([-1, 0, 1]))
    grid = np.linspace(-0.5, 1.5, 60)
    for _ in range(30):
        row = np.tile(rng.uniform(0, 1, 3), (60, 1))
        row[:, 0] = grid
        assert (np.diff(model.score(row)) <= 1e-12).all()
        row = np.tile(rng.uniform(0, 1, 3), (60, 1))
        row[:, 2] = grid
        assert (np.diff(model.score(row)) >= -1e-12).all()
    assert model.score(np.array([[0.1, 0.5, 0.5]]))[0] > 0.7 > 0.3 > model.score(np.array([[0.9, 0.5, 0.5]]))[0]


def test_sql_scores_as_the_arrays_do(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2000, 3))
    model = gbdt.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=12)
    frame = spark.createDataFrame(x[:200].tolist(), "a double, b double, c double")
    got = [r[0] for r in frame.selectExpr(model.sql(["a", "b", "c"])).collect()]
    assert np.allclose(got, model.margin(x[:200]))


def test_rows_are_judged_whole(spark):
    rng = random.Random(1)
    good = [" ".join(f"word{rng.randrange(900)}" for _ in range(60)) for _ in range(120)]
    bad = [" | ".join(f"word{rng.randrange(900)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (None, "a b", "x"), (0, good[0], "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality_rules.digest(documents, labels).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), brute(t)[0]) for i, t, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].kept for i in range(120)) and not any(by_id[i].kept for i in range(120, 180))
    assert by_id[900].base_failed and not by_id[901].kept
    kept = quality_rules.keep(documents, labels)
    assert kept.schema == documents.schema
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if r[0] is not None and by_id[r[0]].kept)
    again = {r.doc_id: r.quality_score for r in quality_rules.digest(documents.repartition(7), labels).collect()}
    assert again == {r.doc_id: r.quality_score for r in quality_rules.digest(documents.coalesce(1), labels).collect()}
    empty = quality_rules.digest(documents.limit(0), labels.limit(0))
    assert empty.collect() == []
    assert all(r.kept for r in quality_rules.digest(documents, labels.limit(0)).collect() if not r.base_failed)
