import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chartloom.llm import substring_dedup, suffix_array


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(70))
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 900]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(3)]
        a = rng.randrange(len(passage) // 2)
        if i % 3 == 0:
            parts.insert(1, passage[a : a + rng.randrange(120, 330)])
        texts.append("\n".join(parts))
    texts += [texts[20], texts[20], texts[30][3:], texts[31] + "!"]
    return texts


def test_order_is_that_of_sorted_suffixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        raw = a.tobytes()
        want = np.argsort(sorted(range(len(a)), key=lambda i: raw[i:]))
        assert (suffix_array.ranks(a.astype(np.int64) + 1, 1000) == want).all()


def test_repeated_starts_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    for t in range(200):
        a = rng.integers(0, rng.integers(1, 4), rng.integers(50, 400)).astype(np.uint8)
        a = np.tile(a[:20], 8) if t % 4 == 0 else a
        length = int(rng.integers(1, 40))
        starts = np.sort(rng.choice(len(a) - length + 1, rng.integers(1, len(a) - length + 2), replace=False))
        raw = a.tobytes()
        seen = Counter(raw[i : i + length] for i in starts)
        assert (suffix_array.repeated_starts(a, starts, length) == [seen[raw[i : i + length]] > 1 for i in starts]).all()


def test_equal_windows_choose_equal_anchors():
    texts = [(t or "").encode() for t in corpus(3)]
    by_window = {}
    for where, data, ends in substring_dedup._pieces(texts, 200):
        anchor, _, first, last = substring_dedup.contexts(np.frombuffer(data, np.uint8), ends, 200)
        n = 0
        for h, a, b in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True):
            for i in range(a, b + 1):
                n += 1
                assert by_window.setdefault(data[i : i + 200], h) == h
        assert n == sum(max(0, len(t) - 199) for t in texts)


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 300)
    texts = [b"q" * 1000, b"ab" * 500, b"r" * 50]
    windows = []
    for where, data, ends in substring_dedup._pieces(texts, 200):
        _, _, first, last = substring_dedup.contexts(np.frombuffer(data, np.uint8), ends, 200)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            p = int(np.searchsorted(ends, a, "right"))
            windows += [(where[p][0], i - (ends[p - 1] if p else 0) + where[p][1]) for i in range(a, b + 1)]
    assert sorted(windows) == [(t, i) for t in (0, 1) for i in range(801)]


def test_a_text_of_several_pieces_loses_what_repeats(spark):
    rng = random.Random(17)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=n))
    passage = letters(700)
    whole = letters(substring_dedup.PIECE - 900) + passage + letters(200_000) + passage + letters(substring_dedup.PIECE)
    rows = [(1, whole, "a", "b"), (2, letters(5000), "a", "b"), (3, "#" + passage[100:400], "a", "b")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, anchor string, context string")
    got = {r.doc_id: r for r in substring_dedup.remove(documents).collect()}
    n = len(passage.encode())
    assert got[1].n_removed == 2 * n and got[1].n_spans == 2 and bytes(got[1].kept).decode() == whole.replace(passage, "")
    assert got[2].n_removed == 0 and bytes(got[3].kept) == b"#" and got[3].n_spans == 1


@pytest.mark.parametrize("hot", [1000, 2])
def test_rows_are_those_of_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [rows[25], (None, texts[40], "x"), (None, "unique text", "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    want = sorted(map(str, ((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 200), strict=True))))
    assert sorted(str(tuple(r)) for r in substring_dedup.digest(documents).collect()) == want
    assert substring_dedup.digest(documents.limit(0)).collect() == []


def test_hot_anchors_are_split_without_loss(spark):
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh", k=190))
    texts = [f"{rng.choice('xyz') * rng.randrange(30)}{i % 7}{shared}{i % 5}{'uvw'[i % 3] * rng.randrange(40)}" for i in range(120)]
    rows = list(enumerate(texts))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, *b) for (i, _), b in zip(rows, brute(texts, 200), strict=True))
    for most in (4, 20):
        got = substring_dedup.remove(documents, most=most).drop("kept").collect()
        assert sorted(map(tuple, got)) == want


def test_a_worker_holds_little_whatever_the_size_of_its_rows():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() for n in [2_000_000, *[3000] * 512]]
    tracemalloc.start()
    windows = 0
    for _, data, ends in substring_dedup._pieces(texts, 200):
        _, _, first, last = substring_dedup.contexts(np.frombuffer(data, np.uint8), ends, 200)
        windows += int((last - first + 1).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == sum(len(t) - 199 for t in texts)
    assert peak < 32 << 20


def test_buckets_are_ordered_whole_in_small_groups():
    rng = np.random.default_rng(6)
    sizes = [1, 2000, *rng.integers(1, 40, 300).tolist(), 700, 3]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    data = [rng.integers(97, 101, 300).astype(np.uint8).tobytes() for _ in bucket]
    rows = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(data, pa.binary())], ["bucket", "bytes"])
    for step in (137, 10_000):
        tables = list(substring_dedup._whole_buckets(rows.slice(i, step) for i in range(0, len(rows), step)))
        assert pa.concat_tables(tables).to_pylist() == rows.to_pylist()
        held = [set(t.column("bucket").to_pylist()) for t in tables]
        assert sum(map(len, held)) == len(sizes)  # no bucket is in two of them
        assert all(len(h) == 1 or t.num_rows * 300 <= substring_dedup.GROUP for h, t in zip(held, tables, strict=True))
    text = np.frombuffer(b"".join(data[2001 : 2001 + substring_dedup.GROUP // 300]), np.uint8)
    tracemalloc.start()
    suffix_array.repeated_starts(text, np.arange(len(text) - 199), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
