"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed features: words,
character n-grams, and for each word after the first whether it repeats the one
before it.  A softmax over two classes reads the average.  Vectors and softmax
are trained by stochastic gradient descent in numpy, on a bounded sample of
labelled documents whose features are gathered on executors; the sample is taken
in the order of a hash of the ids, so the partitioning of the documents changes
nothing.

As the output is linear in the average, scoring folds each vector with the
softmax into one number a bucket: a document is scored by a table look-up for
each feature and a mean, whatever the width of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import ngrams
from chartloom.llm.base import labelled_sample, labelled_texts, small

ORDERS = (3, 5)
BUCKETS = 1 << 17
WIDTH = 16
#: Bound of the labelled rows that the vectors are trained on, some 15 kB each.
MAX_ROWS = 6_000
GOOD_AT = 0.3
#: Buckets of their own, behind those of words and n-grams: a word that repeats the one before it, and one that doesn't.
PAIR_SAME, PAIR_OTHER = BUCKETS, BUCKETS + 1
SIZE = BUCKETS + 2


def features(points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number in the chunk, bucket) of every feature of a chunk, kind by kind."""
    owner = lambda at: np.searchsorted(starts, at, "right") - 1
    hasher = ngrams.Hasher(points)
    start, end, word = hasher.words(BUCKETS)
    yield owner(start), word
    text = owner(start)
    near = text[1:] == text[:-1]
    same = (word[1:] == word[:-1]) & (end[1:] - start[1:] == end[:-1] - start[:-1])
    yield text[1:][near], np.where(same[near], PAIR_SAME, PAIR_OTHER)
    for n in ORDERS:
        at, bucket = hasher.grams(n, BUCKETS)
        yield owner(at), bucket


def sample_features(rows: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each row (buckets, share of each), and the labels, in order of ``place``; the caller bounds ``rows`` (place, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, shares = [], []
            for _, points, starts in ngrams.chunks(batch.column(2).to_pylist()):
                text, bucket = (np.concatenate(x) for x in zip(*features(points, starts), strict=True))
                key, count = np.unique(text * SIZE + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(starts) + 1) * SIZE)
                total = np.maximum(1, np.add.reduceat(np.append(count, 0), cut[:-1]) * (cut[1:] > cut[:-1]))
                for a, b, n in zip(cut[:-1], cut[1:], total, strict=True):
                    ids.append((key[a:b] % SIZE).astype(np.uint32).tobytes())
                    shares.append((count[a:b] / n).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["place", "label", "ids", "shares"])

    got = rows.mapInArrow(run, "place long, label int, ids binary, shares binary").toPandas().sort_values(["place", "label", "ids"], ignore_index=True)
    read = [(np.frombuffer(i, np.uint32).astype(np.int64), np.frombuffer(s, np.float32)) for i, s in zip(got["ids"], got["shares"], strict=True)]
    return read, got["label"].to_numpy(np.int64)


def network(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector of each bucket, softmax's weights by class, its intercepts)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SIZE, WIDTH)).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(WIDTH, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            now = rate * (1 - done / steps)
            back = output.T @ p
            output -= now * 0.1 * np.outer(p, hidden)
            bias -= now * 0.02 * p
            # the mean spreads the gradient over all features; the square root of their number keeps the step's size
            if len(ids):
                vectors[ids] -= (now * np.sqrt(len(ids))) * share[:, None] * back
            done += 1
    return vectors, output, bias


def fold(vectors: np.ndarray, output: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """(folded weight of each bucket, intercept): log-odds of class 1 = intercept + mean of the weights of a document's features."""
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def train(documents: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """The folded model; with rows of one class only, or none, a constant one (without any: class 1)."""
    sample = F.broadcast(labelled_sample(labels, "quality", max_rows, where))  # max_rows rows of 12 bytes
    rows, y = sample_features(labelled_texts(documents, sample))
    if not len(y) or y.min() == y.max():
        return np.zeros(SIZE, np.float32), -6.0 if len(y) and y.max() == 0 else 6.0
    return fold(*network(rows, np.clip(y, 0, 1)))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Adds ``score`` to each row, the chance of class 1; null and empty texts get the intercept's chance.

    Repeated rows are scored alike, an empty table gives no rows.  Texts are read
    whole, in chunks of about 2**18 characters or one text, so a very long text
    costs memory in proportion to it.  A column of the input called ``score`` is
    replaced, all others come back as they are.
    """
    weights, intercept = model
    own = [c for c in documents.columns if c.lower() != "score"]
    rows = documents.select(*(F.col(f"`{c}`") for c in own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            total, count = np.zeros(len(batch)), np.zeros(len(batch))
            for first, points, starts in ngrams.chunks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                here = slice(first, first + len(starts))
                for text, bucket in features(points, starts):
                    total[here] += np.bincount(text, weights[bucket], len(starts))
                    count[here] += np.bincount(text, minlength=len(starts))
            z = intercept + total / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "score double"])
    return rows.mapInArrow(run, schema)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the contract of op2 fixes: every fifth id is held out of training."""
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    found = score(documents.select("doc_id", "text"), train(documents, labels, part != 0))
    held = F.coalesce(part == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))
