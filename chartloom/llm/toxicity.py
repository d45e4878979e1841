"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS`` of each
class).  Document counts of every n-gram bucket, by class, are gathered where the
texts are: each task sums its own, then one aggregation adds them.  The log-count
ratio scales a bucket's feature, log(1 + occurrences).  The weights come from a
logistic regression over the ``KEPT`` buckets whose counts differ most surely
between the classes; other buckets weigh nothing.  The intercept is moved to the
classes' shares among all labelled rows.  ``KEPT`` bounds features, never rows.
Rows are taken in the order of a hash of their ids, so the partitioning of the
documents changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import ngrams
from chartloom.llm.base import labelled_sample, labelled_texts, small

ORDERS = (4, 5, 6)
BUCKETS = 1 << 20
#: Buckets that get a weight, and what the log-count ratio must reach, plainly and in standard errors.
KEPT = 8192
LEAST_RATIO, LEAST_SURE = 0.7, 3.0
#: Bound of the labelled rows of each class that the model is fitted on.
MAX_ROWS = 10_000
TOXIC_AT = 0.7


def buckets_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts so far, text of each n-gram, bucket) by chunk."""
    for first, points, starts in ngrams.chunks(texts):
        hasher = ngrams.Hasher(points)
        for n in ORDERS:
            at, bucket = hasher.grams(n, BUCKETS)
            yield first, np.searchsorted(starts, at, "right") - 1 + first, bucket


def _counted(texts: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bucket of a text once, and how often it occurs there."""
    key, count = np.unique(texts * BUCKETS + buckets, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def class_counts(rows: DataFrame) -> DataFrame:
    """(bucket, positive, negative): the documents of each class that have the bucket, over all ``rows`` (place, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in small(batches):
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for _, text, bucket in buckets_of(batch.column(2).to_pylist()):
                text, bucket, _ = _counted(text, bucket)
                for c in (0, 1):
                    counts[c] += np.bincount(bucket[labels[text] == c], minlength=BUCKETS)
        seen = np.flatnonzero(counts.any(0))
        for i in range(0, len(seen), 65536):
            part = seen[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1][part]), pa.array(counts[0][part])], ["bucket", "positive", "negative"])

    found = rows.mapInArrow(run, "bucket long, positive long, negative long")
    return found.groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def sample_features(rows: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in ``kept``, log(1 + occurrences)) of each feature, and the rows' labels, in order of ``place``; the caller bounds ``rows``."""
    place = np.full(BUCKETS, -1, np.int64)
    place[kept] = np.arange(len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts = [(np.zeros(0, np.int64),) * 3]
            for _, text, bucket in buckets_of(batch.column(2).to_pylist()):
                hit = place[bucket] >= 0
                parts.append(_counted(text[hit], bucket[hit]))
            text, bucket, count = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(text, kind="stable")
            offsets = pa.array(np.searchsorted(text[order], np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (place[bucket], count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["place", "label", "x", "n"])

    got = rows.mapInArrow(run, "place long, label int, x array<int>, n array<int>").toPandas().sort_values(["place", "label"], ignore_index=True)
    row = np.repeat(np.arange(len(got)), [len(x) for x in got["x"]])
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *got[c]]).astype(np.int64)
    return row, flat("x"), np.log1p(flat("n")), got["label"].to_numpy(np.float64)


def logistic(row: np.ndarray, x: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, rounds: int = 300, l2: float = 0.1, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of ``size`` sparse features and the intercept of a logistic regression, by full-batch Adam."""
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[x] * value, len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(x, e[row] * value, size) + l2 * w / max(1, size), e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept).

    ``where`` selects the rows of ``labels`` that may be learnt from; at most
    ``max_rows`` of each class are.  With one class only the model is a constant.
    """
    usable = F.col("label").isin(0, 1) if where is None else where & F.col("label").isin(0, 1)
    some = [labelled_sample(labels, "toxic", max_rows, usable & (F.col("label") == c)) for c in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # at most 2 * max_rows rows of 12 bytes
    rows = labelled_texts(documents, sample)
    shares = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna().where(usable).groupBy("label").count()
    total = {r.label: r["count"] for r in shares.collect()}
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros(BUCKETS), 6.0 if sizes.get(1) else -6.0
    counts = class_counts(rows)
    p = (F.col("positive") + 1) / (sizes[1] + 2)
    q = (F.col("negative") + 1) / (sizes[0] + 2)
    ratio = F.log(p / q)
    # how sure the difference is: the ratio in units of its standard error
    sure = F.abs(ratio) / F.sqrt(1 / (F.col("positive") + 1) + 1 / (F.col("negative") + 1))
    telling = (F.abs("ratio") >= LEAST_RATIO) & (F.col("sure") >= LEAST_SURE)
    best = counts.select("bucket", ratio.alias("ratio"), sure.alias("sure")).where(telling).orderBy(F.desc("sure"), "bucket").limit(KEPT).collect()
    kept, scale = np.array([r.bucket for r in best], np.int64), np.array([r.ratio for r in best])
    row, x, value, y = sample_features(rows, kept)
    w, b = logistic(row, x, value * scale[x], y, len(kept))
    weights = np.zeros(BUCKETS)
    weights[kept] = w * scale
    return weights, b + float(np.log(total[1] / total[0]) - np.log(sizes[1] / sizes[0]))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Adds ``score`` to each row; null and empty texts get the intercept's chance.

    Repeated rows are scored alike, an empty table gives no rows.  Texts are read
    whole, in chunks of about 2**18 characters or one text, so a very long text
    costs memory in proportion to it.  A column of the input called ``score`` is
    replaced, all others come back as they are.
    """
    weights, intercept = model
    own = [c for c in documents.columns if c.lower() != "score"]
    rows = documents.select(*(F.col(f"`{c}`") for c in own))
    table = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            z = np.full(len(batch), intercept)
            for _, text, bucket in buckets_of(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                hit = table[bucket] != 0
                text, bucket, count = _counted(text[hit], bucket[hit])
                z += np.bincount(text, table[bucket] * np.log1p(count), len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "score double"])
    return rows.mapInArrow(run, schema)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the contract of op4 fixes: every third id is held out of training."""
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(documents, labels, part != 1)
    found = score(documents.select("doc_id", "text"), model)
    held = F.coalesce(part == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
