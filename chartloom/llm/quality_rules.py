"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

Statistics are computed text by text in Arrow batches.  The trees are trained on
the driver from the statistics of at most ``MAX_ROWS`` labelled documents, chosen
by a hash of their id and taken in its order, and are scored from flat numpy arrays in the same pass
that computes the statistics.  More repetition, symbols or repeated lines can
only lower a document's score (monotonic constraints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import gbdt
from chartloom.llm.base import labelled_sample, labelled_texts, small

#: Bound of the labelled rows that the trees are trained on.
MAX_ROWS = 20_000
#: A document is kept if its score reaches this.
KEEP_AT = 0.3
SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The features and the sign of their effect on the score, 0 where it is free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1, "top_word_share": -1,
    "same_as_last_share": -1, "bare_symbol_share": -1, "upper_share": -1, "digit_share": -1, "mark_share": 0, "line_words": 0, "longest_word": 0,
}
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:!?"


def repeated(ids: np.ndarray, n: int, window: int = 5) -> int:
    """The words inside any window that occurs twice or more; ids are below n."""
    if len(ids) <= window:
        return 0
    if n <= 4096:  # five ids fit a 64-bit word
        key = ids[: 1 - window].copy()
        for i in range(1, window):
            key = key * n + ids[i : len(ids) - window + 1 + i]
    else:
        key, size = ids, 1
        while size < window:  # names of longer and longer windows, exact at each step
            step = min(size, window - size)
            longer = key[: len(key) - step] * (n + len(ids)) + key[step:]
            key, size = np.unique(longer, return_inverse=True)[1].astype(np.int64), size + step
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[name] > 1)
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + window, -1)
    return int((mark.cumsum()[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text, null being empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # on bytes: exactly \x20 and \x09-\x0D
    n = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if not n:
        return [0, 0, n_symbols, 0, 0], [0.0] * len(FEATURES)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    n_dup = len(lines) - len(set(lines))
    repeats = repeated(ids, len(known))
    word_chars = len(text) - sum(text.count(c) for c in SPACE)
    counts = np.bincount(ids)
    share = lambda kinds: 1 - len(raw.translate(None, kinds)) / len(raw)
    bare = sum(c for w, c in zip(known, counts.tolist(), strict=True) if not w.strip(SYMBOLS))
    features = [
        np.log1p(n), word_chars / n, n_symbols / word_chars, n_dup / len(lines), repeats / n, len(known) / n ** 0.85, counts.max() / n,
        float((ids[1:] == ids[:-1]).sum()) / n, bare / n, share(UPPER), share(DIGITS), share(MARKS), min(n / len(lines), 500.0), max(map(len, known)),
    ]
    return [n, word_chars, n_symbols, n_dup, repeats], [float(x) for x in features]


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, where: Column | None = None) -> gbdt.Trees:
    """Trees for the chance of ``labels.quality`` = 1; a constant where no labelled document is found.

    ``where`` selects the rows of ``labels`` that may be learnt from.
    """
    sample = F.broadcast(labelled_sample(labels, "quality", max_rows, where))  # max_rows rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [statistics(t)[1] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["place", "label", "x"])

    found = labelled_texts(documents, sample).mapInArrow(run, "place long, label int, x array<double>").toPandas()
    if not len(found):
        return gbdt.train(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(found["x"].to_numpy()), found["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y, found["place"].to_numpy()))
    return gbdt.train(x[order], y[order], monotone=np.array(list(FEATURES.values())))


def _verdicts(texts: list[str | None], trees: gbdt.Trees, keep_at: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, base_failed, score, kept) of each text."""
    found = [statistics(t) for t in texts]
    base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
    failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
    score = trees.score(np.array([f for _, f in found], np.float64).reshape(-1, len(FEATURES)))
    return base, failed, score, ~failed & (score >= keep_at)


def _schema(rows: DataFrame, *added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *added])


def judge(documents: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``quality_score`` and ``kept`` to each row.

    Null and wordless texts fail the base rule.  Texts are read whole.  Repeated
    rows are judged alike, an empty table gives no rows; columns of the input with
    a name of the result are replaced, all others come back as they are.
    """
    trees = train(documents, labels)
    added = [*(f"{c} long" for c in BASE), "base_failed boolean", "quality_score double", "kept boolean"]
    names = [a.split()[0] for a in added]
    rows = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c.lower() not in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            base, failed, score, kept = _verdicts(batch.column(batch.schema.get_field_index("text")).to_pylist(), trees, keep_at)
            columns = [*batch.columns, *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return rows.mapInArrow(run, _schema(rows, *added))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the contract of op6 fixes, and the score."""
    return judge(documents.select("doc_id", "text"), labels).select("doc_id", *BASE, "base_failed", "kept", "quality_score")


def keep(documents: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that ``judge`` would keep, with all their columns as they are, whatever their names.

    Null, empty and wordless texts go; of repeated rows all stay or all go; an
    empty table gives no rows; without labels only the base rule counts.
    """
    trees = train(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(_verdicts(batch.column(batch.schema.get_field_index("text")).to_pylist(), trees, keep_at)[3]))

    return documents.mapInArrow(run, _schema(documents))
