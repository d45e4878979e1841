"""Removal of repeated substrings with a distributed difference-cover suffix order.

A suffix order of a whole corpus would shuffle every byte many times over.  Here
two equal strings of ``length`` bytes are sure to meet in one task without that:

1. *Anchors.*  Each window of ``length`` bytes selects the least hash among its
   32-byte grams (the leftmost on ties), so equal windows select equal grams.
   Consecutive windows with one anchor form a *context*, about 280 bytes of text.
   Anchors that occur once in the corpus cannot lie in a repeated window.
2. *Contexts.*  Of each anchor the number of occurrences and the least and
   greatest hash of its contexts are aggregated where texts are read.  An anchor
   with a single context that occurs twice or more repeats in full; only anchors
   with several contexts need more, and their equal contexts are counted as one.
   Rows of anchors with very many occurrences are never dealt out by anchor.
3. *Suffix order.*  The distinct contexts of the other anchors are dealt out by
   anchor and ordered by ``suffix_array`` (sorted sampled triples, recursion on
   names, merging); neighbours are compared over ``length`` bytes.
4. *Hot anchors.*  An anchor with more than ``most`` distinct contexts is split:
   its windows are halved by where they start, seen from the anchor, and each half
   goes by the longer text that all its windows share.  Halving ends at single windows, which are counted.
   No row is dropped, and no task gets more than ``most`` contexts of a bucket.

Intermediate tables are written to the shared checkpoint folder and deleted once
used.  Texts are shuffled compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import suffix_array
from chartloom.llm.base import HOT, Scratch, small, small_batches
from chartloom.llm.ngrams import INVERSE, MULTIPLIER, _powers

LENGTH = 200
GRAM = 32
#: Distinct contexts of a bucket that are ordered together; some 300 bytes each.
MOST = 3000
#: Buckets to be split that are broadcast, 8 bytes each.
MOST_HOT = 1_000_000
#: Bytes hashed at a time; a longer text is cut into pieces that overlap by length - 1.
#: A piece's arrays take some 90 bytes for each of its bytes: 6 MB.
PIECE = 1 << 16
#: Bytes of small buckets that are ordered together, at some 110 bytes for each; a larger bucket is ordered alone.
GROUP = 1 << 16
NO_ID = -(1 << 63)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, n + 1)[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _powers(INVERSE, n + 1)[: n + 1 - gram]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def contexts(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, its position, first window start, last window start) of each context of the texts that end at ``ends``.

    ``data`` is below 2**24 bytes; no window crosses an end.
    """
    width = length - gram + 1
    if len(data) < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    h = _gram_hashes(data, gram)
    # the hash's upper bits, then the position: the least is the leftmost of the least
    keyed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate((keyed, np.full(-len(h) % width, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[: len(h)]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: len(h)]
    least = np.minimum(behind[: len(h) - width + 1], ahead[width - 1 :])
    starts = np.concatenate(([0], ends[:-1]))
    usable = ends - starts >= length
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts[usable]] += 1
    inside[ends[usable] - length + 1] -= 1
    window = np.flatnonzero(inside.cumsum()[: len(least)] > 0)
    if not len(window):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    at = (least[window] & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, window, "right")
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(window) != 1) | (np.diff(text) != 0)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(window) - 1]))
    return h[at[first]], at[first], window[first], window[last]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """([(text, offset)], joined bytes, ends) of about PIECE bytes each."""
    where, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            where.append((i, offset))
            parts.append(text[offset : offset + PIECE + length - 1])
            size += len(parts[-1])
            if size >= PIECE:
                yield where, b"".join(parts), np.cumsum([len(p) for p in parts])
                where, parts, size = [], [], 0
    if parts:
        yield where, b"".join(parts), np.cumsum([len(p) for p in parts])


def _rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): k1 and k2 tell rows apart unless they are equal in id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", text.alias("text")).withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "k2": F.xxhash64("text")})


def _packed(rows: DataFrame) -> DataFrame:
    """(k1, k2, packed): the texts' bytes, compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in small(batches):
            packed = [pack(t.encode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["k1", "k2", "packed"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, packed binary")


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, context, k1, k2, at): every context of every text; ``at`` packs where it is.

    at = first window start << 24 | last less first << 12 | anchor less first
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t.encode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
            for where, data, ends in _pieces(texts, length):
                anchor, position, first, last = contexts(np.frombuffer(data, np.uint8), ends, length)
                digest = xxhash.xxh3_64_intdigest
                context = np.array([digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                piece = np.searchsorted(ends, first, "right")
                text, offset = np.array(where, np.int64).reshape(-1, 2)[piece].T
                at = (first - np.concatenate(([0], ends[:-1]))[piece] + offset) << 24 | (last - first) << 12 | (position - first)
                columns = [anchor.view(np.int64), context.view(np.int64), keys[0][text], keys[1][text], at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "k1", "k2", "at"])

    return rows.select("text", "k1", "k2").mapInArrow(run, "anchor long, context long, k1 long, k2 long, at long")


def _texts_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The contexts that ``wanted`` (anchor, context, k1, k2, at) points to, with their bytes.

    lo and hi are the first and last window start in those bytes, offset is the
    anchor's place.  Seen from the anchor, windows start from ``low`` to ``high``.
    """
    low = GRAM - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for packed, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack(packed)
                for c in found:
                    first, more, offset = c["at"] >> 24, c["at"] >> 12 & 0xFFF, c["at"] & 0xFFF
                    for to, value in zip(out, (c["anchor"], c["context"], more, offset, raw[first : first + more + length]), strict=True):
                        to.append(value)
            anchor, context, more, offset, data = (pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))
            same = lambda x: pa.array(np.full(len(more), x, np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([anchor, anchor, context, same(0), more, offset, same(low), same(0), data], ["bucket", "anchor", "context", "lo", "hi", "offset", "low", "high", "bytes"])

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "context", "at")).alias("found"))
    joined = _packed(rows).join(lists, ["k1", "k2"]).select("packed", "found")
    return joined.mapInArrow(run, "bucket long, anchor long, context long, lo int, hi int, offset int, low int, high int, bytes binary")


def split_hot(texts: DataFrame, length: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows of buckets of at most ``most``, repeated single windows as (anchor, context, lo, hi))."""
    done = []
    while True:
        hot = scratch.store(texts.groupBy("bucket").count().where(F.col("count") > most).select("bucket"))
        n = hot.count()
        if not n:
            break
        # broadcast up to a checked size; beyond it a plain join of two tables, split where skewed
        hot = F.broadcast(hot) if n <= MOST_HOT else hot
        marked = texts.join(hot.withColumn("hot", F.lit(True)), "bucket", "left")
        calm = marked.where(F.col("hot").isNull()).drop("hot")
        half = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        sides = F.array(F.struct(F.col("low").alias("low"), half.alias("high")), F.struct((half + 1).alias("low"), F.col("high").alias("high")))
        halves = marked.where("hot AND low < high").withColumn("s", F.explode(sides)).withColumns({"low": F.col("s.low"), "high": F.col("s.high")})
        halves = halves.withColumns({"lo": F.greatest("lo", F.col("low") + F.col("offset")), "hi": F.least("hi", F.col("high") + F.col("offset"))}).where("lo <= hi")
        shared = F.expr(f"substring(bytes, high + offset + 1, low + {length} - high)")
        halves = halves.withColumn("bucket", F.xxhash64("low", "high", shared))
        singles = marked.where("hot AND low = high").select("anchor", "context", "lo", "hi", F.sha2(F.expr(f"substring(bytes, lo + 1, {length})"), 256).alias("window"))
        counts = singles.groupBy("window").count().where("count > 1").select("window")
        done.append(scratch.store(singles.join(counts, "window", "left_semi").select("anchor", "context", "lo", "hi")))
        texts = scratch.store(calm.unionByName(halves.select(*calm.columns)))
    if not done:
        return texts, texts.select("anchor", "context", "lo", "hi").limit(0)
    repeated = done[0]
    for more in done[1:]:
        repeated = repeated.union(more)
    return texts, repeated


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by bucket, as tables of whole buckets: of GROUP bytes at most, or a single bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        bucket = table.column("bucket").to_numpy()
        total = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy(), dtype=np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
        begin = 0
        for s, e in zip(starts[1:-1].tolist(), starts[2:].tolist(), strict=True):  # the last bucket may go on
            if total[e - 1] - (total[begin - 1] if begin else 0) > GROUP and s > begin:
                yield table.slice(begin, s - begin)
                begin = s
        if len(starts) > 1 and starts[-1] > begin:
            yield table.slice(begin, int(starts[-1]) - begin)
            begin = int(starts[-1])
        held = table.slice(begin).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, lo, hi): the runs of windows of each context that begin elsewhere in its bucket too."""

    def order(table: pa.Table) -> pa.RecordBatch:
        data = table.column("bytes").to_pylist()
        size = np.array([len(d) for d in data], np.int64)
        lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
        begin = np.cumsum(size) - size
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        relative = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        same = suffix_array.repeated_starts(np.frombuffer(b"".join(data), np.uint8), begin[row] + relative, length)
        row, relative = row[same], relative[same]
        new = np.flatnonzero((np.diff(row) != 0) | (np.diff(relative) != 1)) + 1
        first, last = (np.concatenate(([0], new)), np.concatenate((new - 1, [len(row) - 1]))) if len(row) else (row, row)
        of = row[first]
        ids = [pa.array(table.column(c).to_numpy()[of]) for c in ("anchor", "context")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(relative[first].astype(np.int32)), pa.array(relative[last].astype(np.int32))], ["anchor", "context", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            yield order(table)

    dealt = texts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "anchor long, context long, lo int, hi int")


def _matched(found: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of occurrences with ``values``, which has one row for each of its keys and their number of occurrences ``n``.

    Fewer than HOT keys can have more than one in HOT of the occurrences that
    match: those are broadcast, and what they match is dealt out evenly.
    """
    many = (values.agg(F.sum("n")).first()[0] or 0) // HOT
    packed = F.struct(*(c for c in values.columns if c not in (*keys, "n")), F.lit(True).alias("hit"))
    hot = F.broadcast(values.where(F.col("n") > many).select(*keys, packed.alias("hot")))
    cold = values.where(F.col("n") <= many).select(F.col(keys[0]).alias("key"), *keys[1:], packed.alias("cold"))
    known = found.join(hot, keys, "left")
    dealt = known.withColumn("key", F.when(F.col("hot").isNotNull(), F.xxhash64("k1", "k2", "at")).otherwise(F.col(keys[0])))
    joined = dealt.join(cold, ["key", *keys[1:]], "left").withColumn("value", F.coalesce("hot", "cold")).where("value IS NOT NULL")
    return joined.select(*found.columns, "value.*").drop("hit")


def find(documents: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc_id, packed, runs) for each row: the windows, by their start in bytes, that also begin anywhere else.

    ``packed`` is the text's bytes, compressed; a run is its first start << 16 and
    the number of starts that follow.
    """
    with small_batches(documents.sparkSession):  # the jobs below hand whole texts to Python workers
        return _find(documents, length, most)


def _find(documents: DataFrame, length: int, most: int) -> DataFrame:
    rows, spark = _rows(documents), documents.sparkSession
    second, third, last = (Scratch(spark) for _ in range(3))
    stats = occurrences(rows, length).groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    anchors = second.store(stats.where("n > 1"))
    # of each context its number and one place; the three first values are of one row
    found = [F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "at"))]
    kinds = second.store(_matched(occurrences(rows, length), anchors.where("a <> b").select("anchor", "n"), ["anchor"]).groupBy("anchor", "context").agg(*found))
    texts, single = split_hot(third.store(_texts_of(rows, kinds.drop("n"), length)), length, most, third)
    windows = second.store(repeated_windows(texts, length).union(single))
    third.drop()
    # a run of windows is packed as its first start << 16 | how many follow
    packed = lambda start, more: F.shiftleft(start.cast("long"), 16).bitwiseOR(more.cast("long"))
    runs = windows.groupBy("anchor", "context").agg(F.collect_set(packed(F.col("lo"), F.col("hi") - F.col("lo"))).alias("runs"))
    whole = F.array().cast("array<long>")  # stands for all windows of a context
    parts = kinds.join(runs, ["anchor", "context"], "left").select("anchor", "context", "n", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs"))
    alone = anchors.where("a = b").select("anchor", F.col("a").alias("context"), "n", whole.alias("runs"))
    verdicts = second.store(parts.where("runs IS NOT NULL").unionByName(alone))
    # the occurrences are made again each time: cheaper than to keep them all
    hits = _matched(occurrences(rows, length), verdicts, ["anchor", "context"])
    every = F.array(F.shiftright("at", 12).bitwiseAND(F.lit(0xFFF)))
    moved = hits.select("k1", "k2", F.explode(F.when(F.size("runs") == 0, every).otherwise(F.col("runs"))).alias("run"), "at")
    moved = moved.select("k1", "k2", (F.col("run") + F.shiftleft(F.shiftright("at", 24), 16)).alias("run"))
    by_row = last.store(moved.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs")))
    second.drop()
    ids = F.when(F.col("k1") != NO_ID, F.col("k1"))
    return _packed(rows).join(by_row, ["k1", "k2"], "left").select(ids.cast(documents.schema["doc_id"].dataType).alias("doc_id"), "packed", "runs")


def cut_runs(raw: bytes, runs: list | None, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """(maximal removed spans, what is left)."""
    spans: list[list[int]] = []
    for first, more in sorted((r >> 16, r & 0xFFFF) for r in runs or ()):
        last = first + more
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return [tuple(s) for s in spans], b"".join([*kept, raw[at:]])


def remove(documents: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``documents``.

    Null texts are empty; texts shorter than ``length`` bytes lose nothing; of
    repeated rows and equal texts every one loses all.  ``kept`` is the bytes that
    remain, which need not be valid UTF-8.  An empty table gives no rows.  Texts
    are read whole, in overlapping pieces of PIECE bytes.  Other columns of the
    input are not read, so their names don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for packed, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = unpack(packed)
                spans, kept = cut_runs(raw, runs, length)
                for to, value in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    to.append(value)
            columns = [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = find(documents, length, most)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the contract of op1 fixes."""
    return remove(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window of every text as hexadecimal digits: fit for small tables only.
ORACLE = """
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS (SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS w FROM doc, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 199)) AS t(i)),
    rep AS (SELECT r, i FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(*) > 1)),
    run AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM rep),
    span AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM run) GROUP BY r, g),
    kept AS (
        SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans,
               string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS k
        FROM (SELECT span.r, a, b, h, coalesce(lag(b) OVER (PARTITION BY span.r ORDER BY a), 0) AS prev FROM span JOIN doc USING (r)) GROUP BY r)
    SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(k, h))) AS kept_sha256
    FROM doc LEFT JOIN kept USING (r)"""
