"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, up to connection.

Every such pair shares one of the first n - ceil(0.8 n) + 1 shingles of each of
its sets in any common order (prefix filter), so nothing is left to chance.  The
order puts shingles that are common in a sample of the texts late, the most
frequent last: what the sample has decides only how long the lists of a shingle
are.  The members of a
list are first compared with one of them, whose links join most of a group of
near copies; after that only pairs across components are compared, by their
whole sets, and a long list is first split by further shingles.  Before their texts are fetched, pairs are dropped whose parity
sketches differ in more bits than their sets may differ in shingles, which no
pair of 0.8 does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.base import Scratch, cut, merged, small, small_batches
from chartloom.llm.components import components

SEED = 42
SHINGLE = 5
#: The order is taken from a sample of one text in SHARE, or of some SAMPLE texts where that is more; a shingle of more than COMMON texts of it comes late.
SAMPLE, SHARE, COMMON = 20_000, 10, 2
#: Of those shingles so many, the most frequent, are told to every task, 9 bytes each; the others keep their places in the order.
MOST_COMMON = 1_000_000
#: Members of a list that are compared in pairs; a longer list is split by the next shingle that two of them share, so many times at most.
LIST, LEVELS = 4096, 4
#: Bits of a parity sketch; it tells sets of up to some 2,000 shingles apart.
SKETCH = 1024


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """The hash of each word shingle; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the white space of ASCII only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def _common(texts: DataFrame, rows: int, shingle: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come late, sorted, and how late each comes: the number of bits of its count in the sample.

    The sample grows with the texts, so the lists of the shingles that come first
    stay as long as they are: with a sample of one size they would grow with the
    texts, and pairs with their square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = shingle_set(text, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), h))], ["token", "h"])

    one_in = min(SHARE, max(1, rows // SAMPLE))
    tokens = texts.where(F.pmod("h", F.lit(one_in)) == 0).mapInArrow(run, "token long, h long").distinct()
    often = scratch.store(tokens.groupBy("token").count().where(F.col("count") > COMMON))
    counts, least = sorted(often.groupBy("count").agg(F.count("*").alias("n")).collect(), reverse=True), COMMON
    if len(over := np.flatnonzero(np.cumsum([r.n for r in counts]) > MOST_COMMON)):
        least = counts[over[0]]["count"]
    late = often.where(F.col("count") > least).select("token", F.ceil(F.log2(F.col("count") + 1)).cast("byte").alias("bits")).toArrow()
    token, bits = (np.asarray(c, t) for c, t in zip(late.columns, (np.int64, np.uint8), strict=True))
    order = np.argsort(token)
    return token[order], bits[order]


def _late(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How late each shingle comes in the order; 0 for those that aren't common."""
    token, bits = common
    if not len(token):
        return np.zeros(len(found), np.uint8)
    at = np.minimum(np.searchsorted(token, found), len(token) - 1)
    return np.where(token[at] == found, bits[at], 0)


def _prefixes(texts: DataFrame, common, shingle: int, share: int = 1) -> DataFrame:
    """(token, h, n, at, cold): the prefix of each text's set, each token's place in it, and the number of tokens that aren't common.

    Of the prefixes of two sets with a similarity of 0.8 at least ``share`` tokens are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in small(batches):
            parts = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = shingle_set(text, shingle)
                if n := len(found):
                    late = _late(found, last)
                    first = found[np.argsort(late, kind="stable")][: n - (4 * n + 4) // 5 + share]
                    k = len(first)
                    parts.append((first, np.full(k, h), np.full(k, n), np.arange(k), np.full(k, n - np.count_nonzero(late))))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["token", "h", "n", "at", "cold"])

    return texts.mapInArrow(run, "token long, h long, n long, at long, cold long")


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of SKETCH classes, as longs; two sets differ in as many shingles at least as their sketches in bits."""
    odd = np.bincount((found.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(h, n, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            sizes, made = pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), sizes, made], ["h", "n", "sketch"])

    return texts.mapInArrow(run, "h long, n long, sketch array<long>")


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b) that their sketches don't tell apart."""
    left = sketches.select(F.col("h").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_s"))
    right = sketches.select(F.col("h").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_t"))
    bits = F.aggregate(F.zip_with("_s", "_t", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return merged(merged(pairs, left, "a"), right, "b").where(9 * bits <= F.col("_n") + F.col("_m")).select("a", "b")


def _may(n: Column, at: Column, m: Column, to: Column) -> Column:
    """What the sizes and the places of the first shared shingle allow; a pair passes at that shingle at least."""
    most = F.least(n - at, m - to)
    return (9 * most >= 4 * (n + m)) & (5 * F.least(n, m) >= 4 * F.greatest(n, m))


def _verified(pairs: DataFrame, texts: DataFrame, owners: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(u, v): the fingerprints of those ``pairs`` (a, b) of text hashes whose whole sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in small(batches, 16):
            links = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(known) > 16:
                    known.clear()
                for t in (a, b):
                    if t not in known:
                        known[t] = shingle_set(t, shingle)
                if alike(known[a], known[b]):
                    links.append((u, v))
            us, vs = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    keys = scratch.store(merged(owners, wanted, "h").select("id", "h", "fp"))
    own = scratch.store(merged(texts, keys, ["id", "h"]).dropDuplicates(["id", "h"]).select("h", "fp", "text"))
    left = own.select(F.col("h").alias("a"), F.col("fp").alias("u"), F.col("text").alias("s"))
    right = own.select(F.col("h").alias("b"), F.col("fp").alias("v"), F.col("text").alias("t"))
    return scratch.store(merged(merged(pairs, left, "a"), right, "b").select("u", "v", "s", "t").mapInArrow(run, "u long, v long"))


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): the pairs across components of lists that their sizes and places allow."""
    l, r = rows.alias("l"), rows.alias("r")  # noqa: E741
    across = (F.col("l.h") < F.col("r.h")) & (F.col("l.root") != F.col("r.root"))
    for k in keys:
        across = (F.col(f"l.{k}") == F.col(f"r.{k}")) & across
    return merged(l, r, across & _may(F.col("l.n"), F.col("l.at"), F.col("r.n"), F.col("r.at"))).select(F.col("l.h").alias("a"), F.col("r.h").alias("b"))


def _across(rows: DataFrame, texts: DataFrame, common, shingle: int, scratch: Scratch, most: int, levels: int) -> DataFrame:
    """(a, b): pairs of texts of different components, such that every similar one is among them, from ``rows`` (token, h, n, at, root).

    A list of more than ``most`` texts is not compared in pairs: two sets that are
    alike share a second shingle soon behind their first, in prefixes that are
    longer by one, so a list is split by that, and its parts by a third.  Texts
    that have little but a frequent shingle in common part at once; only lists that
    are still long after ``levels`` splits, of sets alike in so many shingles, are
    compared whole.
    """
    keys, found = ["token"], []
    rows = rows.select("token", "h", "n", "at", "root", F.col("at").alias("last"))
    for level in range(1, levels + 1):
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*keys, "m")
        rows = scratch.store(merged(rows, sizes, keys))
        long = rows.where(F.col("m") > most)
        if level == levels or long.isEmpty():
            found.append(_pairs(rows, keys))
            break
        found.append(_pairs(rows.where(F.col("m") <= most), keys))
        wanted = scratch.store(long.select("h").distinct())
        name = f"token{level + 1}"
        more = _prefixes(merged(texts, wanted, "h", "left_semi").select("id", "h", "text").dropDuplicates(["h"]), common, shingle, level + 1)
        more = more.select("h", F.col("token").alias(name), F.col("at").alias("next"))
        rows = merged(long.drop("m"), more, "h").where(F.col("next") > F.col("last")).drop("last").withColumnRenamed("next", "last")
        keys = [*keys, name]
    return reduce(DataFrame.union, found)


def links(documents: DataFrame, rows: DataFrame, known: DataFrame, shingle: int = SHINGLE, most: int | None = None, levels: int | None = None) -> DataFrame:
    """(u, v): links of fingerprints that, with ``known`` (u, v), connect all texts with a similarity of 0.8 or more.

    ``rows``: (doc_id, text_hash, fp) of each row of ``documents``; rows of one
    fingerprint count as connected, so repeated rows and texts need no link.  Null,
    empty and wordless texts have no shingle and are linked with nothing here; a
    text of fewer words than a shingle is one.  Texts are read whole, whatever
    their length; ``most`` and ``levels`` decide the way (see ``_across``), not the
    links; an empty table gives none.
    """
    with small_batches(documents.sparkSession):  # every job below hands whole texts or long lists to Python workers
        return _links(documents, rows, known, shingle, most or LIST, levels or LEVELS)


def _links(documents: DataFrame, rows: DataFrame, known: DataFrame, shingle: int, most: int, levels: int) -> DataFrame:
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.col("text").cast("string")
    texts = documents.select(identity.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    owners = scratch.store(rows.groupBy(F.col("text_hash").alias("h"), "fp").agg(F.min(identity).alias("id")))
    common = spark.sparkContext.broadcast(_common(texts, rows.count(), shingle, scratch))
    prefixes = _prefixes(texts, common, shingle)
    shared = scratch.store(prefixes.groupBy("token").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("token"))
    members = scratch.store(merged(merged(prefixes, shared, "token").distinct(), owners.select("h", "fp"), "h"))
    sketches = scratch.store(merged(_sketches(texts, shingle), members.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"]))
    pivots = members.groupBy("token").agg(F.min(F.struct("cold", "h", "n", "at", "fp")).alias("p"))
    near = merged(members, pivots, "token").where((F.col("fp") != F.col("p.fp")) & _may(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at")))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    first = _verified(scratch.store(_plausible(near.select(*pair(F.col("h"), F.col("p.h"))).distinct(), sketches)), texts, owners, shingle, scratch)
    roots = components(known.unionByName(first))
    labelled = merged(members, roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    labelled = scratch.store(labelled)
    rest = _across(labelled, texts, common, shingle, scratch, most, levels)
    second = _verified(scratch.store(_plausible(rest.distinct(), sketches)), texts, owners, shingle, scratch)
    found = cut(first.unionByName(second))
    scratch.drop()
    return found
