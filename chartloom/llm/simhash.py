"""SimHash near-dedup with anchor-point covering.

Fingerprints are computed row by row (Arrow batches); equal ones collapse into
one node with its least doc_id.  A covering code (``covering``) gives the
anchors: each fingerprint has one own anchor and is replicated to every anchor
within the covering radius plus the threshold, about 60 of 2**24.  At each
anchor the replicas are compared with the fingerprints whose own anchor it is,
as a join with the bit count as its condition.  Links feed a distributed
connected-components job.  Nothing but row counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import covering, similar
from chartloom.llm.base import cut, fresh, join_hot, merged, small
from chartloom.llm.components import components

SEED = 42
THRESHOLD = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the white space of ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): the pairs of distinct fingerprints of ``nodes`` (fp) within ``threshold`` bits, each pair once."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(covering.anchor(fps.view(np.uint64))), batch.column(0)], ["anchor", "u"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                rows, anchors = covering.anchors_within(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(part[rows])], ["anchor", "v"])

    # a checkpoint of few rows has few partitions, and each row becomes some 60: they are dealt out again
    dealt = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    homes = dealt.mapInArrow(own, "anchor long, u long")
    visitors = dealt.mapInArrow(replicas, "anchor long, v long")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    # Spark sizes ``visitors`` by the rows of ``dealt``, some 60 times too low, and would broadcast them
    return merged(homes, visitors, "anchor").where(near).select("u", "v")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, similar_shingle: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row of ``documents``; root is the component's least fingerprint.

    component_id is the least doc_id that links reach (null ids don't count; if a
    component has no other, it is null).  Null, empty and wordless texts have the
    fingerprint 0 and so share a component.  Repeated rows come back repeated.
    With ``similar_shingle``, texts whose shingles of so many words have a Jaccard
    similarity of 0.8 or more are linked as well (``similar``).  Texts are read
    whole, whatever their length; an empty table gives no rows.
    """
    rows = cut(fingerprints(documents))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = links(nodes, threshold)
    if similar_shingle:
        edges = cut(edges)
        edges = edges.unionByName(similar.links(documents, rows, edges, similar_shingle))
    found = components(edges)
    linked = cut(nodes.join(found, nodes.fp == found.node).select("fp", "root", "least"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.join(roots, "root").select("fp", "root", "component_id", F.lit(True).alias("linked"))
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least"))
    named = nodes.join(joined, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), component.alias("component_id"))
    return join_hot(rows, named, "fp", "n", rows.count())


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the contract of op7 fixes, for texts of any length; an empty table gives no rows."""
    found = near_duplicates(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, similar_shingle: int | None = None) -> DataFrame:
    """One row of each component: that of the least doc_id (a null one comes last), and of those the least text hash.

    Null, empty and wordless texts are one component.  Of repeated rows one stays;
    an empty table gives none.  Texts are read whole.  All columns come back as
    they are, whatever their names.
    """
    no_id = F.lit(-(1 << 63))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    winners = near_duplicates(documents, similar_shingle=similar_shingle).groupBy("root").agg(first)
    own, text = fresh(documents.columns, "id", "hash")
    winners = winners.select(F.coalesce("first.doc_id", no_id).alias(own), F.col("first.text_hash").alias(text))
    keyed = documents.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), no_id), text: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(winners, [own, text], "left_semi").dropDuplicates([own, text]).select(*(F.col(f"`{c}`") for c in documents.columns))
