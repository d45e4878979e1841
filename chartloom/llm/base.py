"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A key that has more than 1 / HOT of all rows is hot.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset (tests on one machine) a temporary folder is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chartloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in a folder of the shared one, for results too large to checkpoint row by row."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/chartloom-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame) -> DataFrame:
        """Cut the lineage with a table.

        Afterwards the driver's garbage is collected, so that the shuffle files of
        what has been written are let go of.
        """
        path, schema = f"{self.folder}/{self.n}", df.schema
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables; only when everything made from them has been stored elsewhere."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: what a worker holds as Python objects at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Within it, what is handed to Python workers at a time has some ``size`` at most: for jobs whose rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column has, whatever the case of its letters."""
    used, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join of two tables by a shuffle and merge, however small Spark takes them to be.

    It sizes a stored table by its file, in which repeated texts and numbers take
    little, and what is made of each row by the rows: either may be many times
    too low for a broadcast.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def join_hot(rows: DataFrame, values: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``values``, which has one row for each key and its number of rows ``n``.

    ``total`` is the number of ``rows``.  Fewer than HOT keys can have more than
    ``total`` / HOT of them, so the values of those are broadcast and their rows
    stay where they are; only the rest is dealt out by key.
    """
    many = total // HOT
    hot = F.broadcast(values.where(F.col(n) > many).drop(n))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col(n) <= many).drop(n), key)
    return rows.join(hot, key).unionByName(rest)


def labelled_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(place, label, text): one text, the least, for each id of the ``sample`` (doc_id, label) that has any.

    So repeated rows of an id don't exceed the sample's bound.  ``place`` is a
    hash of the id: a fit that takes rows in its order doesn't depend on how the
    documents were partitioned.
    """
    found = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    one = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    return one.select(F.xxhash64("doc_id").alias("place"), "label", "text")


def labelled_sample(labels: DataFrame, label: str, limit: int, where: Column | None = None) -> DataFrame:
    """At most ``limit`` rows (doc_id, label), chosen by a hash of the id.

    Rows with a null id or label are left out; of several labels for an id the
    smallest counts.  The bound makes the result small enough to broadcast.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        ids = ids.where(where)
    return ids.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
