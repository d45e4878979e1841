"""Objects kept by the beginning of their hash, copies that are checked, and merging two records' folders.

An object lies in the folder of the first two digits of its hash, so some objects
are read from their folders alone, and what a folder lacks is found from hashes,
without contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.session import exists

OBJECT = "hash string, content binary, bytes long, prefix string"


def merge_objects(target: DataFrame, source: DataFrame) -> DataFrame:
    """(hash, content) of both, the target's where it has one: only what it lacks is added."""
    return target.unionByName(source.join(target.select("hash"), "hash", "left_anti").dropDuplicates(["hash"]))


def merge_segments(target: DataFrame, source: DataFrame) -> DataFrame:
    """(segment, line_no, line): of segments of one name the one with more bytes, of equals the target's; logs only grow."""
    both = target.withColumn("_side", F.lit(0)).unionByName(source.withColumn("_side", F.lit(1)))
    sizes = both.groupBy("segment", "_side").agg(F.sum(F.octet_length("line") + 1).alias("_bytes"))
    best = sizes.groupBy("segment").agg(F.max_by("_side", F.struct("_bytes", -F.col("_side"))).alias("_side"))
    return both.join(best, ["segment", "_side"], "left_semi").select("segment", "line_no", "line")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, bytes) of the objects of a folder; contents aren't read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "hash string, bytes long")
    return spark.read.schema(OBJECT).parquet(folder).select("hash", "bytes").distinct()


def get(spark: SparkSession, folder: str, hashes: DataFrame) -> DataFrame:
    """(hash, content) of those of ``hashes`` (hash) that the folder has, whose content is theirs; only their prefixes' folders are read."""
    prefixes = [r[0] for r in hashes.select(F.substring("hash", 1, 2)).distinct().collect()]  # 256 at most
    at = [p for x in prefixes if exists(spark, p := f"{folder}/prefix={x}")]
    if not at:
        return spark.createDataFrame([], "hash string, content binary")
    found = spark.read.schema(OBJECT).option("basePath", folder).parquet(*at).join(hashes.select("hash").distinct(), "hash", "left_semi")
    return found.where(F.sha2("content", 256) == F.col("hash")).groupBy("hash").agg(F.any_value("content").alias("content"))


def put(objects: DataFrame, folder: str) -> None:
    """Add those of ``objects`` (hash, content) that the folder lacks, each once; a content that isn't its hash's is left out.

    What is lacking is found from hashes alone; only the contents of those are
    dealt to their prefixes, once.
    """
    spark = objects.sparkSession
    good = objects.where(F.sha2("content", 256) == F.col("hash"))
    lacking = objects.select("hash").distinct().join(manifest(spark, folder).select("hash"), "hash", "left_anti")
    new = good.join(lacking, "hash", "left_semi").withColumns({"bytes": F.octet_length("content").cast("long"), "prefix": F.substring("hash", 1, 2)})
    once = new.groupBy("prefix", "hash").agg(F.any_value("content").alias("content"), F.any_value("bytes").alias("bytes"))
    once.select("hash", "content", "bytes", "prefix").write.mode("append").partitionBy("prefix").parquet(folder)


def check(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(hash, status) of each of a manifest ``wanted`` (hash, bytes): ok, missing, or changed (another size or other bytes)."""
    own = spark.read.schema(OBJECT).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], OBJECT)
    # contents stay where they are read: only their hashes and sizes are joined
    seen = own.select("hash", (F.sha2("content", 256) == F.col("hash")).alias("_same"), F.octet_length("content").alias("_bytes"))
    best = seen.groupBy("hash").agg(F.max(F.struct("_same", "_bytes")).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_b._same") & (F.col("_b._bytes") == F.col("bytes")), "ok").otherwise("changed")
    return wanted.select("hash", "bytes").distinct().join(best, "hash", "left").select("hash", status.alias("status"))


def move_objects(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy to ``target`` what it lacks of ``source``; (hash, status) of every object of ``source``, read again from ``target``.

    The source stays; its owner deletes it once every status is ok.
    """
    if exists(spark, source):
        put(spark.read.schema(OBJECT).parquet(source).select("hash", "content"), target)
    return check(spark, target, manifest(spark, source))
