"""The projected tables, kept by buckets of the file they are about: a step reads and rewrites only the buckets that new events touch.

An event is filed under each hash that it names, so an image's slice is found
from its document and from its own file.  What a step has to derive again are the
documents of the new events' hashes and those that have one of them as a slice;
it reads the buckets of these and of their slices, projects the events found, and
overwrites the touched buckets of each table with the rows that stay and the new
ones.  Events of a step that is run again replace themselves, and rows are keyed,
so nothing is added twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import replay
from chartloom.schemas import EVENT_FIELDS
from chartloom.session import cut, exists, remove

EVENT = f"hash string, {EVENT_FIELDS}, bucket int, batch long"
#: Each table and the column of the hash that its rows are kept by.
KEYS = {"source_file": "content_hash", "document": "source_file_hash", "ocr_result": "source_file_hash", "imaging_instance": "source_file_hash"}


@dataclass
class Projection:
    """The folders of the events and tables of a log; ``read`` gets (table, buckets) of what a step reads."""

    spark: SparkSession
    folder: str
    buckets: int = 256
    read: list = field(default_factory=list)

    def bucket(self, hash: str | Column) -> Column:
        return F.pmod(F.xxhash64(hash), F.lit(self.buckets)).cast("int")

    def _some(self, kind: str, schema: str, buckets: list[int]) -> DataFrame:
        """The rows of ``buckets``, of whose folders alone files are listed."""
        self.read.append((kind, sorted(buckets)))
        at = [p for b in buckets if exists(self.spark, p := f"{self.folder}/{kind}/bucket={b}")]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*at)

    def _of(self, hashes: DataFrame) -> list[int]:
        """As many numbers at most as there are buckets."""
        return [r[0] for r in hashes.select(self.bucket("hash")).distinct().collect()]

    def _events(self, hashes: DataFrame) -> DataFrame:
        found = self._some("events", EVENT, self._of(hashes))
        return found.join(hashes, "hash", "left_semi").drop("bucket", "batch")

    def step(self, events: DataFrame, objects: DataFrame, number: int) -> None:
        """Take in verified ``events`` and bring the tables up to date.

        ``objects`` that came after the event that waits for them are found once an
        event of their document comes, or by ``again``.
        """
        every = F.array_distinct(F.filter(F.array("content_hash", "source_file_hash", "document_ref.source_file_hash"), lambda h: h.isNotNull()))
        names = [f.name for f in self.spark.createDataFrame([], EVENT_FIELDS).schema]
        filed = events.select(*names).select(F.explode(every).alias("hash"), "*").withColumn("bucket", self.bucket("hash"))
        filed.withColumn("batch", F.lit(number).cast("long")).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.folder}/events")
        self.again(events.select(F.explode(every).alias("hash")).distinct(), objects)

    def again(self, hashes: DataFrame, objects: DataFrame) -> None:
        """Derive anew the rows of ``hashes`` (hash) and of the documents that have one of them as a slice."""
        hashes = cut(hashes.select("hash").distinct())
        own = self._events(hashes)
        slices = own.where("type = 'ImagingInstanceAdded'")
        touched = cut(hashes.union(slices.select(F.col("document_ref.source_file_hash").alias("hash"))).where("hash IS NOT NULL").distinct())
        about = cut(self._events(touched))
        others = about.where("type = 'ImagingInstanceAdded'").select(F.col("source_file_hash").alias("hash")).where("hash IS NOT NULL").distinct().join(touched, "hash", "left_anti")
        files = self._events(cut(others)).where("type = 'FileImported'")
        made = replay.project(about.drop("hash").unionByName(files.drop("hash")).distinct(), objects)
        buckets = self._of(touched)
        for name, key in KEYS.items():
            rows = made[name].join(touched.withColumnRenamed("hash", key), key, "left_semi").withColumn("bucket", self.bucket(key))
            # kept apart first, as a table is not overwritten while it is read
            fresh = cut(rows)
            schema = fresh.schema
            old = self._some(name, schema, buckets)
            whole = cut(old.join(touched.withColumnRenamed("hash", key), key, "left_anti").select(fresh.columns).unionByName(fresh))
            left = {r[0] for r in whole.select("bucket").distinct().collect()}
            whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
            for b in set(buckets) - left:
                remove(self.spark, f"{self.folder}/{name}/bucket={b}")

    def table(self, name: str) -> DataFrame:
        """A whole table."""
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").drop("bucket")
