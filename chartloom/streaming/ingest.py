"""The log as it grows: new lines are verified, appended to a table, and what they touch is derived again.

Segments are append-only files that grow in place, which a stream of files would
read only once.  So each step lists them and reads those whose length has
changed.  What a step knows of the steps before is a snapshot of state written
with it: the files' lengths, the last line and chain link of each segment, and
the watermark of each device.  Late events are never dropped, as the table of
lines is kept whole.

A step's lines, and then its state, are written to folders named by its number;
lines count once the state of their step is there.  A step that is run again,
or one that broke off, adds nothing twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.operators import replay
from chartloom.schemas import EVENT_FIELDS
from chartloom.session import exists, folders, move, remove
from chartloom.sources import log as L

Derived = Callable[[dict[str, DataFrame], int], None]
EVENT = f"{L.ENTRY}, {EVENT_FIELDS}"
LINES = f"{L.ENTRY}, link string, status string"
STATE = {"files": "path string, length long", "marks": "device_id string, applied long", "waiting": EVENT, "ends": "segment string, last_line long, link string"}


@dataclass(frozen=True)
class Table:
    """The folders of a synchronised log: ``lines`` by step, and snapshots of state by step, of which those of the last two are kept."""

    spark: SparkSession
    folder: str

    def steps(self, kind: str) -> list[int]:
        """The numbers of the steps that have written ``kind``, whole."""
        return [n for n in folders(self.spark, f"{self.folder}/{kind}", "batch") if exists(self.spark, f"{self.folder}/{kind}/batch={n}/_SUCCESS")]

    def state(self, kind: str, step: int | None) -> DataFrame:
        return self.spark.createDataFrame([], STATE[kind]) if step is None else self.spark.read.schema(STATE[kind]).parquet(f"{self.folder}/{kind}/batch={step}")

    def lines(self, last: int | None) -> DataFrame:
        """(segment, line_no, line, link, status, batch) of all steps up to the ``last``."""
        if last is None:
            return self.spark.createDataFrame([], f"{LINES}, batch long")
        read = self.spark.read.schema(f"{LINES}, batch long").option("basePath", f"{self.folder}/lines").parquet(f"{self.folder}/lines")
        return read.where(F.col("batch") <= last)

    def put(self, df: DataFrame, kind: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={step}")

    def committed(self) -> int | None:
        """The last step whose state is whole: the ends of segments are written last."""
        return max(self.steps("ends"), default=None)

    def tidy(self, last: int | None) -> None:
        """Remove what steps that broke off have written, and all snapshots but the last whole one."""
        for step in self.steps("lines"):
            if last is None or step > last:
                remove(self.spark, f"{self.folder}/lines/batch={step}")
        for kind in STATE:
            for step in self.steps(kind):
                if step != last:
                    remove(self.spark, f"{self.folder}/{kind}/batch={step}")


def advance(events: DataFrame, objects: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(watermarks, deferred events) of one more pass over the verified ``events`` above the watermarks ``marks`` (device_id, applied).

    What lies at or below its device's watermark has been applied, so its files
    and documents are known.
    """
    below = events.join(marks, "device_id").where(F.col("seq") <= F.col("applied")).drop("applied")
    gone = events.where("type = 'DocumentDeleted'").select("source_file_hash").distinct()
    files = below.where("type = 'FileImported'").select(F.col("content_hash").alias("source_file_hash")).distinct()
    documents = replay.without_tombstones(below.where("type = 'DocumentAdded'").select("source_file_hash").distinct(), gone, "source_file_hash")
    _, deferred, now = replay.settle(replay.pending(events, marks), files, documents, objects, gone, marks)
    return now, deferred


def sync(spark: SparkSession, folder: str, table: str, objects: DataFrame, derived: Derived, number: int | None = None, changed_only: bool = False, key: bytes | None = None) -> None:
    """One step: verify and append the lines that ``table`` lacks, and hand the tables to ``derived``.

    A line's chain, and its mac where a ``key`` is given, are checked from where the
    step before left its segment; lines that fail stay in the table with their
    status and reach ``quarantine`` alone.  A torn last line is left for later, as it
    may still grow.  Beside the tables of ``replay.project`` there are ``watermark``
    (device_id, applied) and ``waiting``, the events that stop a device.  With
    ``changed_only`` the projected tables hold the rows of the documents that the
    new lines touch.  A step that was done already only hands out its tables again.
    """
    number = int(time.time() * 1000) if number is None else number
    kept = Table(spark, table)
    last = kept.committed()
    if last is None or number > last:
        kept.tidy(last)
        _step(kept, folder, objects, last, number, key)
    lines = kept.lines(number)
    log = L.parse(lines.where("status = 'ok'"))
    events = log
    if changed_only:
        fresh = L.parse(lines.where((F.col("batch") == number) & (F.col("status") == "ok")))
        events = replay.about(log, replay.hashes_of(fresh))
    more = {"watermark": kept.state("marks", number), "waiting": kept.state("waiting", number), "quarantine": lines.where("status <> 'ok'").select("segment", "line_no", "line", "status")}
    derived(replay.project(events, objects) | more, number)


def _step(kept: Table, folder: str, objects: DataFrame, last: int | None, number: int, key: bytes | None) -> None:
    spark, ends = kept.spark, kept.state("ends", last)
    kept.put(L.listing(spark, folder), "files", number)
    read = L.read_lines(spark, folder, kept.state("files", last))
    new = read.join(ends.select("segment", "last_line"), "segment", "left").where(F.col("last_line").isNull() | (F.col("line_no") > F.col("last_line"))).drop("last_line")
    found = L.checked(new, key, ends)
    tails = new.groupBy("segment").agg(F.max("line_no").alias("_tail"))
    torn = (F.col("status") == "unreadable") & (F.col("line_no") == F.col("_tail"))
    kept.put(found.join(tails, "segment").where(~torn).select("segment", "line_no", "line", "link", "status"), "lines", number)
    stored = spark.read.schema(LINES).parquet(f"{kept.folder}/lines/batch={number}")
    moved = stored.groupBy("segment").agg(F.max("line_no").alias("last_line"), F.max_by(F.struct("link"), "line_no").alias("_l")).select("segment", "last_line", F.col("_l.link").alias("link"))
    log = L.parse(kept.lines(number).where("status = 'ok'"))
    marks, waiting = advance(log, objects, kept.state("marks", last))
    kept.put(marks, "marks", number)
    kept.put(waiting, "waiting", number)
    kept.put(ends.join(moved.select("segment"), "segment", "left_anti").unionByName(moved), "ends", number)


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, objects: DataFrame, derived: Derived, changed_only: bool = False, key: bytes | None = None, **trigger) -> StreamingQuery:
    """A streaming query whose ticks each do one ``sync``; by default every ten seconds.

    Steps go on from the last one of the table, so it may have been synchronised before.
    """
    done = Table(spark, table).committed()
    base = 0 if done is None else done + 1

    def batch(_: DataFrame, number: int) -> None:
        sync(spark, folder, table, objects, derived, base + number, changed_only, key)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


LETTER = "path string, modificationTime timestamp, status string, reason string"
Ingested = Callable[[DataFrame, int], DataFrame | None]


def _isolated(contents: Callable[[list[str]], DataFrame], paths: list[str], ingested: Ingested, number: int) -> dict[str, tuple[str, str | None]]:
    """{path: (status, reason)} of files handed to ``ingested``; where that fails, of each half, down to the file that is the reason."""
    if not paths:
        return {}
    try:
        told = ingested(contents(paths), number)
        found = {} if told is None else {r.path: (r.status, None) for r in told.select("path", "status").collect()}
        return {p: found.get(p, ("ingested", None)) for p in paths}
    except Exception as wrong:  # noqa: BLE001 - whatever a file's content makes of the caller's functions
        if len(paths) == 1:
            return {paths[0]: ("failed", f"{type(wrong).__name__}: {wrong}"[:500])}
    half = len(paths) // 2
    return _isolated(contents, paths[:half], ingested, number) | _isolated(contents, paths[half:], ingested, number)


def _taken(spark: SparkSession, names: list, ingested: Ingested, letters: str, number: int, archive: str) -> None:
    """Ingest the files of ``names`` (path, modificationTime), write what became of each, move those that passed."""
    read = lambda paths: spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(paths)
    paths = [r.path for r in names]
    # reading and hashing a content shows whether it can be read
    whole = {r.path for r in read(paths).where(F.sha2("content", 256).isNotNull()).select("path").collect()} if paths else set()
    found = _isolated(lambda some: read(some).select("path", "length", "content"), [p for p in paths if p in whole], ingested, number)
    found |= {p: ("failed", "unreadable") for p in paths if p not in whole}
    rows = [(r.path, r.modificationTime, *found[r.path]) for r in names]
    spark.createDataFrame(rows, LETTER).coalesce(1).write.mode("overwrite").parquet(f"{letters}/batch={number}")
    for path, (status, _) in found.items():
        if status != "failed":
            move(spark, path, archive)


def letters_of(spark: SparkSession, letters: str) -> DataFrame:
    """(path, modificationTime, status, reason, batch): the last thing that became of each file as it was at a time."""
    if not folders(spark, letters, "batch"):
        return spark.createDataFrame([], f"{LETTER}, batch long")
    every = spark.read.schema(f"{LETTER}, batch long").option("basePath", letters).parquet(letters)
    return every.groupBy("path", "modificationTime").agg(F.max_by(F.struct("status", "reason", "batch"), "batch").alias("_l")).select("path", "modificationTime", "_l.*")


def watch(spark: SparkSession, inbox: str, archive: str, checkpoint: str, ingested: Ingested, letters: str, most_files: int = 1000, **trigger) -> StreamingQuery:
    """Files dropped into a folder, each once: (path, length, content) to ``ingested``, then moved below ``archive``.

    Dot files, partial downloads and folders below are left alone; names are kept,
    as the archive repeats the path.  ``ingested`` may return (path, status).  A
    batch that fails is handed over again in halves, so it has to be repeatable; a
    file that fails alone, can't be read or has the status failed stays where it is,
    with a row in the table ``letters`` for ``retry``, and the others pass.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", most_files).option("pathGlobFilter", "[!.]*").load(inbox)
    )
    kept = files.where(~F.lower("path").rlike(r"(/[.][^/]*|[.](tmp|part|crdownload))$")).select("path", "modificationTime")

    def batch(df: DataFrame, number: int) -> None:
        # a batch that runs again has moved some of its files already
        names = [r for r in df.collect() if exists(spark, r.path)]  # most_files at most
        if names and number not in folders(spark, letters, "batch"):
            _taken(spark, names, ingested, letters, number, archive)

    return kept.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retry(spark: SparkSession, inbox: str, archive: str, ingested: Ingested, letters: str, most_files: int = 1000) -> int:
    """Hand over again the files of the ``inbox`` that failed, and those that came under the path of one that passed; their number.

    A failed file that is as it was is tried anew, too: what it lacked may be there by now.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(inbox).select("path", "modificationTime")
    known = letters_of(spark, letters)
    paths = known.select("path").distinct()
    names = listed.join(paths, "path", "left_semi").orderBy("path").limit(most_files).collect()
    last = max(folders(spark, letters, "batch"), default=-1)
    if names:
        _taken(spark, names, ingested, letters, max(last + 1, RETRIES), archive)
    return len(names)


#: Batches of retries are numbered from here, those of the stream below.
RETRIES = 1 << 40
