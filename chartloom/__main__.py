"""``python -m chartloom import FOLDER RECORD | search RECORD QUERY | timeline RECORD``.

A record is a folder with two Parquet tables: ``log`` (segment, line_no, line),
appended in sealed lines, and ``objects`` (hash, content).
"""

from __future__ import annotations

import argparse
import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators import ordering, records, replay
from chartloom.session import cut, exists, session
from chartloom.sources import files
from chartloom.sources import log as L

LIMIT = 20
OBJECT = "hash string, content binary"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or none of its rows if it isn't there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def tables(spark: SparkSession, record: str) -> dict[str, DataFrame]:
    """The projection of the entries whose chain holds."""
    lines = L.verify(stored(spark, f"{record}/log", L.ENTRY)).where("status = 'ok'")
    return replay.project(L.parse(lines), stored(spark, f"{record}/objects", OBJECT))


def events_of(found: DataFrame, device: str, at: str) -> DataFrame:
    """File, document and page events of ingested files, numbered in that order by content."""
    rows = found.where("status IN ('ingested', 'metadata_only')").select("*", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(at).alias("at"))
    rows = rows.withColumns({"document_ref": F.struct(F.col("content_hash").alias("source_file_hash")), "doc_type": F.coalesce("doc_type", T.classify(F.col("name")))})
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    file = {"content_hash": "content_hash", "original_name": "name", "mime_type": "mime_type", "byte_size": "length", "imported_at": "at"}
    document = {"source_file_hash": "content_hash", "doc_type": "doc_type", "title": "name", "language": "language", "created_at": "at"}
    kinds = [
        ("FileImported", rows, {k: F.col(v) for k, v in file.items()}),
        ("DocumentAdded", rows, {k: F.col(v) for k, v in document.items()} | {"doc_date": day("dates.start"), "doc_date_end": day("dates.end"), "page_count": F.lit(1)}),
        ("OcrAdded", rows.where("status = 'ingested'"), {"document_ref": F.col("document_ref"), "page_no": F.lit(1), "backend": F.lit("native"), "model_version": F.lit("1"), "text_hash": F.sha2("text", 256), "created_at": F.col("at")}),
    ]
    every = None
    for level, (kind, df, fields) in enumerate(kinds):
        made = replay.event(kind, df, fields, F.lit(device), F.lit(at), F.lit(0)).withColumn("_level", F.lit(level))
        every = made if every is None else every.unionByName(made)
    key = F.coalesce("document_ref.source_file_hash", "source_file_hash", "content_hash")
    every = every.withColumn("_key", key)
    return ordering.numbered(every, F.concat(F.col("_level").cast("string"), F.substring("_key", 1, 2)), [F.col("_level"), F.col("_key")], "_n").drop("_level", "_key")


def take(spark: SparkSession, folder: str, record: str, device: str = "cli") -> DataFrame:
    """Import a folder; (path, status) of each file."""
    at = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = stored(spark, f"{record}/log", L.ENTRY)
    log = L.parse(lines)
    read = files.read_files(spark, folder)
    # kept apart from the log, which is about to change
    found = cut(files.ingest(read, log.where("type = 'FileImported'").select("content_hash")).join(read.select("path", "length"), "path"))
    first = L.next_seq(log).first().next_seq
    # an entry of a type has the fields of that type alone
    entries = events_of(found, device, at).withColumn("seq", F.col("_n") + (first - 1)).withColumn("event_id", F.sha2(F.concat_ws(":", "type", "seq", F.lit(uuid.uuid4().hex)), 256))
    new = entries.select(F.lit(f"{device}-000001.jsonl").alias("segment"), F.col("_n").cast("long").alias("line_no"), F.to_json(F.struct(*(c for c in entries.columns if c != "_n"))).alias("line"))
    sealed = cut(L.append(lines, new))
    texts = found.where("status = 'ingested'").select(F.sha2("text", 256).alias("hash"), F.encode("text", "UTF-8").alias("content"))
    both = files.objects(read).unionByName(texts.dropDuplicates(["hash"])).dropDuplicates(["hash"])
    both.join(stored(spark, f"{record}/objects", OBJECT).select("hash"), "hash", "left_anti").write.mode("append").parquet(f"{record}/objects")
    sealed.write.mode("append").parquet(f"{record}/log")
    return found.select("path", "status").orderBy("path")


def search(spark: SparkSession, record: str, query: str) -> DataFrame:
    made = tables(spark, record)
    pages = made["ocr_result"].select("source_file_hash", "text")
    found = records.search_results(pages, made["document"].select("source_file_hash", "title", "doc_date"), query, LIMIT, "source_file_hash")
    return found.select(F.coalesce(F.substring("doc_date", 1, 10), F.lit("无日期")).alias("date"), "title", "snippet")


def timeline(spark: SparkSession, record: str) -> DataFrame:
    documents = tables(spark, record)["document"]
    rows = documents.orderBy(*records.timeline_order("doc_date", "source_file_hash"))
    return rows.select(F.coalesce(F.substring("doc_date", 1, 10), F.lit("无日期")).alias("date"), records.label(F.col("doc_type")).alias("type"), "title")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chartloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("import", ("folder", "record")), ("search", ("record", "query")), ("timeline", ("record",))):
        command = commands.add_parser(name)
        for word in words:
            command.add_argument(word)
    given = parser.parse_args(arguments)
    spark = session("*")
    shown = take(spark, given.folder, given.record) if given.command == "import" else search(spark, given.record, given.query) if given.command == "search" else timeline(spark, given.record)
    for row in shown.toLocalIterator():
        print("\t".join(map(str, row)))


if __name__ == "__main__":
    main()
