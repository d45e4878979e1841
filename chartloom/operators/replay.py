"""Projection of the event log into tables: order-free, repeatable, never stopped by a bad event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators.ordering import numbered
from chartloom.schemas import EVENT_FIELDS, EVENT_TYPES, HASH, MIME
from chartloom.session import cut

ORDER = ["ts", "device_id", "seq"]


def first_wins(events: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """The first event of each natural key in the merge order."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def pending(events: DataFrame, watermarks: DataFrame, device: str = "device_id", seq: str = "seq") -> DataFrame:
    """Events above their device's watermark (device, applied); a device without one starts at 0."""
    known = watermarks.select(F.col(device).alias("_device"), F.col("applied").alias("_applied"))
    joined = events.join(known, F.col(device) == F.col("_device"), "left")
    return joined.where(F.col(seq) > F.coalesce("_applied", F.lit(0))).select(*events.columns)


def advanced(applied: DataFrame, device: str = "device_id", seq: str = "seq") -> DataFrame:
    """(device, applied): the greatest applied seq of each device."""
    return applied.groupBy(device).agg(F.max(seq).alias("applied"))


def without_tombstones(adds: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Adds whose key has a tombstone anywhere in the log are dropped."""
    return adds.join(tombstones.select(key).distinct(), key, "left_anti")


def before_first(events: DataFrame, stop: Column, device: str, order: list[str]) -> DataFrame:
    """The events of each device before its first one that must wait."""
    at = events.where(stop).groupBy(device).agg(F.min(F.struct(*order)).alias("_stop"))
    joined = events.join(at, device, "left")
    return joined.where(F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))).select(*events.columns)


def objects_with_status(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """``wanted`` (hash) with content and status: ok, missing, poisoned (other bytes) or malformed (no hash)."""
    joined = wanted.join(objects.select(F.col("hash").alias("_hash"), "content"), F.col("hash") == F.col("_hash"), "left").drop("_hash")
    status = F.when(~F.col("hash").rlike(HASH), "malformed").when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("hash"), "poisoned").otherwise("ok")
    return joined.withColumn("status", F.coalesce(status, F.lit("malformed")))


def clean_mime(mime: Column) -> Column:
    """The media type, or that of plain bytes where it hasn't the shape of one."""
    return F.when(mime.rlike(MIME), mime).otherwise("application/octet-stream")


def project(log: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """source_file, document, ocr_result, imaging_instance and deferred from a verified log.

    A document waits for its file, a page for its document and text, an instance
    for its document and file; what can't be resolved is in ``deferred``.  The
    log is three levels deep, so no iteration is needed for a full rebuild.
    """
    of = lambda kind: log.where(F.col("type") == kind)
    gone = of("DocumentDeleted").select("source_file_hash").distinct()
    files = first_wins(of("FileImported").where(F.col("content_hash").rlike(HASH)), ["content_hash"])
    files = files.withColumn("mime_type", clean_mime(F.col("mime_type")))
    have = files.select(F.col("content_hash").alias("source_file_hash"))
    adds = without_tombstones(of("DocumentAdded"), gone, "source_file_hash")
    documents = first_wins(adds.join(have, "source_file_hash", "left_semi"), ["source_file_hash"])
    known = documents.select("source_file_hash")
    pages = of("OcrAdded").withColumn("source_file_hash", F.col("document_ref.source_file_hash"))
    pages = without_tombstones(pages, gone, "source_file_hash")
    texts = objects_with_status(pages.select(F.col("text_hash").alias("hash")).distinct(), objects).withColumnRenamed("hash", "text_hash")
    placed = pages.join(known.withColumn("_known", F.lit(True)), "source_file_hash", "left").join(texts, "text_hash", "left")
    readable = placed.where("_known AND status = 'ok'").withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where("text IS NOT NULL")
    ocr = first_wins(readable.select(*pages.columns, "text"), ["source_file_hash", "page_no"])
    slices = of("ImagingInstanceAdded").withColumn("document_hash", F.col("document_ref.source_file_hash"))
    slices = without_tombstones(slices.withColumnRenamed("source_file_hash", "slice_hash").withColumnRenamed("document_hash", "source_file_hash"), gone, "source_file_hash")
    at = slices.join(known.withColumn("_known", F.lit(True)), "source_file_hash", "left").join(have.withColumnRenamed("source_file_hash", "slice_hash").withColumn("_have", F.lit(True)), "slice_hash", "left")
    placed_slices = at.where("_known AND _have").drop("_known", "_have")
    imaging = first_wins(placed_slices, ["source_file_hash", "slice_hash"])
    study = imaging.groupBy("source_file_hash").agg(F.min_by("study_uid", F.struct(*ORDER)).alias("study_uid"))
    documents = documents.drop("study_uid").join(study, "source_file_hash", "left")
    waiting = lambda df, why: df.select("event_id", "device_id", "seq", "ts", F.lit(why).alias("waits_for"))
    deferred = (
        waiting(adds.join(have, "source_file_hash", "left_anti"), "file")
        .union(waiting(placed.where("_known IS NULL"), "document"))
        .union(waiting(placed.where("_known AND status = 'missing'"), "object"))
        .union(waiting(at.where("_known IS NULL"), "document"))
        .union(waiting(at.where("_known AND _have IS NULL"), "file"))
    )
    return {"source_file": files, "document": documents, "ocr_result": ocr, "imaging_instance": imaging, "deferred": deferred.distinct()}


def ids(documents: DataFrame) -> DataFrame:
    """Numbers documents in replay order, as ``id``; days are counted first, so no task orders them all."""
    return numbered(documents, F.substring("ts", 1, 10), [F.col(c) for c in ORDER], "id")


def hashes_of(log: DataFrame) -> DataFrame:
    """(hash): every file that an event of ``log`` is about, be it a document's or a slice's."""
    every = F.array("content_hash", "source_file_hash", "document_ref.source_file_hash")
    return log.select(F.explode(every).alias("hash")).where("hash IS NOT NULL").distinct()


def about(log: DataFrame, hashes: DataFrame) -> DataFrame:
    """The events of ``log`` that decide the rows of the documents of ``hashes``, and of the studies that have one of them as a slice."""
    document = F.coalesce("document_ref.source_file_hash", "source_file_hash", "content_hash")
    slices = log.where("type = 'ImagingInstanceAdded'").select(F.col("document_ref.source_file_hash").alias("hash"), F.col("source_file_hash").alias("slice"))
    studies = slices.join(hashes.withColumnRenamed("hash", "slice"), "slice", "left_semi").select("hash")
    wanted = hashes.union(studies).distinct()
    files = wanted.union(slices.join(wanted, "hash", "left_semi").select(F.col("slice").alias("hash"))).distinct()
    keyed = log.withColumn("hash", document)
    own = keyed.where("type <> 'FileImported'").join(wanted, "hash", "left_semi")
    return own.unionByName(keyed.where("type = 'FileImported'").join(files, "hash", "left_semi")).drop("hash")


def settle(pending_events: DataFrame, files: DataFrame, documents: DataFrame, objects: DataFrame, gone: DataFrame, watermarks: DataFrame, most_rounds: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applied events, deferred events, watermarks) of one pass over the ``pending_events`` in the merge order.

    ``files`` and ``documents``: (source_file_hash) known before; ``gone``: the
    tombstones of the whole log.  An event whose file, document or text isn't
    there yet stops its device: later events of the device in the merge order
    are left for another pass, and its watermark (device_id, applied) stays below
    it and them, so whatever lies at or below a watermark has been applied.  What a stopped device would have brought stops others in turn, so stops
    are sought again until none moves; each round is distributed.
    """
    order = F.struct(*ORDER)
    known = lambda df, name: df.select(F.col("source_file_hash").alias("_h")).distinct().withColumn(name, F.lit(True))
    texts = objects_with_status(pending_events.where("type = 'OcrAdded'").select(F.col("text_hash").alias("hash")).distinct(), objects).where("status = 'missing'").select(F.col("hash").alias("text_hash"))
    dead = gone.select(F.col("source_file_hash").alias("_h")).distinct().withColumn("_gone", F.lit(True))
    target = F.coalesce("document_ref.source_file_hash", "source_file_hash", "content_hash")
    rows = pending_events.withColumns({"_o": order, "_h": target}).join(dead, "_h", "left").join(known(files, "_file"), "_h", "left").join(known(documents, "_doc"), "_h", "left")
    rows = rows.join(texts.withColumn("_missing", F.lit(True)), "text_hash", "left")
    slice_files = known(files, "_slice").withColumnRenamed("_h", "_s")
    rows = cut(rows.withColumn("_s", F.when(F.col("type") == "ImagingInstanceAdded", F.col("source_file_hash"))).join(slice_files, "_s", "left"))
    stops = cut(rows.limit(0).select("device_id", F.col("_o").alias("_stop")))
    for _ in range(most_rounds):
        live = rows.join(stops, "device_id", "left").where(F.col("_stop").isNull() | (F.col("_o") < F.col("_stop")))
        first_file = live.where((F.col("type") == "FileImported") & F.col("_h").rlike(HASH)).groupBy("_h").agg(F.min("_o").alias("_f"))
        placed = live.join(first_file, "_h", "left").join(first_file.select(F.col("_h").alias("_s"), F.col("_f").alias("_sf")), "_s", "left")
        has_file = F.col("_file") | (F.col("_f") < F.col("_o"))
        first_doc = placed.where((F.col("type") == "DocumentAdded") & F.col("_gone").isNull() & F.coalesce(has_file, F.lit(False))).groupBy("_h").agg(F.min("_o").alias("_d"))
        placed = placed.join(first_doc, "_h", "left")
        has_doc, has_slice = F.col("_doc") | (F.col("_d") < F.col("_o")), F.col("_slice") | (F.col("_sf") < F.col("_o"))
        resolved = (
            F.when(F.col("_gone").isNotNull() | F.col("type").isin("FileImported", "DocumentDeleted", "ExportPerformed", "ShareCreated"), True)
            .when(F.col("type") == "DocumentAdded", F.coalesce(has_file, F.lit(False)))
            .when(F.col("type") == "OcrAdded", F.coalesce(has_doc, F.lit(False)) & F.col("_missing").isNull())
            .otherwise(F.coalesce(has_doc, F.lit(False)) & F.coalesce(has_slice, F.lit(False)))
        )
        found = placed.where(~resolved).groupBy("device_id").agg(F.min("_o").alias("_stop"))
        now = cut(stops.union(found).groupBy("device_id").agg(F.min("_stop").alias("_stop")))
        moved = now.exceptAll(stops).limit(1).count() > 0
        stops = now
        if not moved:
            break
    else:
        raise RuntimeError("the deferrals have not settled")
    both = rows.join(stops, "device_id", "left")
    columns = pending_events.columns
    applied = both.where(F.col("_stop").isNull() | (F.col("_o") < F.col("_stop"))).select(*columns)
    deferred = both.where(F.col("_o") == F.col("_stop")).select(*columns)
    marks = watermarks.select("device_id", "applied").union(advanced(applied)).groupBy("device_id").agg(F.max("applied").alias("applied"))
    caps = both.where(F.col("_o") >= F.col("_stop")).groupBy("device_id").agg((F.min("seq") - 1).alias("_cap"))
    marks = marks.join(caps, "device_id", "full").select("device_id", F.coalesce(F.least(F.coalesce("applied", F.lit(0)), "_cap"), "applied").alias("applied"))
    return applied, deferred, marks


def import_dedup(new: DataFrame, files: DataFrame) -> DataFrame:
    """``new`` (content_hash, ...) with ``deduped``: whether a file of that content is known; only the others make an event."""
    have = files.select("content_hash").distinct().withColumn("_have", F.lit(True))
    return new.join(have, "content_hash", "left").withColumn("deduped", F.coalesce("_have", F.lit(False))).drop("_have")


def event(type: str, rows: DataFrame, fields: dict[str, Column], device: Column, ts: Column, seq: Column) -> DataFrame:
    """One log entry for each row, as the log's columns; fields that the type doesn't have are null."""
    empty = rows.sparkSession.createDataFrame([], EVENT_FIELDS)
    given = {"type": F.lit(type), "device_id": device, "ts": ts, "seq": seq} | {f: fields[f] for f in EVENT_TYPES[type] if f in fields}
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))


def delete_events(documents: DataFrame, wanted: DataFrame, device: str, at: str, first_seq: int) -> DataFrame:
    """A tombstone for each of ``wanted`` (source_file_hash) that is a document; others make none.  Numbered by hash."""
    rows = documents.join(wanted.select("source_file_hash").distinct(), "source_file_hash", "left_semi").select("source_file_hash").distinct()
    placed = numbered(rows, F.substring("source_file_hash", 1, 3), [F.col("source_file_hash")], "_n")
    return event("DocumentDeleted", placed, {"source_file_hash": F.col("source_file_hash"), "deleted_at": F.lit(at)}, F.lit(device), F.lit(at), F.col("_n") + (first_seq - 1))


def export_event(spark: SparkSession, kind: str, sha256: str, record_count: int, device: str, at: str, seq: int, expires: str | None = None) -> DataFrame:
    """The audit entry of an export, or of a share where ``expires`` is given."""
    values = {"at": at, "kind": kind, "record_count": record_count, "sha256": sha256, "expires": expires}
    return event("ShareCreated" if expires else "ExportPerformed", spark.range(1), {k: F.lit(v) for k, v in values.items()}, F.lit(device), F.lit(at), F.lit(seq))


def backfill_events(texts: DataFrame, documents: DataFrame, backend: str, version: str, device: str, at: str, first_seq: int) -> DataFrame:
    """The first page's text of ``texts`` (source_file_hash, text, confidence) for known documents; blank texts make no event.

    The projection keeps a page that is there already.
    """
    clean = texts.withColumn("text", T.trimmed(F.col("text"))).where("text <> ''").join(documents.select("source_file_hash").distinct(), "source_file_hash", "left_semi")
    placed = numbered(clean, F.substring("source_file_hash", 1, 3), [F.col("source_file_hash"), F.col("text")], "_n")
    fields = {
        "document_ref": F.struct("source_file_hash"), "page_no": F.lit(1), "backend": F.lit(backend), "model_version": F.lit(version),
        "text_hash": F.sha2("text", 256), "confidence": F.col("confidence"), "created_at": F.lit(at),
    }
    return event("OcrAdded", placed, fields, F.lit(device), F.lit(at), F.col("_n") + (first_seq - 1))


def events_from_tables(files: DataFrame, documents: DataFrame, pages: DataFrame, device: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, objects, watermarks) that the tables would be replayed from: files, then documents, then pages, each in its own order.

    Texts become objects; the device's watermark is the last number, as the tables
    hold all of it already.
    """
    owned = documents.join(files.select(F.col("content_hash").alias("source_file_hash")), "source_file_hash", "left_semi")
    of = pages.join(owned.select("source_file_hash").distinct(), "source_file_hash", "left_semi")
    of = of.withColumns({"text_hash": F.sha2("text", 256), "document_ref": F.struct("source_file_hash")})
    levels = {"FileImported": files, "DocumentAdded": owned, "OcrAdded": of.drop("source_file_hash")}
    every = None
    for level, (type, rows) in enumerate(levels.items()):
        fields = {f: F.col(f) for f in EVENT_TYPES[type] if f in rows.columns}
        made = event(type, rows, fields, F.lit(device), F.lit(at), F.lit(0)).withColumn("_level", F.lit(level))
        every = made if every is None else every.unionByName(made)
    key = F.coalesce("document_ref.source_file_hash", "source_file_hash", "content_hash")
    every = every.withColumns({"_key": key, "_page": F.coalesce("page_no", F.lit(0))})
    bucket = F.concat(F.col("_level").cast("string"), F.substring("_key", 1, 2))
    log = numbered(every, bucket, [F.col("_level"), F.col("_key"), F.col("_page")], "_seq").withColumn("seq", F.col("_seq").cast("long")).drop("_seq", "_level", "_key", "_page")
    objects = of.groupBy(F.col("text_hash").alias("hash")).agg(F.any_value(F.encode("text", "UTF-8")).alias("content"))
    return log, objects, advanced(log)


def first_slices(imaging: DataFrame, id: str, document: str, slice: str) -> DataFrame:
    """One row, that of the least id, of each slice of a document."""
    return first_wins(imaging, [document, slice], [id]).select(*imaging.columns)
