"""Content-addressed objects and the ingest of folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators.ordering import numbered
from chartloom.sources import dicom

MOST_BYTES = 200 * 1024 * 1024
SKIPPED = r"(^|/)\.|\.(tmp|part|crdownload)$"


def read_files(spark: SparkSession, folder: str, most_depth: int | None = None, most_files: int | None = None) -> DataFrame:
    """(path, length, content, content_hash, mime_type, left_out) of the files below a folder, without dot files and partial downloads.

    A file over the cap or one that can't be read keeps its row, with a null
    content.  So does one beyond a bound of the caller's, as ``left_out`` says:
    ``depth`` (folders below ``folder``) or ``count`` (files by path).
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(folder).where(~F.lower("path").rlike(SKIPPED))
    root = len([p for p in folder.rstrip("/").split("://")[-1].removeprefix("file:").split("/") if p])
    depth = F.size(F.filter(F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/"), lambda p: p != "")) - 1 - root
    deep = depth > most_depth if most_depth is not None else F.lit(False)
    names = listed.select("path", "length").withColumn("left_out", F.when(deep, "depth"))
    wanted = listed.where(~deep & (F.col("length") <= MOST_BYTES))
    if most_files is not None:
        placed = numbered(names.where("left_out IS NULL"), F.substring("path", 1, len(folder) + 12), [F.col("path")], "_n")
        names = names.where("left_out IS NOT NULL").unionByName(placed.select("path", "length", F.when(F.col("_n") > most_files, "count").alias("left_out")))
        wanted = wanted.join(names.where("left_out IS NULL").select("path"), "path", "left_semi")
    # contents stay where they are read: only the paths of those that could be read are looked up
    read = wanted.select("path", "length", "content", F.sha2("content", 256).alias("content_hash"), F.lit(None).cast("string").alias("left_out"))
    lost = names.join(read.where("content_hash IS NOT NULL").select("path"), "path", "left_anti")
    rest = lost.select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("content_hash"), "left_out")
    rows = read.where("content_hash IS NOT NULL").unionByName(rest)
    return rows.select("path", "length", "content", "content_hash", T.mime_of(F.element_at(F.split("path", "/"), -1)).alias("mime_type"), "left_out")


def objects(files: DataFrame) -> DataFrame:
    """(hash, content): each content once."""
    return files.where("content_hash IS NOT NULL").groupBy(F.col("content_hash").alias("hash")).agg(F.any_value("content").alias("content"))


def ingest(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, content_hash, mime_type, status, text, doc_type, language, dates) for each file.

    status: left_out (beyond a bound of the caller's), failed (over the cap or unreadable), duplicate
    (content known or seen under a lesser path), metadata_only (no text layer) or ingested.
    """
    files = files if "left_out" in files.columns else files.withColumn("left_out", F.lit(None).cast("string"))
    first = files.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("path").alias("_first"))
    rows = files.join(first, "content_hash", "left")
    seen = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("content_hash").distinct().withColumn("_known", F.lit(True)), "content_hash", "left")
        seen = F.coalesce(F.col("_known"), F.lit(False))
    body = F.when(F.col("mime_type") == "text/plain", T.fold_radicals(F.try_validate_utf8(F.col("content").cast("string"))))
    rows = rows.withColumn("text", body)
    status: Column = (
        F.when(F.col("left_out").isNotNull(), "left_out").when((F.col("length") > MOST_BYTES) | F.col("content").isNull(), "failed").when(seen | (F.col("path") != F.col("_first")), "duplicate")
        .when(F.col("text").isNull() | (F.octet_length(T.trimmed(F.col("text"))) < 20), "metadata_only").otherwise("ingested")
    )
    return rows.select("path", "content_hash", "mime_type", status.alias("status"), "text", T.classify(F.col("text")).alias("doc_type"), T.language(F.col("text")).alias("language"), T.date_range(F.col("text")).alias("dates"))


def ingest_texts(captures: DataFrame, known: DataFrame) -> DataFrame:
    """Captures whose text the caller has recognised (name, content, text, confidence) -> one row each with a document's fields.

    ``known``: content_hash, has_document.  status: failed (empty or over the cap),
    deduped (content known with a document), backfilled (known without one), new, or
    stored_no_text, where the text is blank and the name stands for it.
    """
    base = F.element_at(F.split(F.coalesce("name", F.lit("")), "/"), -1)
    name = F.when(base == "", "capture.jpg").when(base.rlike(r".[.][^.]+$"), base).otherwise(F.concat(base, F.lit(".jpg")))
    rows = captures.withColumns({"name": name, "content_hash": F.sha2("content", 256), "text": F.when(T.trimmed(F.col("text")) != "", F.col("text"))})
    have = known.groupBy("content_hash").agg(F.bool_or("has_document").alias("_doc"))
    size = F.octet_length("content")
    status = (
        F.when(F.coalesce(size, F.lit(0)).between(1, MOST_BYTES) == F.lit(False), "failed").when(F.col("_doc"), "deduped").when(F.col("text").isNull(), "stored_no_text")
        .when(F.col("_doc").isNotNull(), "backfilled").otherwise("new")
    )
    about = F.coalesce("text", "name")
    made = rows.join(have, "content_hash", "left").withColumn("status", status)
    mine = F.col("status").isin("new", "backfilled", "stored_no_text")
    return made.select(
        "name", "content_hash", T.mime_of(F.col("name")).alias("mime_type"), "status", F.when(mine, F.col("text")).alias("text"), F.when(mine & F.col("text").isNotNull(), F.col("confidence")).alias("confidence"),
        F.when(mine, T.classify(about)).alias("doc_type"), F.when(mine, T.date_range(about)).alias("dates"), F.when(mine, T.language(F.col("text"))).alias("language"), F.when(mine, T.demographics(F.col("text"))["name"]).alias("detected_name"),
    )


def ingest_all(files: DataFrame, known: DataFrame, studies: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """(path, content_hash, mime_type, status, document, doc_type, title, text, confidence, dates, language) of files of any kind, from ``read_files``.

    ``known``: content_hash, has_document (as a document or a slice of one);
    ``studies``: study_uid, document; ``captures``: path, text, confidence of images and
    PDF that the caller has recognised.  An image study has one document, that of
    its least path or the one it had; its other files are slices of it.

    status: left_out or failed (see ``ingest``; an image header that can't be read, too), deduped
    (content known with a document, or of a lesser path here), instance_attached,
    backfilled (known without a document), new, or stored_no_text.  ``document`` is the
    path or name of the document that a file belongs to, null where it makes none.
    """
    rows = files if "left_out" in files.columns else files.withColumn("left_out", F.lit(None).cast("string"))
    name = F.element_at(F.split("path", "/"), -1)
    first = rows.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("path").alias("_first"))
    have = known.groupBy("content_hash").agg(F.bool_or("has_document").alias("_doc"))
    rows = rows.join(first, "content_hash", "left").join(have, "content_hash", "left")
    early = F.when(F.col("left_out").isNotNull(), "left_out").when(F.col("content").isNull() | (F.col("length") > MOST_BYTES), "failed").when(F.col("_doc") | (F.col("path") != F.col("_first")), "deduped")
    rows = rows.withColumn("_early", early)
    image = F.col("_early").isNull() & (F.col("mime_type") == "application/dicom")
    tags = dicom.headers(rows.where(image))
    placed = dicom.studies(tags, studies).select("path", "document", F.col("title").alias("_title"), F.col("summary").alias("_summary"))
    dates = tags.select("path", T.study_date(F.col("study_date")).cast("date").alias("_day"))
    rows = rows.join(placed, "path", "left").join(dates, "path", "left")
    if captures is not None:
        said = captures.where(T.trimmed(F.col("text")) != "").groupBy("path").agg(F.min_by(F.struct("text", "confidence"), F.struct("text", "confidence")).alias("_said"))
        rows = rows.join(said, "path", "left")
    said = F.col("_said") if captures is not None else F.lit(None).cast("struct<text:string,confidence:double>")
    layer = F.when(F.col("mime_type") == "text/plain", T.fold_radicals(F.try_validate_utf8(F.col("content").cast("string"))))
    slice = image & F.col("document").isNotNull() & (F.col("document") != F.col("path"))
    status = F.when(F.col("_early").isNotNull(), F.col("_early")).when(image & F.col("document").isNull(), "failed").when(slice, "instance_attached")
    text = F.when(image, F.col("_summary")).otherwise(F.coalesce(layer, said["text"]))
    rows = rows.withColumns({"_text": text, "_late": status, "_image": image})
    status = F.coalesce("_late", F.when(F.col("_text").isNull(), "stored_no_text").when(F.col("_doc").isNotNull() & ~F.col("_image"), "backfilled").otherwise("new"))
    rows = rows.withColumn("status", status).withColumn("_own", F.col("status").isin("new", "backfilled", "stored_no_text"))
    about = F.coalesce("_text", name)
    own = lambda c: F.when(F.col("_own"), c)
    dated = F.when(F.col("_image"), F.struct(F.col("_day").alias("start"), F.lit(None).cast("date").alias("end"))).otherwise(T.date_range(about))
    return rows.select(
        "path", "content_hash", "mime_type", "status", F.when(F.col("status") == "instance_attached", F.col("document")).otherwise(own(F.col("path"))).alias("document"),
        own(F.when(F.col("_image"), "imaging_report").otherwise(T.classify(about))).alias("doc_type"), own(F.coalesce("_title", name)).alias("title"), own(F.col("_text")).alias("text"),
        own(F.when(~F.col("_image") & layer.isNull(), said["confidence"])).alias("confidence"), own(dated).alias("dates"), own(F.when(~F.col("_image"), T.language(F.col("_text")))).alias("language"),
    )
