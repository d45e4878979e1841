"""What leaves a record: the share's payload, the QR payload, the audit list as CSV and the timeline as HTML parts."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from chartloom.functions import text as T
from chartloom.functions.folds import ordered_fold
from chartloom.operators import clinical, records

#: What encryption authenticates besides the text, so that one kind of payload is never read as the other.
SHARE_AAD, QR_AAD = "chartloom share 1", "chartloom code 1"
# fixed values: caps of a share in bytes, bytes of a QR code
STUDY_CAP, TOTAL_CAP = 40 * 1024 * 1024, 300 * 1024 * 1024
QR_CAPACITY = 2331
PARTS = ["problems", "notable_changes", "imaging", "pathology", "allergies"]
AUDIT_COLUMNS = ("seq", "timestamp", "device_id", "action", "detail", "sha256")


def date_text(start: Column, end: Column) -> Column:
    """A day, two days with an arrow, or 无日期."""
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    both = end.isNotNull() & (day(start) != day(end))
    return F.when(start.isNull(), "无日期").when(both, F.concat(day(start), F.lit(" → "), day(end))).otherwise(day(start))


def embedded(sources: DataFrame, group: str, study_cap: int = STUDY_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """(group, place, tier) of what a share's records could carry: ``sources`` has group, place, kind (image, pdf or study) and bytes.

    In the order of places a photo is always carried, a PDF while the total allows
    it and a study while the total and its own cap do; what is left out adds
    nothing to the total.  tier: full, or text (a PDF left out), large (a study over
    its cap) or total (one that the total has no room for).
    """

    def begin():
        total = 0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal total
            tiers = []
            for kind, n in zip(pdf["kind"], pdf["bytes"].tolist(), strict=True):
                room = total + n <= total_cap
                tier = "full" if kind == "image" or room and (kind == "pdf" or n <= study_cap) else "text" if kind == "pdf" else "large" if n > study_cap else "total"
                total += int(n) if tier == "full" else 0
                tiers.append(tier)
            return pdf[[group, "place"]].assign(tier=tiers)

        return step

    rows = sources.select(group, "place", "kind", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    return ordered_fold(rows, group, ["place"], begin, f"{group} {rows.schema[group].dataType.simpleString()}, place {rows.schema['place'].dataType.simpleString()}, tier string")


def payloads(patients: DataFrame, rows: DataFrame, summary: DataFrame | None, group: str, expires: Column) -> DataFrame:
    """(group, payload, record_count): JSON of the patient, the records in order and, if it has content, the summary.

    ``rows``: group, place, title, doc_type, date, date_end, text, and where they
    carry originals tier (see ``embedded``) and slices; ``patients``: one row for each
    group.  The titles of studies that aren't carried whole are listed as ``degraded``.
    """
    fields = ["title", records.label(F.col("doc_type")).alias("type"), date_text(F.col("date"), F.col("date_end")).alias("date"), "text"]
    if "tier" in rows.columns:
        rows = rows.withColumn("_mb", F.floor(F.coalesce("bytes", F.lit(0)) / 1048576))
        note = F.when(F.col("tier") == "large", F.concat(F.lit("影像约 "), F.col("_mb"), F.lit(" MB,超出单项上限,仅附文字"))).when(F.col("tier") == "total", "分享总量已满,此影像仅附文字")
        fields += ["tier", "slices", note.alias("note")]
    record = F.struct(*fields)
    left_out = F.filter(F.array_sort(F.collect_list(F.when(F.col("tier").isin("large", "total"), F.struct("place", "title")))), lambda x: x.isNotNull()) if "tier" in rows.columns else F.array()
    listed = rows.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", record.alias("r")))), lambda x: x["r"]).alias("records"), F.count("*").alias("record_count"),
        (F.transform(left_out, lambda x: x["title"]) if "tier" in rows.columns else F.array().cast("array<string>")).alias("degraded"),
    )
    whole = patients.join(listed, group)
    fields = [F.struct(*(c for c in patients.columns if c != group)).alias("patient"), expires.cast("string").alias("expires"), F.col("records")]
    if "tier" in rows.columns:
        fields.append(F.col("degraded"))
    if summary is not None:
        whole = whole.join(summary.select(group, F.struct(*(c for c in summary.columns if c != group)).alias("_summary")), group, "left")
        have = [p for p in PARTS if p in summary.columns]
        fields.append(F.when(clinical.has_content(F.col("_summary"), have), F.col("_summary")).alias("summary"))
    return whole.select(group, F.to_json(F.struct(*fields)).alias("payload"), "record_count")


def with_originals(rows: DataFrame, sources: DataFrame, objects: DataFrame, group: str, study_cap: int = STUDY_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """``rows`` (group, place, ...) with bytes, tier and slices: the addresses under which their originals are carried.

    ``sources``: group, place, kind, slice (its place in the stack), hash and bytes
    of each original.  Sizes alone decide the tiers; contents are then read for
    those that are carried whole, and only named in ``slices`` by their hash, each
    content once in ``parts``.
    """
    sizes = sources.groupBy(group, "place").agg(F.first("kind").alias("kind"), F.sum("bytes").alias("bytes"))
    tiers = embedded(sizes, group, study_cap, total_cap).join(sizes.drop("kind"), [group, "place"])
    listed = sources.join(objects.select("hash"), "hash", "left_semi").groupBy(group, "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "hash"))), lambda s: s["hash"]).alias("slices"))
    found = tiers.join(listed, [group, "place"], "left").withColumn("slices", F.when(F.col("tier") == "full", F.coalesce("slices", F.array().cast("array<string>"))))
    return rows.join(found, [group, "place"], "left")


def parts(rows: DataFrame, objects: DataFrame, group: str, size: int = 1 << 20) -> DataFrame:
    """(group, hash, part, bytes): the contents that ``rows`` carry, in parts of ``size`` bytes, each content of a group once."""
    wanted = rows.where("slices IS NOT NULL").select(group, F.explode("slices").alias("hash")).distinct()
    n = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("part"), F.substring("content", i * size + 1, F.lit(size)).alias("bytes")))
    return wanted.join(objects, "hash").select(group, "hash", F.inline(cut))


def encrypted(payload: Column, key: Column, aad: str = SHARE_AAD) -> Column:
    """Base64 of nonce, ciphertext and tag by AES-GCM; ``key`` is 32 bytes."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(aad)))


def decrypted(blob: Column, key: Column, aad: str = SHARE_AAD) -> Column:
    """The payload, or null where the key or the kind of payload is another."""
    return F.try_aes_decrypt(F.unbase64(blob), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string")


def url_safe(data: Column) -> Column:
    """Base64 for addresses, without padding and line ends."""
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), r"[=\s]", "")


def grouped_passphrase(text: Column) -> Column:
    """Groups of four characters with spaces between."""
    return F.array_join(F.regexp_extract_all(text, F.lit("(?s).{1,4}"), 0), " ")


def escaped(text: Column) -> Column:
    """The five characters that HTML sets apart, as entities."""
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


@F.pandas_udf(BinaryType())
def gzipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))


def qr_fragments(trimmed: DataFrame, group: str, key: Column, prefix: str = "", patients: DataFrame | None = None, generated: str = "") -> DataFrame:
    """(group, fragment, cipher_len, problem_count, fits): ``q1.``, the gzipped and encrypted summary and its key; whether an address with it fits a QR code.

    The payload says its version, kind and time and has the group's row of
    ``patients`` as its head.
    """
    summary = F.struct(*(c for c in trimmed.columns if c != group)).alias("summary")
    head = F.lit(None).cast("string")
    if patients is not None:
        trimmed = trimmed.join(patients.select(group, F.struct(*(c for c in patients.columns if c != group)).alias("_head")), group, "left")
        head = F.col("_head")
    n = F.coalesce(F.size("problems"), F.lit(0)) if "problems" in trimmed.columns else F.lit(0)
    payload = F.to_json(F.struct(F.lit(1).alias("v"), F.lit("summary").alias("kind"), F.lit(generated).alias("generated"), head.alias("patient"), summary))
    packed = trimmed.select(group, gzipped(payload).alias("_zip"), key.alias("_key"), F.greatest(n, F.lit(0)).cast("long").alias("problem_count"))
    sealed = packed.withColumn("_c", F.aes_encrypt(F.col("_zip"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(QR_AAD)))
    fragment = F.concat(F.lit("q1."), url_safe(F.col("_c")), F.lit("."), url_safe(F.col("_key")))
    return sealed.select(group, fragment.alias("fragment"), F.octet_length("_c").alias("cipher_len"), "problem_count").withColumn("fits", F.length("fragment") + len(prefix) + 1 <= QR_CAPACITY)


def audit_rows(log: DataFrame) -> DataFrame:
    """The audited events as the columns of the list, nulls as empty text."""
    found = records.audit(log).withColumnRenamed("ts", "timestamp")
    return found.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in AUDIT_COLUMNS))


def write_audit_csv(log: DataFrame, folder: str) -> None:
    """The list, newest first, in one range-sorted file after another; all fields quoted, quotes doubled."""
    newest = records.audit(log).orderBy(F.desc("ts"), F.desc("device_id"), F.desc("seq")).withColumnRenamed("ts", "timestamp")
    rows = newest.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in AUDIT_COLUMNS))
    rows.write.csv(folder, header=True, quoteAll=True, escape='"', emptyValue="")


def html_sections(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``rows`` within the range with ``html``: each record's head, file line and text, all escaped.

    ``rows``: title, doc_type, date, date_end, original_name, mime_type, text.
    """
    t = lambda c: escaped(F.coalesce(F.col(c), F.lit("")))
    head = F.concat(
        F.lit("<article>\n<header>\n<h3>"), escaped(F.coalesce("title", "original_name")), F.lit("</h3>\n<p>"), records.label(F.col("doc_type")), F.lit(" · "), date_text(F.col("date"), F.col("date_end")),
        F.lit("</p>\n<p><small>"), t("original_name"), F.lit(" · "), t("mime_type"), F.lit("</small></p>\n</header>\n"),
    )
    note = F.when(F.col("mime_type") == "application/pdf", "<p><em>此记录为 PDF,本页不含其页面图像</em></p>\n").otherwise("")
    body = F.when(T.trimmed(F.coalesce("text", F.lit(""))) != "", F.concat(F.lit("<pre>"), t("text"), F.lit("</pre>\n"))).otherwise(note)
    return records.in_range(rows, "date", start, end).withColumn("html", F.concat(head, body, F.lit("</article>\n")))
