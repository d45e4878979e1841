"""Headers of DICOM files as rows, and the title and summary lines made of them.  Pixels are never decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T

# fixed values: tags (group, element) and their columns; kinds of values that have a four-byte length; what modalities are called; labels of the searchable lines below
TAGS = {
    (0x0008, 0x0060): "modality", (0x0008, 0x0020): "study_date", (0x0008, 0x1030): "description", (0x0008, 0x0080): "institution", (0x0010, 0x0010): "patient_name", (0x0018, 0x0015): "body_part",
    (0x0020, 0x000D): "study_uid", (0x0020, 0x000E): "series_uid", (0x0020, 0x0011): "series_number", (0x0020, 0x0013): "instance_number", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0008): "frames",
}
LONG = (b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UN", b"UR", b"UT")
MODALITIES = {"CT": "CT", "MR": "MRI", "US": "超声", "CR": "X线", "DX": "X线", "DR": "X线", "MG": "钼靶", "PT": "PET", "NM": "核医学"}
NUMBERS = ("series_number", "instance_number", "rows", "columns", "frames")
SCHEMA = "path string, " + ", ".join(f"{c} {'int' if c in NUMBERS else 'string'}" for c in TAGS.values()) + ", readable boolean"
END = (0x7FE0, 0x0010)


# fixed values: what a file calls its character set, and the decoders' names
CHARSETS = {"ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk", "ISO 2022 IR 58": "gb2312", "ISO_IR 100": "latin-1", "ISO 2022 IR 87": "iso2022_jp", "ISO_IR 13": "shift_jis", "ISO 2022 IR 149": "euc_kr"}
CHARSET, ITEM_GROUP, UNSTATED = (0x0008, 0x0005), 0xFFFE, 0xFFFFFFFF


def _element(data: bytes, at: int) -> tuple[tuple[int, int], int, int]:
    """(tag, length, place of the value) of the element at ``at``, explicit or implicit; items of sequences have no kind."""
    tag = struct.unpack_from("<HH", data, at)
    kind = data[at + 4 : at + 6]
    if tag[0] != ITEM_GROUP and kind.isalpha() and kind.isupper():
        if kind in LONG:
            return tag, struct.unpack_from("<I", data, at + 8)[0] if at + 12 <= len(data) else 1 << 33, at + 12
        return tag, struct.unpack_from("<H", data, at + 6)[0], at + 8
    return tag, struct.unpack_from("<I", data, at + 4)[0], at + 8


def read_tags(data: bytes) -> dict[str, object] | None:
    """The known tags before the pixels, or None where the file isn't DICOM or a length runs past its end.

    Explicit and implicit little-endian elements.  Sequences are passed over; one of
    unstated length ends at its own delimiter, whatever is nested in it.  Texts are
    decoded by the file's character set (of several the last known one), else as
    UTF-8, else as GB18030.
    """
    if data[128:132] != b"DICM":
        return None
    at, found, depth, charset = 132, {}, 0, None
    while at + 8 <= len(data):
        tag, size, at = _element(data, at)
        if tag[0] == ITEM_GROUP and depth:
            # items of unstated length are entered like their sequence, others passed over
            depth += (1 if size == UNSTATED else 0) if tag[1] == 0xE000 else -1
            at += size if tag[1] == 0xE000 and size != UNSTATED else 0
            continue
        if size == UNSTATED:
            if not depth and tag >= END:
                break
            depth += 1
            continue
        if not depth and tag >= END:
            break
        if at + size > len(data):
            return None
        if not depth and tag == CHARSET:
            names = [n.strip("\x00 ") for n in data[at : at + size].decode("latin-1").split("\\")]
            charset = next((CHARSETS[n] for n in reversed(names) if n in CHARSETS), None)
        elif not depth and (name := TAGS.get(tag)):
            raw = data[at : at + size]
            if name in ("rows", "columns"):
                found[name] = struct.unpack_from("<H", raw)[0] if size >= 2 else None
            else:
                text = _decoded(raw, charset).strip("\x00 ")
                found[name] = (int(text) if text.lstrip("+-").isdigit() else None) if name in NUMBERS else text or None
        at += size
    return found


def _decoded(raw: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8", "gb18030"):
        if name:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
    return raw.decode("utf-8", "replace")


def headers(files: DataFrame) -> DataFrame:
    """``files`` (path, content) -> path, a column for each tag and ``readable``; what is no DICOM file has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_tags(bytes(c)) if c is not None else None for c in pdf["content"]]
            out = pd.DataFrame({c: pd.array([(r or {}).get(c) for r in rows], "Int32" if c in NUMBERS else "string") for c in TAGS.values()})
            yield out.assign(path=pdf["path"].to_numpy(), readable=[r is not None for r in rows])[["path", *TAGS.values(), "readable"]]

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def studies(tags: DataFrame, known: DataFrame) -> DataFrame:
    """(path, study, document, new, title, summary) of readable files: which document each is a slice of.

    ``known``: study_uid and document of the studies that have one.  A new study's
    document is its least path; a file without a study is one of its own.
    """
    rows = tags.where("readable").select("path", "study_uid", F.coalesce("study_uid", "path").alias("study"), title(F.element_at(F.split("path", "/"), -1)).alias("title"), summary().alias("summary"))
    have = known.where("study_uid IS NOT NULL").groupBy(F.col("study_uid").alias("study")).agg(F.min("document").alias("_document"))
    first = rows.groupBy("study").agg(F.min("path").alias("_first"))
    joined = rows.join(first, "study").join(have, "study", "left")
    return joined.select("path", "study", F.coalesce("_document", "_first").alias("document"), F.col("_document").isNull().alias("new"), "title", "summary")


def title(name: Column) -> Column:
    """Modality and body part, else the description, else the modality, else the file's name."""
    return F.coalesce(F.concat("modality", F.lit(" · "), "body_part"), "description", "modality", name)


def summary() -> Column:
    """The searchable lines that stand for a report's text."""
    called = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in MODALITIES.items() for x in p)), F.col("modality")), F.col("modality"))
    line = lambda label, value: F.concat(F.lit(f"{label}:"), value)
    return F.concat_ws(
        "\n", F.lit("DICOM 影像检查"), F.concat(F.lit("检查类型:"), called, F.lit("("), "modality", F.lit(")")), line("检查日期", F.date_format(T.study_date(F.col("study_date")), "yyyy-MM-dd")),
        line("检查部位", F.col("body_part")), line("检查描述", F.col("description")), line("检查机构", F.col("institution")), line("患者", F.col("patient_name")),
    )
