"""The append-only log: JSONL segments, one for each device, chained by hashes."""

from __future__ import annotations

import hashlib
import hmac
import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions.folds import ordered_fold
from chartloom.schemas import EVENT_FIELDS, EVENT_TYPES, GENESIS
from chartloom.session import exists

ENTRY = "segment string, line_no long, line string"


#: Below the folder of the devices' own files: what ``write`` appends, hidden from readers of the former.
APPENDED = "_appended"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every file that has lines of the log; contents aren't read."""
    find = lambda at, names: spark.read.format("binaryFile").option("pathGlobFilter", names).load(at).select("path", "length")
    flat = find(folder, "*.jsonl")
    return flat.unionByName(find(f"{folder}/{APPENDED}/*/*", "*.txt")) if exists(spark, f"{folder}/{APPENDED}") else flat


def read_lines(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(segment, line_no, line) of a log's folder; blank lines are counted and skipped.

    Segments are the *.jsonl files that devices keep, each continued by what
    ``write`` has appended to it.  A file is read in blocks by many tasks: a line's
    number is its place in its block plus the lines of the blocks before, of which
    only the counts are ordered.  With ``known`` (path, length), files that still
    have that length are not read.
    """
    flat, appended = spark.read.option("pathGlobFilter", "*.jsonl"), None
    if known is None:
        flat = flat.text(folder)
        appended = f"{folder}/{APPENDED}" if exists(spark, f"{folder}/{APPENDED}") else None
    else:
        # as many paths as Spark's own listing of these files takes through the driver
        new = [r.path for r in listing(spark, folder).join(known, ["path", "length"], "left_anti").collect()]
        mine = [p for p in new if f"/{APPENDED}/" not in p]
        flat = flat.text(mine) if mine else None
        appended = [p for p in new if f"/{APPENDED}/" in p] or None
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    rows = spark.createDataFrame([], "value string, segment string, first long, file string, block long, place long")
    parts = []
    if flat is not None:
        parts.append(flat.select("value", F.col("_metadata.file_name").alias("segment"), F.lit(0).cast("long").alias("first"), *place))
    if appended is not None:
        parts.append(spark.read.option("basePath", f"{folder}/{APPENDED}").schema("value string, segment string, first long").text(appended).select("value", "segment", "first", *place))
    lines = [_placed(p) for p in parts] or [rows.select("segment", F.col("first").alias("line_no"), F.col("value").alias("line"))]
    return reduce(DataFrame.unionByName, lines).where(F.trim("line") != "")


def _placed(rows: DataFrame) -> DataFrame:
    blocks = rows.groupBy("file", "block").agg(F.min("place").alias("_low"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.join(blocks.select("file", "block", "_low", earlier.alias("_before")), ["file", "block"])
    return joined.select("segment", (F.col("first") + F.col("_before") + F.col("place") - F.col("_low")).alias("line_no"), F.col("value").alias("line"))


def parse(lines: DataFrame) -> DataFrame:
    """The fields of each line that is an event; torn lines and unknown types are left out."""
    parsed = lines.select("segment", "line_no", "line", F.from_json("line", EVENT_FIELDS).alias("e"))
    return parsed.where(F.col("e.type").isin(*EVENT_TYPES) & F.col("e.seq").isNotNull()).select("segment", "line_no", "line", "e.*")


class Number(float):
    """A number with a point or exponent, in the spelling of its line: what was hashed is hashed again, whatever wrote it."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made


def _loads(line: str) -> dict:
    return json.loads(line, parse_float=Number)


def _dumps(value: object) -> str:
    """JSON without spaces, non-ASCII characters as they are."""
    if isinstance(value, Number):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dumps(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dumps, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical(entry: dict) -> bytes:
    """The authenticated bytes: declaration order, nulls written, a missing link read as the genesis."""
    event = {"type": entry["type"]} | {f: entry.get(f) for f in EVENT_TYPES[entry["type"]]}
    body = {"seq": entry["seq"], "ts": entry["ts"], "device_id": entry["device_id"], "prev_hash": entry.get("prev_hash") or GENESIS, "event": event}
    return _dumps(body).encode()


def chain_hash(entry: dict) -> str:
    return hashlib.sha256(canonical(entry)).hexdigest()


def mac_of(entry: dict, key: bytes) -> str:
    return hmac.new(key, canonical(entry), hashlib.sha256).hexdigest()


def _entry(line: str) -> dict | None:
    try:
        entry = _loads(line)
        canonical(entry)
        return entry
    except (ValueError, KeyError, TypeError):
        return None


def _sealed(entry: dict, last: str, key: bytes | None) -> tuple[str, str]:
    """(the line, its chain hash)."""
    entry = entry | {"prev_hash": last}
    entry["mac"] = mac_of(entry, key) if key is not None else None
    return _dumps(entry), chain_hash(entry)


def checked(lines: DataFrame, key: bytes | None = None, ends: DataFrame | None = None) -> DataFrame:
    """``lines`` with status (ok, unreadable, bad_mac or broken_chain) and ``link``, what the next line's link has to be.

    A fold over each segment: an entry that fails is set aside, and the next that
    stands on its own authority is accepted and continues the chain; until then
    the link is null.  ``ends`` (segment, link) has the link behind lines that were
    checked before; other segments begin at the genesis.
    """
    rows = lines.select("segment", "line_no", "line", F.lit(GENESIS).alias("link"))
    if ends is not None:
        before = ends.select("segment", F.struct("link").alias("_end"))
        rows = lines.join(before, "segment", "left").select("segment", "line_no", "line", F.when(F.col("_end").isNotNull(), F.col("_end.link")).otherwise(GENESIS).alias("link"))

    def begin():
        expected: str | None = None
        begun = False

        def status(line: str) -> str:
            nonlocal expected
            entry = _entry(line)
            if entry is None:
                return "unreadable"
            if key is not None and not hmac.compare_digest(str(entry.get("mac")), mac_of(entry, key)):
                expected = None
                return "bad_mac"
            if expected is not None and (entry.get("prev_hash") or GENESIS) != expected:
                expected = None
                return "broken_chain"
            expected = chain_hash(entry)
            return "ok"

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal expected, begun
            if not begun:
                expected, begun = pdf["link"][0] if isinstance(pdf["link"][0], str) else None, True
            found = [(status(x), expected) for x in pdf["line"]]
            return pdf.assign(status=[s for s, _ in found], link=[e for _, e in found])

        return step

    return ordered_fold(rows, "segment", ["line_no"], begin, f"{ENTRY}, link string, status string")


def verify(lines: DataFrame, key: bytes | None = None) -> DataFrame:
    """``lines`` with status: ok, unreadable, bad_mac or broken_chain."""
    return checked(lines, key).select("segment", "line_no", "line", "status")


def _resealed(lines: DataFrame, key: bytes | None) -> DataFrame:
    def begin():
        last = GENESIS

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal last
            out = []
            for number, line in zip(pdf["line_no"], pdf["line"], strict=True):
                if (entry := _entry(line)) is not None:
                    text, last = _sealed(entry, last, key)
                    out.append((pdf["segment"][0], number, text))
            return pd.DataFrame(out, columns=["segment", "line_no", "line"])

        return step

    return ordered_fold(lines.select("segment", "line_no", "line"), "segment", ["line_no"], begin, ENTRY)


def seal(lines: DataFrame, key: bytes | None = None) -> DataFrame:
    """Lines with a chain from the genesis and, given a key, a mac; unreadable lines are dropped."""
    return _resealed(lines, key)


def append(lines: DataFrame, new: DataFrame, key: bytes | None = None) -> DataFrame:
    """The sealed lines of ``new`` (segment, line_no, line: entries in their order), to be written behind ``lines``.

    The first is chained to the last readable entry of its segment, or begins at
    the genesis; line numbers go on behind the segment's last.
    """
    some = lines.join(new.select("segment").distinct(), "segment", "left_semi")
    readable = F.get_json_object("line", "$.type").isin(*EVENT_TYPES) & F.get_json_object("line", "$.seq").isNotNull()
    ends = some.groupBy("segment").agg(F.max("line_no").alias("end"), F.max_by("line", F.when(readable, F.col("line_no"))).alias("tail"))
    rows = new.join(ends, "segment", "left").select("segment", "line_no", "line", F.coalesce("end", F.lit(-1)).alias("end"), "tail")

    def begin():
        last, n = None, 0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal last, n
            if last is None:
                tail = _entry(pdf["tail"][0]) if isinstance(pdf["tail"][0], str) else None
                last = chain_hash(tail) if tail else GENESIS
            out = []
            for line, end in zip(pdf["line"], pdf["end"], strict=True):
                if (entry := _entry(line)) is not None:
                    text, last = _sealed(entry, last, key)
                    n += 1
                    out.append((pdf["segment"][0], int(end) + n, text))
            return pd.DataFrame(out, columns=["segment", "line_no", "line"])

        return step

    return ordered_fold(rows, "segment", ["line_no"], begin, ENTRY)


def write(lines: DataFrame, folder: str) -> None:
    """Append sealed lines to the log of a folder, a file for each segment in a folder of its name and first line number.

    ``read_lines`` takes that file for the segment's lines from that number on.
    The commit is Spark's: a task that runs twice leaves one file, and the same
    lines written again replace themselves.
    """
    known = lines.select(F.coalesce("segment", F.lit("")).alias("segment"), "line_no", F.col("line").alias("value"))
    firsts = known.groupBy("segment").agg(F.min("line_no").alias("first"))
    ordered = known.join(firsts, "segment").repartition("segment").sortWithinPartitions("segment", "first", "line_no")
    # a column that can't be null keeps this order: the writer would sort by another expression else
    rows = ordered.select("value", "segment", "first")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "first").text(f"{folder}/{APPENDED}")


def migrate(lines: DataFrame, key: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """(sealed lines of the segments that need it, segments with status: sealed, kept or aborted).

    A segment needs sealing where an entry lacks its link, or its mac while there
    is a key.  Its torn last line is dropped, as it was never a whole append; a
    torn line before that aborts the segment, which then stays as it is.
    """
    field = lambda name: F.get_json_object("line", f"$.{name}")
    torn = ~(field("type").isin(*EVENT_TYPES) & field("seq").isNotNull() & field("ts").isNotNull() & field("device_id").isNotNull())
    bare = field("prev_hash").isNull() | (field("mac").isNull() if key is not None else F.lit(False))
    facts = lines.select("segment", "line_no", F.coalesce(torn, F.lit(True)).alias("torn"), bare.alias("bare")).groupBy("segment")
    facts = facts.agg(F.max("line_no").alias("end"), F.min(F.when(F.col("torn"), F.col("line_no"))).alias("first_torn"), F.bool_or(~F.col("torn") & F.col("bare")).alias("needs"))
    status = F.when(F.col("first_torn") < F.col("end"), "aborted").when(F.col("needs"), "sealed").otherwise("kept")
    segments = facts.select("segment", status.alias("status"))
    return _resealed(lines.join(segments.where("status = 'sealed'"), "segment", "left_semi"), key), segments


def next_seq(log: DataFrame) -> DataFrame:
    """(next_seq): one more than the greatest number in the whole log."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def event_id(entry: dict) -> str:
    event = {"type": entry["type"]} | {f: entry.get(f) for f in EVENT_TYPES[entry["type"]]}
    return hashlib.sha256(_dumps(event).encode()).hexdigest()
