"""Fill-in-middle transformation by big-integer bit-parallelism.

A text's UTF-8 bytes become class masks (``bytes.translate``, one bit a byte), in
which shifted boolean operations mark where units begin; ``bit_count`` gives
their number, and the byte at which the k-th begins is found by halving the mask.
So a text is never split into characters or words, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.base import fresh, small

CONTINUATION = bytes(b"01"[b & 0xC0 == 0x80] for b in range(256))
SPACE = bytes(b"01"[b in b" \t\n\x0b\x0c\r"] for b in range(256))
NEWLINE = bytes(b"01"[b == 0x0A] for b in range(256))
#: Bytes of output after which a batch is handed on.
FLUSH = 1 << 22
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
TYPES = "n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass(frozen=True)
class Plan:
    """How texts are cut: the seed of a row's numbers, the shares of the forms in hundredths, the marks and the unit."""

    seed: str = "1"
    plain_from: int = 90
    spm_below: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "character"

    def __post_init__(self):
        if self.unit not in ("character", "word", "line"):
            raise ValueError("a unit is a character, word or line")


def mask(text: bytes, classes: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(text.translate(classes)[::-1] or b"0", 2)


def starts(text: bytes, unit: str) -> int:
    """Bit i is set if a unit begins at byte i; what stands before the first one belongs to it."""
    every = (1 << len(text)) - 1
    if unit == "character":
        return every & ~mask(text, CONTINUATION)
    if unit == "word":
        space = mask(text, SPACE)
        return every & ~space & (space << 1 | 1)
    return every & (mask(text, NEWLINE) << 1 | 1)


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit number ``rank`` (from 0) among the ``width`` lowest bits, by halving them."""
    at = 0
    while width > 64:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    for _ in range(rank):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def transform_text(text: bytes, key: bytes, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text; ``key`` names the row."""
    hexes = hashlib.sha256(plan.seed.encode() + b":" + key).hexdigest()
    h1, h2, h3, h4 = (int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24))
    bits = starts(text, plan.unit)
    n = bits.bit_count()
    marks = [m.encode() for m in (plan.prefix, plan.suffix, plan.middle)]
    if not text or h3 % 100 >= plan.plain_from or any(m in text for m in marks):
        return n, "plain", None, None, text
    place = lambda k: 0 if k == 0 else len(text) if k == n else select(bits, k, len(text))
    one, two = place(min(h1 % (n + 1), h2 % (n + 1))), place(max(h1 % (n + 1), h2 % (n + 1)))
    leads = bits if plan.unit == "character" else starts(text, "character")
    before = (leads & ((1 << one) - 1)).bit_count()
    inside = (leads >> one & ((1 << (two - one)) - 1)).bit_count()
    a, b, c = text[:one], text[one:two], text[two:]
    form = "spm" if h4 % 100 < plan.spm_below else "psm"
    first, second = (marks[0] + a, marks[1] + c) if form == "psm" else (marks[1] + c, marks[0] + a)
    return n, form, before, inside, first + second + marks[2] + b


def transform(documents: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to each row of ``documents`` (doc_id, text, ...).

    A row's cuts follow from the plan's seed and its doc_id (null: empty), so
    repeated rows are cut alike.  Null texts are empty; an empty text, or one that
    contains a mark, is plain, which leaves the text as it is and the lengths
    null.  Texts are cut whole, whatever their length; an empty table gives no
    rows.  Columns of the input with a name of the result are replaced, all
    others come back as they are.
    """
    plan = plan or Plan()
    own = [c for c in documents.columns if c.lower() not in ADDED]
    key, text = fresh([*own, *ADDED], "key", "bytes")
    rows = documents.select(*(F.col(f"`{c}`") for c in own), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias(text))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, texts = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1)
            first, size, made = 0, 0, []
            for i in range(len(batch)):
                made.append(transform_text(texts[i].as_py(), keys[i].encode(), plan))
                size += len(made[-1][4])
                if size > FLUSH or i == len(batch) - 1:
                    new = [pa.array(column, kind) for column, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(made)) for c in batch.columns[: len(own)]), *new], [*own, *ADDED])
                    first, size, made = i + 1, 0, []

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(own)])
    return rows.mapInArrow(run, f"{kept}, {TYPES}").withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, plan: Plan | None = None) -> Column:
    """The text that an output of this form was made from."""
    plan = plan or Plan()
    marks = "|".join(rf"\Q{m}\E" for m in (plan.prefix, plan.suffix, plan.middle))
    if len({plan.prefix, plan.suffix, plan.middle}) < 3 or re.search(r"\\E", marks.replace(r"\E|", "").removesuffix(r"\E")):
        raise ValueError("marks differ and don't contain \\E")
    parts = F.split(output, marks, -1)
    a, c = (F.get(parts, F.when(form == "psm", F.lit(x)).otherwise(F.lit(y))) for x, y in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(a, F.get(parts, F.lit(3)), c))


def restore(transformed: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The rows of ``transform`` with ``text`` rebuilt from ``output`` and ``form`` alone."""
    return transformed.withColumn("text", restored(F.col("output"), F.col("form"), plan))


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the contract of op12 fixes."""
    cut = transform(documents.select("doc_id", "text")).drop("text")
    return restore(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


ORACLE = """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    r AS (
        SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS k2,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM d),
    p AS (SELECT *, t[1:least(k1, k2)] AS a, t[least(k1, k2) + 1:greatest(k1, k2)] AS b, t[greatest(k1, k2) + 1:] AS c FROM r)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(k1, k2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(k1, k2) - least(k1, k2) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p"""
