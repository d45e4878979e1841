"""Observations from the lines of reports: laboratory rows, medications, allergies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.columns import let

# fixed values: the shape of a laboratory row, numbers, ranges, list marks, doses, usage lines and routes
ROW = r"^\s*(.*?)[\s:：]+(-?[0-9]+(?:\.[0-9]+)?)\s*(.*)$"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
BOTH, HIGH, LOW = rf"({NUMBER})\s*[-~]\s*({NUMBER})", rf"[<≤]=?\s*({NUMBER})", rf"[>≥]=?\s*({NUMBER})"
SENTENCE = "[，,。；;、]"
MARKER = r"^\s*(?:[0-9]+\s*[.、)）]|[\x{2460}-\x{2473}]|[-•*·])\s*"
DOSE = rf"(?i)({NUMBER})\s*(µg|μg|mcg|mg|iu|ml|ug|单位|g|u|片|粒|袋|支|丸|滴)(?![/A-Za-z])"
USAGE = "^(用法|用量|一次|每次|服法|Sig|sig)"
ROUTES = "口服 po 静滴 静脉滴注 静脉注射 静推 iv 皮下 sc 肌注 im 外用 含服 舌下 鼻饲".split()


def _group(text: Column, pattern: str, i: int) -> Column:
    found = F.regexp_extract(text, pattern, i)
    return F.when(found != "", found)


def reference_range(rest: Column) -> Column:
    """struct(low, high, whole): a two-sided range anywhere, else an upper, else a lower bound."""
    number = lambda p, i: _group(rest, p, i).cast("double")
    none = F.lit(None).cast("double")
    make = lambda low, high, p: F.struct(low.alias("low"), high.alias("high"), F.regexp_extract(rest, p, 0).alias("whole"))
    return F.when(rest.rlike(BOTH), make(number(BOTH, 1), number(BOTH, 2), BOTH)).when(rest.rlike(HIGH), make(none, number(HIGH, 1), HIGH)).when(rest.rlike(LOW), make(number(LOW, 1), none, LOW))


def lab_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, raw_name, value, unit, ref_low, ref_high, flag, has_evidence) of each line that has a name and a number.

    Dates in the trailing columns are blanked before a range is looked for; an
    explicit mark is the flag, else the value against its range.
    """
    rest = F.regexp_replace(F.translate(F.regexp_extract("line", ROW, 3), "～－—−＜＞", "~---<>"), r"[0-9]{2,4}-[0-9]{1,2}-[0-9]{1,2}", " ")
    rows = lines.where(F.col("line").rlike(ROW)).select(key, "line_no", T.trimmed(F.regexp_extract("line", ROW, 1)).alias("raw_name"), F.regexp_extract("line", ROW, 2).cast("double").alias("value"), rest.alias("rest"))
    rows = rows.where(F.col("raw_name").rlike(r"\p{L}") & ~F.col("raw_name").rlike(SENTENCE)).withColumn("range", reference_range(F.col("rest")))
    # the text before and after the range, without the range's own digits
    at = F.instr("rest", F.col("range.whole"))
    left = F.when(F.col("range").isNull(), F.col("rest")).otherwise(F.concat(F.substring("rest", F.lit(1), at - 1), F.lit(" "), F.substring("rest", at + F.length("range.whole"), F.length("rest"))))
    words = F.filter(F.split(left, r"(?U)\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^[()（）\[\]【】]+|[()（）\[\]【】]+$", "")
    up = lambda w: w.contains("↑") | bare(w).isin("H", "高", "偏高")
    down = lambda w: ~up(w) & (w.contains("↓") | bare(w).isin("L", "低", "偏低"))
    rows = rows.withColumn("words", words)
    marks = F.filter("words", lambda w: (bare(w) != "") & (up(w) | down(w)))
    marked = F.when(F.size(marks) > 0, F.when(up(F.element_at(marks, -1)), "H").otherwise("L"))
    units = F.filter("words", lambda w: ~up(w) & ~down(w) & ~bare(w).rlike("参考|范围|正常") & bare(w).rlike("[A-Za-z%/°]"))
    compared = F.when(F.col("value") > F.col("range.high"), "H").when(F.col("value") < F.col("range.low"), "L").when(F.col("range").isNotNull(), "N")
    rows = rows.select(key, "line_no", "raw_name", "value", bare(F.get(units, 0)).alias("unit"), F.col("range.low").alias("ref_low"), F.col("range.high").alias("ref_high"), marked.alias("_mark"), compared.alias("_compared"))
    evidence = F.col("unit").isNotNull() | F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull() | F.col("_mark").isNotNull()
    return rows.select(key, "line_no", "raw_name", "value", "unit", "ref_low", "ref_high", F.coalesce("_mark", "_compared").alias("flag"), evidence.alias("has_evidence"))


def medication_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, raw_name, dose, dose_unit, frequency, has_evidence): the name is what stands before the dose and the frequency.

    A line is parsed once, into a struct that a generator hands on: as plain
    columns its steps would be copied into each condition.
    """
    peel = rf"(?i)(?:[\s,，、:：(（]|{'|'.join(ROUTES)})+$"

    def named(x: Column) -> Column:
        at = F.least(x["dose_at"], x["f"]["at"])
        name = F.when(at.isNull(), x["line"]).otherwise(F.substring(x["line"], F.lit(1), at - 1))
        return F.struct(x["line"].alias("line"), T.trimmed(F.regexp_replace(name, peel, "")).alias("raw_name"), x["dose_at"].alias("dose_at"), x["f"]["code"].alias("frequency"))

    def parsed(line: Column) -> Column:
        codes = F.array(*(F.struct(F.lit(code).alias("code"), F.regexp_instr(line, F.lit(p)).alias("at")) for code, p in T.FREQUENCIES))
        dose = F.regexp_instr(line, F.lit(DOSE))
        first = F.get(F.filter(codes, lambda c: c["at"] > 0), 0)
        return let(F.struct(line.alias("line"), F.when(dose > 0, dose).alias("dose_at"), first.alias("f")), named)

    usable = lambda m: (m["line"] != "") & m["raw_name"].rlike(r"\p{L}") & ~m["raw_name"].rlike("[，,。；;、：:]") & ~m["raw_name"].rlike(USAGE)
    line = T.trimmed(F.regexp_replace("line", MARKER, ""))
    rows = lines.select(key, "line_no", F.explode(F.filter(F.array(let(line, parsed)), usable)).alias("m"))
    return rows.select(
        key, "line_no", "m.raw_name", _group(F.col("m.line"), DOSE, 1).cast("double").alias("dose"), T.dose_unit(_group(F.col("m.line"), DOSE, 2)).alias("dose_unit"),
        "m.frequency", (F.col("m.dose_at").isNotNull() | F.col("m.frequency").isNotNull()).alias("has_evidence"),
    )


def allergies(lines: DataFrame, key: str) -> DataFrame:
    """(key, substance, reaction), each once; denials are left out."""
    label = r"^\s*(?:药物)?过敏史?\s*[:：]\s*(.+)$"
    rest = lines.where(F.col("line").rlike(label)).select(key, F.explode(F.split(F.regexp_extract("line", label, 1), "[、，,；;。]")).alias("item"))
    item = T.trimmed(F.col("item"))
    kept = rest.where((item != "") & ~item.rlike("^(无|否认|不详)"))
    substance, reaction = F.regexp_extract(item, r"^([^(（]+)", 1), _group(item, r"[(（]([^)）]+)[)）]", 1)
    return kept.select(key, T.trimmed(substance).alias("substance"), reaction.alias("reaction")).distinct()
