"""Blocks of a report's text for display: laboratory tables, other tables, sections and prescriptions, from numbered lines.

Everything is a window over the lines of one document: runs of lines are islands
(a line's number less its rank), items of a prescription are filled forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.columns import let

# fixed values: words of a table's header, a value, what begins a reference range, marks of a row, lines that end a prescription
HEADER_WORDS = "项目 结果 单位 参考 提示 名称 缩写".split()
NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?$"
RANGE_START = r"^[<>≤≥]|^-$"
HIGH, LOW, NORMAL = "↑|偏高|升高", "↓|偏低|降低|减低", "正常"
FOOTER = r"^(?:医师|药师|审核|备注|Rp\.?|处方)"
ITEM = r"^([0-9]+)\s*[.、)]\s*(.+)"


def _header_words(line: Column) -> Column:
    found = F.lit(0)
    for w in HEADER_WORDS:
        found = found + line.contains(w).cast("int")
    return found


def status(cells: Column) -> Column:
    """high, low, normal or null, by the marks in a text."""
    return F.when(cells.rlike(HIGH), "high").when(cells.rlike(LOW), "low").when(cells.rlike(NORMAL), "normal")


def lab_row(line: Column) -> Column:
    """struct(name, value, unit, range, flag) of a line with a number behind a name and something behind the number, else null."""

    def parts(w: Column) -> Column:
        at = F.array_position(F.transform(w, lambda x: x.rlike(NUMBER)), True).cast("int")
        next = F.get(w, at)
        ranged = next.rlike(RANGE_START) | next.rlike(NUMBER)
        reference = F.array_join(F.slice(w, at + F.when(ranged, 1).otherwise(2), F.size(w)), " ")
        row = F.struct(
            F.array_join(F.slice(w, F.lit(1), at - 1), " ").alias("name"), F.get(w, at - 1).alias("value"), F.when(ranged, "").otherwise(next).alias("unit"),
            reference.alias("range"), status(reference).alias("flag"),
        )
        return F.when((at > 1) & (at < F.size(w)), row)

    return let(F.filter(F.split(T.trimmed(line), r"(?U)\s+"), lambda w: w != ""), parts)


def _runs(lines: DataFrame, key: str, row: Column) -> DataFrame:
    """``lines`` (key, line_no, line) that have a ``row``, numbered by run; one blank line at most parts the rows of a run."""
    w = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("row", row).withColumn("_blank", T.trimmed(F.col("line")) == "")
    # a line breaks a run if it has no row, or is the second blank in a row
    broken = F.when(F.col("row").isNotNull(), 0).when(F.col("_blank") & ~F.coalesce(F.lag("_blank").over(w), F.lit(False)), 0).otherwise(1)
    numbered = marked.withColumn("_break", broken).withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("row IS NOT NULL").drop("_blank", "_break")


def lab_tables(lines: DataFrame, key: str, at_least: int = 3) -> DataFrame:
    """(key, first_line, last_line, header, rows) of the runs of at least three laboratory rows.

    ``header`` is the line of header words, without digits, that stands before the
    run, be it with one blank line between; first_line is then its line.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    trimmed = T.trimmed(F.col("line"))
    titled = lines.withColumn("_head", F.when((_header_words(trimmed) >= 2) & ~trimmed.rlike("[0-9]"), F.struct(F.col("line_no").alias("at"), trimmed.alias("text"))))
    one, two = F.lag("_head", 1).over(w), F.lag("_head", 2).over(w)
    above = titled.withColumn("_above", F.coalesce(one, F.when(F.lag(trimmed == "", 1).over(w), two)))
    rows = _runs(above, key, lab_row(F.col("line"))).groupBy(key, "_run").agg(
        F.min_by("_above", "line_no").alias("_h"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda r: r["row"]).alias("rows"),
    )
    return rows.where(F.size("rows") >= at_least).select(key, F.coalesce("_h.at", "first_line").alias("first_line"), "last_line", F.col("_h.text").alias("header"), "rows")


def cells(line: Column) -> Column:
    """What two or more spaces or a tab part."""
    return F.filter(F.split(T.trimmed(line), r"\s{2,}|\t"), lambda c: c != "")


def tables(lines: DataFrame, key: str, at_least: int = 2) -> DataFrame:
    """(key, first_line, last_line, header, rows, flags) of the runs of at least two rows of three or more cells with a digit, without blank lines between.

    A header has two header words and three cells and stands right before the run.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    split = lines.withColumn("_cells", cells(F.col("line")))
    head = F.when((_header_words(F.col("line")) >= 2) & (F.size("_cells") >= 3), F.struct(F.col("line_no").alias("at"), F.col("_cells").alias("cells")))
    marked = split.withColumn("_is", F.when((F.size("_cells") >= 3) & F.col("line").rlike("[0-9]"), F.col("_cells"))).withColumn("_above", F.lag(head).over(w))
    rows = marked.where("_is IS NOT NULL").withColumn("_run", F.col("line_no") - F.row_number().over(w))
    found = rows.groupBy(key, "_run").agg(
        F.min_by("_above", "line_no").alias("_h"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col("_is").alias("row")))), lambda r: r["row"]).alias("rows"),
    )
    flags = F.transform("rows", lambda r: status(F.array_join(r, " ")))
    return found.where(F.size("rows") >= at_least).select(key, F.coalesce("_h.at", "first_line").alias("first_line"), "last_line", F.col("_h.cells").alias("header"), "rows", flags.alias("flags"))


def section_heads(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, text) of the lines that head a section: all in brackets, or up to 14 characters with a colon at the end."""
    t = T.trimmed(F.col("line"))
    return lines.where(t.rlike(r"^[【\[].+[】\]]$") | ((F.length(t) <= 14) & t.rlike("[:：]$"))).select(key, "line_no", t.alias("text"))


def prescription(lines: DataFrame, key: str) -> DataFrame:
    """(key, intro, meds, footer) of the documents with numbered items; ``meds`` are (name, usage lines).

    Lines before the first item are the intro.  A closing line (doctor, chemist,
    remarks) ends an item; it and what follows, up to the next item, are the footer.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t = T.trimmed(F.col("line"))
    rows = lines.select(key, "line_no", t.alias("text")).where("text <> ''")
    item, closing = F.col("text").rlike(ITEM), F.col("text").rlike(FOOTER)
    kind = F.when(item, "item").when(closing, "closing").otherwise("line")
    rows = rows.withColumn("kind", kind).withColumn("_n", F.sum((F.col("kind") == "item").cast("int")).over(w))
    # the last item or closing line decides whether a line is usage
    rows = rows.withColumn("_last", F.last(F.when(F.col("kind") != "line", F.col("kind")), ignorenulls=True).over(w))
    place = F.when((F.col("kind") == "closing") & F.col("text").rlike(r"^Rp\.?$"), None).when(F.col("_n") == 0, "intro").when(F.col("_last") == "closing", "footer").otherwise("med")
    rows = rows.withColumn("place", place).where("place IS NOT NULL")
    listed = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("line_no", value.alias("v"))))), lambda x: x["v"])
    text = F.col("text")
    meds = rows.where("place = 'med'").groupBy(key, "_n").agg(F.max(F.when(F.col("kind") == "item", F.regexp_extract("text", ITEM, 2))).alias("name"), listed(F.col("kind") == "line", text).alias("usage"))
    meds = meds.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct("name", "usage").alias("m")))), lambda x: x["m"]).alias("meds"))
    rest = rows.groupBy(key).agg(listed(F.col("place") == "intro", text).alias("intro"), listed(F.col("place") == "footer", text).alias("footer"))
    return rest.join(meds, key).select(key, "intro", "meds", "footer")


def report_blocks(lines: DataFrame, key: str) -> DataFrame:
    """(key, place, kind, first_line, last_line, header, rows, flags, text): every line of a report that isn't blank, in exactly one block, in order.

    From the top, a run of three or more laboratory rows (``labtable``; one blank
    line may part them, a header may stand above) comes before a run of two or more
    rows of cells (``table``, its header right above), and that before a heading
    (``section``) or a line of text (``para``).  What a block has taken isn't looked
    at again, be it the beginning of another run: runs from each line on are windows,
    and the choice among them is one pass over those that may be chosen.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    t = T.trimmed(F.col("line"))
    words, own = _header_words(t), F.size("_cells")
    rows = lines.withColumns({"_t": t, "_cells": cells(F.col("line")), "_lab": lab_row(F.col("line"))})
    rows = rows.withColumns({
        "_blank": F.col("_t") == "", "_is_lab": F.col("_lab").isNotNull(), "_lab_head": (words >= 2) & ~t.rlike("[0-9]"), "_head": (words >= 2) & (own >= 3), "_data": (own >= 3) & F.col("line").rlike("[0-9]"),
    })
    # laboratory rows of a run: a line breaks it if it has no row, or is the second blank one
    parts = F.when(F.col("_is_lab"), 0).when(F.col("_blank") & ~F.coalesce(F.lag("_blank").over(w), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("_break", parts).withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = Window.partitionBy(key, "_run").orderBy(F.desc("line_no"))
    left = F.sum(F.col("_is_lab").cast("int")).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col("_is_lab"), F.col("line_no"))).over(Window.partitionBy(key, "_run"))
    rows = rows.withColumn("_l", F.when(F.col("_is_lab"), F.struct(left.alias("n"), last.alias("last")))).drop("_run", "_break")
    # rows of cells of a run: neighbouring lines
    rows = rows.withColumn("_n", F.sum((~F.col("_data")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    beyond = Window.partitionBy(key, "_n", "_data")
    rows = rows.withColumn("_d", F.when(F.col("_data"), F.struct((F.max("line_no").over(beyond) - F.col("line_no") + 1).alias("n"), F.max("line_no").over(beyond).alias("last")))).drop("_n")
    one, two = (lambda c: F.lead(c, 1).over(w)), (lambda c: F.lead(c, 2).over(w))
    lab = F.when(F.col("_lab_head"), F.coalesce(F.when(one("_blank"), two("_l")), one("_l"))).otherwise(F.col("_l"))
    table = F.when(F.col("_head"), one("_d")).otherwise(F.col("_d"))
    kind = F.when(lab["n"] >= 3, F.struct(F.lit("labtable").alias("kind"), lab["last"].alias("last"))).when(table["n"] >= 2, F.struct(F.lit("table").alias("kind"), table["last"].alias("last")))
    rows = rows.withColumn("_c", F.when(~F.col("_blank"), kind)).drop("_l", "_d")

    may = F.array_sort(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct(F.col("line_no").alias("first"), F.col("_c.last").alias("last"), F.col("_c.kind").alias("kind")))))
    item = f"struct<first:{rows.schema['line_no'].dataType.simpleString()},last:{rows.schema['line_no'].dataType.simpleString()},kind:string>"
    begin = F.struct(F.lit(-1).cast(rows.schema["line_no"].dataType).alias("to"), F.array().cast(f"array<{item}>").alias("picked"))
    step = lambda a, c: F.when(c["first"] > a["to"], F.struct(c["last"].alias("to"), F.concat(a["picked"], F.array(c)).alias("picked"))).otherwise(a)
    picked = rows.groupBy(key).agg(may.alias("_may")).select(key, F.explode(F.aggregate("_may", begin, step)["picked"]).alias("_p")).select(key, F.col("_p.first").alias("line_no"), "_p")
    placed = rows.join(picked, [key, "line_no"], "left").withColumn("_p", F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.coalesce(F.col("line_no") <= F.col("_p.last"), F.lit(False))
    heading = F.col("_t").rlike(r"^[【\[].+[】\]]$") | ((F.length("_t") <= 14) & F.col("_t").rlike("[:：]$"))
    placed = placed.where(~F.col("_blank")).withColumns({"first_line": F.when(inside, F.col("_p.first")).otherwise(F.col("line_no")), "kind": F.when(inside, F.col("_p.kind")).when(heading, "section").otherwise("para")})
    at_head = (F.col("line_no") == F.col("first_line")) & F.when(F.col("kind") == "labtable", F.col("_lab_head")).when(F.col("kind") == "table", F.col("_head")).otherwise(F.lit(False))
    lab_cells = F.array("_lab.name", "_lab.value", "_lab.unit", "_lab.range")
    row = F.when(~at_head & (F.col("kind") == "labtable"), F.struct(lab_cells.alias("row"), F.col("_lab.flag").alias("flag"))).when(~at_head & (F.col("kind") == "table"), F.struct(F.col("_cells").alias("row"), status(F.array_join("_cells", " ")).alias("flag")))
    listed = F.array_sort(F.collect_list(F.when(row.isNotNull(), F.struct("line_no", row.alias("r")))))
    found = placed.groupBy(key, "first_line", "kind").agg(
        F.max("line_no").alias("last_line"), F.max(F.when(at_head, F.when(F.col("kind") == "table", F.col("_cells")).otherwise(F.array("_t")))).alias("header"), F.transform(listed, lambda x: x["r"]).alias("_rows"),
        F.max(F.when(F.col("kind") == "section", F.col("_t")).when(F.col("kind") == "para", F.col("line"))).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy("first_line")).cast("long")
    return found.select(key, place.alias("place"), "kind", "first_line", "last_line", "header", F.transform("_rows", lambda r: r["row"]).alias("rows"), F.transform("_rows", lambda r: r["flag"]).alias("flags"), "text")
