"""Labelled parts of reports: sections, diagnoses, impressions, and the layout of scanned pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.columns import let

# fixed values: how headers of sections begin, and labels of diagnoses and conclusions
MEDICATION_HEADERS = "出院医嘱 出院带药 带药 用药医嘱 用药 医嘱 Rp".split()
LAB_HEADERS = "检验项目 检验结果 化验 生化检验 检验报告".split()
OTHER_HEADERS = "出院诊断 入院诊断 初步诊断 主要诊断 临床诊断 病理诊断 诊断 影像所见 超声所见 检查所见 诊断意见 印象 结论 主诉 现病史 既往史 住院经过 查体 处理意见 处方 建议 小结".split()
DIAGNOSIS_LABELS = "出院诊断 入院诊断 初步诊断 主要诊断 其他诊断 临床诊断 诊断".split()
IMAGING_FINDINGS, IMAGING_IMPRESSIONS = "影像所见 检查所见 超声所见 所见".split(), "诊断意见 影像诊断 超声提示 影像提示 检查提示 心电图诊断 印象 结论 意见".split()
PATHOLOGY_FINDINGS, PATHOLOGY_IMPRESSIONS = "病理所见 免疫组化 镜下所见 肉眼所见".split(), ["病理诊断"]
# fixed values: what ends a conclusion, modalities with their words and codes, parts of the body, first match counts
END_OF_BLOCK = "建议 报告医师 审核医师 检查医师 记录医师 诊断医师 医师签名 签名 医师: 医师：".split()
MODALITIES = (
    ("MRI", ("磁共振",), ("MRI", "MR")), ("超声", ("超声", "彩超", "B超"), ("US",)), ("钼靶", ("钼靶",), ()), ("PET", (), ("PET",)), ("造影", ("造影",), ()),
    ("内镜", ("胃镜", "肠镜", "内镜"), ()), ("X线", ("X线", "胸片", "平片"), ("DR", "CR")), ("CT", (), ("CT",)),
)
BODY_PARTS = (
    ("头颅", ("头颅", "颅脑", "脑")), ("颈部", ("甲状腺", "颈部")), ("脊柱", ("脊柱", "腰椎", "颈椎")), ("乳腺", ("乳腺",)), ("心脏", ("心脏",)),
    ("盆腔", ("盆腔",)), ("泌尿", ("泌尿", "肾", "膀胱")), ("胸部", ("胸", "肺")), ("腹部", ("腹", "肝", "胆", "胰", "脾")),
)

MARK = r"(?:[0-9]+\s*[.、)）]|[\x{2460}-\x{2473}])"
ITEM = rf"^\s*{MARK}\s*(.+)$"
CODE = r"\s*[(（\[【]\s*([A-Za-z][0-9][0-9A-Za-z.\-]*)\s*[)）\]】]\s*$"


def _label(labels: list[str]) -> str:
    longest = sorted(labels, key=len, reverse=True)
    return rf"^\s*(?:{MARK}|[-•*·])?\s*({'|'.join(longest)})\s*[:：]\s*(.*)$"


def header_kind(line: Column) -> Column:
    """meds, labs or other for a line that begins a section, else null."""
    begins = lambda words: line.rlike(r"^\s*(?:" + "|".join(words) + ")")
    return F.when(begins(MEDICATION_HEADERS), "meds").when(begins(LAB_HEADERS), "labs").when(begins(OTHER_HEADERS), "other")


def in_sections(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with the kind of the section that each stands in; what precedes the first header has none."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header_kind(F.col("line")), ignorenulls=True).over(w))


def _diagnosis(part: Column) -> Column:
    """struct(raw_text, icd_code) of one term; raw_text may be empty."""
    bare = F.when(part.rlike(ITEM), F.regexp_extract(part, ITEM, 1)).otherwise(part)
    code = lambda b: F.regexp_extract(b, CODE, 1)
    name = lambda b: F.regexp_replace(F.regexp_replace(b, CODE, ""), r"^[\s.。、，,;；:：]+|[\s.。、，,;；:：]+$", "")
    return let(bare, lambda b: F.struct(name(b).alias("raw_text"), F.when(code(b) != "", code(b)).alias("icd_code")))


def conditions(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, position, raw_text, section, icd_code): diagnoses after a label and in the numbered block below it.

    A term counts once for each label; the block ends at a line without a number.
    """
    pattern = _label(DIAGNOSIS_LABELS)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_label = F.col("line").rlike(pattern)
    marked = lines.withColumn("_label", is_label).withColumn("_block", F.sum(F.col("_label").cast("int")).over(w))
    inside = Window.partitionBy(key, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.max((~F.col("_label") & ~F.col("line").rlike(ITEM)).cast("int")).over(inside)
    name = F.first(F.when(F.col("_label"), F.regexp_extract("line", pattern, 1)), ignorenulls=True).over(inside)
    kept = marked.where("_block > 0").withColumns({"_broken": breaks, "section": name}).where("_broken = 0")
    inline = F.filter(F.flatten(F.transform(F.split(F.regexp_extract("line", pattern, 2), r"(?:^|\s)[0-9]+\s*[.、)）](?:\s+|$)"), lambda s: F.split(s, "[；;，,、]"))), lambda s: T.trimmed(s) != "")
    parts = F.when(F.col("_label"), inline).otherwise(F.array("line"))
    terms = kept.select(key, "line_no", "section", F.posexplode(F.transform(parts, _diagnosis)).alias("position", "d")).where("d.raw_text <> ''")
    first = terms.groupBy(key, "section", F.col("d.raw_text").alias("raw_text")).agg(F.min_by(F.struct("line_no", "position", "d.icd_code"), F.struct("line_no", "position")).alias("f"))
    return first.select(key, "f.line_no", "f.position", "raw_text", "section", "f.icd_code")


def impressions(lines: DataFrame, key: str, findings: list[str], conclusions: list[str]) -> DataFrame:
    """(key, text): the first conclusion of a report, else its first finding, as written.

    A block is the rest of its label's line and the lines below it, up to the next
    label or the signature; blank lines do not end it.
    """
    pattern = _label(findings + conclusions)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    label = F.regexp_extract("line", pattern, 1)
    marked = lines.withColumn("_is", F.col("line").rlike(pattern)).withColumn("_block", F.sum(F.col("_is").cast("int")).over(w)).where("_block > 0")
    inside = Window.partitionBy(key, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    trimmed = T.trimmed(F.col("line"))
    ended = F.max((~F.col("_is") & trimmed.rlike("^(?:" + "|".join(END_OF_BLOCK) + ")")).cast("int")).over(inside)
    part = F.when(F.col("_is"), T.trimmed(F.regexp_extract("line", pattern, 2))).otherwise(trimmed)
    kept = marked.withColumns({"_ended": ended, "_part": part, "_name": F.when(F.col("_is"), label)}).where("_ended = 0")
    ordered = F.array_sort(F.collect_list(F.when(F.col("_part") != "", F.struct("line_no", "_part"))))
    blocks = kept.groupBy(key, "_block").agg(F.max("_name").alias("_name"), F.array_join(F.transform(ordered, lambda p: p["_part"]), "\n").alias("text")).where("text <> ''")
    best = F.struct(~F.col("_name").isin(conclusions), "_block")
    return blocks.groupBy(key).agg(F.min_by("text", best).alias("text"))


def modality(text: Column) -> Column:
    upper, found = F.upper(text), F.lit(None).cast("string")
    for name, parts, latin in reversed(MODALITIES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        for p in latin:
            hit = hit | upper.contains(p)
        found = F.when(hit, name).otherwise(found)
    return found


def body_part(text: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, parts in reversed(BODY_PARTS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        found = F.when(hit, name).otherwise(found)
    return found


def imaging_group(title: Column, text: Column) -> Column:
    """Body part and modality, by the title before the text; else the title, else a common name."""
    kind, part = F.coalesce(modality(title), modality(text)), F.coalesce(body_part(title), body_part(text))
    named = F.when(T.trimmed(title) != "", T.trimmed(title)).otherwise("影像检查")
    return F.when(kind.isNotNull(), F.concat(F.coalesce(part, F.lit("")), kind)).otherwise(named)


def rebuild_layout(boxes: DataFrame, key: str, width: int = 90, same_row: float = 0.6, block_gap: float = 1.6) -> DataFrame:
    """(key, text): lines of a scanned page set out as rows and columns.

    ``boxes``: key, text, left, top, right, height.  A box joins the row whose first
    box is near enough in height; boxes of a row are padded to their columns; a
    wide gap between rows leaves a blank line.  The fold runs over one page at a time.
    """

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        shown = pdf[pdf["text"].fillna("").str.strip() != ""].sort_values(["top", "left"], kind="stable")
        rows: list[list] = []
        for box in shown.itertuples(index=False):
            if rows and abs(box.top - rows[-1][0].top) <= same_row * max(box.height, rows[-1][0].height):
                rows[-1].append(box)
            else:
                rows.append([box])
        left, span = (shown["left"].min(), shown["right"].max() - shown["left"].min()) if len(shown) else (0.0, 0.0)
        out, last = [], None
        for row in rows:
            top, height = min(b.top for b in row), max(b.height for b in row)
            if last is not None and last[1] > 0 and top - last[0] > block_gap * last[1]:
                out.append("")
            last, line = (top, height), ""
            if len(row) == 1 or span <= 1e-4:
                line = " ".join(b.text for b in row)
            else:
                for b in sorted(row, key=lambda b: b.left):
                    column = int(np.floor((b.left - left) / span * width + 0.5))
                    line = line.ljust(max(column, len(line) + 2)) + b.text if line else b.text
            out.append(line)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "text": ["\n".join(out)]})

    kind = boxes.schema[key].dataType.simpleString()
    return boxes.groupBy(key).applyInPandas(page, f"{key} {kind}, text string")
