import datetime

import pytest
from pyspark.sql import functions as F

from chartloom.functions import sections
from chartloom.operators import records, summary

D = datetime.date


def lines(spark, text):
    return records.line_rows(spark.createDataFrame([(1, text)], "doc int, text string"), "doc")


def test_conditions(spark):
    text = "出院诊断:1. 急性脑梗死 2. 高血压3级 3. 2型糖尿病(E11.9)\n其它\n诊断：\n1、慢性胃炎[K29.5]\n2、慢性胃炎\n\n3、不算\n甲状腺结节 1.2cm"
    got = [(r.raw_text, r.section, r.icd_code) for r in sections.conditions(lines(spark, text), "doc").orderBy("line_no", "position").collect()]
    assert got == [("急性脑梗死", "出院诊断", None), ("高血压3级", "出院诊断", None), ("2型糖尿病", "出院诊断", "E11.9"), ("慢性胃炎", "诊断", "K29.5")]


def test_sections_run_to_the_next_header(spark):
    text = "前言\n出院带药\n二甲双胍 0.5g\n化验\n血糖 6\n建议\n复查"
    got = [r.section for r in sections.in_sections(lines(spark, text), "doc").orderBy("line_no").collect()]
    assert got == [None, "meds", "meds", "labs", "labs", "other", "other"]


def test_a_conclusion_wins_and_blank_lines_do_not_end_it(spark):
    text = "检查所见:右肺结节\n影像诊断：\n\n右肺良性结节\n随诊\n报告医师:王\n后文"
    got = sections.impressions(lines(spark, text), "doc", sections.IMAGING_FINDINGS, sections.IMAGING_IMPRESSIONS).collect()
    assert [r.text for r in got] == ["右肺良性结节\n随诊"]
    only = sections.impressions(lines(spark, "影像所见: 未见异常"), "doc", sections.IMAGING_FINDINGS, sections.IMAGING_IMPRESSIONS).collect()
    assert [r.text for r in only] == ["未见异常"]


def test_groups_of_studies(spark):
    frame = spark.createDataFrame([("胸部CT平扫", "x"), (None, "颅脑磁共振"), ("某检查", "x"), (None, "x"), ("PET-CT", "x")], "title string, text string")
    got = [r[0] for r in frame.select(sections.imaging_group(F.col("title"), F.col("text"))).collect()]
    assert got == ["胸部CT", "头颅MRI", "某检查", "影像检查", "PET"]


def test_layout(spark):
    boxes = [(1, "名称", 0.0, 0.0, 10.0, 10.0), (1, "结果", 50.0, 3.0, 60.0, 10.0), (1, "血糖", 0.0, 12.0, 10.0, 10.0), (1, "6.1", 50.0, 11.0, 60.0, 10.0), (1, "尾注", 0.0, 60.0, 100.0, 10.0), (1, " ", 0.0, 70.0, 9.0, 1.0)]
    (got,) = sections.rebuild_layout(spark.createDataFrame(boxes, "page int, text string, left double, top double, right double, height double"), "page").collect()
    assert got.text == "名称" + " " * 43 + "结果\n血糖" + " " * 43 + "6.1\n\n尾注"


DOCS = [
    (7, 1, D(2023, 1, 5), "lab_report", None, "血糖 8.1 mmol/L 3.9-6.1\n肌酐 80 umol/L 59-104\n怪指标 5 U/L 1-3"),
    (7, 2, D(2024, 1, 5), "lab_report", None, "血糖 5.9 mmol/L 3.9-6.1"),
    (7, 3, D(2023, 2, 1), "discharge_summary", None, "出院诊断:2型糖尿病、慢性胃炎\n过敏史:青霉素(皮疹)\n出院带药\n二甲双胍 0.5g bid\n奥美拉唑 20mg qd"),
    (7, 9, D(2022, 12, 1), "discharge_summary", None, "出院诊断:2型糖尿病(E11.9)"),
    (7, 4, None, "imaging_report", "胸部CT", "结论:未见异常"), (7, 5, D(2023, 3, 1), "pathology", None, "病理诊断:慢性炎症"),
    (8, 6, None, "other", None, "nothing"),
]


@pytest.fixture(scope="module")
def summaries(spark):
    docs = spark.createDataFrame(DOCS, "patient int, doc int, date date, doc_type string, title string, text string")
    entries = [("glucose", "lab", "血糖", "15074-8", None, ["血糖"]), ("creatinine", "lab", "肌酐", "14682-9", None, ["肌酐"]), ("metformin", "drug", "二甲双胍", None, "A10BA02", ["二甲双胍"]), ("omeprazole", "drug", "奥美拉唑", None, "A02BC01", ["奥美拉唑"])]
    dictionary = spark.createDataFrame([(*e, []) for e in entries], "key string, category string, name string, loinc string, atc string, aliases array<string>, confusions array<string>")
    conversions = spark.createDataFrame([("glucose", "mmol/L", 1.0, 0.0)], "key string, unit_norm string, slope double, intercept double")
    labs = spark.createDataFrame([("2型糖尿病", "15074-8")], "disease string, loinc string")
    drugs = spark.createDataFrame([("2型糖尿病", "A10*"), ("2型糖尿病", "*")], "disease string, atc string")
    made = summary.summarise(docs, dictionary, conversions, labs, drugs, ["2型糖尿病", "高血压"])
    return {r.patient: r for r in made.collect()}, {r.patient: r for r in summary.trim(made).collect()}


def test_summary(summaries):
    whole, short = summaries
    one = whole[7]
    assert [p.term for p in one.problems] == ["2型糖尿病", "慢性胃炎", "其他"]
    diabetes, gastritis, other = one.problems
    assert diabetes.warn and diabetes.status == "需关注" and [s.name for s in diabetes.labs] == ["血糖"] and [m.name for m in diabetes.meds] == ["二甲双胍"]
    assert [(p.month, p.value) for p in diabetes.labs[0].points] == [("2023-01", 8.1), ("2024-01", 5.9)]
    assert diabetes.meds[0].dose == "0.5g bid" and diabetes.onset == D(2022, 12, 1) and diabetes.evidence == [3, 9] and diabetes.icd_code == "E11.9"
    assert (diabetes.labs[0].ref_low, diabetes.labs[0].ref_high, diabetes.labs[0].evidence) == (3.9, 6.1, [1, 2])
    assert gastritis.labs is None and {s.name for s in other.labs} == {"怪指标", "肌酐"} and [m.name for m in other.meds] == ["奥美拉唑"] and other.warn
    assert one.notable_changes == ["血糖 8.1→5.9mmol/L"]
    assert [(a.substance, a.reaction) for a in one.allergies] == [("青霉素", "皮疹")]
    assert one.imaging[0].group == "胸部CT" and one.imaging[0].studies[0].finding == "未见异常" and one.pathology[0].conclusion == "慢性炎症"
    assert whole[8].problems is None and whole[8].imaging is None
    assert [p.term for p in short[7].problems] == ["2型糖尿病", "其他", "慢性胃炎"] and "evidence" not in short[7].problems[0].asDict()
