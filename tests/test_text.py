import datetime

from pyspark.sql import functions as F

from chartloom.functions import lines, text

D = datetime.date


def values(spark, function, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("t"))).collect()]


def test_language(spark):
    assert values(spark, text.language, ["abc", "血糖", "血糖 a", "12", "", None]) == ["en", "zh", "mixed", None, None, None]


def test_dates_are_real_days(spark):
    assert values(spark, text.first_date, ["2023-02-30 then 2023-3-4", "住院号 12023-01-011", "2024年5月6日", "1899-01-01", "2023.1.2 2022年1月1日"]) == [D(2023, 3, 4), None, D(2024, 5, 6), None, D(2023, 1, 2)]


def test_date_range(spark):
    got = values(spark, text.date_range, ["入院日期:2023-01-02 出院日期:2023-01-09", "既往 2010-01-01 报告日期:2024-02-03", "2020-01-01 与 2021-01-01", "出院日期 2022-05-05", "none"])
    assert [tuple(r) for r in got] == [(D(2023, 1, 2), D(2023, 1, 9)), (D(2024, 2, 3), None), (D(2020, 1, 1), D(2021, 1, 1)), (D(2022, 5, 5), None), (None, None)]


def test_types_by_precedence(spark):
    got = values(spark, text.classify, ["出院记录 检验", "处方", "胸部CT", "CT 平扫", "病理报告 化验", "门诊病历 CT 影像", "doctor available", "血压记录", "提到病理", "Lab results"])
    assert got == ["discharge_summary", "prescription", "unknown", "imaging_report", "pathology", "clinical_note", "unknown", "other", "pathology", "lab_report"]


def test_radicals_terms_units_numbers(spark):
    assert values(spark, text.fold_radicals, ["意⻅ ⾎糖 μ"]) == ["意见 血糖 μ"]
    assert values(spark, text.normal_term, ["ＡＬＴ　(谷丙) x"]) == ["alt(谷丙)x"]
    assert values(spark, text.normal_unit, ["×10^9/L", "x10E9/L", "µmol/L", "m²"]) == ["10*9/L", "10*9/L", "umol/L", "m2"]
    assert values(spark, lambda c: text.plain_number(c.cast("double")), ["88", "7.90", "12345678", "0.0005"]) == ["88", "7.9", "12345678", "0.0005"]


def test_demographics(spark):
    (got,) = values(spark, text.demographics, ["姓名:张三 性别：女 年龄: 61 出生日期:1963-1-9"])
    assert tuple(got) == ("张三", "女", "1963-01-09", "61")


def test_frequencies(spark):
    assert values(spark, text.frequency, ["每晚一次", "三餐前", "一日三次", "20mg qd", "q12h", "必要时", "每天"]) == ["qn", "tid ac", "tid", "qd", "q12h", "prn", None]


def test_mime_and_sizes(spark):
    assert values(spark, text.mime_of, ["a.PDF", "b.dcm", "c", "d.xyz"]) == ["application/pdf", "application/dicom", "application/octet-stream", "application/octet-stream"]
    frame = spark.sql("SELECT 512L r, 512L c, 12L b, 1L s, 10L f, 9223372036854775807L big")
    row = frame.select(text.decoded_bytes(F.col("r"), F.col("c"), F.col("b"), F.col("s"), F.col("f")), text.decoded_bytes(F.col("big"), F.col("c"), F.col("b"), F.col("s"), F.col("f"))).first()
    assert tuple(row) == (512 * 512 * 2 * 10, None)


LABS = "\n".join(["肌酐  88.5  μmol/L  59-104", "低密度脂蛋白 3.9 mmol/L < 3.37", "eGFR 85 mL/min > 90 ↓", "年龄:60", "2024-01-05", "血糖 6.8 mmol/L 3.9 - 6.1 2024-01-05", "大小约，结节 8 mm", "白细胞 11 (高) 10^9/L 参考 4～10"])


def test_lab_rows(spark):
    frame = spark.createDataFrame([(1, i, line) for i, line in enumerate(LABS.split("\n"))], "doc int, line_no int, line string")
    got = {r.raw_name: (r.value, r.unit, r.ref_low, r.ref_high, r.flag) for r in lines.lab_rows(frame, "doc").where("has_evidence").collect()}
    assert got == {
        "肌酐": (88.5, "μmol/L", 59.0, 104.0, "N"), "低密度脂蛋白": (3.9, "mmol/L", None, 3.37, "H"), "eGFR": (85.0, "mL/min", 90.0, None, "L"),
        "血糖": (6.8, "mmol/L", 3.9, 6.1, "H"), "白细胞": (11.0, "10^9/L", 4.0, 10.0, "H"),
    }


MEDS = "\n".join(["1. 二甲双胍片 0.5g 每日两次 口服", "② 阿托伐他汀 口服 20mg qn", "血红蛋白 132 g/L", "肌酐 112 umol/L", "用法:口服,一次1片", "一次1片 一日2次", "胰岛素 皮下 12iu 三餐前"])


def test_medication_rows(spark):
    frame = spark.createDataFrame([(1, i, line) for i, line in enumerate(MEDS.split("\n"))], "doc int, line_no int, line string")
    got = {r.raw_name: (r.dose, r.dose_unit, r.frequency) for r in lines.medication_rows(frame, "doc").where("has_evidence").collect()}
    assert got == {"二甲双胍片": (0.5, "g", "bid"), "阿托伐他汀": (20.0, "mg", "qn"), "胰岛素": (12.0, "IU", "tid ac")}


def test_allergies(spark):
    frame = spark.createDataFrame([(1, 0, "过敏史:青霉素(皮疹)、磺胺"), (1, 1, "过敏史:否认"), (1, 2, "过敏:青霉素(皮疹)")], "doc int, line_no int, line string")
    assert sorted(map(tuple, lines.allergies(frame, "doc").collect()), key=str) == [(1, "磺胺", None), (1, "青霉素", "皮疹")]
