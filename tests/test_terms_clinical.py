import datetime

from pyspark.sql import functions as F

from chartloom.operators import clinical, ordering, records, terms

D = datetime.date


def test_resolution_prefers_units_then_confidence_then_length(spark):
    entries = [
        ("glucose", "lab", ["血糖", "GLU"], ["血塘"]), ("glucose_urine", "lab", ["尿糖", "葡萄糖"], []), ("dextrose", "drug", ["葡萄糖"], []),
        ("metformin", "drug", ["二甲双胍"], []), ("hba1c", "lab", ["糖化血红蛋白"], []),
    ]
    index = terms.alias_index(spark.createDataFrame(entries, "key string, category string, aliases array<string>, confusions array<string>"))
    rows = [(1, "血糖(GLU)", "mmol/L"), (2, "血塘", None), (3, "盐酸二甲双胍", None), (4, "二甲双胍缓释片0.5g", None), (5, "葡萄糖", "mg"), (6, "unknown", None), (7, "糖化血红蛋白 血糖", "mmol/L")]
    accepted = spark.createDataFrame([("glucose", "mmol/L")], "key string, unit_norm string")
    got = {r.i: (r.key, r.confidence) for r in terms.resolve(spark.createDataFrame(rows, "i int, t string, u string"), index, "t", accepted, "u").collect()}
    assert got == {1: ("glucose", 1.0), 2: ("glucose", 0.5), 3: ("metformin", 0.8), 4: ("metformin", 0.8), 5: ("glucose_urine", 1.0), 6: (None, None), 7: ("glucose", 1.0)}


def test_candidates_of_brackets_and_slashes(spark):
    names = ["AST/ALT 复查", "检验【尿蛋白】", "检验(尿蛋白", "肌酐 Cr(Scr)", "甲泼尼龙片(美卓乐)4mg", "外（内（里）外内）", "醋酸泼尼松片5mg", "5mg", "青霉素80万单位", "片g"]
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", terms.candidates(F.col("n")).alias("c")).collect()}
    assert got == {
        "AST/ALT 复查": ["AST/ALT 复查", "AST/ALT", "复查"], "检验【尿蛋白】": ["检验【尿蛋白】", "检验", "尿蛋白"], "检验(尿蛋白": ["检验(尿蛋白", "检验", "尿蛋白"],
        "肌酐 Cr(Scr)": ["肌酐 Cr(Scr)", "肌酐 Cr", "肌酐", "Cr(Scr)", "Cr", "Scr"], "甲泼尼龙片(美卓乐)4mg": ["甲泼尼龙片(美卓乐)4mg", "甲泼尼龙片4mg", "美卓乐", "甲泼尼龙片(美卓乐)", "甲泼尼龙片"],
        "外（内（里）外内）": ["外（内（里）外内）", "外", "内里外内"], "醋酸泼尼松片5mg": ["醋酸泼尼松片5mg", "醋酸泼尼松片"], "5mg": ["5mg"], "青霉素80万单位": ["青霉素80万单位", "青霉素"], "片g": ["片g"],
    }


def test_stems_lose_form_carrier_and_salt(spark):
    names = ["盐酸二甲双胍片", "阿托伐他汀钙片", "注射用泮托拉唑钠", "10%氯化钾注射液", "左氧氟沙星氯化钠注射液", "琥珀酸亚铁片", "碳酸氢钠", "甲泼尼龙琥珀酸钠"]
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", terms.drug_stems(F.col("n")).alias("c")).collect()}
    assert got == {
        "盐酸二甲双胍片": ["盐酸二甲双胍", "二甲双胍"], "阿托伐他汀钙片": ["阿托伐他汀钙", "阿托伐他汀"], "注射用泮托拉唑钠": ["泮托拉唑钠", "泮托拉唑", "泮托拉唑钠", "泮托拉唑"],
        "10%氯化钾注射液": ["氯化钾注射液", "氯化钾", "氯化"], "左氧氟沙星氯化钠注射液": ["左氧氟沙星氯化钠", "左氧氟沙星氯化", "左氧氟沙星"], "琥珀酸亚铁片": ["琥珀酸亚铁", "亚铁"],
        "碳酸氢钠": ["碳酸氢", "碳酸氢"], "甲泼尼龙琥珀酸钠": ["甲泼尼龙", "甲泼尼龙"],
    }


def test_a_confusion_comes_before_a_stem_and_drugs_have_a_space_of_their_own(spark):
    entries = [("a", "lab", [], ["药片"]), ("b", "drug", ["药物", "叶酸", "药x"], []), ("c", "lab", ["叶酸"], []), ("d", "drug", ["药"], [])]
    index = terms.alias_index(spark.createDataFrame(entries, "key string, category string, aliases array<string>, confusions array<string>"))
    rows = spark.createDataFrame([(1, "药物片"), (2, "叶酸"), (3, "叶酸片"), (4, "药片")], "i int, t string")
    got = {r.i: (r.key, r.confidence) for r in terms.resolve(rows, index, "t").collect()}
    assert got == {1: ("b", 0.8), 2: ("c", 1.0), 3: ("b", 0.8), 4: ("a", 0.5)}
    assert {r.i: r.key for r in terms.resolve(rows, index, "t", drugs_only=True).collect()} == {1: "b", 2: "b", 3: "b", 4: None}


def test_coverage_and_enumeration(spark):
    rows = spark.createDataFrame([("lab", "x", 1.0, True, "X"), ("lab", "y", 0.8, False, "Y"), ("lab", None, None, None, "Z"), ("drug", None, None, None, "Q")], "g string, key string, confidence double, ok boolean, name string")
    got = {r.g: tuple(r)[1:] for r in terms.coverage(rows, "g", "key", "confidence", "ok", "name").collect()}
    assert got == {"lab": (3, 2, 1, 66.667, 1, ["Z"]), "drug": (1, 0, 0, 0.0, 0, ["Q"])}
    dictionary = spark.createDataFrame([("k", "lab", "K"), ("k", "lab", "K"), ("m", "drug", "M")], "key string, category string, name string")
    assert sorted(map(tuple, terms.entries(dictionary).collect())) == [("k", "lab", "K"), ("m", "drug", "M")] and terms.entries(dictionary, "drug").count() == 1


def test_unit_conversion(spark):
    rows = spark.createDataFrame([("a", 1.0, "mg/dL"), ("a", 1.0, "MG/DL"), ("b", 2.0, "×10^9/L")], "key string, v double, u string")
    table = spark.createDataFrame([("a", "mg/dL", 88.42, 0.0), ("b", "10*9/L", 1.0, 2.0)], "key string, unit_norm string, slope double, intercept double")
    assert [r.canonical for r in terms.convert(rows, table, "v", "u").orderBy("key", F.desc("u")).collect()] == [88.42, None, 4.0]


def test_series_put_undated_points_last_and_ranges_ignore_rows_without_one(spark):
    rows = [("k", D(2024, 2, 1), 0, 2.0, "H", 1.0), ("k", None, 1, 9.0, "N", 5.0), ("k", D(2024, 1, 1), 2, 1.0, "N", None), ("k", D(2024, 2, 1), 3, 3.0, None, 7.0)]
    frame = spark.createDataFrame(rows, "k string, date date, pos int, value double, flag string, low double")
    (s,) = clinical.series(frame, ["k"], "date", "value", ["pos"]).collect()
    assert [p.value for p in s.points] == [1.0, 2.0, 3.0, 9.0] and s.any_abnormal and s.n_points == 4
    (r,) = clinical.latest(frame, ["k"], "date", ["pos"], ["low"], F.col("low").isNotNull()).collect()
    assert r.low == 1.0


def test_spans_take_the_latest_dose_even_if_null(spark):
    frame = spark.createDataFrame([("k", D(2024, 1, 1), 0, "5mg", 1), ("k", D(2024, 3, 1), 1, None, 2), ("k", None, 2, "9mg", 3)], "k string, date date, pos int, dose string, doc int")
    (r,) = clinical.spans(frame, ["k"], "date", ["pos"], "dose", "doc").collect()
    assert (r.start, r.end, r.dose, r.sources) == (D(2024, 1, 1), D(2024, 3, 1), None, [1, 2, 3])


def test_diseases_match_both_ways_in_map_order(spark):
    frame = spark.createDataFrame([("高血压3级",), ("糖尿病",), ("2 型糖尿病",), ("病",), (" ",)], "t string")
    assert [r[0] for r in frame.select(clinical.matched_disease(F.col("t"), ["高血压", "2型糖尿病", "冠心病"])).collect()] == ["高血压", "2型糖尿病", None, "2型糖尿病", None]


def test_tiers_skip_what_is_degraded(spark):
    frame = spark.createDataFrame([("s", i, n) for i, n in enumerate([30, 50, 40, 40, 30])], "g string, i int, size long")
    got = [r.tier for r in clinical.share_tiers(frame, "g", ["i"], "size", 40, 100).orderBy("i").collect()]
    assert got == ["full", "image", "full", "image", "full"]


def test_inpatient_windows_claim_in_order_and_keep_empty_ones(spark):
    docs = spark.createDataFrame([(1, i, D(2024, 1, d), None) for i, d in enumerate((1, 5, 9, 20))] + [(1, 9, None, None)], "patient int, doc int, date date, title string")
    windows = spark.createDataFrame([(1, 100, 1, D(2024, 1, 1), D(2024, 1, 10)), (1, 101, 2, D(2024, 1, 5), D(2024, 1, 9)), (1, 102, 3, D(2024, 2, 9), D(2024, 2, 1))], "patient int, window int, window_order int, start date, end date")
    got = {r.doc: r.window for r in records.inpatient_windows(docs, windows, "patient").collect()}
    assert got == {0: 100, 1: 100, 2: 100, 3: None, 9: None}
    rows = records.encounters(docs, "patient", F.lit(False), windows).collect()
    assert sorted((r.kind, r.n_docs) for r in rows) == [("inpatient", 0), ("inpatient", 0), ("inpatient", 3), ("outpatient", 1)]


def test_numbering_over_the_whole_table(spark):
    frame = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)] + [(2000, None)], "i int, v int")
    got = ordering.numbered(frame, F.floor(F.col("v") / 50), [F.asc_nulls_last("v")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1002)) and [r.v for r in got] == [*range(1000), None]


def test_search_needs_all_tokens_of_one_page(spark):
    pages = spark.createDataFrame([(1, "Blood glucose high"), (2, "glucose"), (3, "血糖偏高 glucose")], "doc_id int, text string")
    assert [r.doc_id for r in records.search(pages, "GLUCOSE!", 10).collect()] == [1, 2, 3]
    assert [r.doc_id for r in records.search(pages, "glucose blood", 10).collect()] == [1]
    assert [r.doc_id for r in records.search(pages, "糖偏", 10).collect()] == [3]
    assert records.search(pages, " - ", 10).collect() == []
