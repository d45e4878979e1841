import datetime
import random
import time

from pyspark.sql import functions as F

from chartloom.operators import containment, records

D = datetime.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pages(spark):
    texts = ["Glucose high; blood count", "blood: glucose", "glucose-blood test", "血糖偏高 CT检查", "病人 foo", None, "a " * 40 + "glucose " + "b " * 40]
    return frame(spark, [(i, t, "Title blood" if i == 3 else None) for i, t in enumerate(texts)], "doc_id int, text string, title string")


def test_search_scans_and_reads_the_index_alike(spark):
    rows = pages(spark)
    index = records.token_table(rows, "doc_id", ["title", "text"]).cache()
    want = {"glucose blood": [0, 1, 2], "glucose-blood": [2], "GLUCOSE": [0, 1, 2, 6], "血糖": [3], "糖偏高": [3], "ct检查": [3], "检查 blood": [3], "病": [], "foo": [4], " - ": [], "": [], "病人foo": [4]}
    for query, ids in want.items():
        assert [r.doc_id for r in records.search(rows, query, 10, title="title").collect()] == ids, query
        assert [r.doc_id for r in records.search_index(index, query, 10).collect()] == ids, query
    assert [r.doc_id for r in records.search(rows, "glucose", 2).collect()] == [0, 1]


def test_snippets(spark):
    got = {r.doc_id: r.s for r in pages(spark).select("doc_id", records.snippet(F.col("text"), "glucose 血糖").alias("s")).collect()}
    assert got[0] == "[Glucose] high; blood count" and got[3] == "[血糖]偏高 CT检查" and got[4] == "病人 foo"
    assert got[6] == "…a a a [glucose] b b b b b b b b…"
    found = records.search_results(pages(spark), frame(spark, [(2, "x"), (9, "y")], "doc_id int, name string"), "glucose blood", 5, "doc_id").collect()
    assert [(r.doc_id, r.name, r.snippet) for r in found] == [(2, "x", "[glucose]-[blood] test")]


def test_page_facts_and_details(spark):
    own = frame(spark, [("a", 2, "two", 0.5, "x"), ("a", 1, "one", None, "y"), ("b", 1, "b", None, "z")], "h string, page_no int, text string, confidence double, backend string")
    documents = frame(spark, [("a", "T", D(2024, 1, 1)), ("b", None, None), ("c", "no pages", None)], "h string, title string, date date")
    files = frame(spark, [("a", "a.txt"), ("b", "b.txt"), ("c", "c.txt"), ("d", "d.txt")], "h string, original_name string")
    got = {r.h: r for r in records.details(documents, files, own, "h", "h").collect()}
    assert (got["a"].ocr_text, got["a"].ocr_confidence, got["a"].ocr_backend, got["a"].original_name) == ("one\ntwo", 0.5, "y", "a.txt")
    assert (got["c"].ocr_text, got["c"].ocr_confidence, got["c"].ocr_backend) == ("", None, None)
    facts = {r.h: (r.n_pages, r.confidence, r.mean_confidence) for r in records.page_facts(own, "h", "page_no", "confidence").collect()}
    assert facts == {"a": (2, 0.5, 0.5), "b": (1, None, 0.0)}
    assert {r.h: r.has_document for r in records.has_document(files, documents, "h").collect()} == {"a": True, "b": True, "c": True, "d": False}
    assert [r.h for r in records.documents_where(documents, "title IS NOT NULL", "date", "h").collect()] == ["a", "c"]
    assert {r.h: r.place for r in records.gathered(documents, [], "date", "h").collect()} == {"a": 0, "b": 1, "c": 2}
    imaging = frame(spark, [("a", "s1", 2, 1), ("a", "s2", None, 1), ("a", "s3", 2, None)], "h string, s string, series int, inst int")
    assert {r.s: r.place for r in records.slices(imaging, "h", "series", "inst", "s").collect()} == {"s1": 1, "s3": 2, "s2": 3}
    assert {r.h: r.n_slices for r in records.slice_counts(documents, imaging, "h").collect()} == {"a": 3, "b": 0, "c": 0}
    assert [r.h for r in records.document_of_slice(documents, imaging, "h", "s", "s2").collect()] == ["a"]
    studies = documents.withColumn("study_uid", F.when(F.col("h") != "a", "u"))
    assert [r.h for r in records.study_document(studies, "u", "h").collect()] == ["b"]


def patients(spark):
    rows = [(1, 1, "discharge_summary", D(2024, 1, 1), D(2024, 1, 10)), (1, 2, "lab_report", D(2024, 1, 5), None), (1, 3, "other", D(2024, 2, 1), None), (1, 4, "other", None, None), (1, 5, "other", D(2024, 2, 1), None)]
    rows += [(2, 1, "discharge_summary", D(2024, 1, 1), D(2024, 1, 2)), (2, 2, "other", D(2024, 1, 2), None), (2, 9, "discharge_summary", D(2024, 1, 2), D(2024, 1, 1))]
    texts = [(1, 1, 1, "北京协和医院 出院"), (1, 2, 1, "上海瑞金医院 化验"), (1, 2, 2, "上海瑞金医院"), (1, 3, 1, "某某医学中心"), (1, 5, 1, "无"), (2, 2, 1, None)]
    return frame(spark, rows, "patient int, doc int, doc_type string, date date, date_end date"), frame(spark, texts, "patient int, doc int, page int, text string")


def test_encounters_count_per_patient_and_name_providers(spark):
    documents, texts = patients(spark)
    windows = records.discharge_windows(documents, "patient")
    said = records.page_providers(texts, "patient", "doc", "page")
    got = {(r.patient, r.encounter): r for r in records.encounters(documents, "patient", F.col("doc") == 5, windows, said).collect()}
    assert {k: (r.kind, r.n_docs, r.docs) for k, r in got.items()} == {
        (1, 1): ("inpatient", 2, [2, 1]), (1, 2): ("emergency", 2, [5, 3]), (2, 1): ("inpatient", 3, [9, 2, 1]), (2, 2): ("inpatient", 0, []),
    }
    assert (got[1, 1].provider, got[1, 1].transferred, got[1, 1].title) == ("上海瑞金医院", True, "住院 · 2024-01-01 → 2024-01-10 · 转院")
    assert (got[1, 2].provider, got[1, 2].transferred, got[1, 2].title) == ("某某医学中心", False, "急诊 · 2024-02-01")
    assert got[2, 1].provider is None and not got[2, 1].transferred
    whole = records.grouped_timeline(documents, "patient", F.lit(False), windows, said).orderBy("patient", "place").collect()
    assert [(r.patient, r.kind, r.encounter, r.docs) for r in whole] == [
        (1, "outpatient", 2, [5, 3]), (1, "inpatient", 1, [2, 1]), (1, "document", None, [4]), (2, "inpatient", 2, []), (2, "inpatient", 1, [9, 2, 1]),
    ]


def test_profile_and_mismatch(spark):
    texts = ["姓名：张三 性别：男 年龄：45", "姓名：张三 出生日期：1979-3-2", "姓名：李四 性别：女", "无", "姓名:李四"]
    rows = frame(spark, [(1, t) for t in texts] + [(2, "x")], "patient int, text string")
    got = {r.patient: tuple(r)[1:] for r in records.patient_profile(rows, "patient").collect()}
    assert got == {1: ("张三", "女", "1979-03-02", "45", 5), 2: (None, None, None, None, 1)}
    names = frame(spark, [(1, "张三"), (2, "李四"), (3, " "), (4, None)], "i int, detected string")
    assert {r.i: r.mismatch for r in records.mismatched(names, "detected", F.lit("张三")).collect()} == {1: None, 2: "李四", 3: None, 4: None}


def test_labels_and_audit(spark):
    types = frame(spark, [("lab_report",), ("nothing",), ("lab_report",)], "doc_type string")
    assert {r.doc_type: (r.n, r.label) for r in records.type_facet(types).collect()} == {"lab_report": (2, "化验"), "nothing": (1, None)}
    log = frame(spark, [("FileImported", "a.txt", "h", None, None, None, None, None), ("ExportPerformed", None, None, "timeline_html", 3, "s", None, None), ("ShareCreated", None, None, None, 2, "t", "2024-05-01", None), ("DocumentDeleted", None, None, None, None, None, None, "g"), ("OcrAdded", None, None, None, None, None, None, None)],
                "type string, original_name string, content_hash string, kind string, record_count long, sha256 string, expires string, source_file_hash string").selectExpr("*", "'t' ts", "'d' device_id", "1L seq")
    assert sorted((r.action, r.detail, r.sha256) for r in records.audit(log).collect()) == sorted([("导入", "a.txt", "h"), ("导出", "timeline_html · 3 条记录", "s"), ("分享", "2 条记录 · 有效期至 2024-05-01", "t"), ("删除", "移除一份文档", "g")])


def test_names_and_texts_that_contain_each_other(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("高血压糖尿病ab ", k=n))
    texts = [word(rng.randrange(0, 7)) for _ in range(400)] + [None, "", " ", "高"]
    names = [(word(rng.randrange(0, 5)), i) for i in range(150)] + [("病", 3), ("", 0), (None, 1)]
    frame, known = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(names, "n string, place int")
    got = sorted(map(tuple, containment.contained(frame, known, "t", "n").collect()))
    assert got == sorted({(t, n) for t in texts if t for n, _ in names if n and n in t})
    first = {r.t: r.n for r in containment.first_match(frame, known, "t", "n", "place").collect()}
    want = {}
    for t in texts:
        if t and t.strip(" "):
            hits = [(p, n) for n, p in names if n and (n in t.strip(" ") or t.strip(" ") in n)]
            if hits:
                want[t] = min(hits)[1]
    assert first == want


def test_many_names_against_many_texts_without_a_nested_loop(spark):
    names = spark.range(20_000).selectExpr("concat('n', hex(id * 7919 + 1000003), 'x') AS n", "id AS place")
    texts = spark.range(200_000).selectExpr("concat('term ', IF(id % 4 = 0, concat('n', hex((id DIV 4 % 20000) * 7919 + 1000003), 'x'), hex(id)), ' end ', id) AS t")
    found = containment.first_match(texts, names, "t", "n", "place")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert found.count() == 50_000


def test_short_phrases_are_found_within_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(0, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 15))) for _ in range(120)] + [None]
    asked = [" ".join(word() for _ in range(rng.randrange(1, 6))) for _ in range(60)] + [None, "", " ", "a", " b"]
    docs, phrases = spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), spark.createDataFrame(list(enumerate(asked)), "item int, text string")
    got = sorted(map(tuple, records.phrase_hits(docs, phrases, "doc", "item").collect()))
    assert got == sorted((i, j) for i, t in enumerate(texts) if t is not None for j, p in enumerate(asked) if p and p in t)


def test_windows_claim_documents_of_a_hot_patient_without_comparing_all_pairs(spark):
    rng = random.Random(8)
    day = lambda: datetime.date(2000, 1, 1) + datetime.timedelta(days=rng.randrange(2500))
    docs = [(p, i, day() if rng.random() < 0.95 else None, None) for p in (1, 2, None) for i in range(150)]
    windows = [(p, 1000 + i, rng.randrange(40), s, s + datetime.timedelta(days=rng.choice([-3, 0, 1, 5, 30, 31, 62, 400, 1500]))) for p in (1, 2, 3) for i, s in enumerate(day() for _ in range(60))]
    frame, known = spark.createDataFrame(docs, "patient int, doc int, date date, title string"), spark.createDataFrame(windows, "patient int, window int, window_order int, start date, end date")

    def first(p, d):
        return min(((o, w) for q, w, o, s, e in windows if q == p and d is not None and s <= d <= e), default=(None, None))[1]

    assert {(r.patient, r.doc): r.window for r in records.inpatient_windows(frame, known, "patient").collect()} == {(p, i): first(p, d) for p, i, d, _ in docs}
    times = frame.withColumn("date", F.col("date").cast("timestamp") + F.make_interval(hours=F.col("doc") % 24)), known.withColumns({"start": F.col("start").cast("timestamp") + F.expr("INTERVAL 7 HOURS"), "end": F.col("end").cast("timestamp") + F.expr("INTERVAL 19 HOURS")})
    hour = lambda d, h: datetime.datetime(d.year, d.month, d.day, h)

    def first_at(p, d, h):
        return min(((o, w) for q, w, o, s, e in windows if q == p and d is not None and hour(s, 7) <= hour(d, h) <= hour(e, 19)), default=(None, None))[1]

    assert {(r.patient, r.doc): r.window for r in records.inpatient_windows(*times, "patient").collect()} == {(p, i): first_at(p, d, i % 24) for p, i, d, _ in docs}
    many = spark.range(100_000).selectExpr("1 AS patient", "CAST(id AS int) AS doc", "date_add(DATE'2000-01-01', CAST(id % 9000 AS int)) AS date", "CAST(NULL AS string) AS title")
    long = spark.range(10_000).selectExpr("1 AS patient", "CAST(id AS int) AS window", "CAST(id AS int) AS window_order", "date_add(DATE'2000-01-01', CAST(9000 - id % 9000 AS int)) AS start", "DATE'2024-08-23' AS end")
    began = time.time()
    assert records.inpatient_windows(many, long, "patient").where("window IS NOT NULL").count() > 90_000 and time.time() - began < 60


def test_providers_as_a_column_are_those_of_a_table(spark):
    rng = random.Random(11)
    rows = [(p, i, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(6)), rng.choice(["A", "B", "C", None])) for p in range(8) for i in range(20)]
    docs = spark.createDataFrame(rows, "patient int, doc int, date date, who string")
    windows = spark.createDataFrame([(p, 100 + p, 1, datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)) for p in range(9)], "patient int, window int, window_order int, start date, end date")
    said = docs.where("who IS NOT NULL").select("patient", "doc", F.col("who").alias("provider"), F.col("doc").alias("at"))
    both = [sorted(map(str, map(tuple, records.encounters(docs, "patient", F.col("doc") % 7 == 0, windows, x).collect()))) for x in ("who", said)]
    assert both[0] == both[1] and any("转院" in r for r in both[0])
