import csv
import datetime
import glob
import gzip
import base64
import hashlib
import json
import random
import re
import struct

from pyspark.sql import functions as F

from chartloom.functions import blocks
from chartloom.functions import text as T
from chartloom.operators import records, share
from chartloom.sources import dicom, files, vault

D = datetime.date


def lines(spark, *texts):
    return records.line_rows(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), "doc")


LAB = "化验单\n项目 结果 单位 参考\n\n血糖 6.8 mmol/L 3.9-6.1 ↑\n\n总胆固醇 TC 5.2 mmol/L 0-5.2\n钾 3.4 3.5-5.3 偏低\n\n\n钠 140 mmol/L 正常\n备注 无"


def test_laboratory_tables(spark):
    (t,) = blocks.lab_tables(lines(spark, LAB, "血糖 6.8 mmol/L\n文字\n钾 3.4 mmol/L\n钠 1 x"), "doc").collect()
    assert (t.doc, t.first_line, t.last_line, t.header) == (0, 2, 7, "项目 结果 单位 参考")
    assert [tuple(r) for r in t.rows] == [("血糖", "6.8", "mmol/L", "3.9-6.1 ↑", "high"), ("总胆固醇 TC", "5.2", "mmol/L", "0-5.2", None), ("钾", "3.4", "3.5-5.3", "偏低", "low")]
    row = {r.l: r.r for r in spark.createDataFrame([("6.8 x",), ("血糖 6.8",), ("血糖 <6.8 - 3",), ("血糖 <6.8 -3 - 9",), ("字",)], "l string").select("l", blocks.lab_row(F.col("l")).alias("r")).collect()}
    assert row["6.8 x"] is None and row["血糖 6.8"] is None and row["字"] is None and row["血糖 <6.8 - 3"] is None and tuple(row["血糖 <6.8 -3 - 9"]) == ("血糖 <6.8", "-3", "", "- 9", None)


def test_tables_and_heads(spark):
    rows = lines(spark, "项目  结果  单位\na  1  mg\nb  2  g  偏高\n\nc  3  x\n【诊断】\n主诉:\n主诉:头痛", "x\ty1\tz\nq\t2\tw")
    got = {(r.doc, r.first_line): (r.last_line, r.header, r.rows, r.flags) for r in blocks.tables(rows, "doc").collect()}
    assert got == {(0, 1): (3, ["项目", "结果", "单位"], [["a", "1", "mg"], ["b", "2", "g", "偏高"]], [None, "high"]), (1, 1): (2, None, [["x", "y1", "z"], ["q", "2", "w"]], [None, None])}
    assert sorted((r.line_no, r.text) for r in blocks.section_heads(rows, "doc").collect()) == [(6, "【诊断】"), (7, "主诉:")]


def ordered(text):
    """The blocks of a report by reading it line by line."""
    words = blocks.HEADER_WORDS
    all_lines = text.split("\n")
    number = re.compile(r"-?[0-9]+(\.[0-9]+)?")

    def lab(line):
        w = line.split()
        at = next((i for i, x in enumerate(w) if number.fullmatch(x)), 0)
        return 0 < at < len(w) - 1

    n_words = lambda line: sum(x in line for x in words)
    split = lambda line: [c for c in re.split(r"\s{2,}|\t", line.strip()) if c]
    data = lambda line: len(split(line)) >= 3 and any(c.isdigit() for c in line)
    skip = lambda k: k + 1 if k < len(all_lines) and not all_lines[k].strip() else k
    out, i = [], 0
    while i < len(all_lines):
        line = all_lines[i].strip()
        if not line:
            i += 1
            continue
        j = skip(i + 1) if n_words(line) >= 2 and not any(c.isdigit() for c in line) else i
        rows, last = 0, i
        while j < len(all_lines) and all_lines[j].strip() and lab(all_lines[j]):
            rows, last, j = rows + 1, j, skip(j + 1)
        if rows >= 3:
            out.append(("labtable", i + 1, last + 1, rows))
            i = j
            continue
        head = n_words(line) >= 2 and len(split(line)) >= 3
        j = i + head
        while j < len(all_lines) and all_lines[j].strip() and data(all_lines[j]):
            j += 1
        if j - i - head >= 2:
            out.append(("table", i + 1, j, j - i - head))
            i = j
            continue
        out.append(("section" if re.fullmatch(r"[【\[].+[】\]]", line) or len(line) <= 14 and line[-1] in ":：" else "para", i + 1, i + 1, 0))
        i += 1
    return out


def test_blocks_of_a_report_in_order(spark):
    (got,) = [blocks.report_blocks(lines(spark, "【检验】\n项目 结果 单位\n\n血糖 6.8 mmol/L 3.9 ↑\n\n钾 3.4 x\n钠 140 x 正常\n说明\n项目  结果  单位\na  b  1\nc  d  2 偏高\n尾"), "doc").orderBy("place").collect()]
    assert [(r.kind, r.first_line, r.last_line) for r in got] == [("section", 1, 1), ("labtable", 2, 7), ("para", 8, 8), ("table", 9, 11), ("para", 12, 12)]
    assert got[1].header == ["项目 结果 单位"] and got[1].rows[0] == ["血糖", "6.8", "mmol/L", "3.9 ↑"] and got[1].flags == ["high", None, "normal"]
    assert got[3].header == ["项目", "结果", "单位"] and got[3].rows == [["a", "b", "1"], ["c", "d", "2 偏高"]] and got[3].flags == [None, "high"] and got[0].text == "【检验】"
    rng = random.Random(6)
    pool = ["", "", "a 1 x", "b 2 y", "a  b  7", "c  8  d", "e  9  f", "项目 结果", "项目  结果  单位", "项目  结果  3", "文字", "主诉:", "【x】", "7 8 9", " "]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 25))) for _ in range(400)]
    found = {}
    for r in blocks.report_blocks(lines(spark, *texts), "doc").orderBy("doc", "place").collect():
        found.setdefault(r.doc, []).append((r.kind, r.first_line, r.last_line, len(r.rows)))
    assert {i: found.get(i, []) for i in range(len(texts))} == {i: ordered(t) for i, t in enumerate(texts)}


def test_prescriptions(spark):
    text = "门诊处方笺\nRp.\n1. 阿司匹林片 100mg\n用法: 每日一次\n\n2、二甲双胍\n一次0.5g\n医师: 张\n复诊\n3) 钙片\n饭后"
    (r,) = blocks.prescription(lines(spark, text, "no items\nat all"), "doc").collect()
    assert (r.doc, r.intro, r.footer) == (0, ["门诊处方笺"], ["医师: 张", "复诊"])
    assert [(m.name, m.usage) for m in r.meds] == [("阿司匹林片 100mg", ["用法: 每日一次"]), ("二甲双胍", ["一次0.5g"]), ("钙片", ["饭后"])]


def test_small_texts(spark):
    one = spark.createDataFrame([("继续口服阿司匹林、二甲双胍;低盐饮食", "0" * 9)], "t string, p string")
    r = one.select(T.medication_lines(F.col("t")).alias("m"), share.grouped_passphrase(F.col("p")).alias("g"), share.escaped(F.lit("<a href='x'>&\"")).alias("e"), T.byte_size(F.lit(1536)).alias("b"), T.byte_size(F.lit(3 * 1024 * 1024)).alias("c"), T.byte_size(F.lit(5)).alias("d")).first()
    assert r.m == ["阿司匹林", "二甲双胍", "低盐饮食"] and r.g == "0000 0000 0" and r.e == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;" and (r.b, r.c, r.d) == ("1.5 KB", "3.0 MB", "5 B")
    spans = one.select(*(T.span_text(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("a", D(2024, 1, 2), D(2024, 3, 1)), ("b", D(2024, 1, 2), D(2024, 1, 9)), ("c", None, None)))).first()
    assert tuple(spans) == ("2024-01 → 2024-03", "2024-01", None)
    assert tuple(one.select(T.decodable(*(F.lit(x) for x in (512, 512, 16, 1, 100))), T.decodable(*(F.lit(x) for x in (60000, 60000, 16, 3, 2**31 - 1)))).first()) == (True, False)


def test_shares(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "B", "lab_report", D(2024, 1, 2), None, "two"), (1, 0, "A", "surgery", D(2024, 1, 1), D(2024, 1, 3), "one")], "patient int, place long, title string, doc_type string, date date, date_end date, text string")
    people = spark.createDataFrame([(1, "张三")], "patient int, name string")
    summary = spark.createDataFrame([(1, ["x"], [])], "patient int, problems array<string>, allergies array<string>")
    (p,) = share.payloads(people, rows, summary, "patient", F.lit("2024-02-01")).collect()
    assert p.record_count == 2 and '"records":[{"title":"A","type":"手术","date":"2024-01-01 → 2024-01-03","text":"one"}' in p.payload and '"summary":{"problems":["x"]' in p.payload
    empty = spark.createDataFrame([(1, [], [])], "patient int, problems array<string>, allergies array<string>")
    assert "summary" not in share.payloads(people, rows, empty, "patient", F.lit("x")).first().payload
    key = F.lit(b"k" * 32)
    sealed = spark.createDataFrame([("文本",)], "t string").withColumn("e", share.encrypted(F.col("t"), key))
    assert sealed.select(share.decrypted(F.col("e"), key)).first()[0] == "文本" and len(base64.b64decode(sealed.first().e)) == 12 + 6 + 16
    (q,) = share.qr_fragments(summary, "patient", key, "https://x/").collect()
    body = q.fragment.split(".")
    assert q.fits and body[0] == "q1" and base64.urlsafe_b64decode(body[2] + "=") == b"k" * 32 and len(base64.urlsafe_b64decode(body[1] + "=" * (-len(body[1]) % 4))) == q.cipher_len
    assert gzip.decompress(spark.createDataFrame([("é",)], "t string").select(share.gzipped("t")).first()[0]).decode() == "é"
    html = share.html_sections(rows.selectExpr("*", "'f' original_name", "'text/plain' mime_type"), "2024-01-02").collect()
    assert len(html) == 1 and "<h3>B</h3>\n<p>化验 · 2024-01-02</p>" in html[0].html and "<pre>two</pre>" in html[0].html
    log = spark.createDataFrame([("DocumentDeleted", 'a"b', 2), ("DocumentDeleted", "c", 10)], "type string, source_file_hash string, seq long").selectExpr("*", "'t' ts", "'d' device_id", "'' original_name", "'' content_hash", "'' kind", "1L record_count", "'' sha256", "'' expires")
    share.write_audit_csv(log, str(tmp_path / "audit"))
    raw = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/audit/part*")))
    assert list(csv.reader(raw.splitlines()))[:3] == [["seq", "timestamp", "device_id", "action", "detail", "sha256"], ["10", "t", "d", "删除", "移除一份文档", "c"], ["2", "t", "d", "删除", "移除一份文档", 'a"b']] and '"a""b"' in raw


def test_kinds_of_payloads_refuse_each_other(spark):
    key = F.lit(b"k" * 32)
    one = spark.createDataFrame([(1, ["p", "q"])], "patient int, problems array<string>")
    people = spark.createDataFrame([(1, "张三", "70")], "patient int, name string, age string")
    (q,) = share.qr_fragments(one, "patient", key, "", people, "2024-02-03T00:00:00Z").collect()
    blob = q.fragment.split(".")[1].replace("-", "+").replace("_", "/")
    sealed = spark.createDataFrame([(blob + "=" * (-len(blob) % 4),)], "b string").select(F.unbase64("b").alias("b"))
    raw = sealed.select(F.try_aes_decrypt("b", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(share.QR_AAD))).first()[0]
    said = json.loads(gzip.decompress(raw))
    assert q.problem_count == 2 and said == {"v": 1, "kind": "summary", "generated": "2024-02-03T00:00:00Z", "patient": {"name": "张三", "age": "70"}, "summary": {"problems": ["p", "q"]}}
    text = spark.createDataFrame([("x",)], "t string").select(share.encrypted(F.col("t"), key).alias("s"), share.encrypted(F.col("t"), key, share.QR_AAD).alias("q"))
    assert tuple(text.select(share.decrypted(F.col("s"), key), share.decrypted(F.col("q"), key), share.decrypted(F.col("q"), key, share.QR_AAD), share.decrypted(F.col("s"), F.lit(b"j" * 32))).first()) == ("x", None, "x", None)


def test_shares_carry_originals_within_their_caps(spark):
    mb = 1 << 20
    kinds = [("study", 39), ("image", 90), ("pdf", 100), ("study", 41), ("study", 40), ("study", 32), ("pdf", 60), ("study", 31), ("image", 5), ("study", 0)]  # of 400 MB and more
    sources = spark.createDataFrame([(p, i, k, 0, f"h{p}{i}", n * mb) for p in (1, 2) for i, (k, n) in enumerate(kinds)], "patient int, place int, kind string, slice int, hash string, bytes long")
    got = {r.place: r.tier for r in share.embedded(sources.drop("slice", "hash"), "patient").where("patient = 1").collect()}
    want, total = {}, 0
    for i, (kind, n) in enumerate(kinds):
        fits = total + n <= 300
        want[i] = "full" if kind == "image" or fits and (kind == "pdf" or n <= 40) else "text" if kind == "pdf" else "large" if n > 40 else "total"
        total += n if want[i] == "full" else 0
    assert got == want and total > 300 - 40 and set(want.values()) == {"full", "text", "large", "total"}
    objects = spark.createDataFrame([(f"h1{i}", bytearray(b"x" * (i + 1))) for i in range(10)], "hash string, content binary")
    rows = spark.createDataFrame([(1, i, f"T{i}", "imaging_report", None, None, "t") for i in range(10)], "patient int, place int, title string, doc_type string, date date, date_end date, text string")
    carried = share.with_originals(rows, sources, objects, "patient").where("patient = 1")
    people = spark.createDataFrame([(1, "张三")], "patient int, name string")
    (p,) = share.payloads(people, carried, None, "patient", F.lit("2024-02-01")).collect()
    said = json.loads(p.payload)
    assert said["degraded"] == [f"T{i}" for i, t in want.items() if t in ("large", "total")] and [r["tier"] for r in said["records"]] == [want[i] for i in range(10)]
    assert [r.get("slices") for r in said["records"]] == [[f"h1{i}"] if want[i] == "full" else None for i in range(10)] and "41 MB" in said["records"][3]["note"]
    sent = share.parts(carried, objects, "patient", 3).orderBy("hash", "part").collect()
    whole = {}
    for r in sent:
        whole[r.hash] = whole.get(r.hash, b"") + bytes(r.bytes)
    assert whole == {f"h1{i}": b"x" * (i + 1) for i, t in want.items() if t == "full"} and max(len(r.bytes) for r in sent) == 3


def element(group, number, kind, value):
    value += b" " * (len(value) % 2)
    size = struct.pack("<HI", 0, len(value)) if kind in dicom.LONG else struct.pack("<H", len(value))
    return struct.pack("<HH", group, number) + kind + size + value


def test_image_headers(spark):
    head = b"\0" * 128 + b"DICM"
    whole = head + element(8, 0x20, b"DA", b"20240203") + element(8, 0x60, b"CS", b"MR") + element(8, 0x1140, b"SQ", b"12345678") + element(0x18, 0x15, b"CS", "头部".encode()) + element(0x20, 0x13, b"IS", b"7") + element(0x28, 0x10, b"US", struct.pack("<H", 512)) + element(0x7FE0, 0x10, b"OW", b"x" * 50)
    implicit = head + struct.pack("<HHI", 8, 0x60, 2) + b"CT"
    rows = [("a", whole), ("b", implicit), ("c", b"no"), ("d", head + struct.pack("<HH", 8, 0x60) + b"CS" + struct.pack("<H", 60000) + b"CT"), ("e", None)]
    tags = dicom.headers(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary"))
    got = {r.path: r for r in tags.select("*", dicom.title(F.col("path")).alias("title"), dicom.summary().alias("summary")).collect()}
    assert (got["a"].modality, got["a"].body_part, got["a"].instance_number, got["a"].rows, got["a"].title) == ("MR", "头部", 7, 512, "MR · 头部")
    assert got["a"].summary.split("\n")[:4] == ["DICOM 影像检查", "检查类型:MRI(MR)", "检查日期:2024-02-03", "检查部位:头部"]
    assert got["b"].modality == got["b"].title == "CT" and [got[p].readable for p in "abcde"] == [True, True, False, False, False] and got["c"].title == "c"


def test_headers_after_sequences_of_unstated_length_and_in_other_character_sets(spark):
    head, open_ = b"\0" * 128 + b"DICM", 0xFFFFFFFF
    item = lambda size: struct.pack("<HHI", 0xFFFE, 0xE000, size)
    close = lambda number: struct.pack("<HHI", 0xFFFE, number, 0)
    inner = element(8, 0x60, b"CS", b"XX") + struct.pack("<HH", 8, 0x1199) + b"SQ" + struct.pack("<HI", 0, open_) + item(4) + b"abcd" + close(0xE0DD)
    sequence = struct.pack("<HH", 8, 0x1140) + b"SQ" + struct.pack("<HI", 0, open_) + item(open_) + inner + close(0xE00D) + item(len(inner)) + inner + close(0xE0DD)
    name = lambda charset, raw: head + element(8, 5, b"CS", charset) + element(8, 0x60, b"CS", b"CT") + sequence + element(0x10, 0x10, b"PN", raw) + element(0x20, 0x0D, b"UI", b"1.2\0")
    private = head + element(8, 0x60, b"CS", b"MR") + struct.pack("<HH", 9, 0x10) + b"UN" + struct.pack("<HI", 0, open_) + item(0) + close(0xE0DD) + element(0x20, 0x0D, b"UI", b"9")
    rows = [("gb", name(b"GB18030", "张三".encode("gb18030"))), ("utf", name(b"ISO_IR 192", "张三".encode())), ("two", name(b"\\ISO 2022 IR 58", b"Zhang")), ("latin", name(b"ISO_IR 100", "Müller".encode("latin-1"))), ("none", name(b"", "李四".encode("gb18030"))), ("private", private), ("cut", head + sequence[:-20])]
    got = {r.path: (r.modality, r.patient_name, r.study_uid, r.readable) for r in dicom.headers(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert got == {
        "gb": ("CT", "张三", "1.2", True), "utf": ("CT", "张三", "1.2", True), "two": ("CT", "Zhang", "1.2", True), "latin": ("CT", "Müller", "1.2", True), "none": ("CT", "李四", "1.2", True),
        "private": ("MR", None, "9", True), "cut": (None, None, None, True),
    }


def test_files_beyond_a_bound_keep_their_rows(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.txt", "y.heif", "a/z.txt", "a/b/w.txt", "a/b/v.txt"):
        (tmp_path / name).write_text("检验报告 报告日期:2024-02-03 " + name)
    assert {r.left_out for r in files.read_files(spark, str(tmp_path)).collect()} == {None}
    found = files.read_files(spark, str(tmp_path), most_depth=1, most_files=2)
    assert {r.path.split("/")[-1]: (r.left_out, r.content is None) for r in found.collect()} == {"v.txt": ("depth", True), "w.txt": ("depth", True), "z.txt": (None, False), "x.txt": (None, False), "y.heif": ("count", True)}
    assert {r.path.split("/")[-1]: (r.status, r.mime_type) for r in files.ingest(found).collect()} == {"v.txt": ("left_out", "text/plain"), "w.txt": ("left_out", "text/plain"), "z.txt": ("ingested", "text/plain"), "x.txt": ("ingested", "text/plain"), "y.heif": ("left_out", "image/heic")}


def test_slices_find_the_document_of_their_study(spark):
    rows = [("b", "u", True), ("a", "u", True), ("c", None, True), ("d", "v", True), ("e", None, False)]
    columns = [c for c in dicom.TAGS.values() if c != "study_uid"]
    tags = spark.createDataFrame(rows, "path string, study_uid string, readable boolean").select("*", *(F.lit(None).cast("string").alias(c) for c in columns))
    known = spark.createDataFrame([("v", "old"), (None, "x")], "study_uid string, document string")
    got = {r.path: (r.document, r.new, r.title) for r in dicom.studies(tags, known).collect()}
    assert got == {"a": ("a", True, "a"), "b": ("a", True, "b"), "c": ("c", True, "c"), "d": ("old", False, "d")}


def test_vaults_and_captures(spark):
    some = lambda *rows: spark.createDataFrame(list(rows), "segment string, line_no long, line string")
    mine, theirs = some(("a", 0, "x"), ("b", 0, "yy"), ("b", 1, "z")), some(("a", 0, "x"), ("a", 1, "longer"), ("b", 0, "zzzz"), ("c", 0, "c"))
    assert sorted(map(tuple, vault.merge_segments(mine, theirs).collect())) == [("a", 0, "x"), ("a", 1, "longer"), ("b", 0, "yy"), ("b", 1, "z"), ("c", 0, "c")]
    objects = lambda *rows: spark.createDataFrame([(h, bytearray(c)) for h, c in rows], "hash string, content binary")
    assert sorted((r.hash, bytes(r.content)) for r in vault.merge_objects(objects(("a", b"1")), objects(("a", b"2"), ("b", b"3"))).collect()) == [("a", b"1"), ("b", b"3")]
    body = b"image"
    captures = spark.createDataFrame([("x/report", bytearray(body), "检验报告 姓名:张三 2024-02-03", 0.9), ("y.png", bytearray(b"other"), " ", 0.1), ("z.png", bytearray(b""), "t", None), ("w.png", bytearray(b"third"), "text", 0.5)], "name string, content binary, text string, confidence double")
    hashes = {r.name: r.h for r in captures.select("name", F.sha2("content", 256).alias("h")).collect()}
    known = spark.createDataFrame([(hashes["w.png"], True), (hashes["x/report"], False)], "content_hash string, has_document boolean")
    got = {r.name: r for r in files.ingest_texts(captures, known).collect()}
    assert {n: r.status for n, r in got.items()} == {"report.jpg": "backfilled", "y.png": "stored_no_text", "z.png": "failed", "w.png": "deduped"}
    assert (got["report.jpg"].doc_type, got["report.jpg"].detected_name, got["report.jpg"].dates.start, got["w.png"].text) == ("lab_report", "张三", D(2024, 2, 3), None)


def test_objects_are_kept_by_prefix_and_copies_are_checked(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    contents = [f"content {i}".encode() for i in range(60)]
    hashed = [(hashlib.sha256(c).hexdigest(), bytearray(c)) for c in contents]
    frame = lambda rows: spark.createDataFrame(rows, "hash string, content binary")
    vault.put(frame(hashed[:40] + hashed[:5] + [("a" * 64, bytearray(b"other"))]), one)
    vault.put(frame(hashed[30:]), one)
    assert vault.manifest(spark, one).count() == 60 == spark.read.parquet(one).count()
    wanted = frame(hashed[7:9] + [("b" * 64, bytearray())]).select("hash")
    assert sorted((r.hash, bytes(r.content)) for r in vault.get(spark, one, wanted).collect()) == sorted((h, bytes(c)) for h, c in hashed[7:9])
    vault.put(frame(hashed[:10]), two)
    assert {r.status for r in vault.move_objects(spark, one, two).collect()} == {"ok"} and spark.read.parquet(two).count() == 60
    part = next((tmp_path / "two" / f"prefix={hashed[3][0][:2]}").glob("*.parquet"))
    part.unlink()
    gone = {h for h, _ in hashed if h[:2] == hashed[3][0][:2]} - {r.hash for r in vault.manifest(spark, two).collect()}
    spark.createDataFrame([(hashed[50][0], bytearray(b"poison"), 6, hashed[50][0][:2])], vault.OBJECT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(two)
    told = {r.hash: r.status for r in vault.check(spark, two, vault.manifest(spark, one)).collect()}
    assert {h for h, s in told.items() if s == "missing"} >= gone and told[hashed[50][0]] == "changed" and gone
    assert {r.status for r in vault.move_objects(spark, one, str(tmp_path / "three")).collect()} == {"ok"}


def test_one_entry_for_files_of_any_kind(spark, tmp_path):
    head = b"\0" * 128 + b"DICM"
    image = lambda study, n, day="20240203": head + element(8, 0x20, b"DA", day.encode()) + element(8, 0x60, b"CS", b"MR") + element(0x20, 0x0D, b"UI", study) + element(0x20, 0x13, b"IS", str(n).encode())
    made = {
        "a.txt": "检验报告 报告日期:2024-02-03 血糖 6.8".encode(), "b.txt": b"\xff\xfe", "c.png": b"png", "d.png": b"png2", "e.pdf": b"%PDF", "s1.dcm": image(b"1.2", 1), "s2.dcm": image(b"1.2", 2),
        "t1.dcm": image(b"9.9", 1), "bad.dcm": b"none", "again.txt": "检验报告 报告日期:2024-02-03 血糖 6.8".encode(), "old.png": b"old", "back.txt": "处方 2024-03-04 阿司匹林".encode(),
    }
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    sha = lambda name: hashlib.sha256(made[name]).hexdigest()
    known = spark.createDataFrame([(sha("old.png"), True), (sha("back.txt"), False)], "content_hash string, has_document boolean")
    studies = spark.createDataFrame([("9.9", "elsewhere")], "study_uid string, document string")
    found = files.read_files(spark, str(tmp_path))
    base = found.first().path.rsplit("/", 1)[0]
    captures = spark.createDataFrame([(f"{base}/c.png", "病理报告 2024-05-06", 0.7), (f"{base}/d.png", " ", 0.1)], "path string, text string, confidence double")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.ingest_all(found, known, studies, captures).collect()}
    assert {n: r.status for n, r in got.items()} == {
        "a.txt": "new", "again.txt": "deduped", "b.txt": "stored_no_text", "c.png": "new", "d.png": "stored_no_text", "e.pdf": "stored_no_text", "s1.dcm": "new", "s2.dcm": "instance_attached",
        "t1.dcm": "instance_attached", "bad.dcm": "failed", "old.png": "deduped", "back.txt": "backfilled",
    }
    assert got["s2.dcm"].document == got["s1.dcm"].path and got["t1.dcm"].document == "elsewhere" and got["old.png"].document is None
    assert (got["s1.dcm"].doc_type, got["s1.dcm"].title, got["s1.dcm"].dates.start, "检查类型:MRI(MR)" in got["s1.dcm"].text) == ("imaging_report", "MR", D(2024, 2, 3), True)
    assert (got["c.png"].confidence, got["c.png"].dates.start, got["a.txt"].doc_type, got["a.txt"].confidence, got["d.png"].title) == (0.7, D(2024, 5, 6), "lab_report", None, "d.png")
