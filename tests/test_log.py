import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from chartloom.operators import replay
from chartloom.sources import files, log
from chartloom.streaming import ingest

KEY = b"k" * 32


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def event(device, seq, ts, type, **fields):
    return {"event_id": "e", "seq": seq, "ts": ts, "device_id": device, "type": type, **fields}


def file_added(device, seq, ts, name):
    return event(device, seq, ts, "FileImported", content_hash=sha(name), original_name=name, mime_type="text/plain", byte_size=3, imported_at=ts)


def document_added(device, seq, ts, name, title):
    return event(device, seq, ts, "DocumentAdded", source_file_hash=sha(name), doc_type="unknown", title=title, page_count=1, created_at=ts)


def page_added(device, seq, ts, name, page, text):
    return event(device, seq, ts, "OcrAdded", document_ref={"source_file_hash": sha(name)}, page_no=page, backend="text", model_version="1", text_hash=sha(text), created_at=ts)


EVENTS = [
    file_added("a", 1, "2024-01-01T00:00:00Z", "f1"), document_added("a", 2, "2024-01-01T00:00:01Z", "f1", "first"), page_added("a", 3, "2024-01-01T00:00:02Z", "f1", 1, "text one"),
    file_added("b", 1, "2024-01-02T00:00:00Z", "f1"), document_added("b", 2, "2024-01-02T00:00:01Z", "f1", "second"), page_added("b", 3, "2024-01-02T00:00:02Z", "f1", 1, "text two"),
    file_added("b", 4, "2024-01-03T00:00:00Z", "f2"), event("a", 4, "2023-01-01T00:00:00Z", "DocumentDeleted", source_file_hash=sha("f2"), deleted_at="x"), document_added("b", 5, "2024-01-03T00:00:01Z", "f2", "gone"),
    document_added("a", 5, "2024-01-04T00:00:00Z", "f9", "dangling"), page_added("a", 6, "2024-01-05T00:00:00Z", "f1", 2, "missing text"), page_added("a", 7, "2024-01-06T00:00:00Z", "f1", 3, "poisoned text"),
]


def lines_of(spark, events):
    rows = [(e["device_id"] + ".jsonl", i, json.dumps(e)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "segment string, line_no long, line string")


def objects(spark):
    rows = [(sha("text one"), b"text one"), (sha("text two"), b"text two"), (sha("poisoned text"), b"other bytes")]
    return spark.createDataFrame([(h, bytearray(c)) for h, c in rows], "hash string, content binary")


def tables(spark, lines):
    made = replay.project(log.parse(lines), objects(spark))
    keep = {"source_file": ["content_hash", "original_name", "device_id"], "document": ["source_file_hash", "title"], "ocr_result": ["source_file_hash", "page_no", "text"], "deferred": ["device_id", "seq", "waits_for"]}
    return {k: sorted(map(tuple, made[k].select(*c).collect())) for k, c in keep.items()}


def test_projection(spark):
    got = tables(spark, lines_of(spark, EVENTS))
    assert got["source_file"] == sorted([(sha("f1"), "f1", "a"), (sha("f2"), "f2", "b")])
    assert got["document"] == [(sha("f1"), "first")]
    assert got["ocr_result"] == [(sha("f1"), 1, "text one")]
    assert got["deferred"] == [("a", 5, "file"), ("a", 6, "object")]


def test_projection_does_not_depend_on_order(spark):
    want = tables(spark, lines_of(spark, EVENTS))
    for seed in (1, 2):
        shuffled = EVENTS[:]
        random.Random(seed).shuffle(shuffled)
        assert tables(spark, lines_of(spark, shuffled + shuffled[:4])) == want


def sealed(spark, key=KEY):
    own = [file_added("a", i, f"2024-01-0{i}T00:00:00Z", f"f{i}") for i in range(1, 7)]
    return sorted(log.seal(lines_of(spark, own), key).collect(), key=lambda r: r.line_no)


def statuses(spark, lines, key=KEY):
    frame = spark.createDataFrame([("a.jsonl", i, line) for i, line in enumerate(lines)], "segment string, line_no long, line string")
    return [r.status for r in sorted(log.verify(frame, key).collect(), key=lambda r: r.line_no)]


def test_chain_verification_takes_up_again_after_a_break(spark):
    whole = [r.line for r in sealed(spark)]
    assert statuses(spark, whole) == ["ok"] * 6
    assert statuses(spark, whole[:2] + whole[3:]) == ["ok", "ok", "broken_chain", "ok", "ok"]
    forged = whole[:2] + [whole[2].replace("f3", "fX")] + whole[3:]
    assert statuses(spark, forged) == ["ok", "ok", "bad_mac", "ok", "ok", "ok"]
    assert statuses(spark, whole[:3] + ["{torn"] + whole[3:])[3] == "unreadable"
    assert statuses(spark, [whole[1], whole[0]], None) == ["broken_chain", "ok"]


def test_watermarks(spark):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "device_id string, seq long")
    marks = spark.createDataFrame([("a", 1)], "device_id string, applied long")
    assert sorted(map(tuple, replay.pending(events, marks).collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, replay.advanced(events).collect())) == [("a", 2), ("b", 1)]


def test_folder_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    long = "检验报告 报告日期:2024-02-03 血糖 6.8 mmol/L"
    for name, body in {"a.txt": long, "sub/b.txt": long, "c.txt": "短", ".hidden.txt": long, "d.part": long, "e.pdf": "%PDF"}.items():
        (tmp_path / name).write_text(body)
    found = files.read_files(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: (r.status, r.doc_type) for r in files.ingest(found).collect()}
    assert got == {"a.txt": ("ingested", "lab_report"), "b.txt": ("duplicate", "lab_report"), "c.txt": ("metadata_only", "unknown"), "e.pdf": ("metadata_only", None)}
    assert files.objects(found).count() == 3


def test_steps_see_appended_lines_and_give_the_tables_of_the_whole_log(spark, tmp_path):
    folder, seen = tmp_path / "log", {}
    folder.mkdir()

    def derived(made, number):
        document = sorted(map(tuple, made["document"].select("source_file_hash", "title").collect()))
        ocr = sorted(map(tuple, made["ocr_result"].select("source_file_hash", "page_no", "text").collect()))
        seen.update(document=document, ocr=ocr)

    want = tables(spark, lines_of(spark, EVENTS))
    links = {}

    def chained(name, events):
        out = []
        for e in events:
            line, links[name] = log._sealed(e, links.get(name, "0" * 64), None)
            out.append(line)
        return "\n".join(out)

    for part, (name, some) in enumerate((("b", EVENTS[6:]), ("a", EVENTS[3:5]), ("a", EVENTS[5:6] + EVENTS[:3]))):
        with (folder / f"{name}.jsonl").open("a") as f:
            f.write(chained(name, some) + "\n\n")
        ingest.sync(spark, str(folder), str(tmp_path / "table"), objects(spark), derived, part)
    assert seen == {"document": want["document"], "ocr": want["ocr_result"]}
    with (folder / "c.jsonl").open("w") as f:
        f.write(chained("c", (file_added("c", 1, "2024-02-01T00:00:00Z", "f3"), document_added("c", 2, "2024-02-01T00:00:01Z", "f3", "third"))) + "\n")
    query = ingest.start(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "checkpoint"), objects(spark), derived, changed_only=True, processingTime="1 second")
    for _ in range(60):
        if seen["document"] == [(sha("f3"), "third")]:
            break
        time.sleep(1)
    query.stop()
    assert seen == {"document": [(sha("f3"), "third")], "ocr": []}


def test_lines_of_a_segment_are_numbered_in_file_order(spark, tmp_path):
    body = [f'{{"n": {i}}}' if i % 5 else "" for i in range(3000)]
    (tmp_path / "s.jsonl").write_text("\n".join(body) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r.line_no: r.line for r in log.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: x for i, x in enumerate(body) if x}


def test_a_slice_waits_for_its_file_and_its_document(spark):
    def slice_added(seq, document, name):
        return event("a", seq, f"2024-01-01T00:00:0{seq}Z", "ImagingInstanceAdded", document_ref={"source_file_hash": sha(document)}, source_file_hash=sha(name), study_uid=f"u{seq}")

    events = [file_added("a", 1, "2024-01-01T00:00:00Z", "f1"), document_added("a", 2, "2024-01-01T00:00:01Z", "f1", "d"), slice_added(3, "f1", "f1"), slice_added(4, "f1", "f8"), slice_added(5, "f9", "f1"), slice_added(6, "f1", "f1")]
    made = replay.project(log.parse(lines_of(spark, events)), objects(spark))
    assert [(r.slice_hash, r.study_uid) for r in made["imaging_instance"].collect()] == [(sha("f1"), "u3")]
    assert sorted((r.seq, r.waits_for) for r in made["deferred"].collect()) == [(4, "file"), (5, "document")]
    assert made["document"].first().study_uid == "u3"
    assert [r.id for r in replay.ids(made["document"]).collect()] == [1]


def test_appending_and_migrating_segments(spark):
    own = [json.dumps(file_added("a", i, f"2024-01-0{i}T00:00:00Z", f"f{i}")) for i in range(1, 5)]
    rows = lambda name, lines: spark.createDataFrame([(name, i, x) for i, x in enumerate(lines)], "segment string, line_no long, line string")
    first = log.seal(rows("a", own[:2]), KEY)
    more = log.append(first, rows("a", own[2:]).unionByName(rows("b", own[:1])), KEY)
    whole = first.unionByName(more)
    assert sorted((r.segment, r.line_no, r.status) for r in log.verify(whole, KEY).collect()) == [("a", i, "ok") for i in range(4)] + [("b", 0, "ok")]
    torn = rows("end", own + ["{torn"]).unionByName(rows("inside", [own[0], "{torn", own[1]])).unionByName(first)
    sealed, segments = log.migrate(torn, KEY)
    assert {r.segment: r.status for r in segments.collect()} == {"end": "sealed", "inside": "aborted", "a": "kept"}
    assert sorted((r.segment, r.line_no, r.status) for r in log.verify(sealed, KEY).collect()) == [("end", i, "ok") for i in range(4)]
    assert log.next_seq(log.parse(torn)).first().next_seq == 5


def marks_of(spark, events, watermarks=(), files=(), documents=()):
    known = lambda names: spark.createDataFrame([(sha(n),) for n in names], "source_file_hash string")
    parsed = log.parse(lines_of(spark, events))
    marks = spark.createDataFrame(list(watermarks), "device_id string, applied long")
    applied, deferred, now = replay.settle(replay.pending(parsed, marks), known(files), known(documents), objects(spark), parsed.where("type = 'DocumentDeleted'"), marks)
    ids = lambda df: sorted((r.device_id, r.seq) for r in df.collect())
    return ids(applied), ids(deferred), {r.device_id: r.applied for r in now.collect()}


def test_a_deferred_event_stops_its_device_and_what_hangs_on_it(spark):
    at = lambda n: f"2024-01-01T00:00:0{n}Z"
    events = [document_added("a", 1, at(0), "f9", "no file"), file_added("a", 2, at(1), "f1"), document_added("b", 1, at(2), "f1", "hangs on a"), file_added("b", 2, at(3), "f2"), file_added("c", 1, at(4), "f3"), document_added("c", 2, at(5), "f3", "fine")]
    assert marks_of(spark, events) == ([("c", 1), ("c", 2)], [("a", 1), ("b", 1)], {"a": 0, "b": 0, "c": 2})
    assert marks_of(spark, events, files=["f9"]) == ([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2)], [], {"a": 2, "b": 2, "c": 2})
    # a higher number with an earlier time was applied first: the mark still stays below the deferred one
    early = [file_added("a", 5, at(0), "f1"), document_added("a", 4, at(1), "f9", "no file"), page_added("a", 6, at(2), "f1", 1, "missing")]
    assert marks_of(spark, early, [("a", 3)]) == ([("a", 5)], [("a", 4)], {"a": 3})
    gone = [event("a", 1, at(9), "DocumentDeleted", source_file_hash=sha("f9"), deleted_at="x"), document_added("a", 2, at(1), "f9", "gone"), page_added("a", 3, at(2), "f9", 1, "missing")]
    assert marks_of(spark, gone) == ([("a", 1), ("a", 2), ("a", 3)], [], {"a": 3})


def test_tables_become_a_log_that_gives_them_again(spark):
    made = replay.project(log.parse(lines_of(spark, EVENTS)), objects(spark))
    events, texts, marks = replay.events_from_tables(made["source_file"], made["document"], made["ocr_result"], "new", "2025-01-01T00:00:00Z")
    again = replay.project(events, texts)
    pick = lambda t: {k: sorted(map(tuple, t[k].select(*c).collect())) for k, c in {"source_file": ["content_hash", "original_name"], "document": ["source_file_hash", "title"], "ocr_result": ["source_file_hash", "page_no", "text"]}.items()}
    assert pick(again) == pick(made) and again["deferred"].count() == 0
    assert [tuple(r) for r in marks.collect()] == [("new", 4)] and sorted(r.seq for r in events.collect()) == [1, 2, 3, 4]
    gone = replay.delete_events(made["document"], spark.createDataFrame([(sha("f1"),), (sha("f7"),)], "source_file_hash string"), "new", "2025-01-02T00:00:00Z", 5)
    assert [(r.type, r.seq, r.source_file_hash) for r in gone.collect()] == [("DocumentDeleted", 5, sha("f1"))]
    assert replay.project(events.unionByName(gone), texts)["document"].count() == 0
    filled = replay.backfill_events(spark.createDataFrame([(sha("f1"), " new ", 0.5), (sha("f1x"), "x", None), (sha("f1"), " ", None)], "source_file_hash string, text string, confidence double"), made["document"], "x", "1", "new", "2025-01-01T00:00:00Z", 5)
    assert [(r.document_ref.source_file_hash, r.text_hash, r.page_no) for r in filled.collect()] == [(sha("f1"), sha("new"), 1)]
    share = replay.export_event(spark, "k", "s", 3, "d", "t", 9, expires="2026").first()
    assert (share.type, share.record_count, share.expires, share.kind) == ("ShareCreated", 3, "2026", None)
    new = spark.createDataFrame([(sha("f1"),), ("x",)], "content_hash string")
    assert sorted((r.content_hash, r.deduped) for r in replay.import_dedup(new, made["source_file"]).collect()) == sorted([(sha("f1"), True), ("x", False)])
    double = spark.createDataFrame([(2, "d", "s"), (1, "d", "s"), (3, "d", "t")], "id int, d string, s string")
    assert sorted(r.id for r in replay.first_slices(double, "id", "d", "s").collect()) == [1, 3]


def test_watched_folders_take_each_file_once(spark, tmp_path):
    inbox, seen = tmp_path / "inbox", []
    inbox.mkdir()
    for name in ("a.txt", ".b.txt", "c.part"):
        (inbox / name).write_text(name)
    take = lambda df, n: seen.extend(r.path.split("/")[-1] for r in df.collect())
    for _ in range(2):
        ingest.watch(spark, str(inbox), str(tmp_path / "done"), str(tmp_path / "checkpoint"), take, str(tmp_path / "letters")).awaitTermination()
        (inbox / "d.txt").write_text("d")
    assert sorted(seen) == ["a.txt", "d.txt"] and sorted(p.name for p in inbox.iterdir()) == [".b.txt", "c.part", "d.txt"]


def test_one_bad_file_leaves_the_others_ingested(spark, tmp_path):
    inbox, done, letters = tmp_path / "inbox", str(tmp_path / "done"), str(tmp_path / "letters")
    inbox.mkdir()
    for i in range(40):
        (inbox / f"{i:02}.txt").write_text("bad" if i == 17 else f"good {i}")
    seen = []

    def take(df, number):
        checked = df.select("path", F.when(F.col("content").cast("string") == "bad", F.raise_error(F.lit("no good"))).otherwise("ingested").alias("status"), F.col("content").cast("string").alias("text"))
        found = checked.collect()
        seen.extend(r.text for r in found)
        return spark.createDataFrame([(r.path, "failed" if r.text == "good 3" else "ingested") for r in found], "path string, status string")

    run = lambda: ingest.watch(spark, str(inbox), done, str(tmp_path / "checkpoint"), take, letters).awaitTermination()
    run()
    told = {r.path.split("/")[-1]: (r.status, r.reason) for r in ingest.letters_of(spark, letters).collect()}
    assert [n for n, (s, _) in told.items() if s == "ingested"] and sorted(n for n, (s, _) in told.items() if s == "failed") == ["03.txt", "17.txt"] and "no good" in told["17.txt"][1]
    assert len(told) == 40 and set(seen) == {f"good {i}" for i in range(40) if i != 17} and sorted(p.name for p in inbox.iterdir()) == ["03.txt", "17.txt"]
    (inbox / "17.txt").write_text("mended")
    (inbox / "40.txt").write_text("new")
    assert ingest.retry(spark, str(inbox), done, take, letters) == 2 and "mended" in seen and "new" not in seen
    run()
    assert "new" in seen and sorted(p.name for p in inbox.iterdir()) == ["03.txt"]
    last = {r.path.split("/")[-1]: r.status for r in ingest.letters_of(spark, letters).orderBy("batch").collect()}
    assert last["17.txt"] == "ingested" and last["03.txt"] == "failed" and last["40.txt"] == "ingested"


def test_written_segments_read_back_whole_and_in_order(spark, tmp_path):
    folder = str(tmp_path)
    rows = lambda name, n: spark.createDataFrame([(name, i, json.dumps(file_added(name, i + 1, "2024-01-01T00:00:00Z", f"{name}{i}"))) for i in range(n)], "segment string, line_no long, line string").repartition(5)
    device = log.seal(rows("own.jsonl", 3), KEY)
    (tmp_path / "own.jsonl").write_text("".join(r.line + "\n" for r in device.orderBy("line_no").collect()))
    for part, names in enumerate((("own.jsonl", "b x=1%.jsonl"), ("b x=1%.jsonl",), ("own.jsonl", "7"))):
        new = log.append(log.read_lines(spark, folder), rows(names[0], 40).unionByName(rows(names[-1], 25 if len(names) > 1 else 0)), KEY)
        new = spark.createDataFrame(new.collect(), new.schema).repartition(7)
        for _ in range(1 + part % 2):  # a job that is run twice adds nothing twice
            log.write(new, folder)
    lines = log.read_lines(spark, folder)
    assert {r.segment: (r.n, r.lo, r.hi) for r in lines.groupBy("segment").agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).collect()} == {"own.jsonl": (83, 0, 82), "b x=1%.jsonl": (65, 0, 64), "7": (25, 0, 24)}
    assert {r.status for r in log.verify(lines, KEY).collect()} == {"ok"}
    assert log.read_lines(spark, folder, log.listing(spark, folder)).count() == 0
    with (tmp_path / "own.jsonl").open("a") as f:
        f.write("{torn")
    assert log.read_lines(spark, folder, log.listing(spark, folder).where("path NOT LIKE '%own.jsonl'")).where("segment = 'own.jsonl'").count() == 4


def test_order_survives_a_large_append(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).selectExpr("CAST(id % 2 AS string) AS segment", "id DIV 2 AS line_no", "concat('{\"n\":', id DIV 2, ',\"pad\":\"', repeat('x', 50), '\"}') AS line").repartition(11)
    log.write(rows, str(tmp_path))
    back = log.read_lines(spark, str(tmp_path)).withColumn("n", F.get_json_object("line", "$.n").cast("long"))
    assert back.where("n = line_no").count() == n


def tampered(rng, steady, devices=3, n=12):
    """Whole segments as lists of lines, some of them edited, forged, dropped, swapped, doubled or torn; objects' texts."""
    out, names = {}, [f"f{i}" for i in range(8)]
    for d in range(devices):
        device, lines, link = f"d{d}", [], "0" * 64
        for seq in range(1, n):
            ts = f"2024-01-{seq if steady else rng.randrange(1, 28):02}T00:00:{rng.randrange(60):02}Z"
            name = rng.choice(names)
            made = file_added(device, seq, ts, name) if steady and seq < 7 else rng.choice([file_added, lambda *a: document_added(*a, f"t{seq}"), lambda *a: page_added(*a, rng.randrange(1, 3), rng.choice(["text one", "text two", "none"]))])(device, seq, ts, name)
            line, link = log._sealed(made, link, KEY)
            lines.append(line)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) - 1)
            kind = rng.randrange(5)
            if kind == 0:
                lines[at] = lines[at].replace('"2024-', '"2025-', 1)
            elif kind == 1:
                del lines[at]
            elif kind == 2:
                lines[at], lines[at + 1] = lines[at + 1], lines[at]
            elif kind == 3:
                lines.insert(at, lines[at])
            else:
                lines.insert(at, lines[at][:40])
        out[f"{device}.jsonl"] = lines
    return out


def picked(made):
    keep = {"source_file": ["content_hash", "device_id", "seq"], "document": ["source_file_hash", "title"], "ocr_result": ["source_file_hash", "page_no", "text"], "deferred": ["device_id", "seq", "waits_for"], "quarantine": ["segment", "line_no", "status"], "watermark": ["device_id", "applied"]}
    return {k: sorted(map(tuple, made[k].select(*c).collect())) for k, c in keep.items() if k in made}


def test_any_split_of_a_tampered_log_gives_the_verified_whole(spark, tmp_path):
    for seed in (1, 2):
        rng, seen = random.Random(seed), {}
        segments = tampered(rng, steady=seed == 1)
        folder, table = tmp_path / f"log{seed}", str(tmp_path / f"table{seed}")
        folder.mkdir()
        whole = spark.createDataFrame([(s, i, x) for s, lines in segments.items() for i, x in enumerate(lines)], "segment string, line_no long, line string")
        verified = log.verify(whole, KEY)
        events = log.parse(verified.where("status = 'ok'"))
        want = picked(replay.project(events, objects(spark)) | {"quarantine": verified.where("status <> 'ok'")})
        written = {s: "".join(x + "\n" for x in lines) for s, lines in segments.items()}
        steps = 3
        for step in range(steps):
            for name, body in written.items():
                # cut anywhere, be it inside a line
                end = len(body) if step == steps - 1 else rng.randrange(len(body) + 1)
                path = folder / name
                if not path.exists() or end > path.stat().st_size:
                    path.write_text(body[:end])
            ingest.sync(spark, str(folder), table, objects(spark), lambda made, _: seen.update(picked(made)), step, key=KEY)
            assert set(seen["quarantine"]) <= set(want["quarantine"])
        marks = seen.pop("watermark")
        assert seen == want and want["quarantine"]
        if seed == 1:
            # the same watermarks as passes over the whole log, as clocks are steady
            known = ingest.Table(spark, table).state("marks", None)
            for _ in range(steps):
                known, _waiting = ingest.advance(events, objects(spark), known)
                known = spark.createDataFrame(known.collect(), known.schema)
            assert marks == sorted(map(tuple, known.select("device_id", "applied").collect())) and any(m for _, m in marks)


def test_a_step_that_broke_off_or_runs_again_adds_nothing_twice(spark, tmp_path):
    folder, table, seen = tmp_path / "log", str(tmp_path / "table"), []
    folder.mkdir()
    rows = sealed(spark)
    (folder / "a.jsonl").write_text("".join(r.line + "\n" for r in rows[:3]))
    take = lambda made, n: seen.append((n, made["source_file"].count()))
    ingest.sync(spark, str(folder), table, objects(spark), take, 5, key=KEY)
    kept = ingest.Table(spark, table)
    kept.put(kept.lines(5).drop("batch"), "lines", 6)  # lines without the state of their step
    (folder / "a.jsonl").write_text("".join(r.line + "\n" for r in rows))
    for step in (7, 7, 8):
        ingest.sync(spark, str(folder), table, objects(spark), take, step, key=KEY)
    assert seen == [(5, 3), (7, 6), (7, 6), (8, 6)] and kept.steps("lines") == [5, 7, 8] and kept.steps("ends") == [7, 8]
    assert kept.lines(8).count() == 6


def test_numbers_are_hashed_as_they_are_spelt(spark):
    page = page_added("a", 1, "2024-01-01T00:00:00Z", "f", 1, "t")
    for number in ("1e-5", "0.00001", "1E16", "0.95", "12345678.0", "-0.0"):
        line = json.dumps(page | {"confidence": 0}).replace('"confidence": 0', f'"confidence": {number}')
        (made,) = log.seal(spark.createDataFrame([("s", 0, line)], "segment string, line_no long, line string"), KEY).collect()
        assert f'"confidence":{number},' in made.line or made.line.endswith(f'"confidence":{number}' + "}")
        assert f'"confidence":{number}' in log.canonical(log._loads(made.line)).decode()
        assert [r.status for r in log.verify(spark.createDataFrame([made]), KEY).collect()] == ["ok"]
