import random

from pyspark.sql import functions as F

from chartloom.operators import replay
from chartloom.sources import log
from chartloom.streaming.projection import KEYS, Projection
from tests.test_log import document_added, event, file_added, lines_of, objects, page_added, sha


def slice_added(device, seq, ts, document, name):
    return event(device, seq, ts, "ImagingInstanceAdded", document_ref={"source_file_hash": sha(document)}, source_file_hash=sha(name), study_uid=f"u{seq}", created_at=ts)


def made_up(rng, n):
    names = [f"f{i}" for i in range(25)]
    out = []
    for seq in range(1, n):
        device, ts, name = rng.choice("ab"), f"2024-01-{rng.randrange(1, 28):02}T00:00:00Z", rng.choice(names)
        kind = rng.random()
        if kind < 0.35:
            out.append(file_added(device, seq, ts, name))
        elif kind < 0.6:
            out.append(document_added(device, seq, ts, name, f"t{seq}"))
        elif kind < 0.75:
            out.append(page_added(device, seq, ts, name, 1, rng.choice(["text one", "text two", "none"])))
        elif kind < 0.93:
            out.append(slice_added(device, seq, ts, name, rng.choice(names)))
        else:
            out.append(event(device, seq, ts, "DocumentDeleted", source_file_hash=sha(name), deleted_at=ts))
    return out


def rows(table):
    kept = [c for c in table.columns if c not in ("segment", "line_no", "line", "hash")]
    return sorted(map(str, map(tuple, table.select(*sorted(kept)).collect())))


def test_steps_keep_the_tables_of_the_whole_log(spark, tmp_path):
    events = made_up(random.Random(4), 90)
    kept = Projection(spark, str(tmp_path), buckets=8)
    parts = [events[:30], events[30:31], events[31:60], events[31:60], events[60:]]
    for number, part in zip((0, 1, 2, 2, 3), parts, strict=True):
        kept.step(log.parse(lines_of(spark, part)), objects(spark), number)
    whole = replay.project(log.parse(lines_of(spark, events)), objects(spark))
    for name in KEYS:
        assert rows(kept.table(name)) == rows(whole[name]), name
    assert all(whole[name].count() for name in KEYS)


def test_a_step_reads_what_it_touches(spark, tmp_path):
    kept = Projection(spark, str(tmp_path), buckets=64)
    many = [e for i in range(150) for e in (file_added("a", 2 * i + 1, "2024-01-01T00:00:00Z", f"f{i}"), document_added("a", 2 * i + 2, "2024-01-02T00:00:00Z", f"f{i}", f"t{i}"))]
    kept.step(log.parse(lines_of(spark, many)), objects(spark), 0)
    kept.read.clear()
    kept.step(log.parse(lines_of(spark, [slice_added("a", 900, "2024-01-03T00:00:00Z", "f3", "f4")])), objects(spark), 1)
    assert max(len(b) for _, b in kept.read) <= 2 and {n for n, _ in kept.read} == {"events", *KEYS}
    assert [(r.source_file_hash, r.study_uid) for r in kept.table("document").where("study_uid IS NOT NULL").collect()] == [(sha("f3"), "u900")]
    read = kept._some("events", kept.spark.read.parquet(f"{tmp_path}/events").schema, kept.read[0][1])
    assert len(read.inputFiles()) <= 4 < len(spark.read.parquet(f"{tmp_path}/events").inputFiles())
    # the last document of its bucket goes
    kept.step(log.parse(lines_of(spark, [event("a", 901, "2024-01-04T00:00:00Z", "DocumentDeleted", source_file_hash=sha("f3"), deleted_at="x")])), objects(spark), 2)
    left = kept.table("document")
    assert left.where(F.col("source_file_hash") == sha("f3")).count() == 0 and left.count() == 149
