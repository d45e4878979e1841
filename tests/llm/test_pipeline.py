import os
import random

import corpus_pipeline
from chartloom.llm import sentencepiece_sampling
from tests.llm.test_quality_rules import brute as counts
from tests.llm.test_simhash import brute_components, brute_fingerprint


def write(spark, folder):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijk", k=rng.randrange(3, 8))) for _ in range(500)]
    good = [" ".join(rng.choices(words, k=rng.randrange(60, 200))) for _ in range(60)]
    bad = [" | ".join(rng.choices(words, k=60)) for _ in range(30)]
    item = " ".join(rng.choices(words, k=20))
    extra = [good[0], good[1] + " end", item + " " + " ".join(rng.choices(words, k=30)), good[5] + " password=abcdef0123456789abcdef ok", None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(good + bad + extra)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_do_what_brute_force_does(spark, tmp_path):
    folder = str(tmp_path)
    rows = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept, seen = [r[0] for r in rows if r[0] < 60 or 90 <= r[0] < 94], {}
    assert all(counts(rows[i][1])[0] >= 10 for i in kept)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        seen[name] = docs
        assert name == "sentencepiece" or docs.columns == columns
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert ids("quality_rules") == kept
    groups = brute_components({i: brute_fingerprint(rows[i][1]) for i in kept})
    assert ids("simhash_near_dedup") == sorted(set(groups.values()))
    left = [i for i in sorted(set(groups.values())) if i != 92]
    assert ids("benchmark_decontamination") == left
    texts = {r.doc_id: r.text for r in seen["secret_scans"].collect()}
    assert sorted(texts) == left
    for i, t in texts.items():
        assert t == rows[i][1].replace("password=abcdef0123456789abcdef", "<secret>")
    decoded = sentencepiece_sampling.decode(seen["sentencepiece"]).collect()
    assert {r.doc_id for r in decoded} == set(left) and all(r.text == texts[r.doc_id] for r in decoded)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.collect())) == sorted(map(str, seen["sentencepiece"].collect()))
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    left = {p for p in os.listdir(shared) if p.startswith("chartloom-")}
    run = corpus_pipeline.run(spark, folder)
    assert len({p for p in os.listdir(shared) if p.startswith("chartloom-")} - left) == 1  # the result's own table


def test_clashing_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    rows = write(spark, folder)
    names = ("_s", "_f", "_r", "_j", "base", "kept", "_id", "_hash", "contaminated", "n_words", "n_ip", "root", "fp", "h", "place", "label", "judged", "scanned")
    wide = [(*r, *(f"{n}{r[0]}" for n in names)) for r in rows]
    wide += [wide[0], wide[0], (None, rows[3][1] + " and more", None, None, None, *(None for _ in names))]
    documents = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema == documents.schema, name
        docs.write.parquet(f"{folder}/wide-{name}")
        docs = spark.read.schema(documents.schema).parquet(f"{folder}/wide-{name}")
    got = {r.doc_id: r for r in docs.collect()}
    assert docs.count() == len(got) and 0 in got and all(r[n] == f"{n}{i}" for i, r in got.items() if i is not None for n in names)
    plain = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i for i in got if i is not None} == plain
    empty = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.collect() == [], name
        empty = empty.limit(0) if name == "sentencepiece" else documents.limit(0)
