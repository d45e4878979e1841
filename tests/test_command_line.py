from chartloom import __main__ as cli
from chartloom.sources import log


def test_import_search_and_timeline(spark, tmp_path, capsys):
    folder, record = tmp_path / "in", str(tmp_path / "record")
    folder.mkdir()
    (folder / "a.txt").write_text("检验报告 报告日期:2024-02-03 血糖 6.8 mmol/L glucose")
    (folder / "b.txt").write_text("处方 报告日期:2024-03-04 阿司匹林 100mg 每日一次 bottle")
    (folder / "c.png").write_bytes(b"\x89PNG")
    assert {r.path.split("/")[-1]: r.status for r in cli.take(spark, str(folder), record).collect()} == {"a.txt": "ingested", "b.txt": "ingested", "c.png": "metadata_only"}
    (folder / "d.txt").write_text((folder / "a.txt").read_text())
    (folder / "e.txt").write_text("门诊病历 就诊日期:2024-01-02 glucose normal today")
    assert {r.path.split("/")[-1]: r.status for r in cli.take(spark, str(folder), record).collect()} == {"a.txt": "duplicate", "b.txt": "duplicate", "c.png": "duplicate", "d.txt": "duplicate", "e.txt": "ingested"}
    assert [tuple(r) for r in cli.timeline(spark, record).collect()] == [("2024-03-04", "处方", "b.txt"), ("2024-02-03", "化验", "a.txt"), ("2024-01-02", "病历", "e.txt"), ("无日期", "未分类", "c.png")]
    assert {r.title for r in cli.search(spark, record, "GLUCOSE").collect()} == {"a.txt", "e.txt"}
    lines = spark.read.schema(log.ENTRY).parquet(f"{record}/log")
    assert {r.status for r in log.verify(lines).collect()} == {"ok"} and lines.count() == 8 + 3
