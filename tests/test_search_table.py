import random

import pytest

from chartloom.operators import records
from chartloom.operators.search_table import Index, add, generations


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    words = ["glucose", "blood", "Blood!", "血糖偏高", "糖", "x1", "the", "the", "the", "of", "A-B", "b"]
    rows = [(i * 3, None if i % 50 == 7 else " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.choice(["title the", "血糖", None])) for i in range(1500)]
    rows[1200] = (3600, "unicorn the", None)
    return spark.createDataFrame(rows, "doc_id long, text string, title string").repartition(5)


def test_pages_of_hits_are_those_of_a_scan(spark, pages, tmp_path):
    folder = str(tmp_path)
    later = pages.where("doc_id % 2 = 0 OR doc_id IS NULL")
    assert add(pages.where("doc_id % 2 = 1"), folder, "doc_id", ["text", "title"], 100) == 0 and add(later, folder, "doc_id", ["text", "title"], 100) == 1
    index = Index(spark, folder)
    assert generations(spark, folder) == [0, 1]
    for query in ("the", "THE of", "血糖", "a-b glucose", "血糖偏", "unicorn", "unicorn the", "nothing", " - ", "the the title"):
        for limit in (1, 7, 5000):
            want = [r.doc_id for r in records.search(pages, query, limit, title="title").collect()]
            assert index.find(query, limit) == want, (query, limit)
    assert [r.doc_id for r in index.search("unicorn", 3).collect()] == [3600]


def test_reading_grows_with_the_limit_not_with_the_pages(spark, tmp_path):
    for n, name in ((2000, "small"), (20_000, "large")):
        rows = spark.range(n).selectExpr("id AS doc_id", "concat('the common words', IF(id % 3 = 0, ' of', ''), IF(id = 1900, ' rare', '')) AS text")
        add(rows, str(tmp_path / name), "doc_id", ["text"], 200)
    counts = {}
    for name in ("small", "large"):
        index = Index(spark, str(tmp_path / name))
        for query, limit in (("the of", 20), ("the of", 300), ("rare the", 20)):
            read = []
            assert len(index.find(query, limit, read)) == (1 if "rare" in query else limit)
            counts[name, query, limit] = len(read)
    for query, limit in (("the of", 20), ("the of", 300), ("rare the", 20)):
        assert counts["large", query, limit] <= counts["small", query, limit] + 1 <= 8
    assert counts["large", "rare the", 20] == 1


def test_an_empty_index_finds_nothing(spark, pages, tmp_path):
    assert Index(spark, str(tmp_path / "none")).find("the", 5) == []
    add(pages.limit(0), str(tmp_path / "empty"), "doc_id", ["text"])
    assert Index(spark, str(tmp_path / "empty")).find("the", 5) == []
