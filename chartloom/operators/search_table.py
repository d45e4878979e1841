"""A kept index: postings in groups of neighbouring keys, read group by group until a page of hits is full.

Pages are dealt by ranges of their key; each range is a folder of postings
(token, key, part, places) sorted by token.  A directory has one row for each
token and group, with the number of its postings and their least and greatest
key.  A query looks up in which groups all of its tokens occur, and reads those
in the order of keys, only as many as the limit needs.  Pages that come later
are a generation of their own, with groups of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import records
from chartloom.session import exists, folders

#: Pages of a group; a group's folder is what a query reads at least.
GROUP = 1 << 16


def add(pages: DataFrame, folder: str, key: str, columns: list[str], group: int = GROUP) -> int:
    """Write ``pages`` (key and text columns) as the next generation of the index in ``folder``; its number.

    The texts are shuffled once, by ranges of the key; tokens are counted where
    they are cut.  Pages without a key aren't found.  A generation counts once its
    directory is written.
    """
    spark = pages.sparkSession
    rows = pages.where(F.col(key).isNotNull()).select(key, *columns)
    number = max(generations(spark, folder), default=-1) + 1
    at = f"{folder}/generation={number}"
    n = max(1, -(-rows.count() // group))
    dealt = rows.repartitionByRange(n, key).withColumn("rg", F.spark_partition_id())
    postings = records.postings(dealt, key, columns, "rg").sortWithinPartitions("rg", "token", key)
    postings.write.mode("overwrite").partitionBy("rg").parquet(f"{at}/postings")
    kept = spark.read.schema(postings.schema).parquet(f"{at}/postings")
    directory = kept.groupBy("token", "rg").agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("greatest"))
    directory.repartitionByRange("token").sortWithinPartitions("token", "rg").write.mode("overwrite").parquet(f"{at}/directory")
    return number


def generations(spark: SparkSession, folder: str) -> list[int]:
    return [g for g in folders(spark, folder, "generation") if exists(spark, f"{folder}/generation={g}/directory/_SUCCESS")]


class Index:
    """An index that is open: what its tables look like is known, so a search only reads rows."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id"):
        self.spark, self.folder, self.key = spark, folder, key
        self.open = [(f"{folder}/generation={g}", spark.read.parquet(f"{folder}/generation={g}/directory")) for g in generations(spark, folder)]
        self.kind = self.open[0][1].schema["least"].dataType.simpleString() if self.open else "long"
        self.posting = f"{key} {self.kind}, part int, token string, places array<int>, rg int"

    def find(self, query: str, limit: int, read: list | None = None) -> list:
        """The first ``limit`` keys, in order, of the pages that ``records.search`` would find; ``read`` gets (generation, group) of what is read."""
        tokens = sorted({t for words in records.query_tokens(query) for t in words})
        found = [k for at, directory in self.open for k in self._first(at, directory, query, tokens, limit, read)] if tokens else []
        return sorted(found)[:limit]

    def _first(self, at: str, directory: DataFrame, query: str, tokens: list[str], limit: int, read: list | None) -> list:
        # a row for each token of the query and group: one task, so that nothing is shuffled
        said = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in tokens)
        groups = f"SELECT rg, min(n) AS most FROM (SELECT /*+ COALESCE(1) */ rg, n FROM {{directory}} WHERE token IN ({said}) AND rg > {{after}}) GROUP BY rg HAVING count(*) = {len(tokens)} ORDER BY rg LIMIT {{size}}"
        found, after, size = [], -1, 64
        while len(found) < limit:
            listed = self.spark.sql(groups, directory=directory, after=after, size=size).collect()
            more = len(listed) == size
            while listed and len(found) < limit:
                # as many groups as may fill the page, were every posting of the rarest token a hit
                take, most = 0, 0
                while take < len(listed) and most < limit - len(found):
                    most += listed[take].most
                    take += 1
                some, listed = [r.rg for r in listed[:take]], listed[take:]
                if read is not None:
                    read += [(at, g) for g in some]
                postings = self.spark.read.schema(self.posting).option("basePath", f"{at}/postings").parquet(*(f"{at}/postings/rg={g}" for g in some))
                postings = postings.where(F.col("token").isin(*tokens))
                # a group is what one task may hold
                postings = postings.coalesce(1) if len(some) == 1 else postings
                found += [r[0] for r in records.search_index(postings, query, limit - len(found), self.key).collect()]
                after = some[-1]
            if not more:
                break
            size *= 4
        return found

    def search(self, query: str, limit: int) -> DataFrame:
        """(key) of ``find``, as a table to join documents with."""
        return self.spark.createDataFrame([(k,) for k in self.find(query, limit)], f"{self.key} {self.kind}")
