"""Row numbers over a whole table, without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's place, from 1, in ``order`` over the whole table.

    ``bucket`` is a coarse key that rises with the order.  Rows are numbered within
    buckets and moved by the number of rows in earlier buckets; only the buckets'
    counts, one row each, are ordered in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(
        F.col("_bucket").alias("_b"),
        (F.sum("_n").over(Window.orderBy(F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    joined = inside.join(before, F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)
