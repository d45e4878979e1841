"""Ordered folds over groups that need not fit in memory: rows stream through in order, a group's state is all that is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, group: str, order: list[str], begin: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Each group's rows in ``order``, in parts, through a function that ``begin`` makes anew for the group.

    The function keeps what it needs between parts of its group.  A group is
    folded by one task, as its steps depend on each other, but never gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for pdf in batches:
            for key, part in pdf.groupby(group, sort=False, dropna=False):
                if step is None or key != last:
                    last, step = key, begin()
                yield step(part.reset_index(drop=True))

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)
