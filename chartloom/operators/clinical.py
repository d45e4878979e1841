"""Folds over documents: series, medication spans, problems and what is notable about them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.folds import ordered_fold
from chartloom.operators.records import top_k


def series(points: DataFrame, group: list[str], date: str, value: str, position: list[str]) -> DataFrame:
    """(group, n_points, points, any_abnormal): points are (date, value) in order; needs a flag column."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(date).isNull().alias("undated"), F.col(date).alias("date"), *position, F.col(value).alias("value"))))
    return points.groupBy(*group).agg(
        F.count("*").alias("n_points"), F.transform(ordered, lambda p: F.struct(p["date"].alias("date"), p["value"].alias("value"))).alias("points"),
        F.coalesce(F.bool_or(F.col("flag").isin("H", "L")), F.lit(False)).alias("any_abnormal"),
    )


def named(rows: DataFrame, group: list[str], raw: str, canonical: str, key: str, position: list[str], codes: list[str]) -> DataFrame:
    """(group, name, codes): canonical name and codes of the first row that has a key, else the first row's raw name and no codes."""
    order = F.struct(*position)
    first = F.min_by(F.struct(F.coalesce(canonical, raw).alias("name"), *codes), F.when(F.col(key).isNotNull(), order))
    found = rows.groupBy(*group).agg(first.alias("_f"), F.min_by(raw, order).alias("_raw"))
    return found.select(*group, F.coalesce("_f.name", "_raw").alias("name"), *(F.col(f"_f.{c}").alias(c) for c in codes))


def any_abnormal(points: DataFrame, group: list[str], flag: str = "flag") -> DataFrame:
    """(group, any_abnormal): whether any point is high or low."""
    return points.groupBy(*group).agg(F.coalesce(F.bool_or(F.col(flag).isin("H", "L")), F.lit(False)).alias("any_abnormal"))


def unattached(rows: DataFrame, attached: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no problem has claimed."""
    return rows.join(attached.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, group: list[str], date: str, position: list[str], values: list[str], where: Column | None = None) -> DataFrame:
    """The values of the latest row of each group; undated rows come first, of equal dates the earliest row counts."""
    order = F.struct(F.col(date).isNotNull(), date, *(-F.col(p) for p in position))
    kept = rows if where is None else rows.where(where)
    return kept.groupBy(*group).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*group, "_v.*")


def spans(rows: DataFrame, group: list[str], date: str, position: list[str], dose: str, source: str) -> DataFrame:
    """(group, start, end, dose, sources): the dose of the latest mention, even if it has none."""
    order = F.struct(F.col(date).isNotNull(), date, *(-F.col(p) for p in position))
    return rows.groupBy(*group).agg(F.min(date).alias("start"), F.max(date).alias("end"), F.max_by(F.struct(dose), order).alias("_d"), F.array_sort(F.collect_set(source)).alias("sources")).select(*group, "start", "end", F.col(f"_d.{dose}").alias("dose"), "sources")


def conditions(found: DataFrame, group: list[str], text: str, date: str, icd: str, position: list[str]) -> DataFrame:
    """(group, text, onset, icd_code, sources): each exact trimmed text once, with its earliest date and the first code that any mention has."""
    rows = found.withColumn(text, T.trimmed(F.col(text))).where(F.col(text) != "")
    first_code = F.min_by(icd, F.when(F.col(icd).isNotNull(), F.struct(*position))).alias("icd_code")
    return rows.groupBy(*group, text).agg(F.min(date).alias("onset"), first_code, F.array_sort(F.collect_set(position[0])).alias("sources"))


def merge_problems(conditions: DataFrame, key: Column, term: str, onset: str, source: str, group: list[str] | None = None, icd: str | None = None) -> DataFrame:
    """(group, key, term, onset, sources, icd_code): the shortest mention, then the least, stands for the problem.

    ``source`` may be an array of sources.  With ``icd`` the code of the earliest
    mention that has one is the problem's.
    """
    group, rows = group or [], conditions
    if conditions.schema[source].dataType.typeName() != "array":
        rows = rows.withColumn(source, F.when(F.col(source).isNotNull(), F.array(source)))
    parts = [F.min_by(term, F.struct(F.length(term), term)).alias("term"), F.min(onset).alias("onset"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(source)))).alias("sources")]
    if icd:
        parts.append(F.min_by(icd, F.when(F.col(icd).isNotNull(), F.struct(F.col(onset).isNull(), onset, term))).alias("icd_code"))
    return rows.groupBy(*group, key.alias("key")).agg(*parts)


def matched_disease(condition: Column, diseases: list[str]) -> Column:
    """The first disease that contains the condition or is contained in it."""
    text, found = F.trim(condition), F.lit(None).cast("string")
    for d in reversed(diseases):
        found = F.when(text.contains(d) | F.lit(d).contains(text), d).otherwise(found)
    return F.when(text != "", found)


def attach_by_prefix(codes: DataFrame, prefixes: DataFrame, code: str, prefix: str) -> DataFrame:
    """``codes`` with each of ``prefixes`` that begins them; a trailing * is no part of a prefix and an empty one matches nothing.

    Joined on the prefix itself, once for each length of prefix that occurs.
    """
    clean = prefixes.withColumn("_prefix", F.regexp_replace(prefix, r"\*+$", "")).where(F.col("_prefix") != "")
    lengths = sorted(r[0] for r in clean.select(F.length("_prefix")).distinct().collect())  # as many as code lengths
    found = codes.select("*", F.explode(F.array_distinct(F.array(*(F.substring(code, 1, n) for n in lengths)))).alias("_begin")) if lengths else codes.withColumn("_begin", F.lit(None).cast("string")).limit(0)
    return found.join(clean, F.col("_begin") == F.col("_prefix")).drop("_begin", "_prefix")


def ends(points: DataFrame, group: list[str], date: str, position: list[str], values: list[str]) -> DataFrame:
    """(group, first, last, n): the values of the first and last dated points, or of the first and last where none is dated."""
    at = F.struct(*position)
    first, last = F.struct(F.col(date).isNull(), date, at), F.struct(F.col(date).isNotNull(), date, at)
    return points.groupBy(*group).agg(F.min_by(F.struct(*values), first).alias("first"), F.max_by(F.struct(*values), last).alias("last"), F.count("*").alias("n"))


def notable(points: DataFrame, group: list[str], series_key: str, date: str, value: str, position: str | list[str], k: int = 4, flag: str | None = None) -> DataFrame:
    """The k series of each group, of two points or more, that change most between their first and last points, with ``first``, ``last`` and ``rank``.

    With a ``flag`` those come first of which one end is high or low and the other
    isn't; then the relative change decides, then the key.
    """
    found = ends(points, [*group, series_key], date, [position] if isinstance(position, str) else position, [value, *([flag] if flag else [])]).where("n >= 2")
    off = lambda c: F.coalesce(F.col(f"{c}.{flag}").isin("H", "L"), F.lit(False)) if flag else F.lit(False)
    first, last = F.col(f"first.{value}"), F.col(f"last.{value}")
    change = F.abs(last - first)
    ranked = found.select(*group, series_key, first.alias("first"), last.alias("last"), "n", (off("first") != off("last")).alias("crossed"), F.when(first == 0, change).otherwise(change / F.abs(first)).alias("change"))
    return top_k(ranked, group, [F.desc("crossed"), F.desc("change"), F.asc(series_key)], k)


def share_tiers(studies: DataFrame, group: str, position: list[str], size: str, study_cap: int, total_cap: int) -> DataFrame:
    """Each study's tier: image where it is over its cap or would take the running total over the other; only full ones add to the total.

    The total skips what is degraded, so a group is folded in order; its rows
    stream through, only the total is kept.
    """

    def begin():
        total = 0

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal total
            tiers = []
            for n in pdf[size].tolist():
                full = n is not None and n == n and n <= study_cap and total + n <= total_cap
                total += int(n) if full else 0
                tiers.append("full" if full else "image")
            return pdf[[group, *position]].assign(tier=tiers)

        return step

    rows = studies.select(group, *position, size)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered_fold(rows, group, position, begin, ", ".join(f"{c} {kinds[c]}" for c in (group, *position)) + ", tier string")


def has_content(summary: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | (F.coalesce(F.size(summary[p]), F.lit(0)) > 0)
    return found
