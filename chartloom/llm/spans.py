"""Spans in texts as arrays of struct(start, end, found), made of built-in functions only.

Positions are code points; ends are exclusive.  Work grows with the length of a
text and n log n with its matches: positions are prefix sums by doubling
(``scanned``), and pieces of a long text are cut from blocks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.llm.base import let

SPAN = "struct<start:int,end:int,found:string>"
MARKED = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Code points of a block; ``substring`` walks a text from its beginning, so a long text is cut into blocks first.
BLOCK = 1024
POWERS = [1 << i for i in range(31)]


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Element i is the combination of elements 0 to i, for an associative ``combine``: log n passes over the array."""
    passes = F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.size(values))
    step = lambda a, p: F.transform(a, lambda v, i: F.when(i >= p, combine(F.get(a, i - p), v)).otherwise(v))
    return F.aggregate(passes, values, step)


def find_all(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern that never matches the empty string.

    The pieces between matches and the matches alternate, so prefix sums of their
    lengths are the positions.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))

    def placed(p: Column) -> Column:
        ends = let(F.transform(p["found"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m)), lambda n: scanned(n, lambda a, b: a + b))
        return let(ends, lambda e: F.transform(p["found"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("found"))))

    return let(parts, placed)


def find_if(test: Column, text: Column, pattern: str, keep=None) -> Column:
    """The matches that ``keep`` accepts, looked for only where ``test`` holds."""
    found = find_all(text, pattern)
    return F.when(test, F.filter(found, keep) if keep else found).otherwise(none())


def mark(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind, in a form whose natural order is start, then rank, then end."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(marked: Column) -> Column:
    """``kind:start:end`` of all spans in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(marked), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _most_end(spans: Column) -> Column:
    return let(F.transform(spans, lambda s: s["end"]), lambda e: scanned(e, lambda a, b: F.greatest(a, b)))


def outside(base: Column, more: Column) -> Column:
    """Those of ``more`` (of higher ranks than all of ``base``) that overlap no span of ``base``."""
    last = max(POWERS)

    def kept(x: Column) -> Column:
        # of both in order: the greatest end of a base span so far, and (seen from the end) the least start of one
        before = lambda e: F.when(e["base"], e["s"]["end"]).otherwise(-1)
        after = lambda e: F.when(e["base"], e["s"]["start"]).otherwise(last)
        ends = let(F.transform(x, before), lambda v: scanned(v, lambda a, b: F.greatest(a, b)))
        starts = let(F.reverse(F.transform(x, after)), lambda v: scanned(v, lambda a, b: F.least(a, b)))
        free = lambda y: F.filter(F.transform(y["x"], lambda e, i: F.struct(
            (~e["base"] & (F.get(y["ends"], i) <= e["s"]["start"]) & (F.get(y["starts"], F.size(y["x"]) - 1 - i) >= e["s"]["end"])).alias("free"), e["s"].alias("s"))), lambda e: e["free"])
        return F.transform(let(F.struct(x.alias("x"), ends.alias("ends"), starts.alias("starts")), free), lambda e: e["s"])

    tagged = lambda spans, own: F.transform(spans, lambda s: F.struct(s.alias("s"), F.lit(own).alias("base")))
    joined = let(F.array_sort(F.concat(tagged(base, True), tagged(more, False))), kept)
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(joined)


def uncovered(base: Column, more: Column) -> Column:
    """Those of ``more`` (of higher ranks than all of ``base``) that no single span of ``base`` contains."""

    def kept(x: Column) -> Column:
        ends = let(F.transform(x, lambda e: F.when(e["base"], e["s"]["end"]).otherwise(-1)), lambda v: scanned(v, lambda a, b: F.greatest(a, b)))
        free = lambda y: F.filter(F.transform(y["x"], lambda e, i: F.struct((~e["base"] & (F.get(y["ends"], i) < e["s"]["end"])).alias("free"), e["s"].alias("s"))), lambda e: e["free"])
        return F.transform(let(F.struct(x.alias("x"), ends.alias("ends")), free), lambda e: e["s"])

    tagged = lambda spans, own: F.transform(spans, lambda s: F.struct(s.alias("s"), F.lit(own).alias("base")))
    joined = let(F.array_sort(F.concat(tagged(base, True), tagged(more, False))), kept)
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(joined)


def merged(marked: Column) -> Column:
    """Disjoint struct(start, end) that cover the same characters, in order; touching spans become one."""

    def runs(x: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x["s"]) - 1), lambda i: (i == 0) | (F.get(x["s"], i)["start"] > F.get(x["e"], i - 1)))
        last = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(x["s"])) - 1
        return let(first, lambda f: F.transform(f, lambda i, j: F.struct(F.get(x["s"], i)["start"].alias("start"), F.get(x["e"], last(f, j)).alias("end"))))

    whole = let(F.array_sort(marked), lambda s: let(F.struct(s.alias("s"), _most_end(s).alias("e")), runs))
    return F.when(F.size(marked) > 0, whole).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def piece(cut: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in ``blocks``."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(cut, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * BLOCK + 1, end - start)).otherwise("")


def replaced(text: Column, marked: Column, by: str) -> Column:
    """The text with each maximal run of marked characters replaced."""

    def build(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["m"], i - 1)["end"]).otherwise(0)
        pieces = F.transform(x["m"], lambda s, i: F.concat(piece(x["b"], before(i), s["start"]), F.lit(by)))
        return F.concat(F.array_join(pieces, ""), piece(x["b"], F.element_at(x["m"], -1)["end"], x["n"]))

    whole = let(F.struct(blocks(text).alias("b"), F.length(text).alias("n"), merged(marked).alias("m")), build)
    return F.when(F.size(marked) > 0, whole).otherwise(text)
