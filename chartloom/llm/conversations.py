"""Conversation structure repair by a time-major dynamic program over numpy tensors.

A conversation's role initials shall read ``(s?(ua)+)?``.  Keeping a row costs 0,
a new role 2, deleting it 3 (blank and repeated rows must go), an empty row of
user or assistant put in anywhere 2, and a truncated row that stays 1 more.  Four
states tell what has been put out so far: nothing, s, u, or an a.

Conversations are bucketed by length.  In a bucket, backward costs of all states
of all conversations are updated turn by turn, from the last; then the cheapest
edits are traced from the first, the least letter first where several are
cheapest (D, I, K, R: delete, insert, keep, rerole).

A conversation of over ``MOST_ROWS`` rows or ``MOST_BYTES`` bytes is not gathered:
its rows are ordered by range over many tasks and cut into chunks, whose costs as
4 x 4 matrices give every chunk the costs behind it, and whose traces from each
state give it the state before it.  Only the hash of its repaired text, which has
to read it in order, streams through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.base import Scratch, join_hot, small

MOST_ROWS = 4096
MOST_BYTES = 1 << 24
#: Rows of a chunk of a long conversation.
CHUNK = 4096
#: Fewer long conversations than this are told to every task, more are joined.
FEW = 10_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 40
FINE, CUT_OFF, BLANK, REPEATED = range(4)
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after an inserted or reroled row, which is an assistant's after a user's and else a user's.
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: What a trace emits: delete, keep, and insert or rerole as user or assistant.
D, K, IU, IA, RU, RA = b"DKiIrR"
LETTERS = bytes.maketrans(b"iIrR", b"IIRR")
ROLE = {IU: "user", IA: "assistant", RU: "user", RA: "assistant"}
SPACE = " \t\n\x0b\x0c\r"
PAD = 16


def code_of(role: str, fault: int) -> int:
    """A row as a number below 16: its role initial (s, u, a, other) and whether it may stay."""
    return "sua".find(role[:1] or "?") % 4 * 4 + fault


def fault_of(text: str, repeated: bool) -> int:
    last = text.rstrip(SPACE)[-1:]
    return BLANK if not last else REPEATED if repeated else FINE if last in ".!?" else CUT_OFF


@lru_cache(1)
def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost of reaching a state by inserts, cost of each code's row from state to state after inserts, state after keeping it or -1)."""
    gap = np.full((4, 4), NEVER, np.int64)
    for x in range(4):
        gap[x, x], y = 0, x
        for n in range(1, 4):
            y = NEXT[y]
            gap[x, y] = min(gap[x, y], n * INSERT)
    kept = np.full((PAD + 1, 4), -1, np.int64)
    rows = np.full((PAD + 1, 4, 4), NEVER, np.int64)
    for code in range(PAD):
        role, fault = divmod(code, 4)
        for x in range(4):
            rows[code, x, x] = DELETE
            if fault > CUT_OFF:
                continue
            stays = TRUNCATED * (fault == CUT_OFF)
            rows[code, x, NEXT[x]] = min(rows[code, x, NEXT[x]], REROLE + stays)
            to = AFTER_S if role == 0 and x == NOTHING else AFTER_U if role == 1 and x != AFTER_U else AFTER_A if role == 2 and x == AFTER_U else -1
            kept[code, x] = to
            if to >= 0:
                rows[code, x, to] = min(rows[code, x, to], KEEP + stays)
    rows[PAD] = np.where(np.eye(4, dtype=bool), 0, NEVER)
    return gap, np.minimum((gap[None, :, :, None] + rows[:, None, :, :]).min(axis=2), NEVER), kept


def ends() -> np.ndarray:
    """The cost of ending a conversation in each state."""
    gap = _steps()[0]
    return np.minimum(gap[:, NOTHING], gap[:, AFTER_A])


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, i, x]: the least cost from row t on of conversation i in state x; codes[t, i], end[i, x]."""
    _, steps, _ = _steps()
    costs = np.empty((len(codes) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        costs[t] = np.minimum((steps[codes[t]] + costs[t + 1][:, None, :]).min(axis=2), NEVER)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: bool | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters[t, slot, i], states after the rows): the cheapest edits from ``state`` on, ties to the least letters.

    Slots 0 to 2 of a row are its inserts and 3 is the row's own letter; 0 is none.
    The row behind all others has the inserts at the end, of conversations that are
    at their ``last`` chunk.
    """
    _, _, kept = _steps()
    n, state = codes.shape[1], state.copy()
    each = np.arange(n)
    letters = np.zeros((len(codes) + 1, 4, n), np.uint8)
    for t in range(len(codes)):
        code, rest = codes[t], costs[t + 1]
        pad, stays = code == PAD, (code % 4 == CUT_OFF) * TRUNCATED
        todo = ~pad
        for slot in range(4):
            best = costs[t][each, state]
            delete = todo & (DELETE + rest[each, state] == best)
            letters[t, 3][delete] = D
            todo &= ~delete
            insert = todo & (INSERT + costs[t][each, NEXT[state]] == best)
            own = todo & ~insert
            to = kept[code, state]
            keep = own & (to >= 0) & (KEEP + stays + rest[each, np.maximum(to, 0)] == best)
            letters[t, 3][keep] = K
            role = own & ~keep
            letters[t, 3][role] = np.where(state[role] == AFTER_U, RA, RU)
            if slot < 3:
                letters[t, slot][insert] = np.where(state[insert] == AFTER_U, IA, IU)
            state = np.where(keep, to, np.where(role | insert, NEXT[state], state))
            todo = insert
            if not todo.any():
                break
    for slot in range(3):
        more = last & (costs[-1][each, state] > 0)
        letters[-1, slot][more] = np.where(state[more] == AFTER_U, IA, IU)
        state = np.where(more, NEXT[state], state)
    return letters, state


def solve(conversations: list[list[int]]) -> list[tuple[int, list[bytes]]]:
    """(least cost, edits of each row and, last, those at the end) of conversations given as codes of their rows."""
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(conversations):
        buckets.setdefault(max(1, 1 << (len(c) - 1).bit_length()) if c else 1, []).append(i)
    out: list = [None] * len(conversations)
    for length, members in buckets.items():
        codes = np.full((length, len(members)), PAD, np.int64)
        for j, i in enumerate(members):
            codes[: len(conversations[i]), j] = conversations[i]
        costs = backward(codes, np.broadcast_to(ends(), (len(members), 4)))
        letters, _ = trace(codes, costs, np.zeros(len(members), np.int64), True)
        for j, i in enumerate(members):
            rows = [bytes(r).replace(b"\0", b"") for r in letters[:, :, j]]
            n = len(conversations[i])
            out[i] = int(costs[0, j, NOTHING]), [*rows[:n], rows[-1]]
    return out


class Report:
    """What the contract of op11 asks of a conversation, from its rows in order; of its texts only a hash is kept."""

    def __init__(self):
        self.first = self.last = self.before = None
        self.turns = self.cost = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.audit: list[bytes] = []
        self.sha, self.begun = hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.begun = True

    def row(self, turn: int | None, role: str, text: str, fault: int, edits: bytes, copies: int = 1) -> None:
        """A row and its ``copies``, of which all but the first are repeated (or blank) and deleted."""
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        pair = (self.before or "") + role[:1]
        self.illegal += self.before is not None and pair not in ("su", "ua", "au")
        self.illegal += copies - 1
        self.before = role[:1]
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else REPEATED] += copies - 1
        self.cost += DELETE * (copies - 1) + (TRUNCATED if fault == CUT_OFF and edits[-1] != D else 0)
        self.edit(edits, role, text)
        self.audit.append(b"D" * (copies - 1))

    def edit(self, edits: bytes, role: str = "", text: str = "") -> None:
        self.audit.append(edits.translate(LETTERS))
        for e in edits:
            self.cost += DELETE if e == D else KEEP if e == K else INSERT if e in (IU, IA) else REROLE
            if e != D:
                self.line(ROLE.get(e, role), "" if e in (IU, IA) else text)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT_OFF], self.illegal, self.cost, b"".join(self.audit).decode(), self.sha.hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "place long, edit string, turn long, role string, text string"


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): one row for each input row; null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows as the contract of op11 damages them; a dropped row has no copies and no text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(name("role")).alias("role"),
        F.when(kind < 2, "").when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _short(rows: DataFrame, report: bool) -> DataFrame:
    """The answers for conversations that a task can hold, by buckets of whole conversations."""

    def answer(held: list[tuple]) -> tuple[list, list[tuple]]:
        convs, made = [], []
        for (conv, found), (_, edits) in zip(held, solve([[code_of(r[1], r[3]) for r in found] for _, found in held]), strict=True):
            if report:
                said = Report()
                for (turn, role, text, fault), e in zip(found, edits, strict=False):
                    said.row(turn, role, text, fault, e)
                said.edit(edits[-1])
                made.append(said.result())
            else:
                kept = [(e, turn, role, text) for (turn, role, text, _), es in zip([*found, (None, "", "", 0)], edits, strict=True) for e in es if e != D]
                made += [(i, bytes([e]).translate(LETTERS).decode(), None if e in (IU, IA) else turn, ROLE.get(e, role), "" if e in (IU, IA) else text) for i, (e, turn, role, text) in enumerate(kept)]
                conv = [conv] * len(kept)
            convs += [conv] if report else conv
        return convs, made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set = set()
        size, kind = 0, None
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 if report else [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [f.split()[0] for f in (RESULT if report else REPAIRED).split(", ")]

        def flush():
            convs, made = answer(held)
            columns = list(zip(*made, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", *names])

        for batch in small(batches):
            kind = batch.schema.field(0).type
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held or held[-1][0] != conv:
                    if size > MOST_BYTES:
                        yield flush()
                        held, size = [], 0
                    held.append((conv, []))
                    seen = set()
                for _ in range(copies):
                    held[-1][1].append((turn, role, text, fault_of(text, (role, text) in seen)))
                    seen.add((role, text))
                size += 256 + copies * len(text)
        if held:
            yield flush()

    return _streamed(rows, ["turn", "role", "text"]).mapInArrow(run, f"conv_id {rows.schema['conv'].dataType.simpleString()}, {RESULT if report else REPAIRED}")


def _streamed(rows: DataFrame, order: list) -> DataFrame:
    """All rows of a conversation in one partition, in order."""
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _numbered(rows: DataFrame, scratch: Scratch, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(distinct rows with copies and rising ids, their chunks and codes): dealt by range, so a conversation is spread over tasks."""
    order = ["conv", "turn", "role", "text"]
    distinct = rows.where("copies > 0").groupBy(*order).agg(F.sum("copies").cast("long").alias("copies"))
    ordered = scratch.store(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    space = r"[^\x20\x09-\x0D]"
    same = F.sha2(F.to_json(F.struct("conv", "role", "text")), 256)
    fault = F.when(~F.col("text").rlike(space), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(CUT_OFF)
    facts = ordered.select("conv", "id", same.alias("same"), fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    firsts = facts.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    marked = join_hot(facts, firsts, "same", "n", ordered.count())
    fault = F.when((F.col("fault") != BLANK) & (F.col("id") > F.col("first")), REPEATED).otherwise(F.col("fault"))
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    codes = scratch.store(marked.select("conv", "id", F.floor(F.col("id") / chunk).alias("chunk"), (role * 4 + fault).alias("code")))
    return ordered, codes


def _padded(lists: list[list[int]]) -> np.ndarray:
    codes = np.full((max(map(len, lists)), len(lists)), PAD, np.int64)
    for j, c in enumerate(lists):
        codes[: len(c), j] = c
    return codes


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, costs): the least costs of a chunk from state to state, row by row."""
    for batch in small(batches, 32):
        codes = np.repeat(_padded(batch.column(3).to_pylist()), 4, axis=1)
        unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
        costs = backward(codes, np.tile(unit, (len(batch), 1)))[0].reshape(len(batch), 4, 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.T.ravel().tolist() for m in costs], pa.list_(pa.int64()))], ["conv", "chunk", "costs"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, rest, last): the costs behind each chunk, of chunks from the last; only those four are kept between rows."""
    before, rest = object(), None
    for batch in batches:
        out = []
        for conv, chunk, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = conv != before
            before, rest = conv, ends() if last else rest
            out.append((chunk, rest.tolist(), last))
            rest = np.minimum((np.array(costs).reshape(4, 4) + rest).min(axis=1), NEVER)
        chunks, rests, lasts = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.int64()), pa.array(rests, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())], ["conv", "chunk", "rest", "last"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, id, edits, after): for each state before a chunk its rows' edits, space-joined, and the state after it."""
    for batch in small(batches, 32):
        lists = batch.column(3).to_pylist()
        codes = np.repeat(_padded(lists), 4, axis=1)
        rest, last = np.repeat(np.array(batch.column(4).to_pylist()), 4, axis=0), np.repeat(np.array(batch.column(5).to_pylist()), 4)
        letters, after = trace(codes, backward(codes, rest), np.tile(np.arange(4), len(batch)), last)
        said = [[b" ".join(bytes(r).replace(b"\0", b"") for r in [*letters[: len(c), :, 4 * i + x], letters[-1, :, 4 * i + x]]).decode() for x in range(4)] for i, c in enumerate(lists)]
        columns = [*batch.columns[:3], pa.array(said, pa.list_(pa.string())), pa.array(after.reshape(-1, 4).tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "chunk", "id", "edits", "after"])


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, state): the state before each chunk, of chunks from the first."""
    known, state = object(), NOTHING
    for batch in batches:
        out = []
        for conv, after in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            state = state if conv == known else NOTHING
            known = conv
            out.append(state)
            state = after[state]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["conv", "chunk", "state"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each conversation, whose rows stream through in order."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def row(conv: pa.Array, said: Report) -> pa.RecordBatch:
        values = said.result()
        return pa.RecordBatch.from_arrays([conv, *(pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values)], ["conv_id", *names])

    known, name, said = object(), None, None
    for batch in small(batches):
        for i, (conv, turn, role, text, copies, fault, edits, tail) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if conv != known:
                if said is not None:
                    yield row(name, said)
                known, name, said = conv, batch.column(0).slice(i, 1), Report()
            said.row(turn, role, text, fault, edits.encode(), copies)
            said.edit(tail.encode())
    if said is not None:
        yield row(name, said)


def _long(rows: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """(conv, id, turn, role, text, copies, fault, edits, tail): rows of long conversations with their edits and those behind their last row."""
    kind = rows.schema["conv"].dataType.simpleString()
    ordered, codes = _numbered(rows, scratch, chunk)
    listed = F.array_sort(F.collect_list(F.struct("id", "code")))
    chunks = scratch.store(codes.groupBy("conv", "chunk").agg(F.min("id").alias("id"), listed.alias("rows")).select("conv", "chunk", "id", "rows.code"))
    places = ["conv", "chunk"]
    costs = chunks.mapInArrow(_matrices, f"conv {kind}, chunk long, costs array<long>")
    rest = _streamed(costs, [F.desc("chunk")]).mapInArrow(_behind, f"conv {kind}, chunk long, rest array<long>, last boolean")
    met = lambda a, b: a.join(b.withColumnRenamed("conv", "_conv"), (F.col("conv").eqNullSafe(F.col("_conv"))) & (a["chunk"] == b["chunk"])).drop("_conv", b["chunk"])
    traces = scratch.store(met(chunks, rest).select(*places, "id", "code", "rest", "last").mapInArrow(_traces, f"conv {kind}, chunk long, id long, edits array<string>, after array<long>"))
    states = _streamed(traces.select(*places, "after"), ["chunk"]).mapInArrow(_before, f"conv {kind}, chunk long, state int")
    edits = met(traces, states).select("id", F.split(F.get("edits", F.col("state")), " ", -1).alias("edits"))
    n = F.size("edits") - 1
    tail = F.when(F.col("at") == n - 1, F.element_at("edits", -1)).otherwise("")
    each = edits.select("*", F.posexplode(F.slice("edits", 1, n)).alias("at", "edit")).select((F.col("id") + F.col("at")).alias("id"), "edit", tail.alias("tail"))
    faults = codes.select("id", (F.col("code") % 4).alias("fault"))
    return ordered.join(faults, "id").join(each, "id").select("conv", "id", "turn", "role", "text", "copies", "fault", F.col("edit").alias("edits"), "tail")


def _edited(rows: DataFrame) -> DataFrame:
    """The repaired rows of long conversations; ``place`` rises within one."""
    one = F.filter(F.split(F.concat("edits", "tail"), ""), lambda e: (e != "") & (e != "D"))
    each = rows.select("*", F.posexplode(one).alias("at", "e"))
    new = F.col("e").isin("i", "I")
    role = F.when(F.col("e").isin("i", "r"), "user").when(F.col("e").isin("I", "R"), "assistant").otherwise(F.col("role"))
    place = F.col("id") * 8 + F.col("at")
    return each.select(F.col("conv").alias("conv_id"), place.alias("place"), F.upper("e").alias("edit"), F.when(~new, F.col("turn")).alias("turn"), role.alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"))


def _answers(rows: DataFrame, report: bool, most_rows: int, most_bytes: int, chunk: int) -> DataFrame:
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    scratch = Scratch(rows.sparkSession)
    long = scratch.store(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv").alias("_conv")))
    n = long.count()
    if not n:
        scratch.drop()
        return _short(rows, report)
    long = F.broadcast(long) if n <= FEW else long
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    edited = _long(rows.join(long, same, "left_semi"), scratch, chunk)
    if report:
        kind = rows.schema["conv"].dataType.simpleString()
        told = _streamed(edited, ["id"]).select("conv", "turn", "role", "text", "copies", "fault", "edits", "tail").mapInArrow(_told, f"conv_id {kind}, {RESULT}")
    else:
        told = _edited(edited)
    return _short(rows.join(long, same, "left_anti"), report).unionByName(told)


def repair(conversations: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired rows of each conversation (conv_id, turn, role, text, ...).

    Rows are taken by turn (nulls first), then role, then text.  ``place`` rises
    within a conversation, ``edit`` is K, I or R; deleted rows are left out, so a
    conversation of which nothing is left has no row.  Null roles and texts are one
    space, null conv_ids are one conversation; of repeated rows the first may stay.
    Texts are whole, whatever their length; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    return _answers(_rows(conversations), False, most_rows, most_bytes, chunk)


def digest(conversations: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """The columns that the contract of op11 fixes, of the damaged conversations: a row for each original conv_id, null too."""
    return _answers(damaged(conversations), True, most_rows, most_bytes, chunk)


def oracle() -> str:
    """DuckDB SQL of the digest: costs, letters and repaired text of all four states, row by row from the last."""
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    role = ["'user'", "'user'", "'assistant'", "'user'"]

    def entry(cost: str, letter: str, said: str, rest: str) -> str:
        return f"{{'c': {cost} + {rest}.c, 's': '{letter}' || {rest}.s, 't': {said} || {rest}.t}}"

    def own(x: int) -> str:
        rest = lambda y: f"v[{y + 1}]"
        keeps = {NOTHING: "CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 END", AFTER_S: "CASE i WHEN 'u' THEN 3 END", AFTER_U: "CASE i WHEN 'a' THEN 4 END", AFTER_A: "CASE i WHEN 'u' THEN 3 END"}[x]
        stays = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END"
        keep = f"{{'c': {stays} + coalesce(v[{keeps}].c, 1000000), 's': 'K' || coalesce(v[{keeps}].s, ''), 't': {line('role', 'text')} || coalesce(v[{keeps}].t, '')}}"
        return f"list_sort([{entry('3', 'D', repr(''), rest(x))}, {keep}, {entry('2 + ' + stays, 'R', line(role[x], 'text'), rest(int(NEXT[x])))}])[1]"

    def inserted(x: int) -> str:
        y = int(NEXT[x])
        twice = entry("4", "II", f"{line(role[x], repr(''))} || {line(role[y], repr(''))}", f"w[{int(NEXT[y]) + 1}]")
        return f"list_sort([w[{x + 1}], {entry('2', 'I', line(role[x], repr('')), f'w[{y + 1}]')}, {twice}])[1]"

    def ending(x: int) -> str:
        lines = {NOTHING: [], AFTER_A: [], AFTER_U: ["assistant"], AFTER_S: ["user", "assistant"]}[x]
        return f"{{'c': {2 * len(lines)}, 's': '{'I' * len(lines)}', 't': {' || '.join(line(repr(r), repr('')) for r in lines) or repr('')}}}"

    return rf"""
    WITH RECURSIVE crcs AS (
        SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) AS r(i))),
    src AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
        FROM conversations),
    kinds AS (
        SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(crc[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8)), 4294967295) % 20 AS kind
        FROM src, crcs),
    damaged AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
        FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
    placed AS (
        SELECT *, role[1:1] AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
        FROM damaged),
    rows AS (
        SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault,
               lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS before
        FROM placed),
    facts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows GROUP BY conv_id),
    best AS (
        SELECT conv_id, n + 1 AS p, [{', '.join(map(ending, range(4)))}] AS v FROM facts
        UNION ALL
        SELECT conv_id, p, [{', '.join(map(inserted, range(4)))}]
        FROM (SELECT b.conv_id, r.p, [{', '.join(map(own, range(4)))}] AS w FROM best AS b JOIN rows AS r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.p = b.p - 1))
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(v[1].c, 0) AS cost, coalesce(v[1].s, '') AS audit, sha256(coalesce(v[1].t[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN facts AS f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.p = 1"""
