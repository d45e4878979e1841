"""SentencePiece encoding and decoding with Gumbel top-k sampled segmentations.

A text is a lattice of vocabulary pieces.  ``k`` distinct segmentations are drawn
without replacement by a perturbed A-star search: the best-first search pops the
set of segmentations with the greatest perturbed log-probability, descends to the
one that attains it, and splits the rest of the set by the place where it first
leaves that path.  The bound of a set is exact (the backward sums of the lattice
give its mass, and the maximum of its perturbed values is a Gumbel variable
truncated at its parent's), so no popped set is wasted.

No piece spans two neighbouring characters that stand together in no piece of the
vocabulary, so the lattice falls apart there into units, mostly words or parts of
them.  The lattice of each distinct unit is built once and kept in flat arrays;
the steps of all units of a run of texts are then taken together.  Randomness is a hash of the
row's key and the place in the text, so results do not depend on batches, tasks
or retries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import ngrams
from chartloom.llm.base import small

SPACE = "▁"
#: Stands for the letter U+2581 itself, which is spelt in bytes; a surrogate is in no text.
OWN_SPACE = "\udc81"
#: log-probability of a piece, up to a constant: -SHARPNESS * log(rank + SHIFT).
SHARPNESS, SHIFT = 1.0, 8.0
#: Distinct units whose lattices a worker keeps; all are dropped when it has more.
MOST_UNITS = 100_000
#: Characters of a run of texts that are stepped together (a longer text is a run of its own).
RUN_CHARACTERS = 250_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces and scores of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        skipped = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        first = min(set(range(n)) - skipped)
        self.score = {p: -SHARPNESS * math.log(i - first + SHIFT) for i, p in enumerate(self.pieces) if i not in skipped}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in skipped}
        self.id_score = np.array([self.score.get(p, 0.0) if self.id.get(p) == i else 0.0 for i, p in enumerate(self.pieces)])
        self.longest = max(map(len, self.id))
        prefixes = sorted({p[:j] for p in self.id for j in range(1, len(p) + 1)})
        ends = np.cumsum([len(p) for p in prefixes])
        hasher = ngrams.Hasher(np.frombuffer("".join(prefixes).encode("utf-32-le"), np.uint32))
        hashed = hasher.slices64(np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashed)
        #: Hashes of all beginnings of pieces, and the id of those that are pieces, else -1.
        self.prefix_hash, self.prefix_id = hashed[order], np.array([self.id.get(p, -1) for p in prefixes], np.int64)[order]
        assert (np.diff(self.prefix_hash) > 0).all()
        known = sorted(p for p in self.id if len(p) == 1)
        self.single = np.zeros(0x110000, np.int16)  # a number of each known character; 0: unknown
        self.single[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.together = np.zeros((len(known) + 1) ** 2, bool)  # pairs of characters that some piece spans
        pairs = sorted({p[j : j + 2] for p in self.id for j in range(len(p) - 1)})
        a, b = (self.single[[ord(p[j]) for p in pairs]].astype(np.int64) for j in (0, 1))
        self.together[(a * (len(known) + 1) + b)[(a > 0) & (b > 0)]] = True
        self.width = len(known) + 1
        spelt = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.raw = pa.array([spelt.get(i, b"" if i in skipped else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)], pa.large_binary())

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points of all texts with spaces marked, start of each unit, number of units in each text)."""
        marked = [SPACE + t.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return points, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in marked])
        kind = self.single[points].astype(np.int64)
        new = np.ones(len(points), bool)
        new[1:] = ~self.together[kind[:-1] * self.width + kind[1:]]
        new[ends[:-1][ends[:-1] < len(points)]] = True
        starts = np.flatnonzero(new)
        return points, starts, np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))

    def bytes_of(self, character: str) -> list[int]:
        return [self.byte_id[b] for b in (SPACE if character == OWN_SPACE else character).encode("utf-8", "replace")]

    def decode(self, ids) -> str:
        """The text of a list or array of ids."""
        if not len(ids):
            return ""
        # the values of what is taken lie one behind the other
        return self.raw.take(pa.array(np.asarray(ids, np.int64))).buffers()[2].to_pybytes().decode("utf-8", "replace")[1:]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of all units met so far; node and edge numbers run through all of them.

    A node's edges stand in falling order of their length, mostly also of their
    chance; ``upto`` is the chance of an edge or an earlier one of its node.  ``code`` is the piece's id, or
    -1 - character for one that is spelt in bytes.  A unit's last node has no edge.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.first, self.target, self.code = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.upto, self.log = np.zeros(1 << 16), np.zeros(1 << 16)
        self.clear()

    def clear(self) -> None:
        self.known, self.root = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of units, sorted, and their first nodes
        self.nodes = self.edges = 0

    def _room(self, nodes: int, edges: int) -> None:
        def grown(x: np.ndarray, n: int) -> np.ndarray:
            return x if len(x) >= n else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))

        self.first = grown(self.first, self.nodes + nodes + 1)
        self.target, self.code, self.upto, self.log = (grown(x, self.edges + edges) for x in (self.target, self.code, self.upto, self.log))

    def roots(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first node of each unit; units not met before are added."""
        if not len(starts):
            return np.zeros(0, np.int64)
        length = np.diff(np.append(starts, len(points)))
        unit, one, which = np.unique(ngrams.Hasher(points).slices64(starts, starts + length), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unit)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != unit[~new]
        if new.any():
            base = self.add(points, starts[one[new]], length[one[new]])
            self.known, self.root = np.insert(self.known, at[new], unit[new]), np.insert(self.root, at[new], base)
            at = np.searchsorted(self.known, unit)
        return self.root[at][which]

    def add(self, points: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first nodes of new units: pieces by the hashes of all slices, then backward sums for all units at once."""
        words, units = self.vocabulary, len(starts)
        begin = np.cumsum(length) - length
        points = points[np.arange(length.sum()) + np.repeat(starts - begin, length)]
        base = self.nodes + begin + np.arange(units)  # a unit of n characters has n + 1 nodes
        unit = np.repeat(np.arange(units), length)
        left = np.repeat(begin + length, length) - np.arange(len(points))  # characters to the unit's end
        hashes = ngrams.Hasher(points)
        at, parts = np.arange(len(points)), []
        for size in range(1, words.longest + 1):
            at = at[left[at] >= size]
            h = hashes.slices64(at, at + size)
            found = np.minimum(np.searchsorted(words.prefix_hash, h), len(words.prefix_hash) - 1)
            fits = words.prefix_hash[found] == h
            at, found = at[fits], found[fits]
            piece = words.prefix_id[found]
            parts.append((at[piece >= 0], np.full((piece >= 0).sum(), size), piece[piece >= 0]))
        node, size, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        spelt = np.flatnonzero(np.bincount(node, minlength=len(points)) == 0)  # only units of one unknown character
        score = np.concatenate((words.id_score[code], np.zeros(len(spelt))))
        code = np.concatenate((code, -1 - points[spelt].astype(np.int64)))
        node, size = np.concatenate((node, spelt)), np.concatenate((size, np.ones(len(spelt), np.int64)))

        # backward sums, from the units' ends: nodes at the same distance together
        order = np.argsort(left[node] * len(points) + node)
        node, size, code, score = node[order], size[order], code[order], score[order]
        target = node + size
        closed = size == left[node]
        below = np.zeros(len(points) + 1)
        value = score.copy()
        step = np.concatenate(([0], np.flatnonzero(np.diff(left[node])) + 1, [len(node)]))
        for a, b in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            v = value[a:b]
            v += np.where(closed[a:b], 0.0, below[target[a:b]])
            n = node[a:b]
            heads = np.concatenate(([0], np.flatnonzero(np.diff(n)) + 1))
            top = np.maximum.reduceat(v, heads)
            many = np.diff(np.concatenate((heads, [b - a])))
            below[n[heads]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), heads))
        log = value - below[node]
        chance = np.exp(log)
        order = np.argsort((node + 1) * (words.longest + 1) - size)  # by whole numbers, so that rounding changes no order
        node, target, code, log, chance = node[order], target[order], code[order], log[order], chance[order]
        count = np.bincount(node, minlength=len(points))
        first = np.cumsum(count) - count
        log[first[count == 1]] = 0.0
        total = chance.cumsum()
        upto = total - np.repeat(np.concatenate(([0.0], total[first[1:] - 1])), count) if len(points) else total
        upto[first + count - 1] = 1.0

        self._room(len(points) + units, len(node))
        e, shift = self.edges, base - begin  # from characters to nodes
        self.target[e : e + len(node)] = target + shift[unit[node]]
        self.code[e : e + len(node)], self.upto[e : e + len(node)], self.log[e : e + len(node)] = code, upto, log
        self.first[np.arange(len(points)) + shift[unit]] = e + first
        self.first[base + length] = e + np.concatenate((first, [len(node)]))[begin + length]
        self.nodes += len(points) + units
        self.edges += len(node)
        self.first[self.nodes] = self.edges
        return base


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def uniform(key: np.ndarray, stream: int, place: np.ndarray | int) -> np.ndarray:
    """In (0, 1), from a row's key, the number of the stream and a place."""
    at = np.atleast_1d(np.asarray(place, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((stream + 1) * 0xD1342543DE82EF95 % (1 << 64))
    return (_mix(key + at) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


class Sampler:
    """Draws segmentations of many texts together over one ``Lattices``."""

    def __init__(self, lattices: Lattices):
        self.first, self.target, self.code = lattices.first[: lattices.nodes + 1], lattices.target, lattices.code
        self.upto, self.log = lattices.upto, lattices.log

    def walk(self, node: np.ndarray, key: np.ndarray, stream: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(element, edge) of a sampled path from each node to its unit's end, in order."""
        element, elements, edges, step = np.arange(len(node)), [], [], 0
        while len(element):
            u = uniform(key[element], stream, place[element] * 4096 + step)
            edge = self.first[node]  # a copy
            late = np.flatnonzero(u > self.upto[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] > self.upto[edge[late]]]
            elements.append(element)
            edges.append(edge)
            node = self.target[edge]
            going = self.first[node + 1] > self.first[node]
            element, node, step = element[going], node[going], step + 1
        if not elements:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        element, edge = np.concatenate(elements), np.concatenate(edges)
        order = np.argsort(element, kind="stable")
        return element[order], edge[order]

    def draw(self, roots: list[np.ndarray], keys: np.ndarray, k: int) -> tuple[list[list[dict]], np.ndarray]:
        """For each text its samples, best first, and the (k+1)-th perturbed value (-inf if there is none).

        A sample is a dict of edges, log_prob and perturbed.
        """
        n = len(roots)
        size = np.array([len(r) for r in roots], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *roots]).astype(np.int64)
        at = np.cumsum(size) - size
        samples: list[list[dict]] = [[] for _ in range(n)]
        # what is popped next: the text, the bound, the parent sample and where to leave it
        popped = [(i, float(-np.log(-np.log(g))), None, 0) for i, g in enumerate(uniform(keys, 1, 0).tolist())]
        for r in range(k):
            starts, owner, place, heads = [], [], [], {}
            for i, bound, parent, t in popped:
                if parent is None:
                    units, nodes = 0, flat[at[i] : at[i] + size[i]]
                else:
                    edge = self._other(parent, t, float(uniform(keys[i : i + 1], 2 + 4 * r, t)[0]))
                    heads[i] = edge
                    units = int(parent["unit"][t])
                    node = self.target[edge]
                    rest = flat[at[i] + units + 1 : at[i] + size[i]]
                    nodes = np.concatenate(([node], rest)) if self.first[node + 1] > self.first[node] else rest
                    units = units if len(nodes) > len(rest) else units + 1
                starts.append(nodes)
                owner.append(np.full(len(nodes), i))
                place.append(np.arange(units, units + len(nodes)))
            if not popped:
                break
            start, own, where = (np.concatenate(x).astype(np.int64) for x in (starts, owner, place))
            element, edge = self.walk(start, keys[own], 3 + 4 * r, where)
            of, unit = own[element], where[element]
            cuts = np.searchsorted(of, np.arange(n + 1)) if len(popped) == n else None
            bounds = [(np.searchsorted(of, i), np.searchsorted(of, i, "right")) for i, *_ in popped] if cuts is None else [(cuts[i], cuts[i + 1]) for i in range(n)]
            for (i, bound, parent, t), (a, b) in zip(popped, bounds, strict=True):
                edges, units, barred, keep = edge[a:b], unit[a:b], [], 0
                if parent is not None:
                    barred, keep = [*parent["barred"].pop(t, ()), int(parent["edges"][t])], t
                    parent["open"][t] = -np.inf
                    edges = np.concatenate((parent["edges"][:t], [heads[i]], edges))
                    units = np.concatenate((parent["unit"][: t + 1], units))
                samples[i].append(self._sample(edges, units, bound, keep, barred, keys[i], r))
            popped = []
            for i, found in enumerate(samples):
                if len(found) == r + 1:
                    best = max(((float(s["open"].max()), -j) for j, s in enumerate(found) if len(s["open"])), default=(-np.inf, 0))
                    if best[0] > -np.inf:
                        parent = found[-best[1]]
                        popped.append((i, best[0], parent, int(parent["open"].argmax())))
        last = np.full(n, -np.inf)
        for i, bound, *_ in popped:
            last[i] = bound
        return samples, last

    def _sample(self, edges: np.ndarray, unit: np.ndarray, bound: float, keep: int, barred: list[int], key: np.uint64, r: int) -> dict:
        """A found path, and the bounds of the sets that leave it at each place from ``keep`` on."""
        log = self.log[edges]
        before = np.cumsum(log) - log
        chance = np.exp(log)
        if barred and len(edges):
            chance[keep] += np.exp(self.log[barred]).sum()
        mass = np.full(len(edges), -np.inf)
        some = np.flatnonzero(chance < 1 - 1e-12)
        mass[some] = before[some] + np.log1p(-chance[some])
        if barred and self._left(int(edges[keep]), barred) == 0:
            mass[keep] = -np.inf
        mass[:keep] = -np.inf
        some = np.flatnonzero(mass > -np.inf)
        u = uniform(key, 4 + 4 * r, some)
        opened = np.full(len(edges), -np.inf)
        # a Gumbel variable with the set's mass, below the bound
        opened[some] = mass[some] - np.log(np.exp(np.minimum(mass[some] - bound, 700)) - np.log(u))
        return {"edges": edges, "unit": unit, "log_prob": float(log.sum()), "perturbed": bound, "open": opened, "barred": {keep: barred} if barred else {}}

    def _siblings(self, edge: int) -> range:
        node = int(np.searchsorted(self.first, np.int32(edge), "right")) - 1  # of the array's type, else it is copied
        return range(int(self.first[node]), int(self.first[node + 1]))

    def _left(self, edge: int, barred: list[int]) -> int:
        return len(self._siblings(edge)) - len({edge, *barred})

    def _other(self, parent: dict, t: int, u: float) -> int:
        """An edge of the node at place ``t`` that no sample has taken there, by its chance."""
        taken = {int(parent["edges"][t]), *parent["barred"].get(t, ())}
        free = [e for e in self._siblings(int(parent["edges"][t])) if e not in taken]
        chance = np.exp(self.log[free])
        return free[min(int(np.searchsorted(chance.cumsum(), u * chance.sum(), "right")), len(free) - 1)]

    def ids(self, edges: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        code = self.code[edges]
        spelt = np.flatnonzero(code < 0)
        if not len(spelt):
            return code
        parts, at = [], 0
        for i in spelt.tolist():
            parts += [code[at:i], np.array(vocabulary.bytes_of(chr(-1 - int(code[i]))), np.int64)]
            at = i + 1
        return np.concatenate([*parts, code[at:]])


def encode_texts(texts: list[str | None], keys: list[str], lattices: Lattices, k: int) -> Iterator[tuple[int, list[dict]]]:
    """(number of the text, its samples with ids, log_prob, perturbed and inclusion), in order."""
    words = lattices.vocabulary
    i = 0
    while i < len(texts):
        if len(lattices.known) > MOST_UNITS:
            lattices.clear()
        first, size = i, 0
        while i < len(texts) and size < RUN_CHARACTERS:
            size += len(texts[i] or "")
            i += 1
        points, starts, count = words.split([t or "" for t in texts[first:i]])
        roots = np.split(lattices.roots(points, starts), np.cumsum(count)[:-1])
        sampler = Sampler(lattices)
        hashed = np.array([xxhash.xxh64_intdigest(key) for key in keys[first:i]], np.uint64)
        samples, last = sampler.draw(roots, hashed, k)
        for j, found in enumerate(samples):
            for s in found:
                s["ids"] = sampler.ids(s["edges"], words)
                s["inclusion"] = float(-np.expm1(-np.exp(min(s["log_prob"] - last[j], 700.0)))) if last[j] > -np.inf else 1.0
            yield first + j, found


def encode(documents: DataFrame, k: int = 2, seed: int = 0, path: str | None = None, restore: bool = False) -> DataFrame:
    """(doc_id, sample, n_pieces, log_prob, perturbed, inclusion, ids): up to ``k`` rows for each row of ``documents``.

    Samples are numbered from 0 in falling order of their perturbed
    log-probability and are distinct; a text with fewer segmentations has fewer.
    ``inclusion`` is the chance of being among the k given the (k+1)-th value.
    The row key is the doc_id (null: a key of its own), so repeated rows are
    sampled alike.  Null and empty texts have one segmentation, without pieces.
    Texts are read whole; an empty table gives no rows.  Other columns of the input
    are not read, so their names don't matter.  With ``restore`` each sample is
    decoded again and ``restored`` says whether that gives the text (null: empty).
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary(path))
        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple[int, int, dict]] = []
            size = 0
            for i, found in encode_texts(texts, [f"{seed}:{d}" for d in ids], lattices, k):
                for r, s in enumerate(found):
                    kept = {c: s[c] for c in ("log_prob", "perturbed", "inclusion", "ids")}
                    if restore:
                        kept["restored"] = lattices.vocabulary.decode(s["ids"]) == (texts[i] or "")
                    rows.append((ids[i], r, kept))
                size += sum(len(s["ids"]) for s in found)
                if size > 1 << 20 or i == len(texts) - 1:
                    yield _batch(rows)
                    rows, size = [], 0

    def _batch(rows: list) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0, np.int64), *(s["ids"] for *_, s in rows)]).astype(np.int32)
        count = np.array([len(s["ids"]) for *_, s in rows], np.int32)
        offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        plain = [pa.array([s[c] for *_, s in rows], pa.float64()) for c in ("log_prob", "perturbed", "inclusion")]
        columns = [pa.array([d for d, *_ in rows], pa.int64()), pa.array([r for _, r, _ in rows], pa.int32()), pa.array(count), *plain, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids"]
        if restore:
            columns, names = [*columns, pa.array([s["restored"] for *_, s in rows], pa.bool_())], [*names, "restored"]
        return pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sample int, n_pieces int, log_prob double, perturbed double, inclusion double, ids array<int>" + (", restored boolean" if restore else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``text``, decoded from ``ids``; null ids give a null text."""
    path = path or model_path()
    own = [c for c in encoded.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in small(batches):
            found = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if i is None else words.decode(i) for i in found], pa.string())], [*batch.schema.names, "text"])

    rows = encoded.select(*own)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "text string"]))
