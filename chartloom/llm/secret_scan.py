"""Secret scans: fixed patterns, and two character Markov models for random strings.

One first-order model is trained on random strings of the usual alphabets, one
on ordinary identifiers; both from ``labelled_samples``.  A run of identifier
characters is a secret if the mean log-likelihood ratio of its transitions
reaches a threshold that is calibrated on other samples.  Scanning is built-in
functions only: the ratios are an array of constants looked up by character.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import spans
from chartloom.llm.base import fresh, let

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs below this length are left to the patterns.
LEAST = 20
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
# fixed values: words of which ordinary identifiers are made
WORDS = (
    "account action active address after algorithm amount analysis application argument array attribute author available average background balance before "
    "between binary block boolean border branch browser buffer build button cache calculate callback cancel category center change channel character check "
    "child class clean client clock close cluster code collection color column command comment common compare compile complete component compute condition "
    "config connect constant container content context control convert copy count create current customer data database date debug decode default define "
    "delete delimiter depth describe design detail device dialog different directory disable display distance document domain download driver duration "
    "dynamic element empty enable encode engine entity entry environment error event example exception execute exist expand export express extend external "
    "factory failure feature field file filter final find first folder follow format forward frame function general generate global graph group handle header "
    "height hidden history host however identifier image implement import include increment index information inherit initial inner input insert instance "
    "integer interface internal interval invoice iterate join keyboard language large layer layout leading length level library limit line link list listen "
    "local location logger lookup machine manager mapping margin master match matrix maximum measure member memory message method middle minimum missing mode "
    "model module monitor mouse multiple native network node normal notification nothing number object offset operation option order original other output "
    "package page panel parameter parent parse partition password path pattern payment percent performance permission person picture pixel platform player "
    "plugin pointer policy position possible prefix prepare preview previous primary print private process product profile program project property protocol "
    "provider public query queue quick random range read reason receive record reference refresh region register release remote remove render repeat replace "
    "report request require reset resource response result return reverse right root route router sample scale schedule schema screen script scroll search "
    "second section select selector separate sequence serial server service session setting shape share shift should signal simple single size socket sort "
    "source space special standard start state static status storage store stream string structure style submit subscribe success summary support switch "
    "symbol sync system table target task template terminal test text theme thread through time title toggle token tracker transaction transform translate "
    "tree trigger type union unique unit unknown until update upload user utility valid value variable vector version video view virtual visible volume "
    "warning watch weight when where which while widget width window without word worker workspace wrapper write zone "
    "und der die das nicht auch eine einer sich werden haben schaft heit keit ung lich gegen unter zwischen über jahr zeit welt leben mensch arbeit "
    "les des une dans pour avec plus tion ment elle nous vous tout comme faire temps monde aussi entre homme femme jour toujours encore autre "
    "los las del una para con por más como pero sus hasta desde nos cuando muy sin sobre también ción mente tiempo vida mundo trabajo siempre donde"
).split()


def labelled_samples(n: int, seed: int) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), n of each."""
    rng = random.Random(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", ALPHABET[:62] + "_-"]
    secrets = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(20, 65))) for _ in range(n)]
    words = [w for w in WORDS if w.isascii()]

    def plain() -> str:
        out, style = "", rng.randrange(8)
        while len(out) < rng.randrange(20, 50):
            w = rng.choice(words)
            if style > 5 and rng.random() < 0.7:  # names of constants: abbreviations and numbered parts
                w = w[: rng.randrange(2, 5)] if rng.random() < 0.5 else w[0] + re.sub("[aeiou]", "", w[1:])[: rng.randrange(1, 4)] + rng.choice(["", "", "", "2", "32"])
            w = w.capitalize() if style == 1 or style == 2 and out else w.upper() if style in (3, 6) else w
            out += (rng.choice(["_", "-", "/"]) if style in (0, 3, 4, 6, 7) and out else "") + w
            if rng.random() < 0.08:
                out += rng.choice(["1", "2", "3", "10", "64", "2024", "v2"])
        return out[:60] if style != 5 else rng.choice("=-_") * rng.randrange(20, 60)

    return secrets, [plain() for _ in range(n)]


@lru_cache(4)
def markov(samples: int = 4000, seed: int = 11, at_most_wrong: float = 0.0005) -> tuple[list[list[float]], float]:
    """(log-likelihood ratios by [last][next], threshold on their mean).

    The threshold is the least at which no more than ``at_most_wrong`` of other
    ordinary samples pass, and 0 at least: below it a run is likelier to be an
    ordinary identifier.
    """
    size = len(ALPHABET)
    where = {c: i for i, c in enumerate(ALPHABET)}
    logs = []
    for texts in labelled_samples(samples, seed):
        counts = [[0.25] * size for _ in range(size)]
        for t in texts:
            for a, b in zip(t, t[1:], strict=False):
                counts[where[a]][where[b]] += 1
        logs.append([[math.log(c / sum(row)) for c in row] for row in counts])
    ratios = [[round(a - b, 4) for a, b in zip(x, y, strict=True)] for x, y in zip(*logs, strict=True)]
    ordinary = sorted(mean_ratio(t, ratios) for t in labelled_samples(samples, seed + 1)[1])
    return ratios, max(0.0, round(ordinary[math.ceil(len(ordinary) * (1 - at_most_wrong)) - 1] + 1e-4, 4))


def mean_ratio(run: str, ratios: list[list[float]]) -> float:
    """What the SQL expression computes, for tests and calibration."""
    ids = [ALPHABET.index(c) for c in run]
    return sum(ratios[a][b] for a, b in zip(ids, ids[1:], strict=False)) / (len(ids) - 1)


def _is_random(run: Column) -> Column:
    ratios, threshold = markov()
    size = len(ALPHABET)
    codes = [ALPHABET.find(chr(i)) for i in range(128)]
    code_of = F.from_json(F.lit(json.dumps(codes)), "array<int>")
    flat = F.from_json(F.lit(json.dumps([x for row in ratios for x in row])), "array<double>")
    ids = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.element_at(code_of, F.ascii(c) + 1))
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.element_at(flat, F.element_at(x, i) * size + F.element_at(x, i + 1) + 1))
    return let(ids, lambda x: F.aggregate(pairs(x), F.lit(0.0), lambda a, r: a + r) / (F.size(x) - 1) >= threshold)


ADDED = ("n_assign", "n_access", "n_hex", "base", "secrets")


def scanned(text: Column) -> Column:
    """The struct of n_assign, n_access, n_hex, base and secrets of a text, null being empty."""

    def found(t: Column) -> Column:
        assigns = t.contains(":") | t.contains("=")
        values = spans.find_if(assigns & t.rlike(ASSIGN), t, ASSIGN, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= 12)
        access = spans.find_if(t.contains("AKIA"), t, ACCESS)
        hexes = spans.find_if(t.rlike(HEX), t, HEX)
        runs = spans.find_if(t.rlike(RUN), t, RUN, lambda s: _is_random(s["found"]))
        return F.struct(values.alias("assign"), access.alias("access"), hexes.alias("hex"), runs.alias("random"))

    def marks(f: Column) -> Column:
        base = F.array_sort(F.concat(*(spans.mark(f[k], k, i) for i, k in enumerate(KINDS[:3]))))
        return F.struct(*(F.size(f[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), spans.mark(f["random"], "random", 3).alias("random"))

    def joined(m: Column) -> Column:
        both = F.array_sort(F.concat(m["base"], spans.uncovered(m["base"], m["random"])))
        return F.struct(*(m[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]), m["base"].alias("base"), both.alias("secrets"))

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(found(t), lambda f: let(marks(f), joined)))


def scan(documents: DataFrame) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base (marked spans) and secrets (base and the models' spans) to each row.

    Null texts are empty.  Texts are read whole, in time that grows with their
    length and (n log n) with their spans; repeated rows are scanned alike; an
    empty table gives none.  Columns of the input with a name of the result are
    replaced, all others come back as they are.  A random run inside a base span
    is not added.
    """
    own = [c for c in documents.columns if c.lower() not in ADDED]
    (name,) = fresh(documents.columns, "scanned")
    rows = documents.withColumn(name, scanned(F.col("text")))
    return rows.select(*(F.col(f"`{c}`") for c in own), *(F.col(f"`{name}`.{c}") for c in ADDED))


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the contract of op10 fixes, and the number of all spans."""
    found = scan(documents.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"),
        spans.listed(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"),
    )


def redact(documents: DataFrame, by: str = "<secret>") -> DataFrame:
    """The same rows with every found secret replaced; null texts stay null and all other columns as they are, whatever their names."""
    text = let(F.struct(F.col("text").alias("t"), scanned(F.col("text"))["secrets"].alias("s")), lambda x: F.when(F.size(x["s"]) > 0, spans.replaced(x["t"], x["s"], by)).otherwise(x["t"]))
    return documents.withColumn("text", text).select(*(F.col(f"`{c}`") for c in documents.columns))
