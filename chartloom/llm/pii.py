"""Personal data: fixed patterns, and boosted trees over proposed spans.

Generators with high recall propose spans that may overlap: runs of digits and
separators, codes of letters and digits, and obfuscated addresses.  Boosted
trees score each from its format and its context (the words before it); a
threshold calibrated for precision selects.  The trees are trained on
``labelled_samples`` of one half of the sentences and calibrated on the other
half, once a process, and scored as one SQL expression, so a scan is built-in
functions only and has no shuffle.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import gbdt, spans
from chartloom.llm.base import fresh, let

# Possessive quantifiers and the start condition keep every scan linear: a run of
# address characters is tried only at its beginning or where a match has ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "number", "code", "address")
#: The generators and the kind that a selected span gets.
GENERATORS = {
    "number": r"(?:(?<![0-9A-Za-z.,/-])|\G)[(]?[0-9](?:[\x20./()-]{0,2}[0-9]){5,}+(?![0-9A-Za-z])",
    "code": r"(?<![0-9A-Za-z-])[A-Z]{1,3}[0-9]{2}(?:\x20?[0-9A-Z]{2,4}){2,}+(?![0-9A-Za-z])",
    "address": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,}+)++",
}
MAY = {"number": r"[0-9](?:[\x20./()-]{0,2}[0-9]){5}", "code": r"[A-Z][0-9]{2}", "address": r"(?:\(at\)|\[at\]|\x20at\x20)"}
BEFORE = 32
#: Words of the context before a span: fixed values.
CONTEXT = {
    "calls": "tel phone call mobile cell fax telefon téléphone teléfono handy whatsapp",
    "names_id": "ssn social passport licence license insurance patient member national identity dni nie ausweis personalausweis sécu steuer tax mrn",
    "names_bank": "iban account konto cuenta compte bank bic card karte tarjeta carte",
    "names_birth": "born birth dob geboren geburtsdatum né née naissance nacido nacimiento",
    "names_order": "order invoice version isbn issn page chapter part item ticket build room line figure table seite rechnung facture pedido",
}
FEATURES = ("digits", "letters", "separators", "length", "groups", "dashes", "dots", "slashes", "brackets", "ssn_shape", "date_shape", "iban_shape", "at_shape", "phone_shape", *CONTEXT)
#: The share of selected samples that must be right, for the calibrated threshold.
PRECISION = 0.995


def _words(name: str) -> str:
    return r"(?i)(?:^|[^a-zà-ÿ])(?:" + "|".join(CONTEXT[name].split()) + r")(?:[^a-zà-ÿ]|$)"


SHAPES = {
    "ssn_shape": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "date_shape": r"^(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9])$",
    "iban_shape": r"^[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,4})?$",
    "phone_shape": r"^(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|0[0-9]{1,4}(?:[ /][0-9]{2,8}){1,4})$",
    "at_shape": r"(?:\(at\)|\[at\]).*(?:\(dot\)|\[dot\]|\.)|\bat\b.*\bdot\b",
}
COUNTS = {"digits": "[0-9]", "letters": "[A-Za-z]", "separators": r"[\x20./()-]", "dashes": "-", "dots": r"\.", "slashes": "/", "brackets": r"[()\[\]]", "groups": "[0-9A-Za-z]+"}


def features(found: str, before: str) -> list[float]:
    """What the SQL expression computes, for training and tests."""
    value = {k: len(re.findall(p, found)) for k, p in COUNTS.items()} | {"length": len(found)}
    value |= {k: int(bool(re.search(p, found))) for k, p in SHAPES.items()} | {k: int(bool(re.search(_words(k), before))) for k in CONTEXT}
    return [float(value[f]) for f in FEATURES]


# Sentences around spans that are personal data and around spans that are not, written apart from CONTEXT:
# most of their words are in no feature.  Every second one trains, the others calibrate.
PERSONAL = {
    "phone": ("ring me on {}", "call {} after six", "Sie erreichen uns unter {}", "meine Nummer ist {}", "Tel. {}", "phone: {}", "appelez le {}", "joignable au {}", "mon portable : {}", "llámame al {}",
              "mi número es {}", "teléfono {}", "contact {}", "mobile {}", "fax {}", "reach her at {}", "text {}", "Rückruf bitte an {}", "dial {}", "WhatsApp {}"),
    "ssn": ("my social security number is {}", "SSN {}", "ssn: {}", "the applicant, {}, signed", "tax id {}", "employee {} was hired", "taxpayer {}", "she gave {} to the clerk"),
    "identity": ("passport no. {}", "patient {}", "Ausweis {}", "dni {}", "licence {}", "member {}", "insurance number {}", "national identity {}", "Personalausweis Nr. {}", "mrn {}", "Steuernummer {}", "numéro de sécu {}"),
    "birth": ("born on {}", "date of birth: {}", "DOB {}", "geboren am {}", "né le {}", "née le {}", "nacido el {}", "Geburtsdatum {}", "birthday {}", "fecha de nacimiento {}"),
    "iban": ("IBAN {}", "pay to {}", "account {}", "Konto {}", "compte {}", "cuenta {}", "transfer the rent to {}", "überweisen Sie auf {}", "virement sur {}", "bank details {}"),
    "address": ("write to {}", "mail {}", "contact {} for details", "Anfragen an {}", "écrivez à {}", "escribe a {}", "reach us: {}", "e-mail: {}", "from {}", "say hello to {}"),
}
OTHER = {
    "long": ("order {}", "invoice no. {}", "isbn {}", "tracking {}", "population {}", "id {}", "the sum of {}", "sample {} was kept", "article {}", "Rechnung {}", "facture {}", "pedido {}", "serial {}", "checksum {}"),
    "date": ("published on {}", "updated {}", "the meeting of {}", "version {}", "am {} eröffnet", "le {} à midi", "el {} en la plaza", "on {} the bridge opened", "released {}", "battle of {}"),
    "version": ("version {}", "release {}", "build {}", "section {}", "firmware {}", "kernel {}", "v {}", "chapter {}"),
    "list": ("scores {}", "figures {}", "values {}", "lottery: {}", "rows {}", "Zahlen {}", "chiffres {}", "the series {}"),
    "code": ("model {}", "part {}", "room {}", "type {}", "flight {}", "item {}", "aircraft {}", "Artikel {}", "référence {}", "catalogue {}"),
    "words": ("we will {} again", "they {} later", "look {} now", "she works {} today", "staying {} until noon", "laugh {} twice"),
}


def labelled_samples(n: int, seed: int, part: int | None = None) -> tuple[list[tuple[str, str]], list[int]]:
    """((span, context before it), 1 for personal data), n of them, half of each class.

    ``part`` 0 or 1 takes every second sentence only, None all.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randrange(3, 9)))
    date = lambda: rng.choice([f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1930, 2024)}", f"{rng.randrange(1930, 2024)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"{rng.randrange(1, 13)}/{rng.randrange(1, 29)}/{rng.randrange(1930, 2024)}"])
    joins = lambda: rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", ".")])
    make = {
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)}/{d(6)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "identity": lambda: d(rng.randrange(7, 12)),
        "birth": date,
        "iban": lambda: "".join(rng.choices("ABCDEFGHINOPST", k=2)) + d(2) + rng.choice([" ", ""]).join(["", *(d(4) for _ in range(4)), d(2)]),
        "address": lambda: "{0}.{1}{a}{2}{b}com".format(word(), word(), word(), **dict(zip("ab", joins(), strict=True))),
        "long": lambda: d(rng.randrange(6, 24)),
        "date": date,
        "version": lambda: f"{d(2)}.{d(2)}.{d(3)}",
        "list": lambda: " ".join(d(rng.randrange(1, 5)) for _ in range(rng.randrange(4, 9))),
        "code": lambda: "".join(rng.choices("ABCDEFGHKLMX", k=rng.randrange(1, 4))) + d(2) + " " + d(2) + rng.choice([" ", ""]) + d(3),
        "words": lambda: f"{word()} at {word()}.{word()}",
    }
    rows, classes = [], []
    for i in range(n):
        said = PERSONAL if i % 2 else OTHER
        kind = rng.choice(list(said))
        filler = " ".join(word() for _ in range(rng.randrange(0, 5)))
        before = f"{filler} {rng.choice(said[kind][part or 0 :: 1 if part is None else 2])}".split("{}")[0]
        rows.append((make[kind](), before[-BEFORE:]))
        classes.append(i % 2)
    return rows, classes


@lru_cache(2)
def model(samples: int = 6000, seed: int = 5) -> tuple[gbdt.Trees, float]:
    """The trees, and the least margin at which the selected part of samples of other sentences has PRECISION."""
    sets = []
    for part in (0, 1):
        rows, classes = labelled_samples(samples, seed + part, part)
        sets.append((np.array([features(*r) for r in rows]), np.array(classes, float)))
    sign = np.array([1 if f in ("ssn_shape", "iban_shape", "at_shape", "phone_shape", "calls", "names_id", "names_bank", "names_birth") else -1 if f == "names_order" else 0 for f in FEATURES])
    trees = gbdt.train(*sets[0], rounds=24, depth=3, rate=0.3, bins=24, monotone=sign)
    margin, truth = trees.margin(sets[1][0]), sets[1][1]
    order = np.argsort(-margin, kind="stable")
    right = truth[order].cumsum() / np.arange(1, len(order) + 1)
    # a threshold takes or leaves all samples of one margin
    whole = np.append(margin[order][1:] < margin[order][:-1], True)
    last = np.flatnonzero((right >= PRECISION) & whole)
    return trees, max(0.0, round(float(margin[order][last[-1]]) - 1e-6, 6)) if len(last) else np.inf


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _is_ip(s: Column) -> Column:
    number = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(s, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.coalesce(F.expr("0") + F.when(F.length(number(p)).between(1, 3), number(p).cast("int")), F.lit(0)) <= 255))


def _is_card(s: Column) -> Column:
    return let(_only_digits(s), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def base_spans(t: Column) -> dict[str, Column]:
    return {
        "email": spans.find_if(t.contains("@"), t, EMAIL),
        "ip": spans.find_if(t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), t, IP, lambda s: _is_ip(s["found"])),
        "card": spans.find_if(t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), t, CARD, lambda s: _is_card(s["found"])),
        "phone": spans.find_if(t.contains("+"), t, PHONE, lambda s: F.length(_only_digits(s["found"])).between(10, 15)),
    }


def _features_sql(found: str, before: str) -> str:
    quoted = lambda p: "r'" + p.replace("'", r"\x27") + "'"
    value = {k: f"double(regexp_count({found}, {quoted(p)}))" for k, p in COUNTS.items()} | {"length": f"double(length({found}))"}
    value |= {k: f"IF({found} RLIKE {quoted(p)}, 1D, 0D)" for k, p in SHAPES.items()} | {k: f"IF({before} RLIKE {quoted(_words(k))}, 1D, 0D)" for k in CONTEXT}
    return ", ".join(f"{value[f]} AS {f}" for f in FEATURES)


def select_spans(text: str, proposals: str) -> Column:
    """The proposals (columns by name, ``text`` being its blocks) that the trees accept."""
    trees, threshold = model()
    n, start, end = spans.BLOCK, f"greatest(p.start - {BEFORE}, 0)", "p.start"
    first = f"int({start} div {n})"
    joined = f"array_join(slice({text}, {first} + 1, int(floor(({end} - 1) / {n})) - {first} + 1), '')"
    before = f"substring({joined}, {start} - {first} * {n} + 1, {end} - {start})"
    described = f"transform({proposals}, p -> transform(array({before}), b -> struct(p.start AS start, p.end AS end, p.found AS found, {_features_sql('p.found', 'b')}))[0])"
    score = trees.sql([f"f.{name}" for name in FEATURES])
    return F.expr(f"transform(filter({described}, f -> {score} >= {threshold!r}D), f -> struct(f.start AS start, f.end AS end, f.found AS found))")


def _scanned(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` with the struct ``name`` of n_email, n_ip, n_card, n_phone, base and personal, all columns of the input untouched."""
    (found_name,) = fresh([*documents.columns, name], "found")

    def found(t: Column) -> Column:
        proposals = {k: spans.find_if(t.rlike(MAY[k]), t, p) for k, p in GENERATORS.items()}
        # the blocks are only needed for the context of proposals
        whole = lambda x: F.struct(F.when(F.size(x["number"]) + F.size(x["code"]) + F.size(x["address"]) > 0, spans.blocks(t)).otherwise(F.array().cast("array<string>")).alias("t"), *(x[k].alias(k) for k in KINDS))
        return let(F.struct(*(c.alias(k) for k, c in (base_spans(t) | proposals).items())), whole)

    rows = documents.withColumn(found_name, let(F.coalesce(F.col("text").cast("string"), F.lit("")), found))
    f = f"`{found_name}`"
    marks = [spans.mark(F.col(f"{f}.{k}"), k, i) for i, k in enumerate(KINDS[:4])]
    more = [spans.mark(select_spans(f"{f}.t", f"{f}.{k}"), k, 4 + i) for i, k in enumerate(GENERATORS)]
    sizes = [F.size(F.col(f"{f}.{k}")).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    both = F.struct(F.array_sort(F.concat(*marks)).alias("base"), F.concat(*more).alias("more"), *sizes)
    counts = [f"n_{k}" for k in KINDS[:4]]
    joined = lambda b: F.struct(*(b[c].alias(c) for c in counts), b["base"].alias("base"), F.array_sort(F.concat(b["base"], spans.outside(b["base"], b["more"]))).alias("personal"))
    return rows.select(*(F.col(f"`{c}`") for c in documents.columns), let(both, joined).alias(name))


def scan(documents: DataFrame) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base (marked spans) and personal (base and selected spans) to each row.

    Null texts are empty.  Texts are read whole, in time that grows with their
    length and (n log n) with their spans; repeated rows are scanned alike; an
    empty table gives none.  Columns of the input with a name of the result are
    replaced, all others come back as they are.  A selected span that overlaps a
    base span is not added.
    """
    added = [*(f"n_{k}" for k in KINDS[:4]), "base", "personal"]
    own = [c for c in documents.columns if c.lower() not in added]
    (name,) = fresh(documents.columns, "scanned")
    return _scanned(documents, name).select(*(F.col(f"`{c}`") for c in own), *(F.col(f"`{name}`.{c}") for c in added))


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the contract of op8 fixes, and the number of all spans."""
    found = scan(documents.select("doc_id", "text"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"),
        spans.listed(F.col("personal")).alias("spans"), F.size("personal").cast("long").alias("n_spans"),
    )


def redact(documents: DataFrame, by: str = "<personal>") -> DataFrame:
    """The same rows with every found span replaced; null texts stay null and all other columns as they are, whatever their names."""
    (name,) = fresh(documents.columns, "scanned")
    text = F.when(F.size(F.col(f"`{name}`.personal")) > 0, spans.replaced(F.col("text"), F.col(f"`{name}`.personal"), by)).otherwise(F.col("text"))
    return _scanned(documents, name).withColumn("text", text).select(*(F.col(f"`{c}`") for c in documents.columns))
