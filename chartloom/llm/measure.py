"""Held-out figures of the models: ``python -m chartloom.llm.measure [SF_DIR]`` prints one JSON line each.

op2 and op4: their own held-out rows.  op6: trees without every fifth id, judged
on those.  op8 and op10: spans that the models add, planted into the table's own
texts.  op10's random strings and identifiers are of other sources than those of
training.  op8 has two parts: ``personal`` and ``other`` are samples of the makers
that training used, in sentences that it didn't, so they show the fit; ``abroad``,
``spelt`` and ``harmless`` are of makers and sentences that neither training nor
calibration has seen.
"""

from __future__ import annotations

import base64
import json
import random
import sys
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import pii, quality_classifier, quality_rules, secret_scan, toxicity
from chartloom.llm.base import table


def auc(score: np.ndarray, truth: np.ndarray) -> float:
    """The chance that a row of class 1 scores higher than one of class 0, ties being half."""
    order, names = np.argsort(score, kind="stable"), np.unique(score, return_inverse=True)[1]
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    rank = (np.bincount(names, rank) / np.bincount(names))[names]
    good = truth.sum()
    return float((rank[truth].sum() - good * (good + 1) / 2) / max(1, good * (len(score) - good)))


def figures(rows: list, at: float) -> dict:
    """Of (score, label): rows, AUC, and at the threshold recall and false alarms."""
    score, truth = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows]) == 1
    chosen = score >= at
    return {"rows": len(rows), "positive": int(truth.sum()), "auc": round(auc(score, truth), 5), "recall": round(float(chosen[truth].mean()), 4), "false_alarms": round(float(chosen[~truth].mean()), 5)}


def _held(scored: DataFrame, labels: DataFrame, label: str, score: str = "score") -> list:
    """(score, label) of the held-out labelled rows, which are a part of ``labels``."""
    return [tuple(r) for r in scored.where("held_out").join(labels.select("doc_id", label).dropna(), "doc_id").select(score, label).collect()]


def op2(spark: SparkSession, folder: str) -> dict:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return figures(_held(quality_classifier.digest(documents, labels), labels, "quality"), quality_classifier.GOOD_AT)


def op4(spark: SparkSession, folder: str) -> dict:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return figures(_held(toxicity.digest(documents, labels), labels, "toxic"), toxicity.TOXIC_AT)


def op6(spark: SparkSession, folder: str) -> dict:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    judged = quality_rules.judge(documents.select("doc_id", "text"), labels.where(part != 0))
    return figures(_held(judged.withColumn("held_out", part == 0), labels, "quality", "quality_score"), quality_rules.KEEP_AT)


def _planted(spark: SparkSession, folder: str, n: int, insert) -> list:
    """(doc_id, text, start, end) of the first texts of the table, by id, with one insertion each; a measure needs no more."""
    rng, rows = random.Random(41), []
    for r in table(spark, folder, "documents").where("length(text) > 60").orderBy("doc_id").limit(n).collect():
        before, found = insert(rng)
        cut = r.text.find(" ", rng.randrange(50)) + 1
        start = cut + len(before)
        rows.append((r.doc_id, f"{r.text[:cut]}{before}{found} {r.text[cut:]}", start, start + len(found)))
    return rows


def _caught(spark: SparkSession, rows: list, scan, column: str, kinds: tuple[str, ...]) -> tuple[float, int]:
    """The share of insertions that an added span overlaps, and the number of other added spans."""
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    where, caught, other = {r[0]: r[2:] for r in rows}, set(), 0
    for r in scan(documents).collect():
        for s in (s for s in r[column] if s.kind in kinds):
            a, b = where[r.doc_id]
            if s.start < b and s.end > a:
                caught.add(r.doc_id)
            else:
                other += 1
    return round(len(caught) / max(1, len(rows)), 4), other


#: Personal data of countries that no maker of the training samples has, by sentences that it doesn't have.
ABROAD = {
    "british insurance number": (lambda d, c: f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", ("her NI number, {}, was on the payslip", "National Insurance: {}")),
    "brazilian tax number": (lambda d, c: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", ("CPF {}", "o CPF dele é {}")),
    "italian tax code": (lambda d, c: f"{c(6)}{d(2)}{c(1)}{d(2)}{c(1)}{d(3)}{c(1)}", ("codice fiscale {}", "il suo codice è {}")),
    "indian identity number": (lambda d, c: f"{d(4)} {d(4)} {d(4)}", ("Aadhaar {}", "aadhaar no {} verified")),
    "dutch service number": (lambda d, c: d(9), ("BSN {}", "burgerservicenummer: {}")),
    "polish identity number": (lambda d, c: d(11), ("PESEL {}", "numer PESEL: {}")),
    "japanese telephone": (lambda d, c: f"0{d(1)}-{d(4)}-{d(4)}", ("電話 {}", "denwa: {}")),
    "swedish identity number": (lambda d, c: f"{d(6)}-{d(4)}", ("personnummer {}", "hennes personnummer är {}")),
}
SPELT = {
    "address in capitals": (lambda d, c: f"{c(6).lower()} AT {c(7).lower()} DOT org", ("drop a line: {}", "skriv til {}")),
    "address with brackets": (lambda d, c: f"{c(6).lower()} {{at}} {c(7).lower()}.net", ("kontakt {}", "ping {}")),
    "birthday in words": (lambda d, c: f"{1 + int(d(1))} March 19{d(2)}", ("she came into the world on {}", "narozen {}")),
    "telephone by twos": (lambda d, c: " ".join(d(2) for _ in range(4)), ("ring us: {}", "tlf. {}")),
}
HARMLESS = {
    "measure": (lambda d, c: f"{d(3)} {d(3)} km", ("some {} away", "etwa {} weit")),
    "time span": (lambda d, c: f"18{d(2)}-19{d(2)}", ("the railway ({})", "(anni {})")),
    "coordinates": (lambda d, c: f"{d(2)}.{d(4)} {d(2)}.{d(4)}", ("at {} on the chart", "position {}")),
    "standard": (lambda d, c: f"ISO {d(4)}-{d(1)}:20{d(2)}", ("conforms to {}", "norme {}")),
    "score": (lambda d, c: f"{d(1)}-{d(1)} {d(1)}-{d(1)} {d(1)}-{d(1)}", ("won {}", "vann {}")),
    "price list": (lambda d, c: f"{d(2)}.{d(2)} {d(3)}.{d(2)} {d(2)}.{d(2)}", ("rates {}", "prijzen {}")),
}


def unseen(spark: SparkSession, folder: str, n: int) -> dict:
    """The share found of each of ABROAD, SPELT and HARMLESS, planted into the table's texts."""
    out = {}
    for name, kinds in (("abroad", ABROAD), ("spelt", SPELT), ("harmless", HARMLESS)):
        each = {}
        for kind, (make, said) in kinds.items():

            def insert(rng, make=make, said=said):
                d, c = (lambda k: "".join(rng.choices("0123456789", k=k))), (lambda k: "".join(rng.choices("ABCDEFGHJKLMNPRSTUVW", k=k)))
                before = rng.choice(said).split("{}")[0]
                return before, make(d, c)

            each[kind], _ = _caught(spark, _planted(spark, folder, n, insert), pii.scan, "personal", tuple(pii.GENERATORS))
        out |= {f"{name}_found": round(sum(each.values()) / len(each), 4), name: each}
    return out


def op8(spark: SparkSession, folder: str, n: int = 1000) -> dict:
    out = {}
    for kind, said in (("personal", pii.PERSONAL), ("other", pii.OTHER)):
        samples, classes = pii.labelled_samples(20 * n, 901, part=1)
        chosen = iter([s for s, c in zip(samples, classes, strict=True) if c == (said is pii.PERSONAL)])
        rows = _planted(spark, folder, n, lambda _: next(chosen)[::-1])  # noqa: B023
        share, other = _caught(spark, rows, pii.scan, "personal", tuple(pii.GENERATORS))
        out |= {f"{kind}_planted": len(rows), f"{kind}_found": share, f"{kind}_spans_elsewhere": other}
    return out | unseen(spark, folder, n // 5)


def ordinary_identifiers() -> list[str]:
    """Names of at least LEAST characters in the standard library's modules."""
    names = set()
    for name in ("ast", "asyncio", "codecs", "collections", "concurrent.futures", "email", "http", "inspect", "locale", "logging", "os", "signal", "socket", "sqlite3", "ssl", "subprocess", "tokenize", "typing", "unittest", "winreg", "xml.sax.handler"):
        try:
            names |= set(dir(__import__(name, fromlist=["x"])))
        except ImportError:
            continue
    names |= {f"{m}/{n}" for m in sorted(sys.stdlib_module_names) for n in ("__init__", "internal") if not m.startswith("_")}
    return sorted(n for n in names if len(n) >= secret_scan.LEAST and set(n) <= set(secret_scan.ALPHABET))


def random_secret(rng: random.Random) -> str:
    raw = rng.randbytes(rng.randrange(16, 40))
    return rng.choice([base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), str(uuid.UUID(int=rng.getrandbits(128))), base64.b32encode(raw).decode(), raw.hex().upper()])


def op10(spark: SparkSession, folder: str, n: int = 1000) -> dict:
    out = {}
    names = ordinary_identifiers()
    for kind, insert in (("random", lambda rng: ("key ", random_secret(rng))), ("ordinary", lambda rng: ("see ", rng.choice(names)))):
        rows = _planted(spark, folder, n, insert)
        share, other = _caught(spark, rows, secret_scan.scan, "secrets", ("random",))
        out |= {f"{kind}_planted": len(rows), f"{kind}_found": share, f"{kind}_spans_elsewhere": other}
    return out


def main() -> None:
    from chartloom.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = session("*")
    for f in (op2, op4, op6, op8, op10):
        print(json.dumps({"query": f.__name__, "table": folder.rstrip("/").split("/")[-1], **f(spark, folder)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
