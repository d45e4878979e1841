"""License scans: a positional index of rare licence words, verified at the place that their positions agree on.

A licence is a few passages.  Each is filed under its rarest words (highest IDF
among all passages) with their positions.  A text's words are looked up in that
index; a word at place i that stands at position p of a passage says that the
passage begins at i - p.  Where enough different rare words say the same, the
passage's mandatory key phrase has to stand at its place word by word, and the
share of the passage's words (weighted by IDF) that agree is its score.

Everything happens in the row, by built-in functions over constants: no shuffle,
no Python, whatever the length of a text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.base import ascii_lower, fresh, let

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: phrases whose every place counts, and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: passages of public licences, the mandatory phrase of each in brackets
PASSAGES = {
    "agpl": (
        "under the terms of the GNU [Affero General Public License] as published by the Free Software Foundation, either version 3 of the License",
        "if you modify the Program, your modified version must prominently offer all users [interacting with it remotely through a computer network]",
    ),
    "apache": (
        "you may not use this file [except in compliance with the License]. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an [\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND], either express or implied",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable [copyright license to reproduce, prepare Derivative Works of], publicly display, publicly perform, sublicense",
    ),
    "boost": (
        "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, [reproduce, display, distribute, execute, and transmit the Software]",
    ),
    "bsd": (
        "[Redistributions of source code must retain] the above copyright notice, this list of conditions and the following disclaimer",
        "[Redistributions in binary form must reproduce] the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "[may be used to endorse or promote products] derived from this software without specific prior written permission",
    ),
    "cc0": (
        "has dedicated the work to the public domain by [waiving all of his or her rights to the work worldwide] under copyright law, including all related and neighboring rights",
    ),
    "gpl": (
        "you can redistribute it and/or modify it under the terms of the [GNU General Public License as published by] the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. [See the GNU General Public License] for more details",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software [for any purpose with or without fee is hereby granted], provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation",
    ),
    "mit": (
        "[Permission is hereby granted, free of charge, to any person obtaining a copy] of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the [rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell] copies of the Software",
        "The above copyright notice and this permission notice [shall be included in all copies or substantial portions of the Software]",
    ),
    "mpl": (
        "This Source Code Form is [subject to the terms of the Mozilla Public License], v. 2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software [released into the public domain]",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, [either in source code form or as a compiled binary], for any purpose, commercial or non-commercial",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. [In no event will the authors be held liable] for any damages arising from the use of this software",
        "Altered source versions must be plainly marked as such, and [must not be misrepresented as being the original software]",
    ),
}
#: The rarest words of a passage that it is filed under, the share of them that has to agree, and the least score (hundredths).
RAREST = 8
AGREEING = 50
LEAST_SCORE = 80
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


@lru_cache(1)
def index() -> tuple[list[dict], dict[str, list[tuple[int, int]]]]:
    """(passages with label, words, weights, first and last position of the phrase and the number of rare words needed; postings of rare words).

    Weights are IDFs in thousandths, so their sums are exact; a word that the
    passage repeats is filed under its first position.
    """
    passages = []
    for label, texts in PASSAGES.items():
        for text in texts:
            before, phrase, after = (plain_words(part) for part in re.fullmatch(r"(.*?)\[(.*)\](.*)", text).groups())
            passages.append({"label": label, "words": [*before, *phrase, *after], "first": len(before), "last": len(before) + len(phrase) - 1})
    found = Counter(w for p in passages for w in set(p["words"]))
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, p in enumerate(passages):
        p["weights"] = [1 + round(1000 * math.log(len(passages) / found[w])) for w in p["words"]]
        rare = sorted(set(p["words"]), key=lambda w: (found[w], p["words"].index(w)))[:RAREST]
        p["needed"] = max(2, -(-AGREEING * len(rare) // 100))
        for w in rare:
            postings.setdefault(w, []).append((number, p["words"].index(w)))
    return passages, postings


PASSAGE = "struct<label:string,words:array<string>,weights:array<int>,first:int,last:int,needed:int,whole:int>"


def _constants() -> tuple[Column, Column, list[str]]:
    """(passages, for each rare word its struct(passage, position)s, the rare words)."""
    passages, postings = index()
    words = sorted(postings)
    whole = json.dumps([p | {"whole": sum(p["weights"])} for p in passages])
    listed = json.dumps([[{"passage": a, "position": b} for a, b in postings[w]] for w in words])
    return F.from_json(F.lit(whole), f"array<{PASSAGE}>"), F.from_json(F.lit(listed), "array<array<struct<passage:int,position:int>>>"), words


def _base(w: Column, heads: Column) -> Column:
    """struct(start, label) of each place of a phrase; ``heads`` are the places of rare words and of the phrases' first words."""
    def of(phrase: str, label: str) -> Column:
        stands = lambda i: reduce(and_, (F.coalesce(F.get(w, i + k) == word, F.lit(False)) for k, word in enumerate(phrase.split())))
        return F.transform(F.filter(heads, stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    return F.concat(*(of(*p) for p in PHRASES.items()))


def _found(w: Column, heads: Column) -> Column:
    """struct(label, score) of each passage that stands in the words."""
    passages, postings, rare = _constants()
    tokens = F.array(*map(F.lit, rare))
    said = lambda i: F.transform(F.get(postings, F.array_position(tokens, F.get(w, i)).cast("int") - 1), lambda e: F.struct(e["passage"].alias("passage"), (i - e["position"]).alias("start"), e["position"].alias("position")))
    places = F.array_sort(F.flatten(F.transform(F.filter(heads, lambda i: F.get(w, i).isin(rare)), said)))
    same = lambda a, b: (a["passage"] == b["passage"]) & (a["start"] == b["start"])

    def agreed(x: Column) -> Column:
        first = lambda c, j: (j == 0) | ~same(c, F.get(x, j - 1))
        enough = lambda c, j: F.coalesce(same(c, F.get(x, j + F.get(passages, c["passage"])["needed"] - 1)), F.lit(False))
        return F.filter(x, lambda c, j: first(c, j) & enough(c, j))

    def stands(c: Column) -> Column:
        p = F.get(passages, c["passage"])
        return F.forall(F.sequence(p["first"], p["last"]), lambda k: F.coalesce(F.get(w, c["start"] + k) == F.get(p["words"], k), F.lit(False)))

    def scored(c: Column) -> Column:
        p = F.get(passages, c["passage"])
        total = F.aggregate(F.sequence(F.lit(0), F.size(p["words"]) - 1), F.lit(0), lambda a, k: a + F.when(F.get(w, c["start"] + k) == F.get(p["words"], k), F.get(p["weights"], k)).otherwise(0))
        return F.struct(p["label"].alias("label"), (100 * total >= LEAST_SCORE * p["whole"]).alias("enough"), (total / p["whole"]).alias("score"))

    return F.filter(F.transform(F.filter(let(places, agreed), stands), scored), lambda s: s["enough"])


def scanned(text: Column) -> Column:
    """The struct of n_words, n_base, first_word, last_word, base_labels, labels and score of a text, null being empty."""
    rare = [*index()[1], *{p.split()[0] for p in PHRASES}]

    def judged(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter(places, lambda i: F.get(w, i).isin(rare))
        return let(heads, lambda h: F.struct(F.size(w).cast("long").alias("n_words"), _base(w, h).alias("base"), _found(w, h).alias("found")))

    def told(x: Column) -> Column:
        starts, base = F.transform(x["base"], lambda b: b["start"]), F.transform(x["base"], lambda b: b["label"])
        more = F.transform(x["found"], lambda f: f["label"])
        best = F.array_max(F.transform(x["found"], lambda f: f["score"]))
        listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
        return F.struct(
            x["n_words"].alias("n_words"), F.size(x["base"]).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
            listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"), F.when(F.size(x["base"]) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        )

    words = F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), lambda w: w != "")
    return let(words, lambda w: let(judged(w), told))


def scan(documents: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to each row.

    ``score`` is 1 where a phrase of the base stands and else the greatest share
    of a passage that was found, 0 if none.  Null, empty and wordless texts have
    no licence; a text is read whole, whatever its length; repeated rows are
    scanned alike; an empty table gives none.  Columns of the input with a name of
    the result are replaced, all others come back as they are.
    """
    own = [c for c in documents.columns if c.lower() not in ADDED]
    (name,) = fresh(documents.columns, "scanned")
    rows = documents.withColumn(name, scanned(F.col("text")))
    return rows.select(*(F.col(f"`{c}`") for c in own), *(F.col(f"`{name}`.{c}") for c in ADDED))


def digest(documents: DataFrame) -> DataFrame:
    """The columns that the contract of op13 fixes."""
    return scan(documents.select("doc_id", "text")).drop("text")


def oracle() -> str:
    """DuckDB SQL of the digest: rare words joined with their postings, places counted, words of candidates compared."""
    passages, postings = index()
    text = lambda s: "'" + s.replace("'", "''") + "'"
    filed = ", ".join(f"({text(w)}, {a}, {b})" for w, found in sorted(postings.items()) for a, b in found)
    heads = ", ".join(f"({n}, {text(p['label'])}, {p['needed']}, {sum(p['weights'])})" for n, p in enumerate(passages))
    words = ", ".join(f"({n}, {k}, {text(w)}, {p['weights'][k]}, {p['first'] <= k <= p['last']})" for n, p in enumerate(passages) for k, w in enumerate(p["words"]))
    phrases = ", ".join(f"({text(p.replace(' ', ','))}, {len(p.split())}, {text(label)})" for p, label in PHRASES.items())
    return rf"""
    WITH filed(t, passage, position) AS (VALUES {filed}), passages(passage, label, needed, whole) AS (VALUES {heads}), word(passage, k, t, weight, must) AS (VALUES {words}), phrase(p, n, label) AS (VALUES {phrases}),
    doc AS (
        SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
        FROM documents),
    tok AS (SELECT r, i - 1 AS i, w[i] AS t, array_to_string(w[i:i + 1], ',') AS two, array_to_string(w[i:i + 2], ',') AS three FROM doc, unnest(range(1, len(w) + 1)) AS u(i)),
    base AS (SELECT r, i, label FROM tok JOIN phrase ON p = CASE n WHEN 2 THEN two ELSE three END),
    rare AS (SELECT r, passage, i - position AS s, count(*) AS n FROM tok JOIN filed USING (t) GROUP BY r, passage, i - position),
    agreed AS (
        SELECT c.r, c.passage, c.s, coalesce(sum(weight) FILTER (tok.t = word.t), 0) AS total, bool_and(NOT must OR coalesce(tok.t = word.t, false)) AS stands
        FROM rare AS c JOIN passages USING (passage) JOIN word USING (passage) LEFT JOIN tok ON tok.r = c.r AND tok.i = c.s + k WHERE c.n >= needed GROUP BY c.r, c.passage, c.s),
    found AS (SELECT r, label, total / whole AS score FROM agreed JOIN passages USING (passage) WHERE stands AND 100 * total >= {LEAST_SCORE} * whole),
    b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY r),
    a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r),
    f AS (SELECT r, max(score) AS score FROM found GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(b.l, '') AS base_labels, coalesce(a.l, '') AS labels,
           CAST(CASE WHEN b.n > 0 THEN 1 ELSE coalesce(f.score, 0) END AS DOUBLE) AS score
    FROM doc LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN f USING (r)"""
