"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's 13-word windows (shorter items: the whole item) become a hash
table of constants, ``buckets[hash mod n]``, that every task carries.  A
training text's token windows are looked up in it in the row, equal hashes are
verified word by word, and the words inside verified windows are hits.  There
is no shuffle and no Python; a text is judged wherever its row lies.

The table is only built up to ``MAX_WINDOWS`` distinct windows, which its count
proves before it is collected; a larger benchmark is joined with the texts'
windows by a shuffle instead (``_by_join``), with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.base import ascii_lower, cut, fresh, let

WINDOW = 13
ADDED = ("n_words", "n_hit", "n_items", "item_ids", "contaminated", "hit_positions")
#: Some 150 bytes a window: about 8 MB of constants.
MAX_WINDOWS = 50_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIT = "array<struct<start:int,size:int,items:array<string>>>"


def words_of(text: Column) -> Column:
    """Lower-cased words; null and wordless texts have none."""
    words = F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")
    return F.coalesce(words, F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window and the ids of the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = items.select("item", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("i"))
    cut = starts.select("item", F.slice("w", F.col("i"), F.col("size")).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _window(words: Column, start: Column, size: int) -> Column:
    """The ``size`` words from ``start`` (from 1) as an array, word by word: a slice would copy all words of a text first."""
    return F.array(*(F.get(words, start + (k - 1)) for k in range(size)))


def _constants(rows: list, n: int) -> str:
    """JSON of the buckets; driver-side, at most MAX_WINDOWS rows."""
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for r in rows:
        buckets[r["bucket"]].append({"w": r["words"], "items": r["items"]})
    return json.dumps(buckets)


def _by_constants(words: Column, rows: list, buckets: int) -> Column:
    """The verified hits of a row, as HIT; each window stands once among the constants, in the table of its size."""

    def of_size(size: int) -> Callable[[Column], Column]:
        own = [r for r in rows if len(r["words"]) == size]
        heads = sorted({r["words"][0] for r in own})
        table = F.from_json(F.lit(_constants(own, buckets)), "array<array<struct<w:array<string>,items:array<string>>>>")

        def found(w: Column, i: Column) -> Column:
            same = lambda g: F.filter(F.element_at(table, F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int") + 1), lambda e: e["w"] == g)
            return F.struct(i.alias("start"), F.lit(size).alias("size"), F.get(let(_window(w, i, size), same), 0)["items"].alias("items"))

        starts = lambda w: F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return lambda w: F.filter(F.transform(F.filter(starts(w), lambda i: F.element_at(w, i).isin(heads)), lambda i: found(w, i)), lambda x: x["items"].isNotNull())

    hits = [of_size(size) for size in sorted({len(r["words"]) for r in rows})]
    return let(words, lambda w: F.concat(F.array().cast(HIT), *(at(w) for at in hits)))


def _by_join(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, hits) for the distinct texts (text, key) that have hits, by a shuffled join on the windows' hashes.

    Only hashes and places are shuffled; equal hashes are then verified word by
    word in the row, as with constants.
    """
    sizes = [r[0] for r in windows.select(F.size("words")).distinct().collect()]  # at most WINDOW values
    split = texts.dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("words"))

    def grams_of(size: int) -> Column:
        """struct(size, start, hash) of each window of ``size`` words."""
        starts = F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - (size - 1))).otherwise(F.array().cast("array<int>"))
        return let(F.col("words"), lambda w: F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), F.xxhash64(_window(w, i, size)).alias("hash"))))

    if not sizes:
        return split.select("key", F.array().cast(HIT).alias("hits")).limit(0)
    grams = split.select("key", F.explode(F.concat(*map(grams_of, sizes))).alias("g")).select("key", "g.*")
    hashed = windows.select(F.xxhash64("words").alias("hash"), F.size("words").alias("of"), F.col("words").alias("w"), "items")
    near = grams.join(hashed, "hash").where(F.col("size") == F.col("of"))
    found = near.groupBy("key").agg(F.collect_list(F.struct("start", "size", "w", "items")).alias("found"))
    checked = let(F.struct("words", "found"), lambda x: F.filter(x["found"], lambda f: F.slice(x["words"], f["start"], f["size"]) == f["w"]))
    hits = F.transform(checked, lambda f: F.struct(f["start"].alias("start"), f["size"].alias("size"), f["items"].alias("items")))
    return split.join(found, "key").select("key", hits.alias("hits"))


def hit_words(hits: Column) -> Column:
    """The 1-based positions of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))


def _judged(documents: DataFrame, benchmark: DataFrame, name: str, window: int, max_windows: int) -> DataFrame:
    """``documents`` with the struct ``name`` of n_words, n_hit, n_items, item_ids, contaminated and hit_positions."""
    windows = windows_of(benchmark, window)
    n = windows.limit(max_windows + 1).count()
    text = F.col("text").cast("string")
    if n <= max_windows:
        buckets = max(16, 2 * n)
        rows = windows.select("words", "items", F.pmod(F.xxhash64("words"), F.lit(buckets)).alias("bucket")).collect()
        found = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _by_constants(w, rows, buckets).alias("hits")))
    else:
        key, hits = fresh([*documents.columns, name], "key", "hits")
        keyed = documents.withColumn(key, F.sha2(text, 256))
        # stored, so that the join below reads it anew and a text with very many copies can be split
        matched = cut(_by_join(keyed.where(text.isNotNull()).select(text.alias("text"), F.col(key).alias("key")), windows))
        matched = matched.select(F.col("key").alias(key), F.col("hits").alias(hits))
        # null texts have no key to be dealt by
        null = keyed.where(text.isNull()).withColumn(hits, F.lit(None).cast(matched.schema[hits].dataType))
        documents = keyed.where(text.isNotNull()).join(matched, key, "left").select(*keyed.columns, hits).unionByName(null)
        found = F.struct(F.size(words_of(text)).alias("n"), F.coalesce(F.col(hits), F.array().cast(HIT)).alias("hits"))

    def counted(x: Column) -> Column:
        items = F.sort_array(F.array_distinct(F.flatten(F.transform(x["hits"], lambda h: h["items"]))))
        return F.struct(x["n"].cast("long").alias("n_words"), items.alias("item_ids"), hit_words(x["hits"]).alias("hit_positions"))

    def verdict(x: Column) -> Column:
        n_hit = F.size(x["hit_positions"]).cast("long")
        return F.struct(
            x["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(x["item_ids"]).cast("long").alias("n_items"), x["item_ids"].alias("item_ids"),
            ((n_hit > 0) & (20 * n_hit >= x["n_words"])).alias("contaminated"), x["hit_positions"].alias("hit_positions"),
        )

    return documents.withColumn(name, let(let(found, counted), verdict))


def match(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Adds n_words, n_hit, n_items, item_ids, contaminated and hit_positions to each row of ``documents``.

    Null and wordless texts have no hits; an empty benchmark hits nothing and an
    empty table gives no rows; repeated rows are judged alike.  ``contaminated``:
    at least one word in twenty is hit.  A text is read whole, whatever its
    length.  Columns of the input with a name of the result are replaced, all
    others come back as they are.
    """
    own = [c for c in documents.columns if c.lower() not in ADDED]
    (name,) = fresh(documents.columns, "judged")
    judged = _judged(documents, benchmark, name, window, max_windows)
    return judged.select(*(F.col(f"`{c}`") for c in own), *(F.col(f"`{name}`.{c}") for c in ADDED))


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns that the contract of op5 fixes."""
    found = match(documents.select("doc_id", "text"), benchmark)
    sha = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


def _without(x: Column) -> Column:
    """The text of words ``w`` between gaps ``g`` without the words at the sorted places ``at`` (from 1); gaps stay."""
    some = lambda what, a, b: F.slice(x[what], a + 1, b - a)
    woven = lambda a, b: F.array_join(F.zip_with(some("g", a, b), some("w", a, b), lambda g, w: F.concat(g, w)), "")
    heads = F.filter(F.sequence(F.lit(0), F.size(x["at"]) - 1), lambda i: (i == 0) | (F.get(x["at"], i) > F.get(x["at"], i - 1) + 1))
    last = lambda h, j: F.get(x["at"], F.coalesce(F.get(h, j + 1), F.size(x["at"])) - 1)
    runs = let(heads, lambda h: F.transform(h, lambda i, j: F.struct((F.get(x["at"], i) - 1).alias("start"), last(h, j).alias("end"))))

    def build(r: Column) -> Column:
        before = lambda j: F.when(j > 0, F.get(r, j - 1)["end"]).otherwise(0)
        pieces = F.transform(r, lambda s, j: F.concat(woven(before(j), s["start"]), F.array_join(some("g", s["start"], s["end"]), "")))
        return F.concat(F.array_join(pieces, ""), woven(F.element_at(r, -1)["end"], F.size(x["w"])), F.element_at(x["g"], -1))

    return let(runs, build)


def remove(documents: DataFrame, benchmark: DataFrame, what: str = "documents", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without contaminated ones, or (``what="spans"``) all of them without their hit words.

    All columns but the text come back as they are, whatever their names.
    """
    (name,) = fresh(documents.columns, "judged")
    found = _judged(documents, benchmark, name, window, max_windows)
    own = [F.col(f"`{c}`") for c in documents.columns]
    if what == "documents":
        return found.where(~F.col(f"`{name}`.contaminated")).select(*own)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    places = F.col(f"`{name}`.hit_positions")
    parts = F.struct(F.regexp_extract_all("text", F.lit(word), 0).alias("w"), F.split("text", word, -1).alias("g"), F.array_sort(places).alias("at"))
    kept = let(parts, _without)
    text = F.when(F.size(places) > 0, kept).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*own)


ORACLE = r"""
    WITH item AS (
        SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
        FROM benchmark WHERE text IS NOT NULL),
    win AS (
        SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g, least(len(w), 13) AS size
        FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
    doc AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
        FROM documents),
    gram AS (
        SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
        FROM doc, (SELECT DISTINCT size FROM win), unnest(range(1, len(w) - size + 2)) AS t(i)),
    hit AS (SELECT r, i, gram.size, item FROM gram JOIN win ON gram.g = win.g AND gram.size = win.size),
    cover AS (SELECT r, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + size)) AS t(p) GROUP BY r),
    found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN cover USING (r) LEFT JOIN found USING (r)"""
