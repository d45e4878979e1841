"""Queries over documents, pages and events: lookups, timeline, encounters, search, audit and profile."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.columns import let
from chartloom.operators import containment


def timeline_order(date: str, key: str) -> list[Column]:
    return [F.desc_nulls_last(date), F.desc(key)]


def gather_order(date: str, key: str) -> list[Column]:
    return [F.asc_nulls_last(date), F.asc(key)]


def in_range(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive on both sides; undated rows only without any bound."""
    if start is None and end is None:
        return df
    kept = df.where(F.col(date).isNotNull())
    if start is not None:
        kept = kept.where(F.col(date) >= F.lit(start))
    return kept if end is None else kept.where(F.col(date) <= F.lit(end))


HAN = r"\x{4E00}-\x{9FFF}"
UNIT = rf"[{HAN}]+|[\p{{L}}\p{{N}}&&[^{HAN}]]+"
SHOWN = rf"[{HAN}]|[\p{{L}}\p{{N}}&&[^{HAN}]]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a run of Chinese characters becomes its pairs of neighbours."""
    pairs = lambda w: F.when(w.rlike(f"^[{HAN}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), 0), pairs))


def phrases(query: str) -> list[list[str]]:
    """The words of a query, each as its runs of letters and digits; words without any are left out."""
    han = lambda c: "\u4e00" <= c <= "\u9fff"
    found = []
    for word in query.lower().split():
        runs: list[str] = []
        last = None
        for c in word:
            kind = han(c) if c.isalnum() else None
            if kind is not None:
                runs = [*runs[:-1], runs[-1] + c] if kind == last else [*runs, c]
            last = kind
        if runs:
            found.append(runs)
    return found


def _pattern(runs: list[str]) -> str:
    """A regular expression for neighbouring tokens in lower-cased text."""
    han = lambda r: "\u4e00" <= r[0] <= "\u9fff"
    border = lambda r: f"[{HAN}]" if han(r) else rf"[\p{{L}}\p{{N}}&&[^{HAN}]]"
    one = lambda r: r if han(r) and len(r) > 1 else f"(?<!{border(r)}){r}(?!{border(r)})"
    return r"[^\p{L}\p{N}]*".join(map(one, runs))


def search(pages: DataFrame, query: str, limit: int, text: str = "text", key: str = "doc_id", title: str | None = None) -> DataFrame:
    """The first ``limit`` pages, by key, whose title or text has every word of the query; none for a query without words.

    A word of several tokens must have them side by side.  Pages are scanned:
    plain containment is tried first, as it is far cheaper than borders.
    ``search_index`` answers from a table of tokens instead.
    """
    wanted = phrases(query)
    hit = F.lit(bool(wanted))
    for runs in wanted:
        has = F.lit(False)
        for column in [text] + ([title] if title else []):
            low, found = F.lower(F.col(column)), F.lit(True)
            for r in runs:
                found = found & low.contains(r)
            has = has | F.coalesce(found & low.rlike(_pattern(runs)), F.lit(False))
        hit = hit & has
    return pages.where(hit).orderBy(key).limit(limit)


def postings(pages: DataFrame, key: str, columns: list[str], *more: str) -> DataFrame:
    """(more, key, part, token, places): where each token stands in the columns of each page."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), tokens(F.col(c)).alias("t")) for i, c in enumerate(columns)))
    rows = pages.select(*more, key, F.explode(parts).alias("p")).select(*more, key, "p.part", F.posexplode("p.t").alias("place", "token"))
    return rows.groupBy(*more, key, "part", "token").agg(F.array_sort(F.collect_list("place")).alias("places"))


def token_table(pages: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, key, part, places), ordered by token for a table whose files prune by it.

    A frequent token's rows are spread over several files, as the order goes on by
    key.  ``search_table`` keeps an index that a search need not read whole.
    """
    return postings(pages, key, columns).select("token", key, "part", "places").repartitionByRange("token", key).sortWithinPartitions("token", key)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def query_tokens(query: str) -> list[list[str]]:
    """The words of a query, each as the tokens that have to stand side by side."""
    pairs = lambda r: [r[i : i + 2] for i in range(len(r) - 1)] if len(r) > 1 and "\u4e00" <= r[0] <= "\u9fff" else [r]
    return [[t for r in runs for t in pairs(r)] for runs in phrases(query)]


def search_index(index: DataFrame, query: str, limit: int, key: str = "doc_id") -> DataFrame:
    """(key): the first ``limit`` pages, by key, that ``search`` would find, from a ``token_table``; only the query's tokens are read."""
    wanted = query_tokens(query)
    if not wanted:
        return index.select(key).limit(0)
    every = sorted({t for words in wanted for t in words})
    rows = index.where(F.col("token").isin(*every))
    per_part = rows.groupBy(key, "part").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("at"))
    hits = []
    for words in wanted:
        shifted = [_moved(F.col("at")[t], i) for i, t in enumerate(words)]
        both = shifted[0]
        for s in shifted[1:]:
            both = F.array_intersect(both, s)
        hits.append(F.coalesce(F.size(both) > 0, F.lit(False)))
    found = per_part.select(key, *(h.alias(f"_h{i}") for i, h in enumerate(hits)))
    whole = found.groupBy(key).agg(*(F.bool_or(f"_h{i}").alias(f"_h{i}") for i in range(len(hits))))
    return whole.where(" AND ".join(f"_h{i}" for i in range(len(hits)))).select(key).orderBy(key).limit(limit)


def snippet(text: Column, query: str, most: int = 12) -> Column:
    """Up to ``most`` tokens around the first hit, hits in square brackets, an ellipsis where text is left out.

    A Chinese character counts as a token; the window begins at most three tokens before the hit.
    """
    found = phrases(query)
    pattern = "|".join(map(_pattern, found)) or "(?!)"

    def window(x: Column) -> Column:
        hit = F.regexp_instr(F.lower(x["t"]), F.lit(pattern))
        before = F.when(hit > 0, F.size(F.regexp_extract_all(F.substring(x["t"], F.lit(1), hit - 1), F.lit(SHOWN), 0))).otherwise(0)
        n = F.size(x["w"])
        return let(F.greatest(F.least(before - 3, n - most), F.lit(0)), lambda s: F.struct(s.alias("s"), F.least(n, s + most).alias("e"), n.alias("n"), x["w"].alias("w"), x["g"].alias("g")))

    def shown(x: Column) -> Column:
        some = lambda c, a: F.slice(x[c], a, x["e"] - x["s"])
        woven = F.concat(F.get(some("w", x["s"] + 1), 0), F.array_join(F.zip_with(F.slice(x["g"], x["s"] + 2, x["e"] - x["s"] - 1), F.slice(x["w"], x["s"] + 2, x["e"] - x["s"] - 1), lambda g, w: F.concat(g, w)), ""))
        marked = F.regexp_replace(woven, f"(?iu)({pattern})", "[$1]")
        return F.when(x["n"] > 0, F.concat(F.when(x["s"] > 0, "…").otherwise(""), marked, F.when(x["e"] < x["n"], "…").otherwise(""))).otherwise("")

    parts = F.struct(text.alias("t"), F.regexp_extract_all(text, F.lit(SHOWN), 0).alias("w"), F.split(text, SHOWN, -1).alias("g"))
    return let(let(parts, window), shown)


def search_results(pages: DataFrame, documents: DataFrame, query: str, limit: int, key: str, text: str = "text", title: str | None = None) -> DataFrame:
    """The documents of the hits with a ``snippet`` of each; a document may come once for each of its pages."""
    hits = search(pages, query, limit, text, key, title).select(F.col(key), snippet(F.col(text), query).alias("snippet"))
    return documents.join(hits, key)


#: So many phrases are broadcast, some 200 bytes each; with more, the openings are joined by a shuffle.
BROADCAST_PHRASES = 100_000
#: So many openings are looked up in the row before windows are made rows of, 8 bytes each.
KNOWN_OPENINGS = 20_000


def phrase_hits(documents: DataFrame, phrases: DataFrame, document: str, phrase: str, text: str = "text") -> DataFrame:
    """(document, phrase), each once: the documents whose text contains the phrase's, character by character.

    A text that has a phrase has all its inner words whole: up to six of them are
    found by equality, then the whole phrase is looked for.  A phrase of one or two
    words has none; it stands within so many words of the text, and the different
    ones of those are joined with it by their grams.  An empty phrase hits nothing.
    """
    inner = lambda c: F.greatest(F.least(F.size(F.split(c, " ")) - 2, F.lit(6)), F.lit(0))
    items = phrases.where(F.col(text).isNotNull()).select(phrase, F.col(text).alias("_phrase"), inner(F.col(text)).alias("_n"))
    items = items.withColumn("_opening", F.array_join(F.slice(F.split("_phrase", " "), 2, F.greatest("_n", F.lit(1))), " "))
    n = items.limit(BROADCAST_PHRASES + 1).count()
    look = F.broadcast(items) if n <= BROADCAST_PHRASES else items
    docs = documents.select(document, F.col(text).alias("_text")).where("_text IS NOT NULL")
    sizes = sorted(r[0] for r in items.select("_n").distinct().collect())  # at most seven

    def windows(w: Column, n: int, keep: Callable[[Column], Column] | None = None) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        # by places, as a slice copies the whole array first
        window = lambda i: F.concat_ws(" ", *(F.get(w, i + (k - 1)) for k in range(n)))
        kept = starts if keep is None else F.filter(starts, lambda i: keep(F.xxhash64(window(i))))
        return F.transform(kept, lambda i: F.struct(F.lit(n).alias("_n"), window(i).alias("_opening")))

    found = [docs.select(document, F.explode(F.array().cast(items.select(F.array(phrase).alias("a")).schema["a"].dataType)).alias(phrase))]
    if 0 in sizes:
        whole = items.where("_n = 0 AND _phrase <> ''").select(phrase, "_phrase", F.size(F.split("_phrase", " ")).alias("_w"))
        for k in (1, 2):
            asked = whole.where(F.col("_w") == k)
            said = docs.select(document, F.explode(F.array_distinct(let(F.split("_text", " "), lambda w: F.transform(windows(w, k), lambda x: x["_opening"])))).alias("_in"))  # noqa: B023
            hits = containment.contained(said.select("_in"), asked.select("_phrase"), "_in", "_phrase")
            found.append(said.join(hits, "_in").join(asked, "_phrase").select(document, phrase))
    if some := [n for n in sizes if n > 0]:
        known = items.where("_n > 0").select(F.xxhash64("_opening").alias("h")).distinct().limit(KNOWN_OPENINGS + 1).collect() if n <= BROADCAST_PHRASES else []
        keep = (lambda h: h.isin([r.h for r in known])) if 0 < len(known) <= KNOWN_OPENINGS else None
        grams = docs.select(document, F.explode(let(F.split("_text", " "), lambda w: F.concat(*(windows(w, n, keep) for n in some)))).alias("_g")).select(document, "_g.*")
        near = grams.join(look, ["_n", "_opening"]).select(document, phrase, "_phrase").distinct()
        found.append(near.join(docs, document).where(F.col("_text").contains(F.col("_phrase"))).select(document, phrase))
    return reduce(DataFrame.union, found).distinct()


def page_texts(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, text): the pages' texts in order, joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return pages.groupBy(document).agg(F.array_join(F.transform(ordered, lambda p: p[text]), "\n").alias("text"))


def page_facts(pages: DataFrame, document: str, page: str, confidence: str | None = None, backend: str | None = None) -> DataFrame:
    """(document, n_pages, confidence, mean_confidence, backend): the least and mean confidence of pages that have one, the first page's backend.

    Without any confidence the least is null and the mean 0.
    """
    parts = [F.count("*").alias("n_pages")]
    if confidence:
        parts += [F.min(confidence).alias("confidence"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("mean_confidence")]
    if backend:
        parts.append(F.min_by(backend, page).alias("backend"))
    return pages.groupBy(document).agg(*parts)


def documents_where(documents: DataFrame, condition: Column | str, date: str, key: str) -> DataFrame:
    """The documents of a predicate in the timeline's order: by id, by source, by study, by encounter."""
    return documents.where(condition).orderBy(*timeline_order(date, key))


def has_document(files: DataFrame, documents: DataFrame, file: str) -> DataFrame:
    """``files`` with ``has_document``."""
    have = documents.select(file).distinct().withColumn("_have", F.lit(True))
    return files.join(have, file, "left").withColumn("has_document", F.coalesce("_have", F.lit(False))).drop("_have")


def details(documents: DataFrame, files: DataFrame, pages: DataFrame, document: str, file: str, page: str = "page_no", text: str = "text", confidence: str = "confidence", backend: str = "backend") -> DataFrame:
    """Each document that has its file, with the file's columns, its text, confidence and backend; texts of pageless documents are empty."""
    facts = page_facts(pages, document, page, confidence, backend).drop("n_pages", "mean_confidence").withColumnRenamed("confidence", "ocr_confidence").withColumnRenamed("backend", "ocr_backend")
    texts = page_texts(pages, document, page, text).withColumnRenamed("text", "ocr_text")
    joined = documents.join(files, file).join(texts, document, "left").join(facts, document, "left")
    return joined.withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))


def gathered(documents: DataFrame, group: list[str], date: str, key: str) -> DataFrame:
    """``documents`` with ``place``, from 0, in the order of the illness: oldest first, undated last."""
    return documents.withColumn("place", (F.row_number().over(Window.partitionBy(*group).orderBy(*gather_order(date, key))) - 1).cast("long"))


def timeline(documents: DataFrame, group: list[str], date: str, key: str) -> DataFrame:
    """``documents`` with ``place``, from 1, newest first and undated last."""
    return documents.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*timeline_order(date, key))).cast("long"))


def slices(imaging: DataFrame, document: str, series: str, instance: str, *key: str) -> DataFrame:
    """``imaging`` with ``place``, from 1, in the stack of its document: by series, then instance, each null last, then key."""
    w = Window.partitionBy(document).orderBy(F.asc_nulls_last(series), F.asc_nulls_last(instance), *key)
    return imaging.withColumn("place", F.row_number().over(w).cast("long"))


def slice_counts(documents: DataFrame, imaging: DataFrame, document: str) -> DataFrame:
    """``documents`` with ``n_slices``, 0 where there are none."""
    counts = imaging.groupBy(document).agg(F.count("*").alias("n_slices"))
    return documents.join(counts, document, "left").withColumn("n_slices", F.coalesce("n_slices", F.lit(0)))


def study_document(documents: DataFrame, study_uid: str, key: str) -> DataFrame:
    """The document of a study, the least key should there be several."""
    return documents.where(F.col("study_uid") == study_uid).orderBy(key).limit(1)


def document_of_slice(documents: DataFrame, imaging: DataFrame, document: str, slice: str, value) -> DataFrame:
    """The documents that have the slice."""
    return documents.join(imaging.where(F.col(slice) == value).select(document).distinct(), document, "left_semi")


def inpatient_windows(documents: DataFrame, windows: DataFrame, group: str) -> DataFrame:
    """Each document with the first window (by window_order) that contains its date, or null.

    ``documents``: group, doc, date; ``windows``: group, window, window_order, start,
    end.  The earliest window wins, which is what claiming them one by one gives.
    The days that a window covers whole are cut into whole months and the days at
    its ends, of each of which only the first window is kept, so a document is
    looked up by its month and by its day, however many windows overlap.  Where
    times have hours, the first and last day of a window are compared by them.
    """
    w = windows.select(F.col(group).alias("_g"), F.struct("window_order", "window").alias("_w"), F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s <= _e")
    days = documents.schema["date"].dataType.simpleString() == windows.schema["start"].dataType.simpleString() == windows.schema["end"].dataType.simpleString() == "date"
    first, last = (F.col("_s"), F.col("_e")) if days else (F.date_add(F.to_date("_s"), 1), F.date_sub(F.to_date("_e"), 1))
    spans = w.withColumns({"_f": first, "_l": last}).where("_f <= _l")
    spans = spans.withColumns({"_m": F.when(F.trunc("_f", "MM") == F.col("_f"), F.col("_f")).otherwise(F.add_months(F.trunc("_f", "MM"), 1)), "_n": F.add_months(F.trunc(F.date_add("_l", 1), "MM"), -1)})
    none, day, month = F.array().cast("array<date>"), F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 MONTH")
    whole = F.col("_m") <= F.col("_n")
    ends = F.concat(
        F.when(F.col("_f") < F.col("_m"), F.sequence("_f", F.date_sub("_m", 1), day)).otherwise(none),
        F.when(F.last_day("_n") < F.col("_l"), F.sequence(F.date_add(F.last_day("_n"), 1), "_l", day)).otherwise(none),
    )
    cover = lambda bins: spans.select("_g", "_w", F.explode(bins).alias("_b")).groupBy("_g", "_b").agg(F.min("_w").alias("_w"))
    months = cover(F.when(whole, F.sequence("_m", "_n", month)).otherwise(none))
    edges = cover(F.when(whole, ends).otherwise(F.sequence("_f", "_l", day)))
    looked = documents.join(months.withColumnRenamed("_w", "_w1"), (F.col(group) == F.col("_g")) & (F.trunc("date", "MM") == F.col("_b")), "left").drop("_g", "_b")
    looked = looked.join(edges.withColumnRenamed("_w", "_w2"), (F.col(group) == F.col("_g")) & (F.to_date("date") == F.col("_b")), "left").drop("_g", "_b")
    found = [F.col("_w1"), F.col("_w2")]
    if not days:
        borders = w.select("*", F.explode(F.array_distinct(F.array(F.to_date("_s"), F.to_date("_e")))).alias("_b"))
        inside = (F.col(group) == F.col("_g")) & (F.to_date("date") == F.col("_b")) & (F.col("date") >= F.col("_s")) & (F.col("date") <= F.col("_e"))
        at = documents.join(borders, inside).groupBy(group, "doc").agg(F.min("_w").alias("_w3"))
        looked = looked.join(at, [group, "doc"], "left")
        found.append(F.col("_w3"))
    return looked.select(*documents.columns, F.array_min(F.array(*found))["window"].alias("window"))


def same_day(documents: DataFrame, group: str, emergency: Column) -> DataFrame:
    """(group, day, n_docs, kind) of the dated documents."""
    dated = documents.where(F.col("date").isNotNull()).withColumn("day", F.to_date("date"))
    kind = F.when(F.bool_or(emergency), "emergency").otherwise("outpatient")
    return dated.groupBy(group, "day").agg(F.count("*").alias("n_docs"), kind.alias("kind"))


def provider(text: Column) -> Column:
    """The first hospital's name in a text, or null."""
    found = F.regexp_extract(text, r"([\x{4E00}-\x{9FA5}]{2,18}?(?:医院|医学中心))", 1)
    return F.when(found != "", found)


def page_providers(pages: DataFrame, group: str, document: str, page: str, text: str = "text") -> DataFrame:
    """(group, doc, provider, at) of the pages that name one; ``at`` orders them by document and page."""
    rows = pages.select(group, F.col(document).alias("doc"), provider(F.col(text)).alias("provider"), F.struct(F.col(document).alias("doc"), F.col(page).alias("page")).alias("at"))
    return rows.where("provider IS NOT NULL")


def discharge_windows(documents: DataFrame, group: str) -> DataFrame:
    """(group, window, window_order, start, end) of the discharge summaries that have both dates, in order of date and document."""
    some = documents.where("doc_type = 'discharge_summary' AND date IS NOT NULL AND date_end IS NOT NULL")
    order = F.row_number().over(Window.partitionBy(group).orderBy("date", "doc"))
    return some.select(group, F.col("doc").alias("window"), order.alias("window_order"), F.col("date").alias("start"), F.col("date_end").alias("end"))


def _commonest(said: Column) -> Column:
    """struct(provider, n_kinds) of an array of struct(provider, at): the commonest, of equals the first seen."""
    kinds = F.array_distinct(F.transform(said, lambda x: x["provider"]))

    def ranked(x: Column) -> Column:
        of = lambda k: F.filter(x["said"], lambda y: y["provider"] == k)
        best = F.transform(x["kinds"], lambda k: let(of(k), lambda own: F.struct((-F.size(own)).alias("n"), F.array_min(F.transform(own, lambda y: y["at"])).alias("at"), k.alias("provider"))))
        return F.struct(F.array_min(best)["provider"].alias("provider"), F.size(x["kinds"]).alias("n_kinds"))

    return let(F.struct(said.alias("said"), kinds.alias("kinds")), ranked)


def encounters(documents: DataFrame, group: str, emergency: Column, windows: DataFrame | None = None, providers: DataFrame | str | None = None) -> DataFrame:
    """(group, encounter, kind, provider, transferred, start, end, title, n_docs, docs) of inpatient stays and of days, for many patients at once.

    ``documents``: group, doc, date; ``providers``: group, doc, provider, at, or the
    column of ``documents`` that names one, seen in the order of documents.  Encounters are numbered from 1: stays in the order of their windows, then days.
    ``docs`` are in the timeline's order.  The provider is the commonest, of equals
    the first seen; two or more make a transfer.  A stay without documents stays.
    """
    claimed = documents.withColumn("window", F.lit(None).cast("string")) if windows is None else inpatient_windows(documents, windows, group)
    day = F.when(F.col("window").isNull(), F.to_date("date"))
    placed = claimed.withColumn("_enc", F.coalesce(F.concat(F.lit("w"), F.col("window").cast("string")), F.concat(F.lit("d"), day.cast("string")))).where("_enc IS NOT NULL")
    newest = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("date", "doc")))), lambda d: d["doc"])
    own = isinstance(providers, str)
    said = _commonest(F.collect_list(F.when(F.col(providers).isNotNull(), F.struct(F.col(providers).alias("provider"), F.col("doc").alias("at"))))) if own else F.lit(None).cast("struct<provider:string,n_kinds:int>")
    members = placed.groupBy(group, "_enc").agg(F.count("*").alias("n_docs"), newest.alias("docs"), F.bool_or(emergency).alias("_em"), F.min(F.to_date("date")).alias("_day"), said.alias("_said"))
    named = F.col("_em").isNotNull() & F.col("_em")
    kind, label = F.when(named, "emergency").otherwise("outpatient"), F.when(named, "急诊 · ").otherwise("门诊 · ")
    none = F.lit(None).cast("date")
    rows = members.where("_enc LIKE 'd%'").select(
        group, "_enc", F.lit(1).alias("_late"), F.lit(0).alias("_order"), kind.alias("kind"), F.col("_day").alias("start"), none.alias("end"), F.concat(label, F.date_format("_day", "yyyy-MM-dd")).alias("title"), "n_docs", "docs", "_said"
    )
    if windows is not None:
        text = F.concat(F.lit("住院 · "), F.date_format("start", "yyyy-MM-dd"), F.lit(" → "), F.date_format("end", "yyyy-MM-dd"))
        named_windows = windows.withColumn("_enc", F.concat(F.lit("w"), F.col("window").cast("string")))
        stays = named_windows.join(members.drop("_em", "_day"), [group, "_enc"], "left").select(
            group, "_enc", F.lit(0).alias("_late"), F.col("window_order").alias("_order"), F.lit("inpatient").alias("kind"), F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"),
            text.alias("title"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("docs", F.array().cast(members.schema["docs"].dataType)).alias("docs"), "_said",
        )
        rows = stays.unionByName(rows)
    if providers is None:
        rows = rows.withColumns({"provider": F.lit(None).cast("string"), "transferred": F.lit(False)})
    elif own:
        rows = rows.withColumns({"provider": F.col("_said.provider"), "transferred": F.coalesce(F.col("_said.n_kinds") >= 2, F.lit(False))})
    else:
        said = providers.join(placed.select(group, "doc", "_enc"), [group, "doc"])
        mode = mode_of(said, [group, "_enc"], "provider", "at").select(group, "_enc", "provider", (F.col("n_kinds") >= 2).alias("transferred"))
        rows = rows.join(mode, [group, "_enc"], "left").withColumn("transferred", F.coalesce("transferred", F.lit(False)))
    rows = rows.withColumn("title", F.when(F.col("transferred"), F.concat("title", F.lit(" · 转院"))).otherwise(F.col("title")))
    number = F.row_number().over(Window.partitionBy(group).orderBy("_late", "_order", "start")).cast("long")
    return rows.withColumn("encounter", number).select(group, "encounter", "kind", "provider", "transferred", "start", "end", "title", "n_docs", "docs")


def standalone(documents: DataFrame) -> DataFrame:
    """The documents that no encounter takes: those without a date."""
    return documents.where(F.col("date").isNull())


def grouped_timeline(documents: DataFrame, group: str, emergency: Column, windows: DataFrame | None = None, providers: DataFrame | str | None = None) -> DataFrame:
    """Encounters and standalone documents of each patient, newest first: ``place`` from 1, the encounter's columns, or one document in ``docs``.

    Of equal dates encounters come first, later ones before earlier ones; what has no date comes last.
    """
    found = encounters(documents, group, emergency, windows, providers)
    alone = standalone(documents).select(group, F.col("doc").alias("_doc"), F.array("doc").alias("docs"), F.lit("document").alias("kind"), F.lit(1).cast("bigint").alias("n_docs"))
    every = found.unionByName(alone, allowMissingColumns=True)
    order = [F.desc_nulls_last("start"), F.col("encounter").isNull(), F.desc("encounter"), F.desc("_doc")]
    return every.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).drop("_doc")


def mode_of(df: DataFrame, group: list[str], value: str, position: str | None = None) -> DataFrame:
    """(group, value, n, n_kinds): the commonest value; ties go to the first seen, or the smallest without a position."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"), *([F.min(position).alias("_at")] if position else []))
    best = F.struct(-F.col("n"), "_at" if position else value, value)
    return counts.groupBy(*group).agg(F.min_by(F.struct(value, "n"), best).alias("_b"), F.count("*").alias("n_kinds")).select(*group, f"_b.{value}", "_b.n", "n_kinds")


def patient_profile(pages: DataFrame, group: str, text: str = "text", demographics: dict[str, str] = T.DEMOGRAPHICS) -> DataFrame:
    """(group, name, gender, birth_date, age, record_count): the commonest value of each over the patient's pages, of equals the smallest.

    ``record_count`` counts pages, not documents.
    """
    fields = ("name", "gender", "birth_date", "age")
    said = pages.select(group, T.demographics(F.col(text), demographics).alias("d"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").cast("string").alias("value")) for f in fields))
    counts = said.select(group, F.explode(pairs).alias("p")).where("p.value IS NOT NULL").groupBy(group, "p.field", "p.value").agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(*(F.min_by("value", F.when(F.col("field") == f, F.struct(-F.col("n"), "value"))).alias(f) for f in fields))
    return pages.groupBy(group).agg(F.count("*").alias("record_count")).join(best, group, "left").select(group, *fields, "record_count")


def mismatched(documents: DataFrame, detected: str, member: Column) -> DataFrame:
    """``documents`` with ``mismatch``: the detected name where it isn't blank and isn't the member's."""
    name = F.col(detected)
    return documents.withColumn("mismatch", F.when((T.trimmed(name) != "") & ~name.eqNullSafe(member), name))


# fixed values: what types of documents and kinds of encounters are called
TYPE_LABELS = {"lab_report": "化验", "imaging_report": "检查", "discharge_summary": "出院", "prescription": "处方", "clinical_note": "病历", "pathology": "病理", "surgery": "手术", "other": "其他", "unknown": "未分类"}
KIND_LABELS = {"inpatient": "住院", "outpatient": "门诊", "emergency": "急诊", "exam": "体检"}


def label(value: Column, labels: dict[str, str] = TYPE_LABELS) -> Column:
    """What a type or kind is called; null for values that are none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), value)


def type_facet(documents: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, doc_type, label, n) of the types that occur."""
    return documents.groupBy(*(group or []), "doc_type").agg(F.count("*").alias("n")).withColumn("label", label(F.col("doc_type")))


def audit(log: DataFrame) -> DataFrame:
    """(ts, device_id, seq, action, detail, sha256) of the four audited kinds of events; callers order them newest first."""
    count = F.concat(F.col("record_count").cast("string"), F.lit(" 条记录"))
    kinds = {
        "FileImported": ("导入", F.col("original_name"), F.col("content_hash")),
        "ExportPerformed": ("导出", F.concat("kind", F.lit(" · "), count), F.col("sha256")),
        "ShareCreated": ("分享", F.concat(count, F.lit(" · 有效期至 "), "expires"), F.col("sha256")),
        "DocumentDeleted": ("删除", F.lit("移除一份文档"), F.col("source_file_hash")),
    }
    action, detail, sha = (F.lit(None).cast("string") for _ in range(3))
    for kind, (name, text, digest) in kinds.items():
        test = F.col("type") == kind
        action, detail, sha = F.when(test, name).otherwise(action), F.when(test, text).otherwise(detail), F.when(test, digest).otherwise(sha)
    return log.where(F.col("type").isin(*kinds)).select("ts", "device_id", "seq", action.alias("action"), detail.alias("detail"), sha.alias("sha256"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops the rest before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def line_rows(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): one row for each line, numbered from 1."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line")).select(key, (F.col("_i") + 1).alias("line_no"), "line")


def islands(lines: DataFrame, key: str, test: Column, at_least: int) -> DataFrame:
    """(key, first_line, last_line, n_lines) of the runs of at least so many neighbouring lines that pass."""
    w = Window.partitionBy(key).orderBy("line_no")
    runs = lines.where(test).withColumn("_run", F.col("line_no") - F.row_number().over(w))
    return runs.groupBy(key, "_run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines")).where(F.col("n_lines") >= at_least).drop("_run")
