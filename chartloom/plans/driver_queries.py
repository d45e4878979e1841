"""One query for each operator over the driver's tables, and its DuckDB equivalent.

The tables stand in for the record's: events for the log (a user is a device),
conversations for pages, documents for page texts (a source is a provider),
orders and line items for dated records and measurements of patients, parts for
the dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions import blocks
from chartloom.functions import text as T
from chartloom.operators import clinical, containment, ordering, records, replay, search_table, share, terms
from chartloom.session import remove, scratch
from chartloom.sources import files, vault
from chartloom.sources import log as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table reader under its name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT event_id, row_number() OVER (ORDER BY ts, user_id, event_id) AS place FROM events")
def merge_order(t):
    bucket = F.date_trunc("hour", F.col("ts"))
    return ordering.numbered(t("events").select("event_id", "ts", "user_id"), bucket, [F.col("ts"), F.col("user_id"), F.col("event_id")], "place").select("event_id", F.col("place").cast("long").alias("place"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def cas_dedup(t):
    rows = t("documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.encode("text", "UTF-8").alias("content"))
    kept = files.objects(rows).select("hash", F.sha2("content", 256).alias("again")).where("hash = again").drop("again")
    return kept.join(rows.groupBy(F.col("content_hash").alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "hash")


@query("SELECT doc_id, 'objects/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path FROM documents")
def object_path(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("h")).select("doc_id", T.object_path(F.col("h")).alias("path"))


@query("""WITH mark AS (SELECT user_id, CAST(floor(avg(event_id)) AS BIGINT) AS applied FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)
    SELECT e.user_id, e.event_id FROM events e LEFT JOIN mark m ON e.user_id = m.user_id WHERE e.event_id > coalesce(m.applied, 0)""")
def pending_after_watermark(t):
    events = t("events").select("user_id", "event_id")
    marks = events.where("user_id % 4 <> 0").groupBy("user_id").agg(F.floor(F.avg("event_id")).alias("applied"))
    return replay.pending(events, marks, "user_id", "event_id")


@query("SELECT user_id, max(event_id) AS applied FROM events GROUP BY user_id")
def watermark_advance(t):
    return replay.advanced(t("events"), "user_id", "event_id")


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'
    AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.event_id % 400 = events.event_id % 400)""")
def tombstone_anti(t):
    events = t("events").select("event_id", "user_id", "event_type", (F.col("event_id") % 400).alias("hash"))
    return replay.without_tombstones(events.where("event_type <> 'error'"), events.where("event_type = 'error'"), "hash").select("event_id", "user_id", "event_type")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_wins_projection(t):
    return replay.first_wins(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH stop AS (SELECT user_id, min(struct_pack(ts := ts, event_id := event_id)) AS s FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT e.user_id, e.event_id FROM events e LEFT JOIN stop USING (user_id) WHERE s IS NULL OR struct_pack(ts := e.ts, event_id := e.event_id) < s""")
def deferral_cut(t):
    events = t("events").select("user_id", "ts", "event_id", "event_type")
    return replay.before_first(events, F.col("event_type") == "error", "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS place FROM orders")
def timeline(t):
    return records.timeline(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query(r"""SELECT doc_id, lang FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'the')
    AND list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'that') ORDER BY doc_id LIMIT 50""")
def search_and(t):
    return records.search(t("documents"), "The that", 50).select("doc_id", "lang")


@query("""SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, text FROM benchmark UNION ALL SELECT 100000 + item_id, array_to_string(string_split(text, ' ')[3:7], ' ') FROM benchmark) b ON contains(d.text, b.text)""")
def phrase_hits(t):
    items = t("benchmark").select("item_id", "text")
    short = items.select((F.col("item_id") + 100000).alias("item_id"), F.array_join(F.slice(F.split("text", " "), 3, 5), " ").alias("text"))
    return records.phrase_hits(t("documents"), items.unionByName(short), "doc_id", "item_id")


@query(r"""WITH hit AS (SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'the') ORDER BY doc_id LIMIT 300) SELECT doc_id, quality, toxic FROM labels JOIN hit USING (doc_id)""")
def search_join(t):
    return records.search_results(t("documents"), t("labels"), "THE", 300, "doc_id").select("doc_id", "quality", "toxic")


@query(r"""SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'the')
    AND list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'that') ORDER BY doc_id LIMIT 50""")
def search_index(t):
    return records.search_index(records.token_table(t("documents"), "doc_id", ["text"]), "the THAT", 50)


@query(r"""SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'the')
    AND list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'that') ORDER BY doc_id LIMIT 50""")
def search_kept_index(t):
    documents = t("documents")
    folder = scratch(documents.sparkSession)
    search_table.add(documents, folder, "doc_id", ["text"], 1000)
    found = search_table.Index(documents.sparkSession, folder).search("the THAT", 50)
    remove(documents.sparkSession, folder)
    return found


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, string_split_regex(text, '[\p{L}\p{N}]+') AS g FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, len(w) AS n, greatest(coalesce(list_position(list_transform(w, lambda x: lower(x)), 'token'), 1) - 1, 0) AS before FROM t),
    s AS (SELECT *, greatest(least(before - 3, n - 12), 0) AS s FROM h)
    SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || array_to_string(list_transform(range(s + 1, least(n, s + 12) + 1), lambda j: CASE WHEN j > s + 1 THEN g[j] ELSE '' END
        || CASE WHEN lower(w[j]) = 'token' THEN '[' || w[j] || ']' ELSE w[j] END), '') || CASE WHEN s + 12 < n THEN '…' ELSE '' END END AS snippet FROM s""")
def search_snippet(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", records.snippet(F.col("text"), "token").alias("snippet"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ocr_text(t):
    return records.page_texts(t("conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, arg_min(role, turn) AS backend, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def ocr_backend(t):
    return records.page_facts(t("conversations"), "conv_id", "turn", backend="role").select("conv_id", "backend", "n_pages")


@query("SELECT user_id, min(value) AS confidence, coalesce(avg(value), 0) AS mean_confidence FROM events GROUP BY user_id")
def ocr_confidence(t):
    return records.page_facts(t("events"), "user_id", "ts", confidence="value").select("user_id", "confidence", "mean_confidence")


def _stays(t):
    """Orders as documents; an urgent one opens a window of 60 days."""
    orders = t("orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("doc"), F.col("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus")
    order = F.row_number().over(Window.partitionBy("patient").orderBy("date", "doc"))
    windows = orders.where("o_orderpriority = '1-URGENT'").select("patient", F.col("doc").alias("window"), order.alias("window_order"), F.col("date").alias("start"), (F.col("date") + F.expr("INTERVAL 60 DAYS")).alias("end"))
    return orders, windows


WINDOWS = "win AS (SELECT o_custkey AS patient, o_orderkey AS win, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e FROM orders WHERE o_orderpriority = '1-URGENT'), claim AS (SELECT o.o_custkey AS patient, o.o_orderkey AS doc, arg_min(w.win, struct_pack(s := w.s, k := w.win)) AS win FROM orders o JOIN win w ON w.patient = o.o_custkey AND o.o_orderdate BETWEEN w.s AND w.e GROUP BY 1, 2)"


@query(f"WITH {WINDOWS} SELECT o_custkey AS patient, o_orderkey AS doc, claim.win AS \"window\" FROM orders LEFT JOIN claim ON claim.doc = o_orderkey AND claim.patient = o_custkey")
def encounters_inpatient(t):
    orders, windows = _stays(t)
    return records.inpatient_windows(orders, windows, "patient").select("patient", "doc", "window")


@query("SELECT o_custkey AS patient, CAST(o_orderdate AS DATE) AS day, count(*) AS n_docs, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'emergency' ELSE 'outpatient' END AS kind FROM orders GROUP BY 1, 2")
def encounters_sameday(t):
    return records.same_day(_stays(t)[0], "patient", F.col("o_orderpriority") == "1-URGENT")


@query("""WITH n AS (SELECT conv_id, role, count(*) AS n, min(turn) AS pos FROM conversations GROUP BY 1, 2)
    SELECT conv_id, arg_min(role, struct_pack(a := -n, b := pos)) AS role, arg_min(n, struct_pack(a := -n, b := pos)) AS n, count(*) >= 2 AS transferred FROM n GROUP BY conv_id""")
def provider_mode(t):
    return records.mode_of(t("conversations"), ["conv_id"], "role", "turn").select("conv_id", "role", "n", (F.col("n_kinds") >= 2).alias("transferred"))


@query(f"""WITH {WINDOWS}, own AS (SELECT o_custkey AS patient, o_orderkey AS doc, o_orderdate AS date, coalesce('w' || claim.win, 'd' || CAST(o_orderdate AS DATE)) AS enc FROM orders LEFT JOIN claim ON claim.doc = o_orderkey AND claim.patient = o_custkey)
    SELECT patient, count(*) AS n_docs, string_agg(doc, ',' ORDER BY date DESC, doc DESC) AS docs FROM own GROUP BY patient, enc""")
def encounter_docs(t):
    orders, windows = _stays(t)
    found = records.encounters(orders, "patient", F.lit(False), windows).where("n_docs > 0")
    return found.select("patient", "n_docs", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@query("SELECT o_orderkey AS doc, o_custkey AS patient FROM orders WHERE o_orderstatus = 'P'")
def standalone(t):
    orders = t("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("patient"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"))
    return records.standalone(orders).select("doc", "patient")


@query(f"""WITH {WINDOWS},
    doc AS (SELECT o_custkey AS patient, o_orderkey AS doc, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS date, o_orderpriority = '1-URGENT' AS em, o_orderstatus AS provider, coalesce('w' || claim.win, 'd' || CAST(o_orderdate AS DATE)) AS enc
        FROM orders LEFT JOIN claim ON claim.doc = o_orderkey AND claim.patient = o_custkey AND o_orderstatus <> 'P'),
    own AS (SELECT * FROM doc WHERE date IS NOT NULL),
    said AS (SELECT patient, enc, provider, count(*) AS n, min(doc) AS pos FROM own GROUP BY ALL),
    mode AS (SELECT patient, enc, arg_min(provider, struct_pack(a := -n, b := pos)) AS provider, count(*) >= 2 AS transferred FROM said GROUP BY ALL),
    member AS (SELECT patient, enc, count(*) AS n_docs, string_agg(doc, ',' ORDER BY date DESC, doc DESC) AS docs, bool_or(em) AS em, min(CAST(date AS DATE)) AS d FROM own GROUP BY ALL),
    enc AS (
        SELECT win.patient, 'w' || win.win AS enc, 0 AS late, row_number() OVER (PARTITION BY win.patient ORDER BY s, win.win) AS ord, 'inpatient' AS kind, CAST(s AS DATE) AS start, CAST(e AS DATE) AS "end",
            '住院 · ' || strftime(s, '%Y-%m-%d') || ' → ' || strftime(e, '%Y-%m-%d') AS title, coalesce(n_docs, 0) AS n_docs, coalesce(docs, '') AS docs FROM win LEFT JOIN member ON member.patient = win.patient AND member.enc = 'w' || win.win
        UNION ALL SELECT patient, enc, 1, 0, CASE WHEN em THEN 'emergency' ELSE 'outpatient' END, d, NULL, CASE WHEN em THEN '急诊 · ' ELSE '门诊 · ' END || strftime(d, '%Y-%m-%d'), n_docs, docs FROM member WHERE enc LIKE 'd%'),
    numbered AS (SELECT enc.*, row_number() OVER (PARTITION BY enc.patient ORDER BY late, ord, start) AS encounter, mode.provider, coalesce(transferred, false) AS transferred FROM enc LEFT JOIN mode ON mode.patient = enc.patient AND mode.enc = enc.enc),
    every AS (SELECT patient, encounter, kind, provider, transferred, start, "end", CASE WHEN transferred THEN title || ' · 转院' ELSE title END AS title, n_docs, docs, NULL AS alone FROM numbered
        UNION ALL SELECT patient, NULL, 'document', NULL, NULL, NULL, NULL, NULL, 1, CAST(doc AS VARCHAR), doc FROM doc WHERE date IS NULL)
    SELECT patient, encounter, kind, provider, transferred, start, "end", title, n_docs, docs, row_number() OVER (PARTITION BY patient ORDER BY start DESC NULLS LAST, encounter IS NULL, encounter DESC, alone DESC) AS place FROM every""")
def grouped_timeline(t):
    orders, windows = _stays(t)
    documents = orders.withColumn("date", F.when(F.col("o_orderstatus") != "P", F.col("date")))
    found = records.grouped_timeline(documents, "patient", F.col("o_orderpriority") == "1-URGENT", windows, "o_orderstatus")
    return found.withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ","))


@query("""SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY l.quality ASC NULLS LAST, d.doc_id) - 1 AS place FROM documents d LEFT JOIN labels l USING (doc_id)""")
def gather_records(t):
    joined = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return records.gathered(joined, ["source"], "quality", "doc_id").select("source", "doc_id", "place")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-09-30'")
def range_filter(t):
    return records.in_range(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-03-01", "1996-09-30")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber > 1 THEN l_linenumber END NULLS LAST, l_partkey NULLS LAST, l_suppkey, l_extendedprice, l_quantity, l_linenumber) AS place FROM lineitem")
def slice_order(t):
    rows = t("lineitem").withColumn("series", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))
    return records.slices(rows, "l_orderkey", "series", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("SELECT o_orderkey, count(l_orderkey) AS n_slices FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def slice_counts(t):
    return records.slice_counts(t("orders").select("o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN '导入' WHEN 'purchase' THEN '分享' WHEN 'error' THEN '删除' END AS action,
    CASE event_type WHEN 'signup' THEN 'file ' || event_id WHEN 'purchase' THEN event_id || ' 条记录 · 有效期至 ' || user_id ELSE '移除一份文档' END AS detail, sha256(CAST(event_id AS VARCHAR)) AS sha256,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type IN ('signup', 'purchase', 'error')""")
def audit_log(t):
    kinds = F.create_map(*(F.lit(x) for x in ("signup", "FileImported", "purchase", "ShareCreated", "error", "DocumentDeleted")))
    id, digest = F.col("event_id").cast("string"), F.sha2(F.col("event_id").cast("string"), 256)
    log = t("events").select(
        "ts", F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.try_element_at(kinds, F.col("event_type")).alias("type"), F.concat(F.lit("file "), id).alias("original_name"), digest.alias("content_hash"),
        F.lit("x").alias("kind"), F.col("event_id").alias("record_count"), F.col("user_id").cast("string").alias("expires"), digest.alias("source_file_hash"), digest.alias("sha256"),
    )
    w = Window.partitionBy("device_id").orderBy(F.desc("ts"), F.desc("seq"))
    return records.audit(log).select(F.col("seq").alias("event_id"), "action", "detail", "sha256", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, arg_min(event_type, struct_pack(a := -n, b := event_type)) AS event_type, max(n) AS n, sum(n) AS record_count FROM n GROUP BY user_id""")
def profile_mode(t):
    events = t("events")
    return records.mode_of(events, ["user_id"], "event_type").drop("n_kinds").join(events.groupBy("user_id").agg(F.count("*").alias("record_count")), "user_id")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[À-ÿ]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[À-ÿ]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS language FROM documents")
def detect_language(t):
    return t("documents").select("doc_id", T.language(F.col("text"), own="[À-ÿ]").alias("language"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_date, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(o_orderdate AS DATE) ELSE DATE '1999-12-31' END AS least_date FROM orders")
def date_in_text(t):
    part = lambda f: F.date_format("o_orderdate", f)
    written = [F.concat_ws("-", part("yyyy"), part("M"), part("d")), F.concat(part("yyyy"), F.lit("年"), part("M"), F.lit(" 月"), part("dd"), F.lit("日")), F.concat_ws("/", part("yyyy"), part("MM"), part("dd"), F.lit("and 1999.12.31"))]
    one = F.when(F.col("o_orderkey") % 3 == 0, written[0]).when(F.col("o_orderkey") % 3 == 1, written[1]).otherwise(F.replace(written[2], F.lit("/and"), F.lit(" and")))
    rows = t("orders").select("o_orderkey", F.concat(F.lit("no. 12345-1-1 and 1999-02-30, "), one).alias("text"))
    earliest = F.when(F.col("o_orderkey") % 3 == 2, F.array_max(T.all_dates(F.col("text"))))
    least = F.when(earliest.isNull(), T.first_date(F.col("text"))).otherwise(F.to_date(F.lit("1999-12-31")))
    return rows.select("o_orderkey", T.first_date(F.col("text")).alias("first_date"), least.alias("least_date"))


@query(r"""SELECT doc_id, CASE WHEN contains(lower(text), 'disgust') THEN 'discharge_summary' WHEN contains(lower(text), 'apache') THEN 'prescription'
    WHEN contains(lower(text), 'token') OR list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'password') THEN 'lab_report' ELSE 'unknown' END AS doc_type FROM documents WHERE text IS NOT NULL""")
def classify_cascade(t):
    rules = (("discharge_summary", ("disgust",), ()), ("prescription", ("apache",), ()), ("lab_report", ("token",), ("password",)))
    return t("documents").where("text IS NOT NULL").select("doc_id", T.classify(F.col("text"), rules).alias("doc_type"))


@query(r"""WITH line AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
    hit AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM line WHERE contains(line, ','))
    SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM hit GROUP BY doc_id, run HAVING count(*) >= 3""")
def line_rows(t):
    lines = records.line_rows(t("documents").select("doc_id", "text"), "doc_id")
    found = records.islands(lines, "doc_id", F.col("line").contains(","), 3)
    return found.select("doc_id", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), "n_lines")


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]+)', 1), '') AS title, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang FROM pages""")
def key_value_lines(t):
    found = T.demographics(F.col("html"), T.DEMOGRAPHICS | {"name": "<title>([^<]+)", "gender": 'lang="([a-z]+)"'})
    return t("pages").select("page_id", found.alias("d")).select("page_id", F.col("d.name").alias("title"), F.col("d.gender").alias("lang"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE p_type WHEN 'ECONOMY' THEN 88.42 * l_quantity WHEN 'PROMO' THEN 0.09148 * l_quantity + 2.152 END AS canonical
    FROM lineitem JOIN part ON p_partkey = l_partkey""")
def unit_convert(t):
    part = t("part").select("p_partkey", F.col("p_type").alias("key"), F.lit("mg/dL").alias("unit"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(part, F.col("p_partkey") == F.col("l_partkey"))
    table = rows.sparkSession.createDataFrame([("ECONOMY", "mg/dL", 88.42, 0.0), ("PROMO", "mg/dL", 0.09148, 2.152)], "key string, unit_norm string, slope double, intercept double")
    return terms.convert(rows, table, "l_quantity", "unit").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "canonical")


@query(r"SELECT p_partkey, lower(regexp_replace(p_brand || ' ' || p_name, '\s', '', 'g')) AS term FROM part")
def normalize_term(t):
    return t("part").select("p_partkey", T.normal_term(F.concat_ws(" ", "p_brand", "p_name")).alias("term"))


@query("""WITH dict AS (SELECT p_brand AS alias, min(p_partkey) AS key FROM part GROUP BY 1), word AS (SELECT DISTINCT p_type AS alias FROM part)
    SELECT p.p_partkey, CASE WHEN w.alias IS NOT NULL AND length(w.alias) > length(d.alias) THEN -1 ELSE d.key END AS key FROM part p JOIN dict d ON d.alias = p.p_brand LEFT JOIN word w ON w.alias = p.p_type""")
def dict_resolve(t):
    part = t("part")
    none = F.array().cast("array<string>")
    brands = part.groupBy("p_brand").agg(F.min("p_partkey").alias("key")).select("key", F.lit("lab").alias("category"), F.array("p_brand").alias("aliases"), none.alias("confusions"))
    types = part.select("p_type").distinct().select(F.lit(-1).cast("long").alias("key"), F.lit("drug").alias("category"), F.array("p_type").alias("aliases"), none.alias("confusions"))
    rows = part.select("p_partkey", F.concat(F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(")")).alias("term"))
    return terms.resolve(rows, terms.alias_index(brands.union(types)), "term").select("p_partkey", "key")


@query("""SELECT o_custkey, count(*) AS n_points, string_agg(strftime(o_orderdate, '%Y-%m') || '=' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ';' ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS points, bool_or(l_returnflag = 'R') AS any_abnormal
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def series_points(t):
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    flag = F.when(F.col("l_returnflag") == "R", "H").otherwise("N")
    points = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", flag.alias("flag")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    found = clinical.series(points, ["o_custkey"], "o_orderdate", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"])
    text = F.transform("points", lambda p: F.concat(F.date_format(p["date"], "yyyy-MM"), F.lit("="), T.plain_number(p["value"])))
    return found.select("o_custkey", "n_points", F.array_join(text, ";").alias("points"), "any_abnormal")


@query("""SELECT l_partkey, arg_max(l_tax, struct_pack(a := l_shipdate, b := -l_orderkey, c := -l_linenumber, d := -l_extendedprice)) AS low FROM lineitem WHERE l_discount > 0.03 GROUP BY l_partkey""")
def latest_range(t):
    rows = t("lineitem").withColumn("low", F.col("l_tax"))
    return clinical.latest(rows, ["l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_extendedprice"], ["low"], F.col("l_discount") > 0.03)


@query("SELECT l_partkey, bool_or(l_returnflag IN ('A', 'R') AND l_quantity > 45) AS any_abnormal FROM lineitem GROUP BY l_partkey")
def any_abnormal(t):
    flag = F.when(F.col("l_quantity") > 45, F.when(F.col("l_returnflag") == "A", "H").when(F.col("l_returnflag") == "R", "L"))
    return clinical.any_abnormal(t("lineitem").withColumn("flag", flag), ["l_partkey"])


@query("""SELECT o_custkey, min(o_orderdate) AS start, max(o_orderdate) AS "end", arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := -o_orderkey)) AS dose,
    array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS sources FROM orders GROUP BY o_custkey""")
def med_span(t):
    found = clinical.spans(t("orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"], "o_orderpriority", "o_orderstatus")
    return found.select("o_custkey", "start", "end", "dose", F.array_join("sources", ",").alias("sources"))


@query("""SELECT substr(p_brand, 1, 7) AS key, arg_min(p_name, struct_pack(a := length(p_name), b := p_name)) AS term, min(p_size) AS onset, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS sources FROM part GROUP BY 1""")
def condition_merge(t):
    found = clinical.merge_problems(t("part"), F.substring("p_brand", 1, 7), "p_name", "p_size", "p_type")
    return found.select("key", "term", "onset", F.array_join("sources", ",").alias("sources"))


PREFIXES = [("economy", "ECO*"), ("promo", "PROMO"), ("small things", "S*"), ("nothing", "*"), ("small", "SMALL")]
PREFIX_SQL = "(VALUES " + ", ".join(f"('{a}', '{b.rstrip('*')}')" for a, b in PREFIXES) + ") AS x(problem, prefix)"


@query(f"SELECT p_partkey, problem FROM part JOIN {PREFIX_SQL} ON prefix <> '' AND starts_with(p_type, prefix)")
def prefix_attach(t):
    part = t("part").select("p_partkey", "p_type")
    rules = part.sparkSession.createDataFrame(PREFIXES, "problem string, atc string")
    return clinical.attach_by_prefix(part, rules, "p_type", "atc").select("p_partkey", "problem")


@query(f"SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM {PREFIX_SQL} WHERE prefix <> '' AND starts_with(p_type, prefix))")
def other_bucket(t):
    return clinical.unattached(t("part").select("p_partkey"), prefix_attach(t), ["p_partkey"])


@query("""WITH ends AS (SELECT o_custkey, o_orderpriority, arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS f, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS l, count(*) AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN f = 0 THEN abs(l - f) ELSE abs(l - f) / abs(f) END AS change FROM ends WHERE n >= 2)
    SELECT o_custkey, o_orderpriority, f AS first, l AS last, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY change DESC, o_orderpriority) AS rank FROM r) WHERE rank <= 4""")
def notable_changes(t):
    found = clinical.notable(t("orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    return found.select("o_custkey", "o_orderpriority", "first", "last", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 6""")
def top_k_trim(t):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return records.top_k(t("lineitem"), ["l_suppkey"], order, 6).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    f AS (SELECT source, doc_id, i, CASE WHEN n_chars <= 8000 THEN n_chars ELSE 0 END AS total, n_chars <= 8000 AS full_size FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.doc_id, o.i, f.total + CASE WHEN o.n_chars <= 8000 AND f.total + o.n_chars <= 60000 THEN o.n_chars ELSE 0 END, o.n_chars <= 8000 AND f.total + o.n_chars <= 60000 FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
    SELECT source, doc_id, CASE WHEN full_size THEN 'full' ELSE 'image' END AS tier FROM f""")
def share_tier_fold(t):
    return clinical.share_tiers(t("documents"), "source", ["doc_id"], "n_chars", 8000, 60000)


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_hit, count(*) FILTER (WHERE quality = 1) AS n_exact, round(100.0 * count(*) FILTER (WHERE l.doc_id IS NOT NULL) / count(*), 3) AS percent,
    count(*) FILTER (WHERE toxic = 1) AS n_unit FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def coverage_report(t):
    hits = t("labels").select("doc_id", F.col("doc_id").alias("key"), F.col("quality").alias("confidence"), (F.col("toxic") == 1).alias("ok"))
    return terms.coverage(t("documents").select("doc_id", "lang").join(hits, "doc_id", "left"), "lang", "key", "confidence", "ok")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_document FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def has_document(t):
    return records.has_document(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def documents_where(t):
    return records.documents_where(t("orders"), F.col("o_orderstatus") == "P", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""SELECT c_custkey, c_name, c_mktsegment, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS ocr_text, min(o_totalprice) AS ocr_confidence, arg_min(o_orderstatus, o_orderkey) AS ocr_backend
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def document_detail(t):
    documents = t("customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    pages = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    found = records.details(documents, t("nation").select("n_nationkey", "n_name"), pages, "c_custkey", "n_nationkey", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return found.select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("ocr_text") != "", F.col("ocr_text")).alias("ocr_text"), "ocr_confidence", "ocr_backend")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH')")
def slice_document(t):
    imaging = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return records.document_of_slice(t("customer").select("c_custkey"), imaging, "c_custkey", "o_orderpriority", "2-HIGH")


@query("SELECT max(event_id) + 1 AS next_seq FROM events")
def next_seq(t):
    return L.next_seq(t("events").withColumnRenamed("event_id", "seq"))


@query("""SELECT l_orderkey, l_suppkey, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_extendedprice)).b AS l_partkey FROM lineitem GROUP BY 1, 2""")
def slice_cleanup(t):
    rows = t("lineitem").select(F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("id"), "l_orderkey", "l_suppkey", "l_partkey")
    return replay.first_slices(rows, "id", "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", "l_partkey")


@query("SELECT d.doc_id, EXISTS (SELECT 1 FROM documents x WHERE x.doc_id < 100 AND sha256(x.text) = sha256(d.text)) AS deduped FROM documents d")
def import_dedup(t):
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return replay.import_dedup(rows, rows.where("doc_id < 100")).select("doc_id", "deduped")


@query("SELECT DISTINCT event_id % 300 AS source_file_hash FROM events WHERE event_type = 'error' AND event_id % 300 IN (SELECT event_id % 300 FROM events WHERE event_type = 'click')")
def delete_events(t):
    events = t("events").select((F.col("event_id") % 300).cast("string").alias("source_file_hash"), "event_type")
    made = replay.delete_events(events.where("event_type = 'click'"), events.where("event_type = 'error'"), "d", "2024-01-01T00:00:00Z", 1)
    return made.where("type = 'DocumentDeleted'").select(F.col("source_file_hash").cast("long").alias("source_file_hash"))


@query("""WITH u AS (SELECT conv_id, regexp_extract(text, '^[A-Za-z]+') AS v FROM conversations), n AS (SELECT conv_id, v, count(*) AS n FROM u WHERE v <> '' GROUP BY 1, 2)
    SELECT c.conv_id, (SELECT arg_min(v, struct_pack(a := -n, b := v)) FROM n WHERE n.conv_id = c.conv_id) AS name, count(*) AS record_count FROM conversations c GROUP BY c.conv_id""")
def patient_profile(t):
    pages = t("conversations").select("conv_id", F.concat(F.lit("姓名:"), F.regexp_extract("text", "^[A-Za-z]{1,10}(?![A-Za-z])|^[A-Za-z]+", 0)).alias("text"))
    return records.patient_profile(pages, "conv_id", demographics=T.DEMOGRAPHICS | {"name": "姓名:([A-Za-z]+)"}).select("conv_id", "name", "record_count")


@query("SELECT s_suppkey, CASE WHEN trim(n_name) <> '' AND n_name <> 'NATION_3' THEN n_name END AS mismatch FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def patient_mismatch(t):
    named = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return records.mismatched(named, "n_name", F.lit("NATION_3")).select("s_suppkey", "mismatch")


@query("""SELECT source, CASE WHEN lang = 'en' THEN 'lab_report' WHEN lang = 'de' THEN 'surgery' ELSE 'none' END AS doc_type, count(*) AS n, CASE WHEN lang = 'en' THEN '化验' WHEN lang = 'de' THEN '手术' END AS label FROM documents GROUP BY source, 2, 4""")
def type_facet(t):
    kind = F.when(F.col("lang") == "en", "lab_report").when(F.col("lang") == "de", "surgery").otherwise("none")
    return records.type_facet(t("documents").withColumn("doc_type", kind), ["source"])


NAMED = r"regexp_replace(url, '^.*/([^/?#]*).*$', '\1')"


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(url, '\.html$') THEN 'application/octet-stream' WHEN page_id % 3 = 0 THEN 'image/heic' ELSE 'image/png' END AS mime,
    CASE WHEN regexp_matches('text/' || {NAMED}, '^[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*$') THEN 'text/' || {NAMED} ELSE 'application/octet-stream' END AS clean FROM pages""")
def mime_types(t):
    name = F.when(F.col("url").rlike("[.]html$"), F.col("url")).otherwise(F.concat("url", F.when(F.col("page_id") % 3 == 0, ".heif").otherwise(".PNG")))
    given = F.concat(F.lit("text/"), F.regexp_replace("url", "^.*/([^/?#]*).*$", "$1"))
    return t("pages").select("page_id", T.mime_of(name).alias("mime"), replay.clean_mime(given).alias("clean"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * l_suppkey * CAST(ceil(l_linenumber * 3 / 8.0) AS BIGINT) * 3 * l_orderkey <= 536870912 AS fits FROM lineitem")
def decode_bound(t):
    fits = T.decodable(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") * 3, F.lit(3), F.col("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fits.alias("fits"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * 10 / 1048576.0 + 0.5) / 10) END AS size,
    sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS html FROM documents""")
def small_formats(t):
    return t("documents").select("doc_id", T.byte_size(F.col("n_chars")).alias("size"), F.sha2(share.escaped(F.col("text")), 256).alias("html"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS text, CAST(o_orderdate AS DATE) AS day FROM orders")
def study_date(t):
    text = F.date_format("o_orderdate", "yyyyMMdd")
    return t("orders").select("o_orderkey", text.alias("text"), T.study_date(text).cast("date").alias("day"))


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'µg' WHEN 'PROMO' THEN 'IU' ELSE p_type END AS unit, CASE p_type WHEN 'ECONOMY' THEN '10*9/L' WHEN 'PROMO' THEN 'umol/L' ELSE p_type END AS norm, 'part ' || p_name AS bare FROM part")
def unit_spellings(t):
    kind = F.col("p_type")
    unit = T.dose_unit(F.when(kind == "ECONOMY", "mcg").when(kind == "PROMO", "iu").otherwise(kind))
    norm = T.normal_unit(F.when(kind == "ECONOMY", "×10^9 / L").when(kind == "PROMO", "μmol/Ｌ").otherwise(kind))
    return t("part").select("p_partkey", unit.alias("unit"), norm.alias("norm"), terms.undosed(F.concat(F.lit("part "), "p_name", F.col("p_size").cast("string"), F.lit("mg"))).alias("bare"))


@query("SELECT p_brand AS key, min(p_type) AS category, min(p_name) AS name FROM part GROUP BY 1")
def dictionary_entries(t):
    return terms.entries(t("part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("category"), F.col("p_name").alias("name")))


@query("""SELECT p_brand, p_name, min(p_size) AS onset, arg_min(p_type, p_partkey) FILTER (WHERE p_type LIKE '%O%') AS icd_code, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1, 2""")
def condition_dedup(t):
    rows = t("part").select("p_brand", F.concat(F.lit(" "), "p_name").alias("p_name"), "p_size", F.when(F.col("p_type").contains("O"), F.col("p_type")).alias("icd"), "p_partkey")
    return clinical.conditions(rows, ["p_brand"], "p_name", "p_size", "icd", ["p_partkey"]).select("p_brand", "p_name", "onset", "icd_code", F.size("sources").cast("long").alias("n"))


@query("""WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL), t AS (SELECT DISTINCT array_to_string(w[i:i + 1], ' ') AS condition FROM w, unnest(range(1, len(w))) AS r(i)), n AS (SELECT DISTINCT unnest(w) AS name FROM w)
    SELECT condition, min(name) AS disease FROM (SELECT condition, name FROM t JOIN n ON contains(condition, name) AND length(name) > 5
        UNION ALL SELECT condition, name FROM t JOIN n ON contains(name, trim(condition)) AND length(name) > 5) WHERE trim(condition) <> '' GROUP BY condition""")
def contained_names(t):
    words = t("benchmark").where("text IS NOT NULL").select(F.split("text", " ").alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p")).where("p.b IS NOT NULL").select(F.concat_ws(" ", "p.a", "p.b").alias("condition"))
    names = words.select(F.explode("w").alias("disease")).where("length(disease) > 5").distinct()
    return containment.first_match(pairs, names.withColumn("place", F.col("disease")), "condition", "disease", "place")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'cold') THEN 'cold' WHEN contains('widget gear', p_name) OR contains(p_name, 'widget gear') THEN 'widget gear' WHEN contains(p_name, 'widget') THEN 'widget' END AS disease FROM part""")
def match_disease(t):
    return t("part").select("p_partkey", clinical.matched_disease(F.col("p_name"), ["cold", "widget gear", "widget"]).alias("disease"))


@query("""SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, CASE WHEN strftime(min(o_orderdate), '%Y-%m') = strftime(max(o_orderdate), '%Y-%m') THEN strftime(min(o_orderdate), '%Y-%m') ELSE strftime(min(o_orderdate), '%Y-%m') || ' → ' || strftime(max(o_orderdate), '%Y-%m') END AS span FROM orders GROUP BY 1""")
def span_text(t):
    spans = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.withColumn("span", T.span_text(F.col("a"), F.col("b")))


@query(r"""WITH line AS (SELECT doc_id, i AS line_no, trim(string_split(replace(text, '. ', ':' || chr(10)), chr(10))[i], ' ' || chr(9) || chr(13)) AS line FROM documents, unnest(range(1, len(string_split(replace(text, '. ', ':' || chr(10)), chr(10))) + 1)) AS u(i))
    SELECT doc_id, line_no, line AS text FROM line WHERE length(line) <= 14 AND ends_with(line, ':')""")
def section_heads(t):
    texts = t("documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(":\n")).alias("text"))
    found = blocks.section_heads(records.line_rows(texts, "doc_id"), "doc_id")
    return found.where(F.col("text").endswith(":")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, l_quantity > 10 AS data FROM lineitem),
    i AS (SELECT *, line_no - row_number() OVER (PARTITION BY l_orderkey ORDER BY line_no) AS run FROM r WHERE data)
    SELECT l_orderkey, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_rows FROM i GROUP BY l_orderkey, run HAVING count(*) >= 2""")
def report_tables(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    text = F.when(F.col("l_quantity") > 10, F.concat_ws("  ", F.lit("part"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string"))).otherwise("no table")
    lines = t("lineitem").select("l_orderkey", F.row_number().over(w).alias("line_no"), text.alias("line"))
    return blocks.tables(lines, "l_orderkey").select("l_orderkey", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.size("rows").cast("long").alias("n_rows"))


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, l_quantity > 10 AS data, l_quantity FROM lineitem),
    i AS (SELECT *, line_no - row_number() OVER (PARTITION BY l_orderkey ORDER BY line_no) AS run FROM r WHERE data)
    SELECT l_orderkey, min(line_no) AS first_line, count(*) AS n_rows, max(l_quantity) AS most FROM i GROUP BY l_orderkey, run HAVING count(*) >= 3""")
def lab_tables(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    text = F.when(F.col("l_quantity") > 10, F.concat(F.lit("glucose "), F.col("l_quantity").cast("string"), F.lit(" mg 1-2"))).otherwise("no row")
    found = blocks.lab_tables(t("lineitem").select("l_orderkey", F.row_number().over(w).alias("line_no"), text.alias("line")), "l_orderkey")
    most = F.array_max(F.transform("rows", lambda r: r["value"].cast("double")))
    return found.select("l_orderkey", F.col("first_line").cast("long").alias("first_line"), F.size("rows").cast("long").alias("n_rows"), most.alias("most"))


#: A line of a made report: laboratory row, row of cells, both, blank, heading or text, by a quantity.
LINE = {40: ("X", "glucose  7  mg"), 25: ("L", "glucose 7 mg 1-2"), 15: ("T", "a  b  7"), 8: ("B", " "), 4: ("S", "Plan:"), 0: ("P", "plain text")}


@query(f"""WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, CASE {' '.join(f"WHEN l_quantity > {q} THEN '{k}'" for q, (k, _) in LINE.items())} END AS k FROM lineitem),
    r AS (SELECT l_orderkey, 1 AS first_line, string_agg(k, '' ORDER BY i) AS rest, 0 AS took, '' AS kind FROM l GROUP BY l_orderkey
        UNION ALL SELECT l_orderkey, first_line + took, rest[took + 1:], CASE kind WHEN 'labtable' THEN length(regexp_extract(rest[took + 1:], '^[LX](B?[LX])+B?')) WHEN 'table' THEN length(regexp_extract(rest[took + 1:], '^[TX]+')) ELSE 1 END, kind
        FROM (SELECT *, CASE WHEN regexp_matches(rest[took + 1:], '^[LX](B?[LX]){{2}}') THEN 'labtable' WHEN regexp_matches(rest[took + 1:], '^[TX]{{2}}') THEN 'table' WHEN rest[took + 1:] LIKE 'B%' THEN 'blank' WHEN rest[took + 1:] LIKE 'S%' THEN 'section' ELSE 'para' END AS kind
              FROM (SELECT l_orderkey, first_line, rest, took FROM r) WHERE length(rest) > took))
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line) AS place, kind, first_line, first_line + length(rtrim(rest[1:took], 'B')) - 1 AS last_line, CASE WHEN kind IN ('labtable', 'table') THEN length(replace(rest[1:took], 'B', '')) ELSE 0 END AS n_rows
    FROM r WHERE took > 0 AND kind <> 'blank'""")
def report_blocks(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = F.lit(None).cast("string")
    for q, (_, text) in reversed(LINE.items()):
        line = F.when(F.col("l_quantity") > q, text).otherwise(line)
    found = blocks.report_blocks(t("lineitem").select("l_orderkey", F.row_number().over(w).alias("line_no"), line.alias("line")), "l_orderkey")
    return found.select("l_orderkey", "place", "kind", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.size("rows").cast("long").alias("n_rows"))


@query("""SELECT o_custkey, count(*) AS n_meds, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS names FROM orders GROUP BY 1""")
def prescription_blocks(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "_p")
    texts = F.array(F.concat(F.lit("1. "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.lit(""))
    lines = t("orders").select("o_custkey", "o_orderkey", F.posexplode(texts).alias("_p", "line")).withColumn("line", F.when(F.col("_p") == 1, F.concat(F.lit("take "), "line")).otherwise(F.col("line")))
    found = blocks.prescription(lines.select("o_custkey", F.row_number().over(w).alias("line_no"), "line"), "o_custkey")
    ok = F.forall("meds", lambda m: F.size(m["usage"]) == 1)
    return found.where(ok).select("o_custkey", F.size("meds").cast("long").alias("n_meds"), F.array_join(F.transform("meds", lambda m: m["name"]), ",").alias("names"))


@query("""WITH a AS (SELECT source AS segment, doc_id AS line_no, lang AS line FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source AS segment, doc_id AS line_no, lang AS line FROM documents WHERE doc_id % 3 = 0),
    n AS (SELECT coalesce(x.segment, y.segment) AS segment, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS m FROM (SELECT segment, sum(strlen(line) + 1) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT segment, sum(strlen(line) + 1) AS n FROM b GROUP BY 1) y ON x.segment = y.segment)
    SELECT a.* FROM a JOIN n USING (segment) WHERE n.n >= n.m UNION ALL SELECT b.* FROM b JOIN n USING (segment) WHERE n.n < n.m""")
def merge_segments(t):
    rows = t("documents").select(F.col("source").alias("segment"), F.col("doc_id").alias("line_no"), F.col("lang").alias("line"))
    return vault.merge_segments(rows.where("line_no % 2 = 0"), rows.where("line_no % 3 = 0"))


@query("SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') AS timestamp, '导入' AS action, 'n' || event_id AS detail FROM events WHERE event_type = 'signup'")
def audit_rows(t):
    rows = t("events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "FileImported").otherwise("OcrAdded").alias("type"),
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("original_name"), *(F.lit(None).cast("string").alias(c) for c in ("content_hash", "kind", "sha256", "expires", "source_file_hash")), F.lit(None).cast("long").alias("record_count"),
    )
    return share.audit_rows(rows).select(F.col("seq").cast("long").alias("seq"), "timestamp", "action", "detail")
