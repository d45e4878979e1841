"""The problem-oriented summary of a patient: one nested row, from documents to what a doctor reads first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import lines as L
from chartloom.functions import sections as S
from chartloom.functions import text as T
from chartloom.operators import clinical, containment, records, terms
from chartloom.session import cut

# fixed values: stems under which variants of a disease are one problem
STEMS = "脑梗死 脑梗塞 脑出血 脑卒中".split()


def _listed(df: DataFrame, keys: list[str], name: str, order: list[str], fields: list[str]) -> DataFrame:
    """(keys, name): an ordered array of structs of ``fields``."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.struct(*order).alias("_o"), F.struct(*fields).alias("_v")])))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["_v"]).alias(name))


def observations(docs: DataFrame, dictionary: DataFrame, conversions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(laboratory rows, medication rows) of documents (patient, doc, date, doc_type, text), with their terms resolved.

    A laboratory report is read whole, other documents in their laboratory
    sections; prescriptions likewise for medications.  Unmatched rows are kept.
    """
    lines = S.in_sections(records.line_rows(docs, "doc"), "doc").join(docs.select("doc", "patient", "date", "doc_type"), "doc")
    index = terms.alias_index(dictionary)
    names = dictionary.select("key", F.col("name").alias("canonical_name"), "loinc", "atc")
    whole = lambda kind: F.col("doc_type").isNull() | F.col("doc_type").contains(kind)
    about = lines.select("doc", "patient", "date").distinct()
    row_id = F.concat_ws(":", "doc", "line_no")
    labs = L.lab_rows(lines.where(whole("lab") | (F.col("section") == "labs")), "doc").withColumn("row", row_id)
    labs = terms.resolve(labs, index, "raw_name", conversions, "unit").where("has_evidence OR key IS NOT NULL")
    labs = terms.convert(labs, conversions, "value", "unit").join(names, "key", "left").join(about, "doc")
    # a list of medications within a section is taken apart first
    parts = F.when(whole("prescription"), F.array("line")).otherwise(T.medication_lines(F.col("line")))
    said = lines.where(whole("prescription") | (F.col("section") == "meds")).select("doc", "line_no", F.posexplode(parts).alias("_part", "line"))
    said = said.select(F.struct("doc", "line_no", "_part").alias("_at"), "line_no", "line")
    meds = L.medication_rows(said, "_at").withColumn("row", F.concat_ws(":", "_at.doc", "line_no", "_at._part")).withColumn("doc", F.col("_at.doc")).drop("_at")
    meds = terms.resolve(meds, index, "raw_name", drugs_only=True).where("has_evidence OR key IS NOT NULL")
    return labs, meds.join(names, "key", "left").join(about, "doc")


def condition_key(raw: Column, disease: Column) -> Column:
    """What a mention is merged by: the disease of the map that it matches, else a stem in it, else itself."""
    found = F.trim(raw)
    for stem in reversed(STEMS):
        found = F.when(raw.contains(stem), stem).otherwise(found)
    return F.coalesce(disease, found)


def with_disease(rows: DataFrame, column: str, diseases: DataFrame) -> DataFrame:
    """``rows`` with ``disease``: the first of ``diseases`` (disease, place) that contains the text or is contained in it."""
    found = containment.first_match(rows.select(column), diseases, column, "disease", "place")
    return rows.join(found, column, "left")


def summarise(docs: DataFrame, dictionary: DataFrame, conversions: DataFrame, problem_labs: DataFrame, problem_drugs: DataFrame, diseases: list[str] | DataFrame) -> DataFrame:
    """(patient, problems, allergies, notable_changes, imaging, pathology); absent parts are null.

    ``docs``: patient, doc (rising in record order), date, doc_type, title, text;
    ``problem_labs``: disease, loinc; ``problem_drugs``: disease, atc (a prefix, * at
    its end ignored); ``diseases``: names in their order, or (disease, place).
    Series and spans that no problem claims come under 其他.
    """
    spark = docs.sparkSession
    if not isinstance(diseases, DataFrame):
        diseases = spark.createDataFrame(list(zip(diseases, range(len(diseases)), strict=True)), "disease string, place int")
    # what several parts are made of is written once
    labs, meds = map(cut, observations(docs, dictionary, conversions))
    # analytes group by their key, or by their raw name in a space of its own
    group = F.coalesce(F.concat(F.lit("k:"), "key"), F.concat(F.lit("r:"), "raw_name"))
    one = ["patient", "grp"]
    points = labs.withColumns({"grp": group, "shown": F.coalesce("canonical", "value")})
    place = ["doc", "line_no"]
    series = clinical.series(points, one, "date", "shown", place).join(clinical.named(points, one, "raw_name", "canonical_name", "key", place, ["loinc"]), one)
    series = series.join(clinical.latest(points, one, "date", place, ["ref_low", "ref_high"], F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()), one, "left")
    last = F.max_by(F.struct("unit"), F.struct(F.col("date").isNull(), "date", *place))
    series = series.join(points.groupBy(*one).agg(last["unit"].alias("unit"), F.array_sort(F.collect_set("doc")).alias("evidence")), one)
    dated = F.filter("points", lambda p: p["date"].isNotNull())
    series = series.withColumn("points", F.transform(dated, lambda p: F.struct(F.date_format(p["date"], "yyyy-MM").alias("month"), p["value"].alias("value")))).withColumnRenamed("any_abnormal", "abnormal")
    series = cut(series)
    taken = meds.withColumns({"grp": group, "dose_text": T.dose_text(F.col("dose"), F.col("dose_unit"), F.col("frequency"))})
    spans = clinical.spans(taken, one, "date", place, "dose_text", "doc").withColumnRenamed("dose_text", "dose")
    spans = cut(spans.join(clinical.named(taken, one, "raw_name", "canonical_name", "key", place, ["atc"]), one))

    found = S.conditions(records.line_rows(docs, "doc"), "doc").join(docs.select("doc", "patient", "date"), "doc")
    mentions = with_disease(clinical.conditions(found, ["patient"], "raw_text", "date", "icd_code", ["doc", "line_no", "position"]), "raw_text", diseases)
    problems = clinical.merge_problems(mentions, condition_key(F.col("raw_text"), F.col("disease")), "raw_text", "onset", "sources", ["patient"], "icd_code").withColumnsRenamed({"key": "ckey", "sources": "evidence"})
    problems = cut(with_disease(problems, "term", diseases))
    owned = problems.where("disease IS NOT NULL").select("patient", "ckey", "disease")
    lab_links = series.join(problem_labs.distinct(), "loinc").join(owned, ["patient", "disease"]).dropDuplicates(["patient", "ckey", "grp"])
    med_links = clinical.attach_by_prefix(spans.where("atc IS NOT NULL").withColumnRenamed("atc", "code"), problem_drugs.distinct(), "code", "atc").drop("atc").withColumnRenamed("code", "atc")
    med_links = med_links.join(owned, ["patient", "disease"]).dropDuplicates(["patient", "ckey", "grp"])
    lab_fields, med_fields = ["name", "unit", "ref_low", "ref_high", "points", "abnormal", "evidence"], ["name", "start", "end", "dose", "sources"]
    lab_lists = _listed(lab_links, ["patient", "ckey"], "labs", ["name", "grp"], lab_fields)
    med_lists = _listed(med_links, ["patient", "ckey"], "meds", ["name", "grp"], med_fields)
    rows = problems.join(lab_lists, ["patient", "ckey"], "left").join(med_lists, ["patient", "ckey"], "left")
    warn = F.exists(F.coalesce("labs", F.array().cast(lab_lists.schema["labs"].dataType)), lambda s: s["abnormal"])
    rows = rows.select("patient", F.lit(0).alias("late"), "term", "onset", "icd_code", warn.alias("warn"), "evidence", "labs", "meds")
    left_labs = _listed(clinical.unattached(series, lab_links, one), ["patient"], "labs", ["name", "grp"], lab_fields)
    left_meds = _listed(clinical.unattached(spans, med_links, one), ["patient"], "meds", ["name", "grp"], med_fields)
    none = lambda name: F.lit(None).cast(problems.schema[name].dataType).alias(name)
    other = left_labs.join(left_meds, "patient", "full").select("patient", F.lit(1).alias("late"), F.lit("其他").alias("term"), none("onset"), none("icd_code"), warn.alias("warn"), none("evidence"), "labs", "meds")
    every = rows.unionByName(other).withColumns({"undated": F.col("onset").isNull(), "status": F.when(F.col("late") == 1, "其他").when(F.col("warn"), "需关注").otherwise("在管")})
    out = _listed(every, ["patient"], "problems", ["late", "undated", "onset", "term"], ["term", "onset", "icd_code", "status", "warn", "evidence", "labs", "meds"])

    # a series that several problems have counts once; its name decides between equals
    watched = lab_links.where("abnormal").select(*one, "name", "unit").distinct().withColumn("series", F.struct("name", "grp"))
    ranked = clinical.notable(points.select(*one, "date", "shown", "flag", *place).join(watched, one), ["patient"], "series", "date", "shown", place, 4, "flag").join(watched.select("patient", "series", "unit"), ["patient", "series"])
    text = F.concat("series.name", F.lit(" "), T.plain_number(F.col("first")), F.lit("→"), T.plain_number(F.col("last")), F.coalesce("unit", F.lit("")))
    notable = _listed(ranked.withColumn("text", text), ["patient"], "notable_changes", ["rank"], ["text"]).withColumn("notable_changes", F.col("notable_changes.text"))

    reactions = L.allergies(records.line_rows(docs, "doc"), "doc").join(docs.select("doc", "patient"), "doc")
    reactions = reactions.groupBy("patient", "substance", "reaction").agg(F.min("doc").alias("doc"))
    allergies = _listed(reactions, ["patient"], "allergies", ["doc", "substance", "reaction"], ["substance", "reaction"])

    def reports(kind: str, findings: list[str], conclusions: list[str]) -> DataFrame:
        some = docs.where(F.col("doc_type").contains(kind))
        said = S.impressions(records.line_rows(some, "doc"), "doc", findings, conclusions).withColumnRenamed("text", "finding")
        return some.join(said, "doc", "left").withColumns({"undated": F.col("date").isNull(), "month": F.date_format("date", "yyyy-MM")})

    studies = reports("imaging", S.IMAGING_FINDINGS, S.IMAGING_IMPRESSIONS).withColumn("group", S.imaging_group(F.col("title"), F.col("text")))
    grouped = _listed(studies, ["patient", "group"], "studies", ["undated", "date", "doc"], ["month", "finding", "doc"])
    imaging = _listed(grouped, ["patient"], "imaging", ["group"], ["group", "studies"])
    told = reports("pathology", S.PATHOLOGY_FINDINGS, S.PATHOLOGY_IMPRESSIONS).where("finding IS NOT NULL").withColumnRenamed("finding", "conclusion")
    pathology = _listed(told, ["patient"], "pathology", ["undated", "date", "doc"], ["month", "conclusion", "doc"])
    whole = docs.select("patient").distinct()
    for part in (out, allergies, notable, imaging, pathology):
        whole = whole.join(part, "patient", "left")
    return whole


def trim(summary: DataFrame, problems: int = 6, labs: int = 2, points: int = 4, meds: int = 3, changes: int = 3, reports: int = 2, active_only: bool = True) -> DataFrame:
    """A summary that fits a QR code: problems to watch first and healed ones last, the latest points, no evidence.

    A problem is healed if it has an ``end``, a medication active unless its ``on``
    is false; without such fields none is healed and all are active.
    """
    tail = lambda a, n: F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n)
    problem = summary.schema["problems"].dataType.elementType
    ends, medication, measured = "end" in problem.names, problem["meds"].dataType.elementType, problem["labs"].dataType.elementType.names
    healed = lambda p: p["end"].isNotNull() if ends else F.lit(False)
    active = lambda m: F.coalesce(m["on"], F.lit(False)) if active_only and "on" in medication.names else F.lit(True)
    lab = lambda s: F.struct(*(s[f].alias(f) for f in ("name", "unit", "ref_low", "ref_high") if f in measured), tail(s["points"], points).alias("points"), s["abnormal"].alias("abnormal"))
    one = lambda p: F.struct(
        *(p[f].alias(f) for f in problem.names if f not in ("labs", "meds", "evidence")),
        F.transform(F.slice(p["labs"], 1, labs), lab).alias("labs"), F.slice(F.filter(p["meds"], active), 1, meds).alias("meds"),
    )
    rank = lambda p: F.when(p["warn"] & ~healed(p), 0).when(~p["warn"] & ~healed(p), 1).otherwise(2)
    of_rank = lambda r: F.filter("problems", lambda p: rank(p) == r)
    ordered = F.concat(*map(of_rank, range(3)))
    few = lambda c, n: F.slice(c, 1, n).alias(c)
    return summary.select("patient", F.transform(F.slice(ordered, 1, problems), one).alias("problems"), "allergies", few("notable_changes", changes), few("imaging", reports), few("pathology", reports))
