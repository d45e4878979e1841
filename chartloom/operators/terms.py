"""Terms against a dictionary: exact aliases, then known misreadings, then stripped drug names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.columns import let

#: A dictionary below this many aliases is broadcast.
BROADCAST_ALIASES = 200_000
STRIPPED = 0.8
# fixed values: dosage forms, salts in front of and behind a drug's name, carrier solutions, units of a dose
FORMS = "缓释片 控释片 分散片 咀嚼片 泡腾片 肠溶片 口服溶液 口服液 软胶囊 缓释胶囊 肠溶胶囊 注射液 混悬液 干混悬剂 颗粒 胶囊 滴丸 胶丸 散 糖浆 贴片 栓 片".split()
SALTS_BEFORE = "盐酸 硫酸氢 硫酸 苯磺酸 琥珀酸 马来酸 富马酸 酒石酸 氢溴酸 磷酸 醋酸 枸橼酸 甲磺酸 门冬".split()
SALTS_BEHIND = "琥珀酸钠 磷酸钠 磺酸钠 氨丁三醇 钙 钠 钾 镁".split()
CARRIERS = "氯化钠 葡萄糖".split()
DOSE_UNITS = "万单位 万iu 单位 mcg mg ug gm ml iu g u %".split()
OPEN, CLOSE = "(（\\[【", ")）\\]】"


def alias_index(dictionary: DataFrame) -> DataFrame:
    """(space, alias_norm, key, category, confidence, alias_length): space ``any`` or ``drug``.

    ``dictionary``: key, category, aliases array<string>, confusions array<string>.
    An alias comes before a confusion.  In ``any`` a laboratory or vital entry wins
    over a drug's; ``drug`` has drugs only.  Of equals the smallest key stays.
    """
    forms = F.concat(F.transform("aliases", lambda a: F.struct(a.alias("alias"), F.lit(1.0).alias("confidence"))), F.transform("confusions", lambda a: F.struct(a.alias("alias"), F.lit(0.5).alias("confidence"))))
    rows = dictionary.select("key", "category", F.explode(forms).alias("f")).select("key", "category", "f.alias", T.normal_term(F.col("f.alias")).alias("alias_norm"), "f.confidence")
    spaces = F.when(F.col("category") == "drug", F.array(F.lit("any"), F.lit("drug"))).otherwise(F.array(F.lit("any")))
    order = F.struct(-F.col("confidence"), F.col("category") == "drug", "key")
    spread = rows.where("alias_norm <> ''").withColumn("space", F.explode(spaces))
    found = spread.groupBy("space", "alias_norm").agg(F.min_by(F.struct("key", "category", "confidence", F.length("alias").alias("alias_length")), order).alias("e"))
    return found.select("space", "alias_norm", "e.*")


def entries(dictionary: DataFrame, category: str | None = None) -> DataFrame:
    """(key, category, name) of all entries or those of a category, each once: what an auto-completion lists."""
    some = dictionary if category is None else dictionary.where(F.col("category") == category)
    return some.groupBy("key").agg(F.min("category").alias("category"), F.min("name").alias("name"))


def undosed(name: Column) -> Column:
    """A name without the strength at its end; the same where there is none or nothing else."""
    return F.regexp_replace(name, r"(?is)^(.*[^0-9.])[0-9.]+(?:" + "|".join(DOSE_UNITS) + ")$", "$1")


def candidates(term: Column) -> Column:
    """array<string>: the whole, what is outside brackets, the tokens of both, the tokens inside brackets, and each without a trailing dose.

    Brackets may hold one more pair and may lack their end.  A slash parts
    nothing, as in laboratory names it is mostly a ratio.
    """
    flat = f"[^{OPEN}{CLOSE}]"
    bracket = f"[{OPEN}]((?:{flat}|[{OPEN}]{flat}*[{CLOSE}])*)(?:[{CLOSE}]|$)"
    tokens = lambda t: F.split(t, r"[ \x{3000}、,，]")
    bare = F.regexp_replace(F.regexp_replace(term, bracket, ""), f"[{OPEN}{CLOSE}]", "")
    inside = F.transform(F.regexp_extract_all(term, F.lit(bracket), 1), lambda b: F.regexp_replace(b, f"[{OPEN}{CLOSE}]", ""))
    every = let(bare, lambda b: F.concat(F.array(term, b), tokens(term), tokens(b), F.flatten(F.transform(inside, tokens))))
    trimmed = F.filter(F.transform(every, T.trimmed), lambda t: t != "")
    return let(trimmed, lambda x: F.array_distinct(F.concat(x, F.filter(F.transform(x, undosed), lambda t: t != ""))))


def drug_stems(norm: Column) -> Column:
    """array<string> of what a normalised drug name may be without strength, form, carrier and salt, nearest first.

    Each base (no strength and mark of injections; no forms; no carrier; no salt
    in front) is followed by itself without one salt behind it.
    """
    either = lambda words: "(?:" + "|".join(words) + ")"
    start = F.regexp_replace(norm, "^[0-9.%]*(?:注射用)?", "")
    formless = lambda s: F.regexp_replace(s, either(FORMS) + "+$", "")
    without = lambda s, pattern: F.when(s.rlike(pattern), F.regexp_replace(s, pattern, ""))
    bases = lambda s, f: F.array(s, f, without(f, f"(?<=.){either(CARRIERS)}$"), without(f, f"^{either(SALTS_BEFORE)}"))
    both = lambda b: F.array(b, without(b, f"(?<=..){either(SALTS_BEHIND)}$"))
    every = let(start, lambda s: let(formless(s), lambda f: F.flatten(F.transform(F.filter(bases(s, f), lambda b: b.isNotNull()), both))))
    return F.filter(every, lambda c: c.isNotNull() & (F.length(c) > 1) & (c != norm))


def resolve(rows: DataFrame, index: DataFrame, term: str, accepted: DataFrame | None = None, unit: str | None = None, drugs_only: bool = False) -> DataFrame:
    """``rows`` with key and confidence of the best candidate, null where none is known.

    A candidate stands for its exact alias, else its known misreading, else (at
    0.8) the first of its ``drug_stems`` that is a drug's alias.  Better among
    candidates: its unit is accepted, then the confidence, then a longer alias,
    then an earlier candidate.  Each different term (and unit) is resolved once.
    The index and the units are broadcast only below BROADCAST_ALIASES rows.
    """
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES else df
    said = F.col(unit) if unit else F.lit(None).cast("string")
    asked = rows.where(F.col(term).isNotNull()).select(F.col(term).alias("_term"), said.alias("_said")).distinct()
    cased = asked.select("*", F.posexplode(candidates(F.col("_term"))).alias("_pos", "_cand")).withColumn("_norm", T.normal_term(F.col("_cand")))
    first = F.array(F.struct(F.col("_norm").alias("norm"), F.lit("drug" if drugs_only else "any").alias("space")))
    stems = F.transform(drug_stems(F.col("_norm")), lambda s: F.struct(s.alias("norm"), F.lit("drug").alias("space")))
    forms = cased.where("_norm <> ''").select("_term", "_said", "_pos", F.posexplode(F.concat(first, stems)).alias("_tier", "_f"))
    hits = forms.join(few(index), (F.col("_f.norm") == F.col("alias_norm")) & (F.col("_f.space") == F.col("space"))).where((F.col("_tier") == 0) | (F.col("confidence") == 1))
    good = F.lit(0)
    if accepted is not None and unit is not None:
        known = accepted.select(F.col("key").alias("_key"), F.col("unit_norm").alias("_unit")).distinct().withColumn("_ok", F.lit(1))
        hits = hits.join(few(known), (F.col("key") == F.col("_key")) & (T.normal_unit(F.col("_said")) == F.col("_unit")), "left")
        good = F.coalesce("_ok", F.lit(0))
    confidence = F.when(F.col("_tier") > 0, STRIPPED).otherwise(F.col("confidence"))
    hit = F.struct(good.alias("a"), F.floor(confidence * 100).alias("b"), F.col("alias_length").alias("c"), (-F.col("_pos")).alias("d"), (-F.col("_tier")).alias("tier"), "key", confidence.alias("confidence"))
    # the hits of a term are as few as its candidates; of each candidate the first form counts
    best = lambda h: F.array_max(F.filter(h, lambda x: ~F.exists(h, lambda y: (y["d"] == x["d"]) & (y["tier"] > x["tier"]))))
    found = hits.groupBy("_term", "_said").agg(F.collect_list(hit).alias("_h")).select("_term", "_said", best(F.col("_h")).alias("_b"))
    found = found.select("_term", "_said", F.col("_b.key").alias("key"), F.col("_b.confidence").alias("confidence"))
    return rows.join(found, (F.col(term) == F.col("_term")) & said.eqNullSafe(F.col("_said")), "left").drop("_term", "_said")


def convert(rows: DataFrame, conversions: DataFrame, value: str, unit: str) -> DataFrame:
    """Adds canonical = slope * value + intercept where the key has the unit; conversions: key, unit_norm, slope, intercept."""
    table = conversions.select(F.col("key").alias("_key"), "unit_norm", "slope", "intercept")
    joined = rows.join(table, (F.col("key") == F.col("_key")) & (T.normal_unit(F.col(unit)) == F.col("unit_norm")), "left")
    return joined.withColumn("canonical", F.col("slope") * F.col(value) + F.col("intercept")).drop("_key", "unit_norm", "slope", "intercept")


def coverage(rows: DataFrame, group: str, key: str, confidence: str, unit_ok: str | None = None, name: str | None = None) -> DataFrame:
    """(group, n, n_hit, n_exact, percent[, n_unit][, missed]): how many terms are known, exactly known and of an accepted unit.

    ``missed`` lists the distinct names without a key, sorted.
    """
    hits = F.count_if(F.col(key).isNotNull())
    parts = [F.count("*").alias("n"), hits.alias("n_hit"), F.count_if(F.col(key).isNotNull() & (F.col(confidence) == 1)).alias("n_exact"), F.round(100.0 * hits / F.count("*"), 3).alias("percent")]
    if unit_ok is not None:
        parts.append(F.count_if(F.col(key).isNotNull() & F.col(unit_ok)).alias("n_unit"))
    if name is not None:
        parts.append(F.array_sort(F.collect_set(F.when(F.col(key).isNull(), F.col(name)))).alias("missed"))
    return rows.groupBy(group).agg(*parts)
