"""Column functions over report text: languages, dates, types, units and numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: radicals of the supplement block and what they stand for
SUPPLEMENT = {"⻄": "西", "⻅": "见", "⻆": "角", "⻓": "长", "⻔": "门", "⻛": "风", "⻝": "食", "⻩": "黄", "⻬": "齐"}
# fixed values: labels of a report's own date, in order
REPORT_LABELS = "检查日期 检测日期 检验日期 报告日期 报告时间 就诊日期 就诊时间 收到日期 采集时间 采集日期 签发日期 手术日期 检查时间 诊断日期".split()
ISO_DATE = r"(?<![0-9])([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?![0-9])"
CHINESE_DATE = r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日"
# fixed values: (type, substrings, whole words), first match counts
TYPE_RULES = (
    ("discharge_summary", ("出院记录", "discharge"), ()),
    ("prescription", ("处方", "prescription"), ()),
    ("surgery", ("手术记录", "手术经过", "术中", "surgical", "operative"), ()),
    ("pathology", ("病理科", "病理诊断报告", "病理报告", "pathology"), ()),
    ("lab_report", ("检验", "化验", "laborator"), ("lab",)),
    ("clinical_note", ("门诊病历", "门诊记录", "急诊病历", "急诊记录", "入院记录", "病程记录", "门诊电子病历"), ()),
    ("imaging_report", ("影像", "超声", "ultrasound", "imaging", "radiolog", "computed tomograph", "magnetic resonance", "x-ray", "x线", "心电", "dr ", "拍片"), ("ct", "mri", "xray")),
    ("pathology", ("病理",), ()),
    ("other", ("血压记录", "血糖记录", "体温记录", "家庭监测", "血压监测", "血糖监测", "自测"), ()),
)
# fixed values: frequency codes and their patterns, first match counts
FREQUENCIES = (
    ("qn", r"(?i)每晚一次|每晚|睡前|\bqn\b"), ("tid ac", "三餐前|餐前"), ("qw", r"(?i)每周一次|每周1次|\bqw\b"), ("q12h", r"(?i)每12小时|\bq12h\b"),
    ("q8h", r"(?i)每8小时|\bq8h\b"), ("bid", r"(?i)每日两次|每日2次|一日两次|一日2次|每天两次|\bbid\b"), ("tid", r"(?i)每日三次|一日三次|每天三次|\btid\b"),
    ("qid", r"(?i)每日四次|一日四次|每天四次|\bqid\b"), ("qd", r"(?i)每日一次|一日一次|每天一次|每日1次|\bqd\b"), ("prn", r"(?i)必要时|按需|\bprn\b"),
)
# full-width forms and what they stand for
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
MIME_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "heic": "image/heic", "heif": "image/heic", "dcm": "application/dicom", "tif": "image/tiff", "tiff": "image/tiff"}


def fold_radicals(text: Column) -> Column:
    """Radical code points to the characters they stand for; other text stays."""
    pairs = dict(SUPPLEMENT)
    for code in range(0x2E80, 0x2FE0):
        c = chr(code)
        whole = unicodedata.normalize("NFKC", c)
        if c not in pairs and whole != c and len(whole) == 1:
            pairs[c] = whole
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def language(text: Column, own: str = "[\\x{4E00}-\\x{9FFF}]", latin: str = "[A-Za-z]") -> Column:
    """mixed, zh, en or null, by the scripts that occur."""
    chinese, english = text.rlike(own), text.rlike(latin)
    return F.when(chinese & english, "mixed").when(chinese, "zh").when(english, "en")


def _dates(text: Column, pattern: str) -> Column:
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    part = lambda s, i: F.regexp_extract(s, r"^([0-9]{4})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})", i)
    padded = lambda s: F.concat_ws("-", part(s, 1), F.lpad(part(s, 2), 2, "0"), F.lpad(part(s, 3), 2, "0"))
    dates = F.transform(whole, lambda s: F.when(part(s, 1).cast("int").between(1900, 2100), F.try_to_date(padded(s), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(padded(s), F.lit("yyyy-MM-dd")))))
    return F.filter(dates, lambda d: d.isNotNull())


def all_dates(text: Column) -> Column:
    """The real calendar days of a text from 1900 to 2100, sorted, each once."""
    return F.array_sort(F.array_distinct(F.concat(_dates(text, ISO_DATE), _dates(text, CHINESE_DATE))))


def first_date(text: Column) -> Column:
    """The first ISO day, else the first written the Chinese way."""
    return F.get(F.concat(_dates(text, ISO_DATE), _dates(text, CHINESE_DATE)), 0)


def labelled_date(text: Column, labels: list[str]) -> Column:
    """The day within 24 characters of a label's first occurrence; the first label that has one counts."""
    after = lambda l: F.when(F.instr(text, l) > 0, F.substring(text, F.instr(text, l) + len(l), F.lit(24)))  # noqa: E731, E741
    return F.coalesce(*(first_date(after(label)) for label in labels))


def date_range(text: Column) -> Column:
    """struct(start, end): admission to discharge, a report's own day, any labelled day, else the least and greatest day."""
    admitted, discharged = labelled_date(text, ["入院日期", "入院时间"]), labelled_date(text, ["出院日期", "出院时间"])
    own = F.coalesce(labelled_date(text, REPORT_LABELS), admitted, discharged, labelled_date(text, ["日期"]))
    every = all_dates(text)
    nothing = F.lit(None).cast("date")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return (
        F.when(admitted.isNotNull() & discharged.isNotNull(), pair(admitted, discharged))
        .when(own.isNotNull(), pair(own, nothing))
        .otherwise(pair(F.get(every, 0), F.when(F.size(every) > 1, F.element_at(every, -1))))
    )


def classify(text: Column, rules=TYPE_RULES) -> Column:
    """The first rule of which a substring or a whole word occurs in the lower-cased text."""
    lower = F.lower(text)
    words = F.split(lower, r"[^\p{L}\p{N}]+")
    found = F.lit("unknown")
    for name, parts, whole in reversed(rules):
        tests = [lower.contains(p) for p in parts] + [F.array_contains(words, w) for w in whole]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        found = F.when(hit, name).otherwise(found)
    return F.when(text.isNotNull(), found)


# fixed values: how a page names its patient; the birth date's parts are groups 1 to 3
DEMOGRAPHICS = {
    "name": r"(?:姓名|名字)[:：]\s*([^\s，,;；、0-9]{1,10})", "gender": r"性别[:：]\s*([男女])", "age": r"年龄[:：]\s*([0-9]{1,3})",
    "birth_date": r"(?:出生日期|出生|生日)[:：]\s*([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})",
}


def demographics(text: Column, patterns: dict[str, str] = DEMOGRAPHICS) -> Column:
    """struct(name, gender, birth_date, age), each null where it isn't found."""
    first = lambda field: F.regexp_extract(text, patterns[field], 1)
    part = lambda i: F.regexp_extract(text, patterns["birth_date"], i)
    birth = F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    found = {f: F.when(first(f) != "", first(f)) for f in ("name", "gender", "age")} | {"birth_date": birth}
    return F.struct(*(found[f].alias(f) for f in ("name", "gender", "birth_date", "age")))


def frequency(line: Column) -> Column:
    """The code of the first frequency pattern that the line has."""
    found = F.lit(None).cast("string")
    for code, pattern in reversed(FREQUENCIES):
        found = F.when(line.rlike(pattern), code).otherwise(found)
    return found


def dose_unit(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low.isin("mcg", "ug", "µg", "μg"), "µg").when(low == "iu", "IU").when(low == "u", "U").when(low == "ml", "mL").when(low.isin("mg", "g"), low).otherwise(unit)


def normal_term(term: Column) -> Column:
    """Half-width, without white space, lower-cased: what terms are compared by."""
    return F.lower(F.regexp_replace(F.translate(term, WIDE, NARROW), r"(?U)\s", ""))


def normal_unit(unit: Column) -> Column:
    """Spellings of a unit folded together; the case of letters is kept, as it tells milli from mega."""
    narrow = F.regexp_replace(F.translate(unit, WIDE, NARROW), r"(?U)\s", "")
    folded = F.regexp_replace(F.translate(narrow, "µμ×✕^²³", "uuxx*23"), "10[Ee]", "10*")
    return F.regexp_replace(folded, "^[xX]", "")


def plain_number(value: Column) -> Column:
    """A double without trailing zeros or exponent."""
    fixed = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNotNull(), fixed)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def mime_of(name: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))), F.lit("application/octet-stream"))


def object_path(digest: Column) -> Column:
    """objects/ab/cd/<hash>"""
    return F.concat(F.lit("objects/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest)


def study_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def decoded_bytes(rows: Column, columns: Column, bits: Column, samples: Column, frames: Column) -> Column:
    """The size of decoded pixels, null beyond a long: then over any cap."""
    size = rows.cast("long")
    for factor in (columns, F.ceil(bits / 8), samples, frames):
        size = F.try_multiply(size, factor.cast("long"))
    return size


MOST_DECODED = 512 * 1024 * 1024
# fixed values: what part a list of medications and the verbs in front of one, longer before shorter
LIST_MARKS = "、；;，,。"
USAGE_VERBS = "继续口服 继续服用 继续 口服 服用 给予 予".split()


def decodable(rows: Column, columns: Column, bits: Column, samples: Column, frames: Column) -> Column:
    """Whether decoded pixels stay within 512 MiB."""
    return F.coalesce(decoded_bytes(rows, columns, bits, samples, frames) <= MOST_DECODED, F.lit(False))


def medication_lines(text: Column) -> Column:
    """array<string>: the text at its list marks and line ends, each part without a verb of usage in front of it."""
    parts = F.split(F.translate(text, LIST_MARKS, "\n" * len(LIST_MARKS)), "\n")
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^\s*(?:" + "|".join(USAGE_VERBS) + ")", ""))


def dose_text(dose: Column, unit: Column, frequency: Column) -> Column:
    """Dose with unit and frequency, of what there is; null without any."""
    text = F.concat_ws(" ", F.concat(plain_number(dose), F.coalesce(unit, F.lit(""))), frequency)
    return F.when(text != "", text)


def span_text(start: Column, end: Column) -> Column:
    """The months of a medication's first and last mention: one if they are the same, null without dates."""
    month = lambda d: F.date_format(d, "yyyy-MM")
    return F.when(start.isNull(), month(end)).when(end.isNull() | (month(start) == month(end)), month(start)).otherwise(F.concat(month(start), F.lit(" → "), month(end)))


def byte_size(n: Column) -> Column:
    """B, KB or MB, the latter with one decimal."""
    scaled = lambda by, unit: F.concat(F.format_string("%.1f", n / by), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, scaled(1024.0, " KB")).otherwise(scaled(1024.0 * 1024, " MB"))


def page_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) + 1
