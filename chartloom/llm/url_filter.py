"""URL filters: pattern rules indexed by their rarest literal token.

Every pattern rule names the literal tokens that a matching URL must contain as
whole tokens; where one of several is enough, they are alternatives.  The index
keeps each rule under the token (or all its alternatives) that is rarest among
the URLs, so a URL's tokens fetch few candidate rules and only those run their
regular expression.  A rule that is sure of no whole token runs on every URL.
Host/path rules are decided first.

All of it is DataFrame code.  Up to ``max_rules`` rules the index is a hash table
of constants and a URL is judged in its row, without a shuffle; more rules are
joined with the tokens of the distinct URLs, with the same result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.base import HOT, ascii_lower, cut, let


@dataclass(frozen=True)
class HostRule:
    """``host`` and its subdomains, where the URL's path starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL that needs all of ``tokens``, each a whole token or a tuple of alternatives."""

    name: str
    action: str
    regex: str
    tokens: tuple[str | tuple[str, ...], ...] = ()


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

# fixed values: our own list of words; one as a whole label of a host or a whole part of a path is enough
BLOCKED_WORDS = {
    "gambling": "baccarat betting bingo blackjack bookmaker casinos craps gambling jackpot keno lottery roulette slots sportsbook sweepstakes wager",
    "adult": "adultchat camgirls erotica escorts hentai milf nudes porno pornhub sexcam sexchat stripclub swingers webcamsex xxxcams",
    "pills": "ambien cialis codeine diazepam hydrocodone kamagra levitra modafinil oxycodone phentermine tramadol valium viagra xanax",
    "warez": "cracks crackz keygen keygens nulled serialz torrentz warezbb",
    "scams": "binaryoptions cashadvance clickbank doubler getrichquick moneymaker mlm paydayloan paydayloans ponzi pyramidscheme workfromhome",
    "farms": "backlinks articlespinner buyfollowers buylikes essaymill freedownloads linkfarm linkwheel pbnlinks seospam trafficbot",
    "parked": "domainparking domainsforsale forsaledomain parkeddomain sedoparking",
}
# fixed values: offers, blocked after one of the words that sell them
SOLD = "backlinks cialis degrees diplomas essays followers handbags instagram likes passports pills replicas rolex steroids traffic viagra watches xanax".split()
SELLING = ("buy", "cheap", "discount", "order")
# fixed values: parameters that only click and affiliate farms set, blocked with a long hexadecimal value
FARM_PARAMETERS = "affclick affid afftrack clickkey clkid hitid popid subaff trackaff zoneclick".split()


def generated_rules() -> tuple[PatternRule, ...]:
    """Two rules for each blocked word, one for each selling word with each offer, one for each parameter."""
    rules = []
    for kind, words in BLOCKED_WORDS.items():
        for w in words.split():
            rules.append(PatternRule(f"{kind}:host:{w}", "block", rf"^[a-z]+://([^/?#]*[.-])?{w}([.-][^/?#]*)?([/?#:]|$)", (w,)))
            rules.append(PatternRule(f"{kind}:path:{w}", "block", rf"^[a-z]+://[^/?#]*/([^?#]*[/._-])?{w}([/?#._-]|$)", (w,)))
    rules += [PatternRule(f"sale:{s}:{w}", "block", rf"[/._-]{s}[._-]([a-z0-9]+[._-])?{w}([/?#._-]|$)", (s, w)) for s in SELLING for w in SOLD]
    rules += [PatternRule(f"farm:{p}", "block", rf"[?&]{p}=[0-9a-f]{{12,}}(&|#|$)", (p,)) for p in FARM_PARAMETERS]
    return tuple(rules)


PATTERN_RULES = (
    PatternRule("bets", "block", r"^[a-z]+://([a-z0-9-]+\.)*(free|best|online)-bets?\.", (("bet", "bets"), ("free", "best", "online"))),
    PatternRule("casino", "block", r"[/.-]casino([/.-]|$)", ("casino",)),
    PatternRule("poker", "block", r"[/.-](online-)?poker([/.-]|$)", ("poker",)),
    PatternRule("adult", "block", r"^[a-z]+://([a-z0-9-]+\.)*(xxx|porn)([a-z0-9-]*\.)"),
    PatternRule("adult_tube", "block", r"[/.-]porn[/.-]tube", ("porn",)),
    PatternRule("pills", "block", r"cheap-pills"),
    PatternRule("replica", "block", r"replica-watch(es)?[./-]", (("watch", "watches"),)),
    PatternRule("warez", "block", r"[/.-]warez[/.-]", ("warez",)),
    PatternRule("click_farm", "block", r"[?&]clickid=[0-9a-f]{16,}", ("clickid",)),
    PatternRule("docs_of_farm", "allow", r"://docs\.[a-z0-9.-]+/.*[?&]clickid=", ("docs", "clickid")),
    *generated_rules(),
)

#: Up to so many pattern rules the index is a table of constants (some 300 bytes a rule) or, for the counts, broadcast.
MAX_RULES = 20_000
ENTRY = "struct<token:string,regex:string,action:string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The longest fitting rule as struct(rule, action), else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r) for r in ordered]
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for test, r in reversed(fits):
        found = F.when(test, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(spark: SparkSession, urls: DataFrame, rules: tuple[PatternRule, ...], max_rules: int = MAX_RULES) -> DataFrame:
    """(position, token, regex, action) with each rule that has tokens under its rarest one, or under all alternatives of the rarest.

    Token counts come from every url; only tokens that rules name are counted, so
    the counts are no larger than the rules.
    """
    schema = "position int, part int, regex string, action string, token string"
    parts = [(i, k, r, t) for i, r in enumerate(rules) for k, t in enumerate(r.tokens)]
    named = spark.createDataFrame([(i, k, r.regex, r.action, t) for i, k, r, part in parts for t in ((part,) if isinstance(part, str) else part)], schema)
    if len(rules) <= max_rules:
        named = F.broadcast(named)
    tokens = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    counts = tokens.join(named.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    # no more rows than there are tokens in the rules
    sums = named.join(counts, "token", "left").groupBy("position", "part", "regex", "action").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"), F.sort_array(F.collect_set("token")).alias("tokens"))
    best = sums.groupBy("position").agg(F.min(F.struct("n", "part", "tokens", "regex", "action")).alias("r"))
    return best.select("position", F.explode("r.tokens").alias("token"), "r.regex", "r.action")


def _always(rules: tuple[PatternRule, ...]) -> Column:
    """The actions of the rules without tokens that match."""
    found = [F.when(ascii_lower(F.col("url")).rlike(r.regex), r.action) for r in rules if not r.tokens]
    return F.filter(F.array(*found), lambda a: a.isNotNull()) if found else F.array().cast("array<string>")


def in_row_actions(index: DataFrame, rules: tuple[PatternRule, ...]) -> Column:
    """The actions of all rules that match the url of a row; the caller bounds ``index``."""
    rows = index.collect()
    n = max(16, 2 * len(rows))
    placed = index.sparkSession.createDataFrame([(r.token,) for r in rows], "token string").select("token", F.pmod(F.xxhash64("token"), F.lit(n)).alias("at")).distinct().collect()
    at, buckets = {r.token: r["at"] for r in placed}, [[] for _ in range(n)]
    for r in rows:
        buckets[at[r.token]].append({"token": r.token, "regex": r.regex, "action": r.action})
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{ENTRY}>>")
    fetch = lambda t: F.filter(F.element_at(table, F.pmod(F.xxhash64(t), F.lit(n)).cast("int") + 1), lambda e: e["token"] == t)
    tried = lambda x: F.filter(x["rules"], lambda e: F.rlike(x["url"], e["regex"]))
    candidates = F.struct(ascii_lower(F.col("url")).alias("url"), F.flatten(F.transform(url_tokens(F.col("url")), fetch)).alias("rules"))
    return F.concat(F.transform(let(candidates, tried), lambda e: e["action"]), _always(rules))


def pattern_verdicts(urls: DataFrame, index: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """(url, n, action) for each of the distinct ``urls`` (url, n), action null where no rule matches.  Allow rules win."""
    fetched = urls.select("url", "n", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token")
    hits = fetched.where(F.expr("translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') rlike regex")).select("url", "n", "action")
    own = urls.select("url", "n", F.array_min(_always(rules)).alias("action"))
    return own.unionByName(hits).groupBy("url", "n").agg(F.min("action").alias("action"))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, max_rules: int = MAX_RULES) -> DataFrame:
    """``pages`` (page_id, url, ...) -> page_id, host, path, rule, verdict.

    One row for each input row, repeated rows and null ids included; an empty table
    gives none.  A null or malformed url has an empty host and path, no rule and
    the verdict allow (a pattern rule may still match what isn't null).  Urls are
    judged whole, whatever their length.  Other columns of the input are not read.
    """
    spark = pages.sparkSession
    rows, rules = pages.select("page_id", F.col("url").cast("string").alias("url")), tuple(pattern_rules)
    host, path = host_and_path(F.col("url"))
    if len(rules) <= max_rules:
        index = rule_index(spark, rows, rules, max_rules)
        judged = rows.select("page_id", host.alias("host"), path.alias("path"), F.array_min(in_row_actions(index, rules)).alias("action"))
    else:
        urls = cut(rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n")))
        verdicts = cut(pattern_verdicts(urls, cut(rule_index(spark, urls, rules, max_rules)), rules))
        # fewer than HOT urls can have more than one row in HOT: those are broadcast, and null urls stay where they are
        many = urls.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(verdicts.where(F.col("n") > many // HOT).drop("n"))
        cold = verdicts.where(F.col("n") <= many // HOT).where("action IS NOT NULL").drop("n")
        rest = rows.where(F.col("url").isNotNull()).join(hot.select("url"), "url", "left_anti").join(cold, "url", "left")
        none = rows.where(F.col("url").isNull()).withColumn("action", F.lit(None).cast("string"))
        judged = rows.join(hot, "url").unionByName(rest).unionByName(none).select("page_id", host.alias("host"), path.alias("path"), "action")
    judged = judged.withColumn("found", host_rule(F.col("host"), F.col("path"), tuple(host_rules)))
    verdict = F.coalesce(F.col("found.action"), F.col("action"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def oracle(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same result as DuckDB SQL, with every pattern run on every url."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(host_rules, key=lambda r: (-len(r.text), r.text))
    fits = {r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in ordered}
    case = lambda value: "CASE " + " ".join(f"WHEN {fits[r]} THEN '{value(r)}'" for r in ordered) + " END"
    hit = lambda r: f"regexp_matches({lower.format('url')}, '{r.regex}')"
    any_of = lambda action: reduce(lambda a, b: f"{a} OR {b}", [hit(r) for r in pattern_rules if r.action == action], "false")
    return f"""
        WITH rest AS (
            SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, coalesce(url, '') AS url, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
        SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
               coalesce({case(lambda r: r.action)}, CASE WHEN {any_of("allow")} THEN 'allow' WHEN {any_of("block")} THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts"""
