"""URL filters: pattern rules found by their rarest literal token, so that few regular expressions run."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable, small


#: Ways to write a pattern's match, at most: one for each choice of branches.
WAYS = 256


def _atom(chars: set[str], negated: bool) -> str:
    """A set of characters: a letter or digit that it must be, " " if it holds none of them, * if it is unknown."""
    own = {c for c in "abcdefghijklmnopqrstuvwxyz0123456789" if (c in chars) != negated}
    return " " if not own else next(iter(own)) if len(own) == 1 and chars == own and not negated else "*"


def _ways(tree) -> set[str]:
    """All ways to write what a parsed expression matches: letters and digits, " " for separators and ends, * for what is unknown."""
    out = {""}
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            own = {_atom({chr(arg)}, False)}
        elif name == "IN":
            chars = {chr(c) for kind, x in arg if str(kind) in ("RANGE", "LITERAL") for c in (range(x[0], x[1] + 1) if str(kind) == "RANGE" else [x])}
            own = {"*" if any(str(kind) == "CATEGORY" for kind, _ in arg) else _atom(chars, str(arg[0][0]) == "NEGATE")}
        elif name == "BRANCH":
            own = set().union(*map(_ways, arg[1]))
        elif name == "SUBPATTERN":
            own = _ways(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = _ways(arg[2])
            own = ({""} if arg[0] == 0 else set()) | (inner if arg[1] == 1 or inner <= {"", " "} else {"*"})
        else:
            own = {" " if name == "AT" else "*"}
        out = {a + b for a in out for b in own}
        if len(out) > WAYS:
            raise ValueError("a pattern has too many branches")
    return out


@dataclass(frozen=True)
class Pattern:
    """A blocking rule: a regular expression on the lower-cased url.

    tokens: sets of whole tokens, [a-z0-9]+ between other characters or ends; each match has all of one set. They are read
    off the parsed expression, and one that has a way to match without a whole token is refused.
    """

    regex: str

    @cached_property
    def tokens(self) -> tuple[tuple[str, ...], ...]:
        sets = {tuple(sorted(t for t in f"*{way}*".split(" ") if re.fullmatch("[a-z0-9]+", t))) for way in _ways(re._parser.parse(self.regex))}
        if () in sets:
            raise ValueError(f"matches without a whole token: {self.regex}")
        return tuple(sorted(sets))

    def __post_init__(self):
        assert self.tokens


@dataclass(frozen=True)
class Scope:
    """A rule for a host with all its subdomains and for the paths that start with path."""

    verdict: str
    host: str
    path: str


#: Fixed rules of the contract.
SCOPES = (
    Scope("allow", "com", "/"),
    Scope("block", "example.com", "/en/"),
    Scope("allow", "www.example.com", "/en/"),
    Scope("block", "net", "/es/"),
    Scope("block", "net", "/fr/"),
)
#: The library's own patterns: adult, gambling, trackers, link shops, and session or search pages.
PATTERNS = (
    Pattern(r"(^|[^a-z0-9])(porn|xxx)([^a-z0-9]|$)"),
    Pattern(r"(^|[^a-z0-9])xxx([^a-z0-9]|$)"),
    Pattern(r"(^|[^a-z0-9])casino([^a-z0-9]|$)"),
    Pattern(r"(^|[^a-z0-9])online[-_/.]?casino([^a-z0-9]|$)"),
    Pattern(r"(^|[^a-z0-9])sports?[-_]betting([^a-z0-9]|$)"),
    Pattern(r"(^|[^a-z0-9])buy[-_]backlinks([^a-z0-9]|$)"),
    Pattern(r"[?&]utm_source=(feed|ads?|mail)([&#]|$)"),
    Pattern(r"[?&]session[-_]?id=[a-z0-9]+"),
    Pattern(r"[?&]page=[0-9]+&(.*&)?ref=[a-z]"),
    Pattern(r"/wp-login\.php([?#]|$)"),
    Pattern(r"/tag/[^/?#]+/feed/?([?#]|$)"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    at = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def scoped(host: Column, path: Column, scopes: tuple[Scope, ...] = SCOPES) -> Column:
    """The longest of the scopes (host and path together) that fits, as a struct of rule and verdict; null if none does."""
    out = None
    for s in sorted(scopes, key=lambda s: (-len(s.host + s.path), s.host, s.path)):
        fits = ((host == s.host) | host.endswith(f".{s.host}")) & path.startswith(s.path)
        named = F.struct(F.lit(s.host + s.path).alias("rule"), F.lit(s.verdict).alias("verdict"))
        out = F.when(fits, named) if out is None else out.when(fits, named)
    return out


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def blocked_urls(urls: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """The distinct rows of urls (url) that a pattern matches, each with its number of matching patterns.

    Every set of tokens of a pattern is filed under that one of its tokens that the fewest urls have, counted over all of
    them, so that each match's url fetches it; no pattern is run on the urls that don't. The index has a row for each set.
    """
    spark = urls.sparkSession
    distinct = durable(urls.select("url").filter("url is not null").distinct())
    listed = [(i, p.regex, k, t) for i, p in enumerate(patterns) for k, own in enumerate(p.tokens) for t in own] or [(-1, "", 0, "")]
    filed = spark.createDataFrame(listed, "rule long, regex string, way int, token string")
    tokens = distinct.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    uses = tokens.join(small(filed.select("token").distinct(), len(listed)), "token").groupBy("token").agg(F.count("*").alias("uses"))
    rarest = filed.join(uses, "token", "left").groupBy("rule", "regex", "way").agg(F.min_by("token", F.struct(F.coalesce("uses", F.lit(0)), "token")).alias("token"))
    index = small(rarest.select("rule", "regex", "token").distinct(), len(listed))
    hits = tokens.join(index, "token").filter(F.expr("rlike(lower(url), regex)")).select("url", "rule")
    return hits.groupBy("url").agg(F.countDistinct("rule").alias("n_patterns"))


def judge(pages: DataFrame, scopes: tuple[Scope, ...] = SCOPES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, n_patterns of each row of pages (page_id, url).

    rule: the longest scope that fits the url, else null; verdict: that scope's, else block if a pattern matches, else
    allow. A null url, or one without ://, has an empty host and path and no rule; it is allowed unless a pattern
    matches. Equal urls are judged once and each row keeps its result: what patterns say of blocked urls is a table of its
    own, so that rows of a frequent url are a skewed join, which Spark splits, and null urls take no part in it. An empty
    table gives an empty one.
    """
    rows = pages.select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    met = rows.filter("url is not null").join(durable(blocked_urls(rows, patterns)), "url", "left")
    whole = met.unionByName(rows.filter("url is null"), allowMissingColumns=True)
    out = whole.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("n_patterns", F.lit(0)).cast("long").alias("n_patterns"))
    rule = scoped(F.col("host"), F.col("path"), scopes)
    return out.withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("n_patterns") > 0, "block").otherwise("allow")).alias("verdict"), "n_patterns")
