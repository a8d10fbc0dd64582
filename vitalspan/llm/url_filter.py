"""Operator 7, URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules decide a URL. *Place rules* name a host (with its
subdomains) and a path prefix; the longest that fits wins. Where none fits,
*pattern rules* decide: each is a regular expression together with literal
tokens that every match must contain. The rarest of them in the data is the
rule's only index entry, so a URL fetches few candidates by its own tokens and
runs no other expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PlaceRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``tokens`` are whole ``[a-z0-9]+`` tokens of every URL that ``regex``
    finds, in the lower-cased URL."""

    regex: str
    tokens: tuple[str, ...]
    verdict: str = "block"


#: Place rules of the registered query, as its contract gives them.
PLACES = (
    PlaceRule("allow", "org", "/"),
    PlaceRule("block", "example.org", "/es/"),
    PlaceRule("block", "example.org", "/en/1"),
    PlaceRule("allow", "com", "/fr/"),
    PlaceRule("block", "com", "/de/"),
)

#: Adult, gambling, pharmacy, spam and advertising hosts; session and shop pages.
PATTERNS = (
    PatternRule(r"://([^/?#]*[.-])?adult-[a-z0-9]", ("adult",)),
    PatternRule(r"://([^/?#]*[.-])?(xxx)[.-]", ("xxx",)),
    PatternRule(r"://([^/?#]*[.-])?(porn)[.-]", ("porn",)),
    PatternRule(r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule(r"://([^/?#]*[.-])?free-bets[.-]", ("free", "bets")),
    PatternRule(r"://([^/?#]*[.-])?poker[.-]", ("poker",)),
    PatternRule(r"://([^/?#]*[.-])?cheap-pills[.-]", ("cheap", "pills")),
    PatternRule(r"://([^/?#]*[.-])?viagra[.-]", ("viagra",)),
    PatternRule(r"://([^/?#]*[.-])?spam-farm[.-]", ("spam", "farm")),
    PatternRule(r"://([^/?#]*[.-])?ads-track[.-]", ("ads", "track")),
    PatternRule(r"://([^/?#]*[.-])?doubleclick[.-]", ("doubleclick",)),
    PatternRule(r"^[^?#]*/login(/|[.?#]|$)", ("login",)),
    PatternRule(r"^[^?#]*/checkout(/|[.?#]|$)", ("checkout",)),
    PatternRule(r"^[^?#]*/wp-admin(/|$)", ("wp", "admin")),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(F.coalesce(url, F.lit(""))), r"[^a-z0-9]+"))


def token_index(pages: DataFrame, rules: tuple[PatternRule, ...], url: str = "url") -> dict[str, list[PatternRule]]:
    """Rules by the literal token that fewest rows contain.

    One distributed count over all rows, limited to tokens that occur in a
    rule: what comes back is bounded by the rules, not by the data.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    if not literals:
        return {}
    wanted = F.array(*map(F.lit, literals))
    seen = pages.select(F.explode(F.array_intersect(url_tokens(F.col(url)), wanted)).alias("t"))
    freq = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[PatternRule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (freq.get(t, 0), -len(t), t))
        index.setdefault(rarest, []).append(rule)
    return index


def place_rule(host: Column, path: Column, places: tuple[PlaceRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name = verdict = None
    for r in sorted(places, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def judge_urls(pages: DataFrame, places: tuple[PlaceRule, ...] = PLACES, patterns: tuple[PatternRule, ...] = PATTERNS,
               key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, pattern, verdict`` of every row.

    Rows keep their number: repeated rows give repeated results, an empty
    table an empty one. A null URL has empty host and path and the default
    verdict. Other columns are not read. Among pattern rules that match, the
    first given wins.
    """
    index = token_index(pages, patterns, url)
    order = {r: i for i, r in enumerate(patterns)}
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(key), F.col(url).alias("_url")).withColumns({"host": host, "path": path})
    lowered = ascii_lower(F.col("_url"))
    # a rule's expression stands behind the test for its token, so it runs for candidates only
    tested = F.array(*[
        F.when(F.array_contains("_tokens", t), F.array(*[
            F.when(F.col("_low").rlike(r.regex), F.lit(order[r])) for r in rules]))
        .otherwise(F.array().cast("array<int>"))
        for t, rules in sorted(index.items())])
    first = F.array_min(F.flatten(tested)) if index else F.lit(None).cast("int")
    name, verdict = place_rule(F.col("host"), F.col("path"), places)
    rows = rows.withColumns({"_tokens": url_tokens(F.col("_url")), "_low": lowered}).withColumn("_first", first)
    none = F.lit(None).cast("string")
    pattern, method = none, F.lit(default)
    if patterns:
        pattern = F.get(F.array(*[F.lit(r.regex) for r in patterns]), F.col("_first"))
        method = F.coalesce(F.get(F.array(*[F.lit(r.verdict) for r in patterns]), F.col("_first")), F.lit(default))
    return rows.select(key, "host", "path", name.alias("rule"), pattern.alias("pattern"),
                       F.coalesce(verdict, method).alias("verdict"))
