"""URL filters: rules indexed by their rarest literal token, in DataFrame operations alone.

A rule is a host pattern, a path pattern or a bare pattern, with literal tokens
that any URL it fits must hold. Tokens of all URLs are counted once; each rule
is filed under the one of its tokens that fewest URLs hold. A URL's tokens
fetch the rules filed under them, and only those run their regular expression.
Distinct addresses are judged once, so a host with a third of all pages costs
one row, and the verdicts are joined back (AQE splits a hot address).

Of the rules given as addresses (``net/``: that host, its subdomains, paths
that start alike) the longest that fits decides. Else the pattern rules below
decide: a fitting allow rule wins over block rules; without any, allow.

Cases: a null URL, or one without ``://``, has an empty host and path, no
tokens, no rule, and is allowed; repeated rows are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that may be broadcast: at most so many, of at most so many characters each.
MOST_RULES, LONGEST_RULE = 100_000, 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path joined; ``tokens`` are literal parts of it."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    address: bool


def address_rule(verdict: str, address: str) -> Rule:
    host, slash, path = address.partition("/")
    tokens = tuple(t for t in re.split(r"[^a-z0-9]+", host) if t)
    return Rule(address, verdict, rf"(?s)^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tokens, True)


def pattern_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, verdict, pattern, tokens, False)


ADDRESSES = (address_rule("block", "net/"), address_rule("allow", "example.net/en/"), address_rule("block", "example.com/de/"), address_rule("allow", "org/fr/"))
#: The method's own rules: parts of a site that hold no prose, and education or government hosts.
PATTERNS = (
    *(pattern_rule("block", f"host:{w}", rf"^([^/]*[.-])?{w}([.-][^/]*)?(/|$)", w) for w in ("ads", "adserver", "casino", "porn", "xxx", "tracker")),
    *(pattern_rule("block", f"path:{w}", rf"/{w}([/._-]|$)", w) for w in ("login", "signin", "signup", "cart", "checkout", "admin")),
    *(pattern_rule("allow", f"host:.{w}", rf"^[^/]*\.{w}(/|$)", w) for w in ("edu", "gov")),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits, A-Z lower-cased."""
    joined = F.translate(F.concat(host, path), _UPPER, _LOWER)
    return F.array_remove(F.array_distinct(F.split(joined, "[^a-z0-9]+")), "")


def index_rules(addresses: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(token, name, verdict, pattern, address)``: each rule under its rarest token.

    ``addresses`` has ``tokens``; all are counted, combined before the shuffle,
    for the tokens that some rule has.
    """
    if len(rules) > MOST_RULES or any(len(r.pattern) > LONGEST_RULE for r in rules):
        raise ValueError(f"more than {MOST_RULES} rules, or one of more than {LONGEST_RULE} characters, can't be broadcast")
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    spark = addresses.sparkSession
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.address, list(r.tokens)) for r in rules], "name string, verdict string, pattern string, address boolean, tokens array<string>")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    held = addresses.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted), "token").groupBy("token").count()
    each = table.select("name", "verdict", "pattern", "address", F.explode("tokens").alias("token")).join(held, "token", "left")
    rarest = each.groupBy("name", "verdict", "pattern", "address").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("least"))
    return rarest.select(F.col("least.token").alias("token"), "name", "verdict", "pattern", "address")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = ADDRESSES + PATTERNS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``."""
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    addresses = pages.select("host", "path").distinct().withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    index = index_rules(addresses, rules)
    fetched = addresses.select("host", "path", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")
    fitting = fetched.where(F.expr("rlike(concat(host, path), pattern)"))
    longest = F.struct(F.length("name").alias("n"), "name", "verdict")
    fits = fitting.groupBy("host", "path").agg(
        F.max(F.when(F.col("address"), longest)).alias("by_address"),
        F.max(F.when(~F.col("address"), F.col("verdict") == "allow")).alias("allowed"))
    decided = fits.select("host", "path", F.col("by_address.name").alias("rule"), F.coalesce("by_address.verdict", F.when(F.col("allowed"), "allow").otherwise("block")).alias("verdict"))
    return pages.join(decided, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def oracle_sql() -> str:
    """The same judgement in DuckDB SQL, each rule tried on every URL."""
    values = ", ".join(f"('{r.name}', '{r.verdict}', '{r.pattern}', {str(r.address).lower()})" for r in ADDRESSES + PATTERNS)
    return f"""
WITH rules(name, verdict, pattern, address) AS (VALUES {values}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{ADDRESS}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
             coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path, row_number() OVER () AS r FROM pages),
f AS (SELECT u.r, max(CASE WHEN rules.address THEN struct_pack(n := length(rules.name), name := rules.name, verdict := rules.verdict) END) AS a,
             bool_or(CASE WHEN NOT rules.address THEN rules.verdict = 'allow' END) AS allowed
      FROM u JOIN rules ON regexp_matches(u.host || u.path, rules.pattern) GROUP BY u.r)
SELECT u.page_id, u.host, u.path, f.a.name AS rule,
       coalesce(f.a.verdict, CASE WHEN f.allowed IS NULL THEN 'allow' WHEN f.allowed THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN f ON u.r = f.r"""
