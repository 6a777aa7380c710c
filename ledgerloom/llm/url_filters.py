"""URL filters (8): host/path rules, and pattern rules indexed by their rarest literal token.

Pattern rules follow the usual filter-list notation: ``*`` any text, ``^`` one separator or the end, ``||`` the start of
a host label, ``|`` an end of the address, ``@@`` an exception. A URL's tokens fetch candidate rules from the index;
only those candidates run their regular expression.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import ASCII_UPPER

HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PATTERN_RULES = (
    "||ads-track.",
    "||adult-x.",
    "/banner/*.gif",
    "||m.*.example.com^de^",
    "?utm_source=feed|",
    "^page=2^ref=x|",
    "/popup^",
    "@@||blog.*?utm_source=feed|",
    "@@.org/en/*?page=2^ref=x|",
)
#: Rules beyond this number are joined by shuffle instead of being broadcast.
BROADCAST_RULES = 50_000
SEPARATOR = "[^a-z0-9_.%-]"


def to_regex(rule: str) -> str:
    """The rule's regular expression over the lower-cased URL, in the common part of Java's and RE2's syntax."""
    body, head, tail = rule.removeprefix("@@").lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    return head + "".join({"*": ".*", "^": f"({SEPARATOR}|$)"}.get(c) or re.sub(r"([^a-z0-9/=_&:-])", r"\\\1", c) for c in body) + tail


def literal_tokens(rule: str) -> list[str]:
    """Runs of a-z0-9 that any matching URL must hold as whole tokens: both sides are a literal, a separator or an end."""
    body = rule.removeprefix("@@").lower()
    closed = ("|" if body.startswith("|") else "*") + body.strip("|") + ("|" if body.endswith("|") else "*")
    return sorted({m.group() for m in re.finditer(r"(?<=[^*a-z0-9])[a-z0-9]+(?=[^*a-z0-9])", closed)})


def _listed(rows: list[tuple], schema: str) -> Column:
    """The rows as one array of structs: a single literal, however many they are."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = "array<struct<" + ",".join(c.replace(" ", ":") for c in schema.split(", ")) + ">>"
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), kind)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(_listed(rows, schema)))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path starts the URL's; else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_index(urls: DataFrame, patterns=PATTERN_RULES) -> DataFrame:
    """(token, regex, exempt): each rule under its rarest literal token over ``urls`` (ties: first in order).

    ``token`` is null for rules without a literal token; those are candidates for every URL.
    """
    spark = urls.sparkSession
    rules = _rows(spark, [(k, to_regex(p), p.startswith("@@")) for k, p in enumerate(patterns)], "rule_id int, regex string, exempt boolean")
    tokens = [(k, t) for k, p in enumerate(patterns) for t in literal_tokens(p)]
    if not tokens:
        return rules.select(F.lit(None).cast("string").alias("token"), "regex", "exempt")
    tokens = _rows(spark, tokens, "rule_id int, token string")
    wanted = tokens.select("token").distinct()
    if len(patterns) <= BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = tokens.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.join(rarest, "rule_id", "left").select(F.col("best.token").alias("token"), "regex", "exempt")


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, blocked_by, exempted_by.

    The longest fitting host rule decides; without one, a page is blocked if a pattern rule matches and no exception
    does. blocked_by and exempted_by are the first matching expressions (null if none). Null or malformed URLs have empty host
    and path, fit no host rule and are judged by the patterns on the text as it is (null: allowed). Repeated rows are
    judged alike and all returned; no rows give no rows.
    """
    distinct = pages.select(F.col(url_col).alias("url")).filter("url IS NOT NULL").distinct()
    urls = distinct.withColumn("low", F.lower("url")).withColumn("tokens", F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0))))
    verdicts = None
    if patterns:
        index = rule_index(urls, patterns)
        if len(patterns) <= BROADCAST_RULES:
            index = F.broadcast(index)
        by_token = urls.select("url", "low", F.explode("tokens").alias("token")).join(index.filter("token IS NOT NULL"), "token")
        found = by_token.filter(F.expr("low RLIKE regex")).select("url", "regex", "exempt")
        free = [p for p in patterns if not literal_tokens(p)]
        if free:  # no literal to look up: they run on every URL, in one pass
            every = _listed([(to_regex(p), p.startswith("@@")) for p in free], "regex string, exempt boolean")
            hits = urls.select("url", F.explode(F.filter(every, lambda r: F.regexp_like(F.col("low"), r["regex"]))).alias("r"))
            found = found.unionByName(hits.select("url", "r.regex", "r.exempt"))
        verdicts = found.groupBy("url").agg(
            F.min(F.when(~F.col("exempt"), F.col("regex"))).alias("blocked_by"), F.min(F.when(F.col("exempt"), F.col("regex"))).alias("exempted_by")
        )
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    joined = base.join(verdicts, "url", "left") if verdicts is not None else base.withColumns({"blocked_by": F.lit(None).cast("string"), "exempted_by": F.lit(None).cast("string")})
    judged = joined.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("rule", host_rule(F.col("host"), F.col("path"), host_rules))
    ruled = F.lit(None).cast("string")
    for verdict, rule in host_rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    method = F.when(F.col("blocked_by").isNotNull() & F.col("exempted_by").isNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(ruled, method).alias("verdict"), "blocked_by", "exempted_by")
