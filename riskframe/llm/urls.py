"""URL filtering by pattern rules, indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower
from riskframe.session import durable

# The rules of the contract, as (host, path, verdict).
HOST_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
# Words that mark a host or path as spam wherever they stand as whole words.
SPAM_WORDS = (
    "cheap-pills", "spam-farm", "casino", "poker-online", "viagra", "cialis", "payday-loan", "xxx", "porn", "adult-chat",
    "free-ringtones", "replica-watches", "work-from-home", "click-here-now", "malware", "phishing", "warez", "keygen",
)
TOKEN = "[a-z0-9]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def prefix_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host, its subdomains and a path prefix, as (rule, pattern, tokens, priority, verdict).

    Tokens are the literal words that a fitting URL must hold whole; the last one of an open path is left out.
    """
    tokens = re.findall(TOKEN, host) + [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, 1, verdict


def word_rule(words: str, verdict: str = "block") -> tuple:
    """A rule for whole words anywhere in host and path; it gives a verdict but no rule name."""
    return None, rf"(?i)(?:^|[^a-z0-9]){re.escape(words)}(?:[^a-z0-9]|$)", re.findall(TOKEN, words), 0, verdict


RULES = [prefix_rule(*r) for r in HOST_RULES] + [word_rule(w) for w in SPAM_WORDS]


def rule_table(spark: SparkSession, rules: Iterable[tuple] = RULES) -> DataFrame:
    schema = "rule string, pattern string, tokens array<string>, priority int, verdict string"
    return spark.createDataFrame(list(rules), schema)


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, ``host``, ``path``, ``rule``, ``verdict``.

    Of the named rules that fit, the longest decides, then the last by name; else a spam word blocks; else the URL is
    allowed.  A null URL or one without ``://`` has empty host and path, no rule, and is allowed.

    Each rule is listed under the token of its own that the fewest distinct URLs hold, counted over all of them; a rule
    without a whole token is listed under the empty token, which every URL holds.  A URL's tokens fetch the rules listed
    there, and only their patterns run.  URLs are judged once however often they occur; rules may be many, as both
    lookups are joins.
    """
    named = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    named = named.withColumn("_target", F.concat("host", "path"))
    targets = named.select("_target").where("_target <> ''").distinct()
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(ascii_lower(F.col("_target")), F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))
    held = targets.select("_target", F.explode(tokens).alias("token"))

    numbered = rules.withColumn("_id", F.xxhash64("rule", "pattern", "verdict"))
    wanted = numbered.select("_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    common = held.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_urls"))
    rarest = wanted.join(common, "token", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("_urls", F.lit(0)), "token")).alias("_rarest"))
    index = durable(numbered.join(rarest, "_id").select(F.col("_rarest.token").alias("token"), "rule", "pattern", "priority", "verdict"))

    fits = held.join(index, "token").where(F.expr("_target RLIKE pattern"))
    order = F.struct("priority", F.coalesce(F.length("rule"), F.lit(0)).alias("long"), "rule", "verdict")
    best = durable(fits.groupBy("_target").agg(F.max(order).alias("_best")))
    judged = named.join(best, "_target", "left")
    return judged.select(
        F.col("_key").alias(key), "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"),
    )


_WORDS = " OR ".join(f"regexp_matches(host || path, '(?i)(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)')" for w in SPAM_WORDS)
_FITS = " UNION ALL ".join(
    f"SELECT page_id, url, '{h}{p}' AS rule, '{v}' AS verdict FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    for h, p, v in HOST_RULES
)
SQL = f"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS ({_FITS}),
b AS (SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY ALL)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, CASE WHEN {_WORDS} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN b ON u.page_id = b.page_id AND u.url = b.url
"""
