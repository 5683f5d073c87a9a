"""URL filtering with pattern rules indexed by their rarest literal token, with DataFrame operations only.

A rule is a regular expression with the literal tokens that any match must hold. Each rule is filed under the one of its
tokens that is rarest among the URLs; a URL's tokens fetch the rules filed under them, and only those are run. Every rule needs a token. Host rules (`example.com/en/`) are such patterns too: they fit their host
and its subdomains where the path starts with the rule's, and the longest that fits wins over all others.

The rule table is sent to every task as long as it has at most BROADCAST_RULES rows; a larger one is joined by token.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
SPLIT = "[^a-z0-9]+"

#: Host rules and their verdicts.
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: Patterns over host and path for urls that no host rule fits: (name, pattern, tokens, verdict). A pattern matches only where
#: each of its tokens stands between characters that aren't letters or digits, or ends.
PATTERNS = (
    *((f"path-{w}", rf"/{w}([/.]|$)", (w,), "block") for w in ("login", "signin", "signup")),
    *((f"host-{w}", rf"(^|\.){w}\.", (w,), "block") for w in ("ad", "ads", "adserver", "doubleclick", "tracker")),
    *((f"word-{w}", rf"(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)", (w,), "block") for w in ("casino", "porn")),
    *((f"file-{w}", rf"\.{w}$", (w,), "block") for w in ("zip", "exe", "iso", "tar", "gz")),
    ("cgi", r"/cgi-bin/", ("cgi", "bin"), "block"),
    ("wp-admin", r"/wp-admin(/|$)", ("wp", "admin"), "block"),
)


def host_rule(rule: str, verdict: str) -> dict:
    """A host rule as a pattern over host and path."""
    host, slash, path = rule.partition("/")
    tokens = [t for t in re.split(SPLIT, host.lower()) if t]
    return {"rule": rule, "pattern": r"^([^/]*\.)?" + re.escape(host) + re.escape(slash + path), "tokens": tokens, "verdict": verdict, "rank": len(rule)}


def pattern_rule(name: str, pattern: str, tokens: tuple, verdict: str) -> dict:
    return {"rule": name, "pattern": pattern, "tokens": list(tokens), "verdict": verdict, "rank": 0}


def parts(url: str = "url") -> dict:
    """host and path of a url column; both empty for null and where `://` is missing."""
    after = f"substring({url}, instr({url}, '://') + 3)"
    known = f"coalesce(instr({url}, '://') > 0, false)"
    host = f"regexp_extract({after}, '^[^/?#]*', 0)"
    path = f"regexp_extract({after}, '^[^/?#]*([^?#]*)', 1)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {"host": F.expr(f"if({known}, translate({host}, '{upper}', '{lower}'), '')"), "path": F.expr(f"if({known}, {path}, '')")}


def rule_table(spark, rules: list[dict]) -> DataFrame:
    kind = "array<struct<rule:string,pattern:string,tokens:array<string>,verdict:string,rank:int>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rules)), kind)))


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of each row of pages.

    rules: rule, pattern (over host and path), tokens, verdict, rank; the highest rank that fits wins, then the longer, then
    the later name. A rule of rank 0 is a plain pattern: its verdict counts, but `rule` is null, as where no rule fits and
    the default counts. A null url, or one without `://`, has an empty host and path. Rows that repeat a key are judged
    each. An empty table gives no rows.
    """
    read = pages.select(F.col(key), *(v.alias(k) for k, v in parts(url).items()))
    place = F.concat("host", "path")
    words = F.array_distinct(F.filter(F.split(F.lower(place), SPLIT), lambda t: t != ""))
    rules = rules.withColumn("id", F.xxhash64("rule", "pattern"))
    counts = rules.agg(F.count("*").alias("n"), F.count_if(F.size("tokens") < 1).alias("bare")).first()
    if counts.bare:
        raise ValueError("every rule needs a literal token to be indexed by")
    small = counts.n <= BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)
    # how often the rules' tokens occur; the other tokens don't matter
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = read.select(F.explode(words).alias("token")).join(near(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("id", F.explode("tokens").alias("token")).join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = rules.join(filed, "id").select(F.col("least.token").alias("token"), "rule", "pattern", "verdict", "rank")
    # several places have one url: judge each distinct place once
    places = read.select("host", "path").distinct().withColumn("place", place)
    fetched = places.withColumn("token", F.explode(words)).join(near(index), "token")
    fits = fetched.where("rlike(place, pattern)").select("host", "path", "rule", "verdict", "rank")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    out = read.join(best, ["host", "path"], "left")
    return out.select(key, "host", "path", F.expr("if(best.rank > 0, best.rule, NULL)").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_of(spark) -> DataFrame:
    return rule_table(spark, [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS])


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_of(spark))


def _oracle() -> str:
    known = "strpos(url, '://') > 0"
    after = "substr(url, strpos(url, '://') + 3)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    arms = " ".join(
        f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for r, _ in sorted(HOST_RULES, key=lambda x: -len(x[0]))
    )
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in HOST_RULES)
    plain = " OR ".join(f"regexp_matches(host || path, '{p}')" for _, p, _, v in PATTERNS if v == "block")
    return f"""WITH parts AS (
        SELECT page_id, CASE WHEN {known} THEN translate(regexp_extract({after}, '^[^/?#]*'), '{upper}', '{lower}') ELSE '' END AS host,
               CASE WHEN {known} THEN regexp_extract({after}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
    ruled AS (SELECT *, CASE {arms} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE {verdicts} WHEN {plain} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


ORACLE_SQL = _oracle()
