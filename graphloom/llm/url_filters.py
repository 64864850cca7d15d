"""URL filters: longest-match host and path rules, then exact list membership by a cascade of Bloom filters.

Level 0 of the cascade encodes the listed keys. Level 1 encodes the keys of the corpus that level 0 lets through
although they are not listed, level 2 the listed keys that level 1 wrongly holds, and so on until no key of the
corpus is judged wrongly. As the levels are made over all keys that occur, every answer is exact, and judging a row
needs no join: the levels are literals in the plan. The list may be a sequence, or a table of any size; if a level would not fit the plan
(see bloom.MAX_FILTER_BYTES), hosts are looked up by a shuffle instead, with the same result.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Repeated
rows are judged alike. Column names of the input other than the url do not matter. An empty list allows all; an empty
table gives an empty result. Null and empty names on the list are passed over, and capitals do not matter there. Hosts of any length and number of labels are judged whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bloom
from graphloom.operators.spread import spread_join
from graphloom.session import materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the registered query: longest fitting rule wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Listed domains of the registered query; a listed domain stands for its subdomains too.
BLOCKED = ("adult-x.example.net", "cheap-pills.example.com", "spam-farm.example.org")
#: Rates of false positives: of each level over keys of the corpus and of those behind it, and of the first.
RATE, FIRST_RATE = 0.25, 1e-3


def parse(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?`` or ``#``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    after = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    authority = F.regexp_extract(after, r"^[^/?#]*", 0)
    return df.withColumn(host, F.translate(authority, UPPER, LOWER)).withColumn(path, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def fits(rule: str, host: Column, path: Column) -> Column:
    """A rule ``domain/rest`` fits the domain and its subdomains where the path starts with ``/rest``."""
    domain, _, rest = rule.partition("/")
    return ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))


def longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null; of two equally long ones the first in order of text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        out = F.when(fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def listing(spark: SparkSession, listed: Sequence[str] | DataFrame) -> DataFrame:
    """Distinct listed domains as a table (key), from a sequence or from the first column of a table."""
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(x,) for x in sorted({x for x in listed if x})], "key string")
    key = F.translate(F.col(f"`{listed.columns[0]}`").cast("string"), UPPER, LOWER)
    return listed.select(key.alias("key")).filter(F.coalesce("key", F.lit("")) != "").distinct()


def suffixes(host: Column, depths: Sequence[int]) -> Column:
    """The host's last k labels for each k that a listed domain has; no other suffix can be listed."""
    if not depths:
        return F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in depths])), lambda x: x != "")


@dataclass(frozen=True)
class Cascade:
    """Filters in turn for listed keys (even levels) and for keys let through wrongly (odd levels)."""

    levels: tuple[bloom.Bloom, ...]

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that lacks the key decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].test(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def cascade(universe: DataFrame, listed: DataFrame, rate: float = RATE, first_rate: float = FIRST_RATE) -> Cascade:
    """The cascade for the distinct keys of ``listed`` over a table of distinct keys (both with a column ``key``).

    Level 0 is bounded by the list, at a rate of its own, which keeps what passes it small even for a large universe. At the rate used each further level over list keys is a fraction of it; the
    levels over corpus keys hold the share of the universe that the level before let through. Raises bloom.TooLarge if a level does not fit a plan.
    """
    n, levels = listed.count(), []
    if not n:
        return Cascade(())
    levels.append(bloom.build(listed, "key", n, first_rate, seed=0))
    turn = materialise(universe.filter(levels[0].test(F.col("key"))).join(listed, "key", "left_anti"), "cascade")
    other, made = listed, [turn]  # what the next level encodes; afterwards the other side is filtered by it
    try:
        while (count := turn.count()) > 0:
            levels.append(bloom.build(turn, "key", count, rate, seed=len(levels)))
            turn, other = materialise(other.filter(levels[-1].test(F.col("key"))), "cascade"), turn
            made.append(turn)
    finally:
        for t in made:
            release(t)
    return Cascade(tuple(levels))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] | DataFrame = BLOCKED, url: str = "url", rate: float = RATE, first_rate: float = FIRST_RATE) -> DataFrame:
    """Adds host, path, rule and verdict to every row; columns of those names are replaced."""
    own = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # The row is one column, so that no name of the input clashes with those made here.
    whole = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("_"))
    parsed = parse(df.select(whole.alias("_row"), F.col(f"`{url}`").cast("string").alias("_url")), "_url").select("_row", "host", "path")
    mine = materialise(listing(df.sparkSession, listed), "listed")
    depths = sorted(r[0] for r in mine.select(F.size(F.split("key", r"\.")).alias("d")).distinct().collect())
    host = F.col("host")
    try:
        found = cascade(parsed.select(F.explode(suffixes(host, depths)).alias("key")).distinct(), mine, rate, first_rate)
        blocked = F.exists(suffixes(host, depths), found.member) if found.levels else F.lit(False)
    except bloom.TooLarge:
        each = parsed.select("host").distinct().select("host", F.explode(suffixes(host, depths)).alias("key"))
        hosts = materialise(each.join(mine, "key", "left_semi").select("host", F.lit(True).alias("_blocked")).distinct(), "hosts")
        parsed = spread_join(parsed, hosts, ["host"], "left")
        blocked = F.coalesce("_blocked", F.lit(False))
    release(mine)
    best = longest_rule(rules, host, F.col("path"))
    return parsed.select(
        *[F.col("_row")[c].alias(c) for c in own], "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def _sql_rule(rule: str, verdict: str) -> str:
    domain, _, rest = rule.partition("/")
    return f"SELECT '{rule}' AS rule, '{verdict}' AS verdict, '{domain}' AS domain, '/{rest}' AS prefix"


def oracle(rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] = BLOCKED) -> str:
    """DuckDB SQL for :func:`filter_urls` on ``pages``: rules by a join and arg_max, the list by plain comparison."""
    member = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in listed) or "false"
    return f"""
WITH rules AS ({" UNION ALL ".join(_sql_rule(r, v) for v, r in rules)}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT p.page_id, r.rule, r.verdict FROM parts p JOIN rules r
        ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.prefix))
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN {member} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""
