"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens (runs of a-z and 0-9) that any URL it fits must hold. The rule
is filed under the one that is rarest in the URLs at hand. A URL's tokens fetch the rules filed
under them, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many rules are filed in a map inside the plan; more go through a join on the token.
INLINE_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    """``name`` is reported, ``pattern`` is a Java regular expression over host + path, ``tokens``
    are literals that every fitting URL holds as whole tokens; none means: tried on every URL."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_path_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    name = host + path
    # the last run of a path prefix may go on in the URL, so it is no whole token
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path)
    return UrlRule(name, verdict, rf"^(?:[^/]*\.)?\Q{name}\E", tuple(dict.fromkeys(whole)))


#: The rules of the registered query.
RULES = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for URLs without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(place: Column) -> Column:
    # rules name their tokens in lower case, and a path's case counts, so nothing is folded here
    return F.array_distinct(F.regexp_extract_all(place, F.lit(r"[A-Za-z0-9]+"), F.lit(0)))


def file_rules(urls: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, list[UrlRule]]:
    """Each rule under its token that the fewest URLs of ``urls(host, path)`` hold ('' if it has none).

    Counts only tokens that some rule names, so what comes back is bounded by the rules.
    """
    named = sorted({t for r in rules for t in r.tokens})
    counts = {t: 0 for t in named}
    if named:
        held = F.filter(_tokens(F.concat("host", "path")), lambda t: t.isin(named))
        for row in urls.select(F.explode(held).alias("token")).groupBy("token").count().collect():
            counts[row["token"]] = row["count"]
    filed: dict[str, list[UrlRule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append(r)
    return filed


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict.

    Of the rules that fit, the one with the longest name wins (ties: the smaller name). Without any,
    ``rule`` is null and the verdict is ``default``. Null URLs and URLs without ``://`` have empty
    host and path and are judged like any other; empty tables give empty results; repeated rows and
    ids are judged row by row. Clashing input columns of these four names are replaced.
    """
    host, path = split_url(F.col("url"))
    placed = pages.select(whole_rows(pages, "host", "path", "rule", "verdict"), host.alias("host"), path.alias("path"))
    if len(rules) <= INLINE_RULES:
        judged = placed.withColumn("hit", _inline(file_rules(placed, rules)))
    else:
        judged = _joined(placed, rules)
    return judged.select(
        "row.*", "host", "path", F.col("hit.name").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


def _rule_structs(rules: list[UrlRule]) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(-len(r.name)).alias("rank"), F.lit(r.name).alias("name"),
                F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"),
            )
            for r in rules
        )
    )


def _inline(filed: dict[str, list[UrlRule]]) -> Column:
    place = F.concat("host", "path")
    if not filed:
        return F.lit(None).cast("struct<rank:int,name:string,verdict:string,pattern:string>")
    index = F.create_map(*(x for t, rs in sorted(filed.items()) for x in (F.lit(t), _rule_structs(rs))))
    tokens = F.concat(F.array(F.lit("")), _tokens(place)) if "" in filed else _tokens(place)
    keys = F.filter(tokens, lambda t: t.isin(sorted(filed)))
    candidates = F.flatten(F.transform(keys, lambda t: F.element_at(index, t)))
    return F.array_min(F.filter(candidates, lambda r: F.regexp_like(place, r["pattern"])))


def _joined(placed: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """For many rules: distinct places' tokens join the filed rules; the best hit goes back by place."""
    spark: SparkSession = placed.sparkSession
    filed = file_rules(placed, rules)
    table = spark.createDataFrame(
        [(t, -len(r.name), r.name, r.verdict, r.pattern) for t, rs in filed.items() for r in rs],
        "token string, rank int, name string, verdict string, pattern string",
    )
    places = placed.select(F.concat("host", "path").alias("place")).distinct()
    hits = (
        places.select("place", F.explode(F.concat(F.array(F.lit("")), _tokens(F.col("place")))).alias("token"))
        .join(table, "token")
        .where(F.regexp_like("place", F.col("pattern")))
        .groupBy("place")
        .agg(F.min(F.struct("rank", "name", "verdict", "pattern")).alias("hit"))
    )
    return placed.withColumn("place", F.concat("host", "path")).join(hits, "place", "left").drop("place")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict. A null url, or one without ``://``, has an empty host and path and the default verdict; repeated pages are judged each; an empty table gives an empty result."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
placed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                          ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits AS (
  SELECT page_id, host, path, h, p, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM placed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM hits WHERE k = 1
"""
