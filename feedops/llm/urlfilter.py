"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact join; host and path rules come first.

Only built-in functions. Results by case: a URL that is null or has no ``://`` has an empty host and path, fits no rule, is on no list and is allowed;
repeated rows are judged each; an empty list blocks nothing; further columns of the pages are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.llm import bloom
from feedops.llm.registry import Tables, query

# The rules of the filter, as verdict and host with path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
# Query parameters that do not change what a URL shows.
IGNORED_PARAMETERS = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
# The given tables hold no block list; the query lists the URLs of hosts that name one of these trades and of pages whose title is a row of keywords.
# What a page holds is not seen in its URL, so other spellings of a listed URL are found by the filter and the join alone.
LISTED_HOSTS = "(^|[.-])(adult|casino|porn|viagra)([.-]|$)"
LISTED_TITLES = "<title>[^<|]*([|][^<|]*){3}"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, fragment, closing slashes and idle parameters, the other parameters sorted; null without ``://``."""
    query_string = F.regexp_extract(url, r"://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query_string, "&"), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETERS)))
    base = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(url.contains("://"), F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page; ``listed`` has one column ``url``.

    Pages without a Bloom hit never meet a shuffle; the exact join sees the hits only.
    """
    names = listed.select(canonical(F.col("url")).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    blocks = bloom.block_count(names.count())
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("_key"))
    rows = bloom.probe(rows, "_key", bloom.build(names, "_name", blocks), blocks, "_possible")
    hits = rows.where("_possible").join(names, F.col("_key") == F.col("_name"), "left").withColumn("listed", F.col("_name").isNotNull())
    columns = ["page_id", "host", "path", "listed"]
    judged = rows.where("not _possible").withColumn("listed", F.lit(False)).select(columns).unionByName(hits.select(columns))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def listed_of(pages: DataFrame) -> DataFrame:
    """The URLs of hosts and pages that the query lists; a null html lists nothing."""
    return pages.where(host_of(F.col("url")).rlike(LISTED_HOSTS) | F.col("html").rlike(LISTED_TITLES)).select("url")


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [(f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')", s, t) for s, t in rules]
    return rf"""
    WITH parts AS (
      SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
             list_sort(list_filter(string_split(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
                                   lambda p: p <> '' AND NOT regexp_matches(p, '{IGNORED_PARAMETERS}'))) AS kept
      FROM pages),
    named AS (
      SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '/+$', '')
                     || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS name
      FROM parts),
    listing AS (SELECT DISTINCT name FROM named WHERE name IS NOT NULL AND (regexp_matches(host, '{LISTED_HOSTS}') OR regexp_matches(html, '{LISTED_TITLES}'))),
    judged AS (
      SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{t}'" for f, _, t in fits)} END AS rule,
             CASE {' '.join(f"WHEN {f} THEN '{s}'" for f, s, _ in fits)} END AS ruled, name IN (SELECT name FROM listing) AS hit
      FROM named)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict, coalesce(hit, false) AS listed FROM judged
    """


@query("op2_url_filter", sql=_oracle())
def _query(t: Tables) -> DataFrame:
    return url_filter(t.pages, listed_of(t.pages))
