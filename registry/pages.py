"""HTML extraction over pages. Selectors are parameters: the given pages have navigation links and paragraphs, no tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions.urls import UrlPolicy
from feedops.operators import extract as X
from feedops.sources.tables import read_pages
from registry.base import Tables, query

NAV_ROWS = X.ListingSpec("nav li", 'a[href^="/"]', "b")
LINKS_SQL = """links AS (SELECT page_id, url, list_pos, links[list_pos + 1] AS href, titles[list_pos + 1] AS title FROM
 (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS links, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
 LATERAL (SELECT unnest(generate_series(0, len(links) - 1)) AS list_pos))"""


def position() -> Column:
    return F.col("list_pos").cast("bigint").alias("list_pos")


@query("a2_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(t: Tables) -> DataFrame:
    return read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("b1_extract_rows_table", f"WITH {LINKS_SQL} SELECT page_id, list_pos, href, trim(title) AS title, false AS has_image, false AS is_notice FROM links")
def _(t: Tables) -> DataFrame:
    return X.extract_rows_table(t.pages, NAV_ROWS).select("page_id", position(), "href", "title", "has_image", "is_notice")


@query("b2_extract_rows_hybrid", rf"""WITH {LINKS_SQL}
SELECT page_id, list_pos, 'hybrid' AS layout, 'https://arca.live' || href AS link, regexp_extract(href, '^/([A-Za-z]+)$', 1) AS post_id FROM links WHERE regexp_matches(href, '^/[A-Za-z]+$')""")
def _(t: Tables) -> DataFrame:
    """Links with plain letters count as posts; a page without any would fall back to the second layout."""
    rows = X.extract_rows_hybrid(t.pages, NAV_ROWS, X.ListingSpec("footer a", None, "b"), id_pattern=r"live/([A-Za-z]+)$", need_icon=False)
    return rows.select("page_id", position(), "layout", "link", F.regexp_extract("link", "live/([A-Za-z]+)$", 1).alias("post_id"))


@query("b3_drop_notices", """
SELECT page_id, page_id % 4 IN (0, 1, 3) AS notice FROM pages""")
def _(t: Tables) -> DataFrame:
    kind = F.col("page_id") % 4
    classes = F.when(kind == 0, F.array(F.lit("vrow"), F.lit("notice"))).when(kind == 1, F.array(F.lit("notice-board"))).otherwise(
        F.array(F.lit("vrow"), F.lit("unnoticed")))
    return t.pages.select("page_id", X.is_notice(classes, F.when(kind == 3, F.lit("icon_notice"))).alias("notice"))


@query("b4_has_image", "SELECT page_id, regexp_matches(html, '(?s)<article>.*<b>') AS has_image FROM pages")
def _(t: Tables) -> DataFrame:
    """The bold mark plays the part of the image icon."""
    return X.extract_rows_table(t.pages, X.ListingSpec("article", "h1", "b")).select("page_id", "has_image")


@query("b7_extract_media_all", """
SELECT page_id, CAST(unnest(generate_series(0, n - 1)) AS BIGINT) AS img_pos FROM (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')) AS n FROM pages)""")
def _(t: Tables) -> DataFrame:
    tags = X.extract_media_all(t.pages, keep=("page_id",), body="article", content=".none", tag="p")
    return tags.select("page_id", F.col("img_pos").cast("bigint").alias("img_pos"))


@query("b8_extract_media_first", rf"""WITH {LINKS_SQL}
SELECT page_id, 'attachment' AS kind, regexp_extract(url, '^(https://[^/?#]*)', 1) || href AS primary_url, trim(title) AS filename_hint, 0 AS fallbacks FROM links
WHERE list_pos = 0 AND regexp_matches(url, '^https://[^/?#]*\.example\.com([/?#]|$)')""")
def _(t: Tables) -> DataFrame:
    found = X.extract_media_first(t.pages, keep=("page_id",), post_url="url", policy=UrlPolicy(suffixes=(".example.com",)),
                                  attachments="nav ul li a[href]", inline=("footer",))
    return found.select("page_id", "kind", "primary_url", "filename_hint", F.size("fallback_urls").alias("fallbacks"))
