"""URL and text columns over pages, documents and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions import labels, urls
from feedops.functions.expr import let
from registry.base import Tables, query
from registry.fetchlog import pick

HOST_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
QUERY_SQL = r"regexp_extract(url, '\?([^#]*)', 1)"
POLICY = urls.UrlPolicy(hosts=("www.ththen.example.com",), suffixes=(".example.org", ".example.net"))
LABEL_POLICY = urls.UrlPolicy(suffixes=(".example.com",), label="blog|m", strict_user=True)


@query("b5_post_id", f"""
SELECT page_id, nullif(regexp_extract({QUERY_SQL}, '(?:^|&)page=([^&]+)', 1), '') AS by_query, nullif(regexp_extract(url, '/[a-z][a-z]/([0-9]+)', 1), '') AS by_path FROM pages""")
def _(t: Tables) -> DataFrame:
    by_path = urls.post_id_from_path(F.col("url"), "/[a-z][a-z]/([0-9]+)")
    return t.pages.select("page_id", urls.post_id_from_query(F.col("url"), "page").alias("by_query"), by_path.alias("by_path"))


@query("b6_canonical_link", r"""
WITH p AS (SELECT page_id, page_id % 6 AS kind, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE kind
 WHEN 0 THEN 'https://board.example.com' || path || '?p=1' WHEN 1 THEN 'https://board.example.com/b/' || page_id WHEN 2 THEN 'https://board.example.com/b/list/y/' || page_id
 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN starts_with(url, 'https://board.example.com/') THEN url END END AS link FROM p""")
def _(t: Tables) -> DataFrame:
    path = let(urls.url_parts(F.col("url")), lambda p: p["path"])
    number = F.col("page_id").cast("string")
    href = pick_columns(F.col("page_id") % 6, [
        F.concat(path, F.lit("?p=1#top")), F.concat(F.lit("../"), number), F.concat(F.lit("./x/../y/"), number, F.lit("#c")),
        F.concat(F.lit("https://user@board.example.com/"), number), F.concat(F.lit("//board.example.com:443/"), number), F.col("url")])
    return t.pages.select("page_id", urls.canonical_link("https://board.example.com/b/list/", href, "board.example.com").alias("link"))


def pick_columns(index, values: list):
    chosen = F.when(index == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        chosen = chosen.when(index == i, value)
    return chosen


@query("b6_board_link", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://gall.dcinside.com/board/view/?id=x&no=' || page_id || '#c' WHEN page_id % 3 = 1 THEN NULL END AS link,
 CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END AS post_id FROM pages""")
def _(t: Tables) -> DataFrame:
    number = F.col("page_id").cast("string")
    href = pick_columns(F.col("page_id") % 3, [F.concat(F.lit("/board/view/?id=x&no="), number, F.lit("#c")),
                                               F.lit("/board/view/?id=x&no="), F.concat(F.col("url"), F.lit("&no=1"))])
    link = urls.board_link(urls.SINGLE_BASE, href, "gall.dcinside.com")
    return t.pages.select("page_id", link.alias("link"), urls.post_id_from_query(link).alias("post_id"))


@query("b9_is_allowed_url", f"""
SELECT page_id, starts_with(url, 'https:') AND ({HOST_SQL} = 'www.ththen.example.com' OR {HOST_SQL} LIKE '%.example.org' OR {HOST_SQL} LIKE '%.example.net') AS by_host,
 starts_with(url, 'https:') AND regexp_matches({HOST_SQL}, '^(blog|m)\\..*\\.example\\.com$') AS by_label FROM pages""".replace("\\\\", "\\"))
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.is_allowed_url(F.col("url"), POLICY).alias("by_host"), urls.is_allowed_url(F.col("url"), LABEL_POLICY).alias("by_label"))


@query("b9_source_policies", """
SELECT page_id, page_id % 8 IN (0, 1, 2) AS multi, page_id % 8 IN (3, 4) AS single FROM pages""")
def _(t: Tables) -> DataFrame:
    """Both built-in policies on eight kinds of media URL made from every page's number."""
    kinds = ["https://arca.live/", "https://ac-p2.namu.la/", "https://@ac.arca.live/", "https://dcimg7.dcinside.co.kr/", "https://12.dcinside.com/",
             "https://@dcimg1.dcinside.com/", "https://ac-o.arca.live:443/", "http://dcimg1.dcinside.com/"]
    url = F.concat(pick(kinds, F.col("page_id") % 8), F.col("page_id").cast("string"))
    return t.pages.select("page_id", urls.is_allowed_url(url, urls.MULTI_MEDIA).alias("multi"), urls.is_allowed_url(url, urls.SINGLE_MEDIA).alias("single"))


MEDIA_URL = ["https://ac-p3.namu.la/a/{}.webp", "https://ac-o.arca.live/b/{}.png?type=orig&x=1", "https://ac.arca.live/c/{}.jpg?x=1", "https://arca.live/d.e/{}"]


def media_url():
    number = F.col("page_id").cast("string")
    return pick_columns(F.col("page_id") % 4, [F.concat(F.lit(u.split("{}")[0]), number, F.lit(u.split("{}")[1])) for u in MEDIA_URL])


@query("b10_url_variants", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://ac-o.namu.la/a/' || page_id || '.webp?type=orig' WHEN 1 THEN 'https://ac-o.arca.live/b/' || page_id || '.png?type=orig&x=1'
 WHEN 2 THEN 'https://ac.arca.live/c/' || page_id || '.jpg?x=1' ELSE 'https://arca.live/d.e/' || page_id || '?type=orig' END AS original,
 CASE page_id % 4 WHEN 0 THEN 'https://ac-p3.namu.la/a/' || page_id || '.webp' WHEN 1 THEN 'https://ac.arca.live/b/' || page_id || '.png?x=1'
 WHEN 2 THEN 'https://ac.arca.live/c/' || page_id || '.jpg?x=1' ELSE 'https://arca.live/d.e/' || page_id END AS thumbnail,
 CASE page_id % 4 WHEN 0 THEN 'https://ac-p3.namu.la/a/' || page_id || '.gif' WHEN 1 THEN 'https://ac-o.arca.live/b/' || page_id || '.gif?type=orig&x=1'
 WHEN 2 THEN 'https://ac.arca.live/c/' || page_id || '.gif?x=1' ELSE 'https://arca.live/d.e/' || page_id END AS extension FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.original_variant(media_url()).alias("original"), urls.thumbnail_variant(media_url()).alias("thumbnail"),
                          urls.extension_variant(media_url(), F.lit("gif")).alias("extension"))


@query("b11_ordered_candidates", """
SELECT page_id, CASE page_id % 4
 WHEN 0 THEN 'https://ac-o.namu.la/a/' || page_id || '.gif?type=orig|https://ac-o.namu.la/a/' || page_id || '.webp?type=orig|https://ac-p.namu.la/a/' || page_id || '.webp'
 WHEN 1 THEN 'https://ac-o.arca.live/b/' || page_id || '.png?type=orig&x=1|https://ac.arca.live/b/' || page_id || '.png?x=1|https://ac-o.arca.live/b/' || page_id || '.png?x=1'
 WHEN 2 THEN '' ELSE 'https://ac-o.arca.live/c/' || page_id || '.jpg?type=orig|https://ac.arca.live/c/' || page_id || '.jpg' END AS urls FROM pages""")
def _(t: Tables) -> DataFrame:
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    src = pick_columns(kind, [F.concat(F.lit("https://ac-p.namu.la/a/"), number, F.lit(".webp")), F.concat(F.lit("//ac-o.arca.live/b/"), number, F.lit(".png?x=1")),
                              F.col("url"), F.concat(F.lit("https://ac.arca.live/c/"), number, F.lit(".jpg"))])
    data_original = F.when(kind == 3, F.concat(F.lit("https://ac-o.arca.live/c/"), number, F.lit(".jpg?type=orig")))
    data_orig = F.when(kind == 0, F.lit(".GIF")).when(kind == 1, F.lit("tiff"))
    return t.pages.select("page_id", F.array_join(urls.ordered_candidates(data_original, src, data_orig), "|").alias("urls"))


@query("b12_filename_hint", r"""
WITH p AS (SELECT page_id, regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS base FROM pages)
SELECT page_id, CASE WHEN base <> '' THEN base || ' a+b' ELSE ' a+b' END AS named, CASE WHEN base <> '' THEN base ELSE 'arca_' || page_id || '_0.jpg' END AS plain FROM p""")
def _(t: Tables) -> DataFrame:
    path = let(urls.url_parts(F.col("url")), lambda p: urls.unsplit(p["scheme"], p["authority"], p["path"], F.lit("")))
    spaced = urls.filename_hint(F.concat(path, F.lit("%20a+b")), F.lit("image"))
    plain = urls.filename_hint(F.col("url"), F.concat(F.lit("arca_"), "page_id", F.lit("_0.jpg")), F.lit("  "), 255)
    return t.pages.select("page_id", spaced.alias("named"), plain.alias("plain"))


@query("b16_mask_credentials", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://***:***@') ELSE url END AS masked FROM pages""")
def _(t: Tables) -> DataFrame:
    secret = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.lit("://user:p4ss@"))).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.mask_credentials(secret).alias("masked"))


@query("b18_truncate_fields", """
SELECT doc_id, left(CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE text END, 255) AS filename, left(text, 500) AS title,
 CASE WHEN doc_id % 2 = 0 THEN '' ELSE left(text, 2048) END AS link, left(source, 100) AS gallery FROM documents""")
def _(t: Tables) -> DataFrame:
    fields = labels.truncate_fields(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.col("text"),
                                    F.when(F.col("doc_id") % 2 != 0, F.col("text")), F.col("source"))
    return t.documents.select("doc_id", *[c.alias(n) for n, c in fields.items()])


@query("b21_source_of", "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'arcalive' ELSE 'dcinside' END AS source FROM supplier")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("s_nationkey") % 3 == 0, F.lit("arca")).when(F.col("s_nationkey") % 3 == 1, F.lit("dc"))
    return t.supplier.select("s_suppkey", labels.source_of(kind).alias("source"))


@query("b23_safe_link", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/b/' || page_id WHEN 4 THEN upper(url) ELSE '' END AS link FROM pages""")
def _(t: Tables) -> DataFrame:
    number = F.col("page_id").cast("string")
    link = pick_columns(F.col("page_id") % 5, [F.col("url"), F.concat(F.lit("/b/"), number), F.concat(F.lit("//"), F.col("url")),
                                               F.concat(F.lit("javascript:"), F.col("url")), F.upper("url")])
    return t.pages.select("page_id", urls.safe_link(link).alias("link"))


@query("b24_aspect_ratio", "SELECT doc_id, CASE WHEN doc_id % 7 > 0 AND n_chars > 0 THEN CAST(n_chars AS DOUBLE) / (doc_id % 7) ELSE 1 END AS ratio FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", labels.aspect_ratio(F.col("doc_id") % 7, F.col("n_chars")).alias("ratio"))
