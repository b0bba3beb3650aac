"""Listing and post pages of both layouts, and the plans built on them."""

import pandas as pd
from pyspark.sql import functions as F

from feedops.operators import extract
from feedops.plans import acknowledge, media, selection
from feedops.plans.profiles import MULTI, SINGLE
from tests.test_operators import DELIVERY, rows, table


def table_row(number, notice=False, icon=True, href=None):
    kind = ' data-type="icon_notice"' if notice else ""
    return (f'<tr class="ub-content us-post"{kind}><td class="gall_num">{number}<td class="gall_tit ub-word"><a href="{href or f"/board/view/?id=x&no={number}"}">'
            f'<em class="icon_img {"icon_pic" if icon else "icon_txt"}"></em> post &amp; {number} </a><a href="/c">[1]</a></tr>')


def hybrid_row(number, icon=True, notice="", href=None):
    mark = '<span class="media-icon"></span>' if icon else ""
    return (f'<div class="vrow hybrid {notice}"><div class="vrow-inner"><a class="title hybrid-title" href="{href or f"/b/x/{number}?p=1#c"}">'
            f'<b>post</b> {number} {mark}</a></div></div>')


def column_row(number, icon=True):
    mark = '<span class="media-icon"></span>' if icon else ""
    return f'<a class="vrow column" href="/b/x/{number}"><span class="title">col {number}{mark}</span><br></a>'


def pages(spark, *html):
    return table(spark, [(i, "g", 1, h) for i, h in enumerate(html)], "page_id bigint, gallery string, crawl_id int, html string")


def test_table_rows(spark):
    html = "<table><tbody>" + table_row(0, notice=True) + table_row(1) + table_row(2, icon=False) + table_row(3, href="https://evil.example/board/view/?no=3") + \
        table_row(4, href="/other") + '<tr class="x"><td class="gall_tit"><a href="/board/view/?no=9">n</a></table>'
    found = extract.extract_rows_table(pages(spark, html, None, ""))
    assert rows(found, "list_pos", "post_id", "title", "has_image", "is_notice") == [
        (0, "0", "post & 0", True, True), (1, "1", "post & 1", True, False), (2, "2", "post & 2", False, False), (3, None, "post & 3", True, False)]


def test_classes_written_with_entities(spark):
    html = "<table><tbody>" + table_row(1).replace("ub-content us-post", "ub&#45;content us&#x2d;post") + "</table>"
    assert rows(extract.extract_rows_table(pages(spark, html, "<p>a &amp; b</p>")), "page_id", "post_id") == [(0, "1")]


def test_hybrid_rows_fall_back_to_columns(spark):
    good = hybrid_row(1) + hybrid_row(2, icon=False) + hybrid_row(3, notice="notice") + hybrid_row(4, notice="notice-unfilter") + hybrid_row(5, href="https://evil.example/b/x/5") + column_row(9)
    only_invalid = hybrid_row(6, icon=False) + column_row(7) + column_row(8, icon=False)
    found = extract.extract_rows_hybrid(pages(spark, good, only_invalid))
    assert rows(found, "page_id", "post_id", "layout", "title", "link") == [
        (0, "1", "hybrid", "post1", "https://arca.live/b/x/1?p=1"), (1, "7", "column", "col 7", "https://arca.live/b/x/7")]


def test_listing_to_new_posts(spark):
    html = "<table>" + table_row(0, notice=True) + "".join(table_row(n, href="/x" if n == 5 else None) for n in range(1, 24)) + "</table>"
    known = table(spark, [("dcinside", "g", "post:22")], "source string, gallery_name string, delivery_key string")
    fresh = selection.select_new_posts(selection.listing_rows(pages(spark, html), SINGLE), known, SINGLE)
    assert rows(fresh, "post_id") == [("23",)]
    many = "".join(hybrid_row(n, icon=n != 3) for n in range(20))
    fresh = selection.select_new_posts(selection.listing_rows(pages(spark, many), MULTI), known, MULTI)
    assert rows(fresh, "post_id") == [(str(n),) for n in range(11, 16)]


def posts(spark, *html):
    return table(spark, [("s", "g", str(i), f"https://gall.dcinside.com/board/view/?no={i}", h) for i, h in enumerate(html)],
                 "source string, gallery string, post_id string, post_url string, html string")


def test_media_of_a_body(spark):
    inside = '<div class="article-body"><div class="fr-view article-content"><img src="//ac-p1.namu.la/a.webp"><img class="arca-emoticon" src="//ac.namu.la/e.png"></div></div>'
    beside = '<div class="article-body"><img src="https://ac.namu.la/a.png?x"></div><section class="fr-view article-content"><p><img src="https://ac.namu.la/b.png"><img data-type="emoticon" src="https://ac.namu.la/c.png">' \
        '<img src="https://evil.example/d.png"><img src="https://ac.namu.la/a.png?y"></section>'
    found = media.media_of_posts(posts(spark, inside, beside, "<p>none"), MULTI)
    assert rows(found, "post_id", "media_idx", "primary_url", "filename_hint") == [
        ("0", 0, "https://ac-o.namu.la/a.webp?type=orig", "a.webp"), ("1", 0, "https://ac.namu.la/a.png?type=orig&x", "a.png"),
        ("1", 1, "https://ac.namu.la/b.png?type=orig", "b.png")]


FILES = '<div class="appending_file_box"><ul><li><a href="{}">label.jpg</a></ul></div>'


def test_first_media_of_a_post(spark):
    inline = '<div class="writing_view_box"><img alt="none"><img data-original="https://dcimg1.dcinside.com/o.png" src="https://dcimg1.dcinside.com/s.png"></div><div class="write_div"><img src="/late.png"></div>'
    good = FILES.format("https://dcimg7.dcinside.com/a.php?no=1")
    foreign = FILES.format("https://evil.example/a.php")
    found = media.media_of_posts(posts(spark, inline + good, inline + foreign, '<div class="write_div"><img src="https://evil.example/x.png">', "<p>"), SINGLE)
    assert [(r.post_id, r.primary_url, r.fallback_urls, r.filename_hint) for r in found.orderBy("post_id").collect()] == [
        ("0", "https://dcimg7.dcinside.com/a.php?no=1", [], "label.jpg"),
        ("1", "https://dcimg1.dcinside.com/o.png", ["https://dcimg1.dcinside.com/s.png"], "o.png"),
        ("2", "https://evil.example/x.png", [], "x.png")]


PNG = bytes.fromhex("89504E470D0A1A0A0000000D494844520000002000000010")
LOG = "url string, attempt int, status int, error_kind string, declared_length string, content binary"
LEDGER = "source string, gallery_name string, delivery_key string, delivered_at timestamp"


def test_partial_delivery_is_completed_on_the_next_run(spark):
    page = '<div class="article-body"><img src="https://ac.namu.la/a.png"><img src="https://ac.namu.la/b.png"><img src="https://ac.namu.la/c.png"><img src="https://ac.namu.la/d.png"></div>'
    listed = posts(spark, page).withColumn("has_image", F.lit(True)).withColumn("page_available", F.lit(True))
    urls = {n: f"https://ac.namu.la/{n}.png?type=orig" for n in "abcd"}
    log = table(spark, [(urls["a"], 1, 200, None, "25", PNG + b"a"), (urls["b"], 1, 503, None, None, None), (urls["b"], 2, 200, None, None, PNG + b"b"),
                        (urls["c"], 1, 404, None, None, None), ("https://ac.namu.la/c.png", 1, 404, None, None, None), (urls["d"], 1, 200, None, None, PNG + b"a")], LOG)
    found = media.media_of_posts(listed, MULTI)
    empty = table(spark, [], LEDGER)
    resolved = media.resolve_media(found, log, empty, MULTI)
    assert rows(resolved, "media_idx", "status", "filename") == [(0, "ready", "a.png"), (1, "ready", "b.png"), (2, "rejected", None), (3, "ready", "d.png")]
    ready = media.sendable_media(resolved)
    first, second = [r.content_hash for r in ready.orderBy("media_idx").collect()]
    now = F.lit("2025-01-01").cast("timestamp")

    def delivered(*hashes, outcome):
        return table(spark, [("s", "g", "0", 0, "discord", "c", outcome, [first, second], list(hashes), True, None)], DELIVERY)

    recorded = acknowledge.acknowledge(listed, resolved, delivered(first, outcome="partial"), MULTI, now).dropDuplicates()
    assert rows(recorded, "delivery_key") == [(f"image:{first}",)]
    again = media.resolve_media(found, log, recorded, MULTI)
    assert rows(again, "media_idx", "status") == [(0, "duplicate"), (1, "ready"), (2, "rejected"), (3, "duplicate")]
    finished = acknowledge.acknowledge(listed, again, delivered(second, outcome="succeeded"), MULTI, now).dropDuplicates()
    assert rows(finished, "delivery_key") == sorted([(f"image:{second}",), ("post:0",)])


def test_pages_are_read_in_slices_of_bounded_length():
    html = pd.Series(["a" * 4, None, "b" * 6, "c" * 30, "", "d"])
    assert list(extract._slices(html, 10)) == [(0, 3), (3, 4), (4, 6)]
    assert list(extract._slices(html[:0], 10)) == []
