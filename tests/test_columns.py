"""Row-level rules (B, H, I, J) on literal cases."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from feedops.functions import fetch, labels, media, scan, urls

L = F.lit


def test_post_ids(one):
    assert one(
        urls.post_id_from_path(L("https://arca.live/b/x/12345?p=2")), urls.post_id_from_path(L("https://arca.live/b/x/")),
        urls.post_id_from_query(L("https://h/board/view/?id=a&no=77&no=78")), urls.post_id_from_query(L("https://h/?no=")),
        urls.post_id_from_query(L("https://h/?no=&no=5")), urls.post_id_from_query(L("https://h/?no=a%20b")),
    ) == ("12345", None, "77", None, "5", "a b")


BASE = "https://h.example/a/b/c?q=1#f"
REFERENCES = ["", "d", "./d", "../d", "../../../d", "/x/./y/../z", "//o.example/p?x#y", "?n=1", "#top", "https://h.example/k/../m", "http://o.example",
              "mailto:me", "d/", "..", ".", "d//e", "/", "d?x=/../y", "d;p", "g:h"]


def test_resolution_matches_the_standard_library(spark):
    rows = spark.createDataFrame([(r,) for r in REFERENCES], "href string")
    for base in (BASE, "https://h.example", "https://h.example/dir/"):
        got = {r.href: r.url for r in rows.select("href", urls.resolve(base, F.col("href")).alias("url")).collect()}
        by_column = {r.href: r.url for r in rows.select("href", urls.resolve(L(base), F.col("href")).alias("url")).collect()}
        want = {r: urljoin(base, r) for r in REFERENCES}
        assert got == want
        assert by_column == want


def test_canonical_links(one):
    def link(href):
        return urls.canonical_link(urls.MULTI_BASE, L(href), "arca.live")

    assert one(*map(link, ["/b/x/1?p=2#c", "https://arca.live:443/b/x/1", "https://other.live/b/x/1", "http://arca.live/b/x/1", "https://u@arca.live/b/x/1",
                           "https://@arca.live/b/x/1", "https://ARCA.live/b/x/1", ""])) == (
        "https://arca.live/b/x/1?p=2", None, None, None, None, "https://@arca.live/b/x/1", "https://ARCA.live/b/x/1", None)
    assert one(urls.board_link(urls.SINGLE_BASE, L("/board/view/?no=3"), "gall.dcinside.com"),
               urls.board_link(urls.SINGLE_BASE, L("/board/view/?id=3"), "gall.dcinside.com"),
               urls.board_link(urls.SINGLE_BASE, L("https://x.example/?no=3"), "gall.dcinside.com")) == ("https://gall.dcinside.com/board/view/?no=3", None, None)


def test_url_policies(one):
    multi = {"https://arca.live/x": True, "https://ac-o.arca.live/x": True, "https://ac.arca.live/x": True, "https://ac-p1.namu.la/x": True,
             "http://arca.live/x": False, "https://arca.live:443/x": False, "https://arca.live.evil.example/x": False, "https://evilnamu.la/x": False,
             "https://x.arca.live/": False, "https://u:p@arca.live/": False, "https://@arca.live/": True, "https://arca.live:/": True, "": False,
             "https://evil.example/.namu.la": False, "https://evil.example#.namu.la": False, "HTTPS://ARCA.live": True}
    assert one(*[urls.is_allowed_url(L(u), urls.MULTI_MEDIA) for u in multi]) == tuple(multi.values())
    single = {"https://dcimg1.dcinside.com/x": True, "https://dcimg.dcinside.co.kr/x": True, "https://7.dcinside.com/x": True,
              "https://dcimg1.dcinside.com:443/x": False, "https://dcimgx.dcinside.com/x": False, "https://dcimg1.evil.com/x": False,
              "https://@dcimg1.dcinside.com/x": False, "https://image.dcinside.com/": False, "https://dcimg1.cdn.dcinside.com/": True}
    assert one(*[urls.is_allowed_url(L(u), urls.SINGLE_MEDIA) for u in single]) == tuple(single.values())


def candidates(data_original, src, orig):
    return urls.ordered_candidates(L(data_original).cast("string"), L(src).cast("string"), L(orig).cast("string"))


def test_ordered_candidates(one):
    assert one(candidates(None, "https://ac-p2.namu.la/a.webp?e=1", None)) == [
        "https://ac-o.namu.la/a.webp?type=orig&e=1", "https://ac-p2.namu.la/a.webp?e=1"]
    assert one(candidates(None, "https://ac-p2.namu.la/a.webp", "GIF"))[0] == "https://ac-o.namu.la/a.gif?type=orig"
    assert one(candidates(None, "https://ac-o.arca.live/a.png", None)) == [
        "https://ac-o.arca.live/a.png?type=orig", "https://ac.arca.live/a.png", "https://ac-o.arca.live/a.png"]
    assert one(candidates(None, "https://ac.arca.live/a.png", None)) == ["https://ac.arca.live/a.png"]
    assert one(candidates(None, "https://evil.example/a.png", None)) == []
    assert one(candidates(None, None, None)) == []


def test_names_and_labels(one):
    assert one(media.fix_extension(L("claimed.jpg"), L("png")), media.fix_extension(L("a/b/photo.JPEG"), L("jpg")), media.fix_extension(L(".hidden"), L("gif")),
               media.fix_extension(L(""), L("bmp")), media.fix_extension(L("a.tar.gz"), L("png")), media.fix_extension(L("x"), L(None).cast("string"))) == (
        "claimed.png", "photo.JPEG", ".hidden.gif", "image.bmp", "a.tar.png", None)
    assert one(urls.filename_hint(L("https://h/a%20b%2B+c.png?x"), L("d")), urls.filename_hint(L("https://h/"), L("d")),
               urls.filename_hint(L("https://h/a"), L("d"), L(" label "), 3)) == ("a b++c.png", "d", "lab")
    assert one(urls.mask_credentials(L("socks5://user:pass@h:1")), urls.mask_credentials(L("https://h/a@b"))) == ("socks5://***:***@h:1", "https://h/a@b")
    assert one(*[urls.safe_link(L(u)) for u in ("/x", "//x", "https://x", "HTTP://x", "javascript:1", "", "/")]) == ("/x", "", "https://x", "HTTP://x", "", "", "/")
    assert one(labels.safe_error_label(L("HTTPError"), L(500)), labels.safe_error_label(L("Timeout"), L(None).cast("int"))) == ("HTTPError(status=500)", "Timeout")
    ages = [(59_999_999, "방금"), (60_000_000, "1분 전"), (3_599_000_000, "59분 전"), (3_600_000_000, "1시간 전"), (86_400_000_000, "1일 전")]
    assert one(*[labels.relative_age(L(0), L(a)) for a, _ in ages]) == tuple(t for _, t in ages)
    assert one(labels.aspect_ratio(L(2), L(3)), labels.aspect_ratio(L(0), L(3))) == (1.5, 1.0)
    assert one(labels.client_ip(L("1.1.1.1"), L("2.2.2.2")), labels.client_ip(L(""), L("2.2.2.2")), labels.client_ip(L(None).cast("string"), L(""))) == (
        "1.1.1.1", "2.2.2.2", "unknown")
    assert one(*labels.truncate_fields(L("id"), L(""), L("t" * 600), L(None).cast("string"), L("g" * 200)).values()) == ("id", "t" * 500, "", "g" * 100)
    assert one(labels.display_title(L("t"), L(0)), labels.display_title(L("t"), L(2)), labels.display_link(L("l"), L(1))) == ("t", "t - 3", "")
    assert one(labels.ledger_key("post", L("1")), labels.ledger_key("image", L("1")), labels.ledger_key("post", L(""))) == ("post:1", "image:1", None)
    with pytest.raises(ValueError):
        labels.ledger_key("other", L("1"))


def test_status_and_backoff(one):
    cases = {408: "retry", 429: "retry", 500: "retry", 502: "retry", 599: "retry", 400: "permanent_failure", 401: "permanent_failure", 404: "permanent_failure",
             413: "permanent_failure", 200: "success", 304: "success", None: "retry"}
    assert one(*[fetch.classify_status(L(s).cast("int")) for s in cases]) == tuple(cases.values())
    linear = fetch.RetryPolicy(backoff="linear", base_delay=0.5)
    exponential = fetch.RetryPolicy(base_delay=0.5)
    assert one(fetch.backoff_delay(L(3), linear), fetch.backoff_delay(L(3), exponential)) == (1.5, 2.0)
    jittered = fetch.RetryPolicy(base_delay=4.0, max_delay=5.0, jitter=0.25)
    assert all(3.0 <= d <= 5.0 for d in one(*[fetch.backoff_delay(L(1), jittered, seed) for seed in range(20)]))
    for bad in ({"max_attempts": 0}, {"backoff": "x"}, {"base_delay": -1}, {"jitter": 2.0}, {"retry_statuses": frozenset({99})}):
        with pytest.raises(ValueError):
            fetch.RetryPolicy(**bad)


def test_retry_after(one):
    now = 1_735_689_600_000_000
    cases = {"12": 12.0, " 12 ": 12.0, "Wed, 01 Jan 2025 00:00:30 GMT": 30.0, "01 Jan 2025 00:00:30 +0000": 30.0, "": None, "-1": None, "junk": None, "1e1": 10.0,
             "Tue, 31 Dec 2024 23:00:00 GMT": None, "12d": None, "Wed, 99 Jan 2025 00:00:30 GMT": None}
    assert one(*[fetch.parse_retry_after(L(v), L(now)) for v in cases]) == tuple(cases.values())
    forms = {"Wed, 01 Jan 2025 00:00:30 EST": 18_030.0, "Wed, 01 Jan 2025 12:00:30 pdt": 68_430.0, "Wed Jan  1 00:00:30 2025": 30.0, "Jan 1 00:00:30 2025": 30.0,
             "01 Jan 2025 00:00:30 XYZ": 30.0, "inf": float("inf"), "+Infinity": float("inf"), "-inf": None, "nan": None}
    assert one(*[fetch.parse_retry_after(L(v), L(now)) for v in forms]) == tuple(forms.values())
    assert one(fetch.retry_delay(L(1), L(429), L("inf"), L(now)), L(0))[0] == 4.0
    headers = F.create_map(L("RETRY-after"), L("7"))
    value = fetch.header(headers, "Retry-After")
    assert one(fetch.retry_delay(L(1), L(429), value, L(now), fetch.RetryPolicy()), fetch.retry_delay(L(1), L(503), value, L(now), fetch.RetryPolicy()),
               fetch.retry_delay(L(1), L(429), L("99"), L(now)), fetch.retry_delay(L(1), L(429), L("0"), L(now), fetch.RetryPolicy(request_interval=2.0))) == (
        7.0, 1.0, 4.0, 2.0)


def test_challenge_pages(one):
    page = "<html><title>Just a moment...</title> Cloudflare"
    assert one(fetch.is_challenge(L("text/html"), L(page)), fetch.is_challenge(L(None).cast("string"), L(page)),
               fetch.is_challenge(L("text/plain"), L("just a moment cloudflare")), fetch.is_challenge(L("text/html"), L("x" * 131_072 + "__cf_chl_")),
               fetch.is_challenge(L("text/html"), L("x __CF_CHL_ y")), fetch.classify_response(L(503), L("text/html"), L(page)),
               fetch.classify_attempt(L("challenge"), L(503)), fetch.classify_attempt(L("other"), L(200))) == (
        True, True, False, False, True, "blocked", "blocked", "permanent_failure")


def test_signatures_and_dimensions(one):
    def content(hexed):
        return F.unhex(L(hexed))

    jpeg = "FFD8" + "FFE10006" + "00" * 4 + "FFFF" + "C000110800100020" + "03" + "00" * 9
    cases = {
        "89504E470D0A1A0A0000000D4948445200000020000000100802000000": ("png", 32, 16), jpeg: ("jpg", 32, 16), "47494638376120001000F700": ("gif", 32, 16),
        "424D" + "00" * 12 + "28000000" + "20000000" + "F0FFFFFF" + "00" * 4: ("bmp", 32, 16),
        "524946460000000057454250565038580A000000100000001F00000F0000": ("webp", 32, 16),
        "5249464600000000574542505650382000000000000000" + "9D012A" + "2000" + "1000": ("webp", 32, 16),
        "5249464600000000574542505650384C000000002F" + "1FC00300": ("webp", 32, 16),
        "25504446": (None, None, None), "": (None, None, None), "5249464600000000": (None, None, None),
    }
    for hexed, (ext, width, height) in cases.items():
        kind = media.sniff_type(content(hexed))
        dims = media.image_dims(content(hexed), kind)
        assert one(kind, dims["width"], dims["height"]) == (ext, width, height), hexed
    assert one(media.media_type(L("jpg")), media.media_type(L("png"))) == ("image/jpeg", "image/png")
    assert one(*[media.expected_type_ok(L(e).cast("string"), L("jpg")) for e in (None, "", "image", "image/jpeg", "JPG", "png")]) == (True, True, True, True, True, False)


def test_jpeg_headers_are_walked_to_any_depth(spark):
    frame, segment = "FFC2001108" + "0102" + "0304" + "03" + "00" * 9, "FFE10004ABCD"
    sized, unread = (0x0304, 0x0102), (None, None)
    cases = [
        (frame, sized), (segment * 63 + frame, sized), (segment * 500 + frame, sized), ("FF" * 300 + frame, sized), ("FFE10002" * 70 + frame, sized), ("FFE10000" + frame, unread), ("FFD0FF01" + frame, sized),
        ("FFC4000411" + "22" + frame, sized), ("FFDA0004" + frame, unread), (segment * 100 + "FFD9" + frame, unread), (segment * 100 + "00" + frame, unread),
        ("FFE1FFFF" + frame, unread), ("FFE1FFF0" + "11" * 0xFFEE + frame, sized), (segment * 200, unread), ("", unread)]
    rows = spark.createDataFrame([(i, bytearray.fromhex("FFD8" + hexed)) for i, (hexed, _) in enumerate(cases)] + [(len(cases), None)], "i int, content binary")
    dims = media.image_dims(F.col("content"), L("jpg"))
    found = rows.select("i", dims.alias("d")).select("i", "d.*").orderBy("i")
    assert [(r.width, r.height) for r in found.collect()] == [size for _, size in cases] + [unread]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_sizes_and_admission(one):
    limits = media.MediaLimits(discord_bytes=10, telegram_bytes=8, ingest_bytes=100, feed_image_bytes=50, feed_total_bytes=60, feed_pixels=100)
    plan = [media.size_plan(L(s), L(False), L(c).cast("int"), limits) for s, c in ((8, None), (9, None), (11, 8), (11, 9))]
    assert [(r.discord, r.telegram) for r in one(*plan)] == [("fits", "fits"), ("fits", "compress"), ("compress", "reuse"), ("compress", "compress")]
    assert one(media.initial_scale(L(100), L(400), L(True)), media.initial_scale(L(400), L(400), L(True)), media.initial_scale(L(400), L(400), L(False))) == (0.6, 1.0, 0.8)
    assert one(media.recompress_target(L(9), L(5)), media.recompress_target(L(9), L(10)), media.recompress_target(L(9), L(None).cast("int"))) == (5, 4, 4)
    assert one(*[media.web_payload_choice(L(s), limits) for s in (100, 101, 0)]) == ("original", "compressed", "compressed")
    assert one(media.pixel_gate(L(10), L(10), 100), media.pixel_gate(L(0), L(10), 100), media.pixel_gate(L(11), L(10), 100)) == (True, False, False)
    assert one(media.needs_thumbnail(L(1200), L(False)), media.needs_thumbnail(L(1200), L(True)), media.needs_thumbnail(L(480), L(False)),
               media.needs_thumbnail(L(1200), L(False), 0)) == (True, False, False, False)

    def reason(declared="", size=10, ext="png", w=5, h=5, animated=False, packed=None, duplicate=False, thumb=0):
        return media.admission_reason(L(declared), L(size), L(ext).cast("string"), L(w), L(h), L(animated), L(packed).cast("int"), L(duplicate), L(thumb), limits)

    assert one(reason(), reason("x"), reason("101"), reason(size=101), reason(ext="bmp"), reason(ext=None, size=0), reason(w=20, h=20), reason(size=51, ext="gif"),
               reason(size=51, animated=True), reason(size=51), reason(size=51, packed=51), reason(size=51, packed=40), reason(duplicate=True), reason(size=50, thumb=11)) == (
        None, "400_invalid_length", "413_declared_too_large", "413_body_too_large", "415_unsupported_format", "415_unsupported_format", "415_too_many_pixels",
        "413_animated_too_large", "413_animated_too_large", "needs_compress", "413_image_too_large", None, "duplicate", "413_over_capacity")
    assert one(*[media.oversize_reason(L(d).cast("string"), L(a), 10) for d, a in ((None, 10), ("11", 1), ("x", 1), ("5", 11), ("-1", 1))]) == (
        None, "declared_too_large", "declared_invalid", "body_too_large", None)


def test_scanner_rules(one):
    browser = "Mozilla/5.0 Chrome/131.0 Safari/537.36"
    cases = [
        ("GPTBot/1.0", "/", "ai-crawler", "GPTBot"), (browser, "/api/v1", None, None), ("curl/8", "/.env", "credential-hunter", "/.env"),
        ("Googlebot/2.1", "/.env", None, None), ("facebookexternalhit/1.1", "/", None, None), ("x", "/CGI-bin/a", "exploit-scanner", "/CGI-bin/a"),
        ("x", "actuator/y/", "probe", "/actuator/y"), ("GPTBot", "/robots.txt", "ai-crawler", "/robots.txt"), ("x", "/robots.txt", None, None),
        (browser + " GPTBot", "/wp-admin/", "exploit-scanner", "/wp-admin"), ("META-externalagent", "/", "ai-crawler", "Meta-ExternalAgent"), ("", "/v1", "api-scanner", "/v1"),
    ]
    got = one(*[scan.classify_request(L(agent), L(path)) for agent, path, _, _ in cases])
    assert [(r.category, r.matched_signature) for r in got] == [(c, s) for _, _, c, s in cases]
    shapes = {("/.git/config", 200): "decoy-git-config", ("/.env", 200): "decoy-credentials", ("/actuatorx", 200): "decoy-actuator", ("/x", 404): "decoy-not-found",
              ("/x", 200): "decoy-generic", ("//", 200): "decoy-generic", ("/ADMIN/", 200): "decoy-login", ("v2", 200): "decoy-api-index"}
    assert one(*[scan.response_shape(L(p), L(s)) for p, s in shapes]) == tuple(shapes.values())


def test_signatures_in_list_order_wherever_they_lie(spark):
    agents = ["Mozilla axios GPTBot", "xokhttpx", "okhttpclient/1", "Meta-EXTERNALAGENT", "nothing", "", None, "curlwget", "go-HTTP-client httpclient", "wgethttpx httpclient"]
    low = [(a, next((s for s in scan.CRAWLER_SIGNATURES if s.lower() in (a or "").lower()), None)) for a in agents]
    df = spark.createDataFrame([(a,) for a in agents], "ua string").select("ua", scan.matched_signature(F.col("ua")).alias("s"))
    assert [(r.ua, r.s) for r in df.collect()] == low
    few = spark.createDataFrame([("a+b",), ("ab",)], "ua string").select(scan.matched_signature(F.col("ua"), ["b", "A+"]).alias("s"))
    assert [r.s for r in few.collect()] == ["b", "b"]
