"""Table operators on small tables and against sequential models on random traces."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedops.functions.expr import packed, unpacked
from feedops.operators import admission, anchors, dedup, delivery, feed, fetchlog, ledger, ratelimit, scanlog, select
from feedops.functions.urls import SINGLE_MEDIA
from feedops.plans.media import resolve_media
from feedops.plans.profiles import SINGLE
from registry import load


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- selection


def listing(spark, count, gallery="g", start=0):
    return table(spark, [("s", gallery, 1, i, str(i), f"t{i % 2}", True) for i in range(start, start + count)],
                 "source string, gallery string, crawl_id int, list_pos int, post_id string, title string, has_image boolean")


BY = ["source", "gallery", "crawl_id"]


def test_holdback_then_ledger_then_limit(spark):
    posts = listing(spark, 23).unionByName(listing(spark, 20, "short"))
    held = select.moderation_holdback(posts, 20, BY, ["list_pos"])
    assert rows(held, "gallery", "list_pos") == [("g", 20), ("g", 21), ("g", 22)]
    known = table(spark, [("s", "g", "post:20"), ("s", "other", "post:21")], "source string, gallery_name string, delivery_key string")
    fresh = ledger.unseen_posts(held, known)
    assert rows(select.next_unseen(fresh, 1, BY, ["list_pos"]), "post_id") == [("21",)]
    assert held.filter("list_pos > 20").count() == 2  # equal titles with different ids are different posts
    assert select.moderation_holdback(posts, 0, BY, ["list_pos"]).count() == 43


def test_caps_batches_and_frames(spark):
    media = table(spark, [("p", i) for i in range(7)] + [("q", 0)], "post string, pos int")
    assert select.cap_media_per_post(media, ["post"], ["pos"]).count() == 5
    batched = select.assign_batches(media, ["post"], ["pos"], size=2, cap=5)
    assert rows(batched, "post", "media_idx", "batch_idx", "start_index") == [
        ("p", 0, 0, 0), ("p", 1, 0, 0), ("p", 2, 1, 2), ("p", 3, 1, 2), ("p", 4, 2, 4), ("q", 0, 0, 0)]
    frames = table(spark, [("m", i, None if i == 1 else 10) for i in range(5)] + [("n", 0, 7)], "media_id string, frame_idx int, duration int")
    assert rows(select.downsample_frames(frames, max_frames=2)) == [("m", 0, 120), ("m", 3, 20), ("n", 0, 7)]


def store_model(items, now, ttl, max_items, max_bytes):
    held = []
    for created, seq, size in items:
        held = [h for h in held if h[0] >= created - ttl]
        while held and (len(held) >= max_items or sum(h[2] for h in held) + size > max_bytes):
            held.pop(0)
        held.append((created, seq, size))
    return sorted(h[1] for h in held if h[0] >= now - ttl)


def test_recent_store_equals_arrival_by_arrival_eviction(spark):
    rng = random.Random(3)
    for _ in range(8):
        at, items = 0, []
        for seq in range(40):
            at += rng.choice([0, 1, 5])
            items.append((at, seq, rng.randint(1, 30)))
        now, ttl, count, size = at + rng.randint(0, 20), rng.randint(5, 60), rng.randint(1, 15), rng.randint(30, 200)
        df = table(spark, [(c * 1_000_000, s, b) for c, s, b in items], "created_us bigint, seq bigint, bytes bigint")
        got = select.recent_store(df, F.lit(now * 1_000_000), ttl, count, size)
        assert [r[0] for r in rows(got, "seq")] == store_model(items, now, ttl, count, size)
    df = table(spark, [(0, 1, 5)], "created_us bigint, seq bigint, bytes bigint")
    assert select.recent_store(df, F.lit(60_000_000), 60, 2, 10).count() == 1
    assert select.recent_store(df, F.lit(61_000_000), 60, 2, 10).count() == 0
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            select.recent_store(df, F.lit(0), *bad)
    with pytest.raises(ValueError):
        select.newest_feed(df, 201)


# --- anchored windows


def anchor_model(events, gap, closed):
    found, last = set(), {}
    for key, t in sorted(set(events), key=lambda e: (str(e[0]), e[1])):
        if key not in last or (t - last[key] >= gap if closed else t - last[key] > gap):
            last[key] = t
            found.add((key, t))
    return found


@pytest.mark.parametrize(("gap", "closed", "sizes"), [
    (60, False, {}), (60, True, {"fold_rows": 20, "chunk_rows": 50, "fan_in": 3}), (7, False, {"fold_rows": 20, "chunk_rows": 50, "fan_in": 3}),
    (700, False, {"fold_rows": 20, "cell_rows": 5}), (700, True, {"fold_rows": 200, "cell_rows": 80, "chunk_rows": 90, "fan_in": 2})])
def test_anchors_on_every_path(spark, gap, closed, sizes):
    rng = random.Random(gap)
    shapes = (("a", 3000, 1500), ("b", 9000, 1500), ("c", 500, 150), (None, 60_000, 700), ("e", 10, 40))
    events = [(k, rng.randint(-span // 2, span)) for k, span, n in shapes for _ in range(n)]
    df = table(spark, events, "k string, t bigint").repartition(4)
    scale = 1_000_000
    got = anchors.anchors(df.withColumn("t", F.col("t") * scale), ["k"], "t", gap * scale, closed, **sizes)
    assert {(r.k, r.anchor // scale) for r in got.collect()} == anchor_model(events, gap, closed)


def test_many_windows_of_a_hot_key_take_few_rounds(spark, monkeypatch):
    """Pointers double their reach: 20,000 windows of one key, of cells too large for a task, take at most 16 rounds."""
    rng = random.Random(11)
    events = [("hot", t + rng.randint(0, 40)) for t in range(0, 20_000 * 61, 30)] + [("hot", 7), (None, 3), (None, 90), (None, 95)]
    steps = []
    monkeypatch.setattr(anchors, "pinned", lambda df, real=anchors.pinned: steps.append(1) or real(df))
    got = anchors.anchors(table(spark, events, "k string, t bigint").repartition(4), ["k"], "t", 60, fold_rows=2, cell_rows=1)
    found = {(r.k, r.anchor) for r in got.collect()}
    assert found == anchor_model(events, 60, False) and len(found) > 15_000
    assert len(steps) <= 4 + 16


def test_rate_limit_counts_rejected_requests(spark):
    events = [(1, "a", s) for s in (0,)] + [(i, "a", s) for i, s in enumerate((1, 2, 3, 60, 61, 121, 122), 2)]
    df = table(spark, [(i, k, s * 1_000_000) for i, k, s in events], "id bigint, ip string, t_us bigint")
    got = ratelimit.rate_limit(df, ["ip"], "t_us", "id", 60, 3)
    # Exactly 60 s after the start still belongs to the window.
    assert rows(got, "id", "limited") == [(1, False), (2, False), (3, False), (4, True), (5, True), (6, False), (7, False), (8, False)]


def test_rate_limit_random(spark):
    rng = random.Random(11)
    events = sorted((rng.randint(0, 400) * 1_000_000, i, rng.choice("abc")) for i in range(600))
    limited, state = [], {}
    for t, i, k in events:
        count, start = state.get(k, (0, t))
        if t - start > 20_000_000:
            count, start = 0, t
        state[k] = (count + 1, start)
        limited.append((i, count + 1 > 4))
    df = table(spark, [(i, k, t) for t, i, k in events], "id bigint, ip string, t_us bigint")
    for sizes in ({}, {"fold_rows": 30, "chunk_rows": 60}):
        assert rows(ratelimit.rate_limit(df, ["ip"], "t_us", "id", 20, 4, **sizes), "id", "limited") == sorted(limited)


def test_likes(spark):
    likes = table(spark, [(1, "x", "i", 0), (2, "x", "i", 1), (3, "y", "i", 2), (4, "x", "gone", 3), (5, "x", "j", 4)],
                  "id bigint, client_ip string, image_id string, t_us bigint")
    items = table(spark, [("i",), ("j",)], "image_id string")
    got = ratelimit.accept_likes(likes, items, "client_ip", "image_id", "t_us", "id", 60, 3)
    assert rows(got, "id", "status") == [(1, "accepted"), (2, "repeated"), (3, "accepted"), (4, "not_found"), (5, "limited")]
    assert rows(feed.like_counts(got.filter("status = 'accepted'"))) == [("i", 2)]
    assert rows(feed.likes_for_items(likes, items), "id", "found") == [(1, True), (2, True), (3, True), (4, False), (5, True)]


# --- de-duplication


def test_anchored_suppression(spark):
    arrivals = [(1, "h", 0), (2, "h", 299), (3, "h", 300), (4, "h", 599), (5, "k", 1), (6, "h", 300)]
    df = table(spark, [(i, h, s * 1_000_000) for i, h, s in arrivals], "seq bigint, content_hash string, created_us bigint")
    assert rows(dedup.dedup_anchored(df, ["content_hash"], "created_us", "seq"), "seq") == [(1,), (3,), (5,)]
    assert rows(dedup.flag_anchored(df, ["content_hash"], "created_us", "seq").filter("accepted"), "seq") == [(1,), (3,), (5,)]


def lru_model(touches, size):
    held = []
    for key in touches:
        held = [k for k in held if k != key] + [key]
        held = held[-size:]
    return set(held)


def test_recent_keys_and_first_touch(spark):
    rng = random.Random(2)
    for touches, size in (("abac", 2), ("abc", 2), ("".join(rng.choice("abcdefgh") for _ in range(60)), 4)):
        df = table(spark, [(i, k) for i, k in enumerate(touches)], "t bigint, k string")
        assert {r.k for r in dedup.recent_keys(df, "k", "t", size).collect()} == lru_model(touches, size)
    df = table(spark, [(1, "a", 5), (2, "a", 3), (3, "b", 3), (4, "a", 3)], "id bigint, k string, t bigint")
    assert rows(dedup.first_touch(df, ["k"], "t", "id"), "id", "first") == [(1, False), (2, True), (3, True), (4, False)]


def test_post_dedup(spark):
    media = table(spark, [("p", 0, "h", "https://h/a?1"), ("p", 1, "h", "https://h/a?2#x"), ("p", 2, None, "https://h/b"), ("q", 0, "h", "https://h/a")],
                  "post string, pos int, content_hash string, url string")
    assert rows(dedup.dedup_within_post(media, ["post"], "content_hash", ["pos"]), "post", "pos") == [("p", 0), ("q", 0)]
    assert rows(dedup.dedup_urls_within_post(media, ["post"], "url", ["pos"]), "post", "pos") == [("p", 0), ("p", 2), ("q", 0)]


def test_admission(spark):
    base = (None, 10, "png", 5, 5, False, None, None)
    items = [(1, 0, "h") + base, (2, 10, "h") + base, (3, 20, "g", None, 10, "bmp", 5, 5, False, None, None), (4, 400, "h") + base]
    df = table(spark, [(s, t * 1_000_000, *rest) for s, t, *rest in items],
               "seq bigint, created_us bigint, content_hash string, declared_length string, size bigint, ext string, width int, height int, "
               "animated boolean, compressed_size bigint, thumb_size bigint")
    judged = admission.admit(df)
    assert rows(judged.filter("reason is not null"), "seq", "reason") == [(2, "duplicate"), (3, "415_unsupported_format")]
    good, bad = admission.split_admitted(judged)
    assert (good.count(), bad.count()) == (2, 2)


# --- ledger


def test_ledger_rules(spark):
    schema = "source string, gallery string, post_id string, at timestamp"
    offered = table(spark, [("s", "g", "1", None), ("s", "g", "", None), ("", "g", "2", None), ("s", None, "3", None)], schema)
    good, bad = ledger.ledger_rows(offered, "post", "post_id", F.lit("2025-01-05").cast("timestamp"))
    assert (rows(good, "delivery_key"), bad.count()) == ([("post:1",)], 3)
    stamped = [("s", "g", "post:1", "2025-01-10"), ("s", "g", "post:1", "2025-01-01"), ("s", "h", "post:1", "2025-01-02"), ("s", "g", "image:1", "2025-01-03")]
    rows_in = table(spark, stamped, "source string, gallery_name string, delivery_key string, delivered_at string").withColumn(
        "delivered_at", F.col("delivered_at").cast("timestamp"))
    empty = rows_in.limit(0)
    added = ledger.ledger_add(empty, rows_in)
    assert added.count() == 3
    assert str(added.filter("gallery_name = 'g' and delivery_key = 'post:1'").first().delivered_at) == "2025-01-01 00:00:00"
    assert ledger.ledger_add(added, rows_in).count() == 0
    kept, removed = ledger.ledger_prune(rows_in, F.lit("2025-01-02").cast("timestamp"))
    assert (kept.count(), removed.first().removed) == (3, 1)
    assert ledger.ledger_check(rows_in.select(*ledger.LEDGER_KEYS), added).count() == 4


def test_seen_media_is_per_gallery(spark):
    media = table(spark, [("s", "g", "h"), ("s", "k", "h")], "source string, gallery string, content_hash string")
    known = table(spark, [("s", "g", "image:h")], "source string, gallery_name string, delivery_key string")
    assert rows(ledger.seen_media(media, known), "gallery") == [("g",)]
    assert rows(ledger.unseen_media(media, known), "gallery") == [("k",)]
    empty = table(spark, [("s", "g", "h"), ("x", "g", None)], "source string, gallery string, content_hash string")
    twice = known.unionByName(known)  # a key that is there twice repeats no medium
    assert rows(ledger.flag_seen_media(media.unionByName(empty).withColumn("seen", F.lit("old")), twice), "source", "gallery", "content_hash", "seen") == [
        ("s", "g", "h", True), ("s", "g", "h", True), ("s", "k", "h", False), ("x", "g", None, False)]


# --- delivery


DELIVERY = ("source string, gallery string, post_id string, batch_idx int, transport string, destination_id string, outcome string, "
            "requested_media array<string>, delivered_media array<string>, ack_eligible boolean, reason string")


def sent(post, outcome, delivered, transport="discord", eligible=True, destination="c1", batch=0):
    return ("s", "g", post, batch, transport, destination, outcome, ["a", "b"], delivered, eligible, None)


def test_outcomes_and_acknowledgement(spark, one):
    def outcome(requested, delivered):
        return delivery.delivery_outcome(F.lit(requested), F.lit(delivered))

    assert one(outcome(["a"], ["a"]), outcome(["a", "b"], ["a"]), outcome(["a"], []), outcome([], [])) == ("succeeded", "partial", "failed", "failed")
    log = table(spark, [sent("1", "succeeded", ["a", "b"]), sent("1", "failed", [], destination="c2"), sent("2", "failed", []), sent("3", "queued", [], "web_gallery", False),
                        sent("4", "partial", ["a"]), sent("5", "succeeded", ["a", "b"], eligible=False)], DELIVERY)
    assert rows(delivery.acknowledged(log), "post_id", "acknowledged") == [("1", True), ("2", False), ("3", False), ("4", False), ("5", False)]
    media = table(spark, [("s", "g", p, 0, i, m) for p in "124" for i, m in enumerate("ab")],
                  "source string, gallery string, post_id string, batch_idx int, media_idx int, media_id string")
    web = delivery.web_rows_for_delivered(media, log)
    assert rows(web.groupBy("post_id").count()) == [("1", 2), ("4", 1)]
    assert rows(delivery.media_to_record(media.withColumnRenamed("media_id", "content_hash"), log, multi=True), "post_id", "content_hash") == [
        ("1", "a"), ("1", "b"), ("4", "a")]
    assert rows(delivery.media_to_record(media.withColumnRenamed("media_id", "content_hash"), log, multi=False), "post_id", "content_hash") == [("1", "a"), ("1", "b")]
    channels = table(spark, [("c2",)], "channel_id string")
    resolved = delivery.resolve_destination(log, channels).filter("post_id = '1'")
    assert rows(resolved, "destination_id", "outcome", "reason", "ack_eligible") == [("c1", "failed", "channel_not_found", True), ("c2", "failed", None, True)]
    merged = delivery.merge_results(log, log.limit(1))
    assert merged.count() == 7 and "ordinal" in merged.columns


@pytest.mark.parametrize(("multi", "want"), [
    (True, {"text": True, "down": False, "dup": True, "fail": False, "ok": True, "half": False, "notsent": False, "rejected": True}),
    (False, {"text": True, "down": False, "dup": True, "fail": False, "ok": True, "half": False, "notsent": False, "rejected": True})])
def test_post_acknowledgement(spark, multi, want):
    posts = table(spark, [("s", "g", p, p != "text", p != "down") for p in want], "source string, gallery string, post_id string, has_image boolean, page_available boolean")
    status = {"dup": ["duplicate"], "fail": ["failed"], "ok": ["ready"], "half": ["ready", "failed"], "notsent": ["ready"], "rejected": ["rejected"]}
    media = table(spark, [("s", "g", p, s) for p, all_of in status.items() for s in all_of], "source string, gallery string, post_id string, status string")
    log = table(spark, [sent("ok", "succeeded", ["a", "b"]), sent("half", "succeeded", ["a", "b"]), sent("notsent", "failed", [])], DELIVERY)
    got = delivery.post_ack(posts, media, log, multi)
    assert {r.post_id: r.post_acknowledged for r in got.collect()} == want


def test_fan_out_and_message_fields(spark):
    media = table(spark, [("s", "g", "p", i // 2, i, f"m{i}", "t", "l", ["c1", "c2"]) for i in range(3)],
                  "source string, gallery string, post_id string, batch_idx int, media_idx int, media_id string, title string, link string, channel_ids array<string>")
    out = delivery.fan_out(media, telegram=True, telegram_chat="chat", web_always=True)
    assert out.count() == 4 + 3 + 3
    assert rows(out.filter("transport = 'discord' and destination_id = 'c1'").select("batch_idx", F.array_join("requested_media", ","))) == [(0, "m0,m1"), (1, "m2")]
    fields = delivery.message_fields(media, F.lit("label"))
    assert rows(fields, "media_idx", "message_title", "message_footer") == [(0, "t", "label · 2개 이미지"), (1, None, None), (2, None, None)]
    shown = spark.range(1).select(delivery.web_outcome(F.lit(True), F.lit(0)).alias("a"), delivery.web_outcome(F.lit(False), F.lit(1)).alias("b"),
                                  delivery.web_outcome(F.lit(True), F.lit(1)).alias("c")).first()
    assert [(x.outcome, x.reason) for x in shown] == [("skipped", "empty_media"), ("skipped", "gallery_disabled"), ("queued", None)]


# --- fetch log


def chain(spark, fetches, urls, budget=6, candidates=4):
    cands = table(spark, [("m", i, u, "image") for i, u in enumerate(urls)], "media string, cand_rank int, url string, expected_media_type string")
    fetched = table(spark, [(u, *f) for u, f in fetches.items()], "url string, verdict string, requests int, size_ok boolean, ext string, valid boolean")
    return tuple(fetchlog.resolve_candidates(cands, fetched, ["media"], SINGLE_MEDIA, candidates, budget).select("verdict", "chosen_url", "chosen_rank").first())


def test_candidate_chains(spark):
    a, b, c, bad = "https://dcimg1.dcinside.com/a", "https://dcimg1.dcinside.com/b", "https://dcimg1.dcinside.com/c", "https://evil.example/x"
    good, missing, down = ("success", 1, True, "png", True), ("permanent_failure", 1, None, None, None), ("exhausted", 3, None, None, None)
    assert chain(spark, {a: missing, b: good}, [a, b]) == ("chosen", b, 1)
    assert chain(spark, {a: down, b: good}, [a, b]) == ("chosen", b, 1)
    assert chain(spark, {a: missing, bad: good}, [a, bad]) == ("rejected", None, None)
    assert chain(spark, {a: missing, b: missing, c: good}, [a, b, c], budget=2) == ("budget_exceeded", None, None)
    assert chain(spark, {a: missing, b: missing}, [a, b]) == ("rejected", None, None)
    assert chain(spark, {a: missing, b: missing, c: good}, [a, b, c], candidates=2) == ("rejected", None, None)
    assert chain(spark, {a: down, b: down, c: good}, [a, b, c]) == ("budget_exceeded", None, None)
    assert chain(spark, {a: down, b: down}, [a, b]) == ("exhausted", None, None)
    assert chain(spark, {a: ("success", 1, True, None, True), b: ("success", 1, False, "png", True)}, [a, b]) == ("rejected", None, None)
    assert chain(spark, {}, [a]) == ("exhausted", None, None)


def test_request_verdicts(spark):
    log = table(spark, [("a", 1, "retry"), ("a", 2, "success"), ("b", 1, "retry"), ("b", 2, "retry"), ("b", 3, "retry"), ("b", 4, "success"), ("c", 1, "blocked"),
                        ("c", 2, "success"), ("d", 1, "retry"), ("e", 1, "permanent_failure")], "url string, attempt int, decision string")
    assert rows(fetchlog.request_verdict(log, ["url"]), "url", "verdict", "requests") == [
        ("a", "success", 2), ("b", "exhausted", 3), ("c", "blocked", 1), ("d", "pending", 1), ("e", "permanent_failure", 1)]


# --- feed


def test_feed_statistics(spark):
    live = table(spark, [(1, 10, 5), (2, 30, 7)], "seq bigint, created_s bigint, bytes bigint").withColumn("created_us", F.col("created_s") * 1_000_000)

    def health(items, now, started, limit=30):
        stats = feed.store_stats(items, F.lit(now * 1_000_000), F.lit(started * 1_000_000), 100)
        return feed.health(stats, limit)

    stale = health(live, 61, 0)
    assert tuple(stale.select("items", "memory_bytes", "latest_age_seconds", "fresh").first()) == (2, 12, 31.0, False)
    assert health(live, 60, 0).first().fresh
    empty = live.limit(0)
    assert [health(empty, now, 0).first().fresh for now in (30, 31)] == [True, False]
    assert [feed.capacity(h, 120, 10_800, up).first().state for h, up in ((stale, True), (health(live, 40, 0), True), (health(empty, 99, 0), True), (stale, False))] == [
        "late", "ok", "late_nothing_collected", "down"]


def test_feed_lookups_and_diff(spark):
    live = table(spark, [("i", "d1", "t1"), ("j", "d2", None)], "image_id string, data_ref string, thumb_ref string")
    assert feed.lookup_item(live, "i", True).first().content == "t1"
    assert feed.lookup_item(live, "j", True).first().content == "d2"
    assert feed.lookup_item(live, "k").count() == 0
    before, after = (table(spark, d, "image_id string, likes int") for d in ([("a", 5), ("b", 1)], [("b", 0), ("c", 2)]))
    assert rows(feed.snapshot_diff(before, after)) == [("a", "removed", None), ("b", "kept", 1), ("c", "fresh", 2)]


def test_scan_events(spark):
    log = table(spark, [(1, "curl/8", "/.env", ["token", "page", "page"], "1.1.1.1", None), (2, "Chrome/1", "/.env", [], None, "2.2.2.2"), (3, "curl/8", "/internal/x", [], None, None)],
                "id bigint, user_agent string, path string, query_keys array<string>, header_ip string, socket_ip string").withColumn(
        "ts", F.lit("2025-01-01 00:00:00.123456").cast("timestamp")).withColumn("method", F.lit("GET")).withColumn("status_code", F.lit(200))
    events = scanlog.scan_events(scanlog.drop_internal_requests(log)).collect()
    assert [(e.category, e.matched_signature, e.query_keys, e.source_ip, len(e.event_id), e.response_shape) for e in events] == [
        ("credential-hunter", "/.env", ["page", "token"], "1.1.1.1", 32, "decoy-credentials")]


def test_a_fetch_log_is_never_broadcast(spark):
    """Its size is misjudged by the compressed files it comes from; 4.8 million URLs would have met in the driver's memory."""
    candidates = spark.createDataFrame([(1, 0, "https://dcimg1.dcinside.com/1", "image"), (2, 0, "u", None)], "m int, cand_rank int, url string, expected_media_type string")
    fetches = spark.createDataFrame([("https://dcimg1.dcinside.com/1", "success", 1, True, "png", True)], "url string, verdict string, requests int, size_ok boolean, ext string, valid boolean")
    joined = fetchlog.candidates_with_fetches(candidates, fetches)
    settled = fetchlog.resolve_candidates(candidates, fetches, ["m"], None, carry=["ext"])
    for found in (joined, settled):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in settled.collect()} == {(1, "chosen", "https://dcimg1.dcinside.com/1", 0, "png"), (2, "exhausted", None, None, None)}


def test_media_travel_once_by_url_and_once_back(spark):
    """A medium's own columns go along with its first candidate: they were shuffled, and their posts numbered, a second time to meet the verdicts."""
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000003E8000003E8")
    urls = [f"https://dcimg1.dcinside.com/{i}" for i in range(3)]
    media = table(spark, [("s", "g", "1,2", 0, urls[0], [urls[1]], "a.jpg", "image"), ("s", "g", "1,2", 1, urls[2], None, "b.jpg", "image"), ("s", "g", "1,2", 1, urls[2], [], None, "image"),
                          ("s", "g,", "1", 2, urls[1], [], "c", "image"), (None, "g", "1", 0, urls[1], [], "c", "image"), ("s", "g", "1", None, urls[1], [], "c", "image")],
                  "source string, gallery string, post_id string, media_idx bigint, primary_url string, fallback_urls array<string>, filename_hint string, expected_media_type string")
    log = table(spark, [(urls[0], 1, "http", 404, None, None), (urls[1], 1, "http", 200, None, png), (urls[2], 1, "http", 503, None, None), (urls[2], 2, "http", 200, None, png + b"x")],
                "url string, attempt int, error_kind string, status int, declared_length string, content binary")
    hashes = [hashlib.sha256(png + end).hexdigest() for end in (b"", b"x")]
    known = table(spark, [("s", "g,", f"image:{hashes[0]}"), ("s", "g", f"post:{hashes[0]}"), ("s", "g", "image:"), ("s", "g", None)], "source string, gallery_name string, delivery_key string")
    found = resolve_media(media, log, known, SINGLE)
    assert found.schema["media_idx"].dataType.simpleString() == "bigint"
    assert sorted(map(str, rows(found, "gallery", "post_id", "media_idx", "chosen_url", "content_hash", "filename", "status"))) == sorted(map(str, [
        ("g", "1,2", 0, urls[1], hashes[0], "a.png", "ready"), ("g", "1,2", 1, urls[2], hashes[1], "b.png", "ready"), ("g", "1,2", 1, urls[2], hashes[1], "image.png", "ready"),
        ("g,", "1", 2, urls[1], hashes[0], "c.png", "duplicate")]))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("filename_hint#") and text.count("primary_url#") and text.count("Join") == 2


def test_sent_media_stay_where_the_ledger_met_them(spark):
    """One hash of a gallery is in one place after the ledger's join, so the first medium of a post and hash needs no further shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        build = load()[0]["plan_media_sent"]
        text = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Lines by order, the log and its candidates by URL, media by their keys, media and ledger by hash, and the distinct rows the ledger is made of.
    assert text.count("FileScan parquet") == 3 and text.count("Exchange hashpartitioning") == 7 and "l_extendedprice" not in text


def test_packed_values_come_back(spark):
    data = [("a", 1, ""), ("a1", 2, ",1"), ("", 0, "a,1,1"), ("\u00e9,", -3, "\u4e2d"), (None, 1, "x")]
    given = table(spark, data, "a string, b int, c string").withColumn("p", packed([F.col("a"), F.col("b"), F.col("c")]))
    a, b, c = unpacked(F.col("p"), ["string", "int", "string"])
    back = given.select(a.alias("a"), b.alias("b"), c.alias("c"), "p").collect()
    assert [tuple(r)[:3] for r in back] == [*data[:-1], (None, None, None)] and len({r.p for r in back}) == len(data)
