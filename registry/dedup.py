"""Hashing, de-duplication, rate limits and likes over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.expr import micros
from feedops.functions.media import content_hash
from feedops.functions.urls import without_query
from feedops.operators import dedup as D
from feedops.operators import ledger as L
from feedops.operators import ratelimit as R
from feedops.operators.anchors import anchors
from feedops.operators.feed import like_counts
from registry.base import Tables, query

GAP, WINDOW, LIMIT = 86_400, 2 * 86_400, 3


def event_times(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("t_us"),
                           F.get_json_object("props", "$.k").alias("image_id"))


def _anchor_sql(keys: str, gap: int, operator: str) -> str:
    match = " AND ".join(f"e.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t_us, CAST(json_extract(props, '$.k') AS VARCHAR) AS image_id FROM events),
a AS (SELECT {keys}, min(t_us) AS anchor FROM e GROUP BY {keys}
      UNION ALL SELECT {picked}, min(e.t_us) FROM e JOIN a ON {match} AND e.t_us {operator} a.anchor + {gap * 1_000_000} GROUP BY {picked})"""


def _limit_sql(window: int, limit: int) -> str:
    return f"""WITH RECURSIVE {_anchor_sql("user_id", window, ">")},
placed AS (SELECT e.event_id, e.user_id, e.t_us, e.event_type, e.image_id, max(a.anchor) AS anchor FROM e JOIN a ON e.user_id = a.user_id AND a.anchor <= e.t_us GROUP BY ALL),
judged AS (SELECT *, row_number() OVER (PARTITION BY user_id, anchor ORDER BY t_us, event_id) > {limit} AS limited FROM placed)"""


RATE_SQL = _limit_sql(WINDOW, LIMIT) + " SELECT event_id, user_id, anchor, limited FROM judged"
DEDUP_SQL = f"WITH RECURSIVE {_anchor_sql('user_id, event_type', GAP, '>=')} SELECT e.event_id, e.user_id, e.event_type FROM e JOIN a ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.t_us = a.anchor"
LIKES_SQL = f"""{_limit_sql(WINDOW, LIMIT)},
passed AS (SELECT *, row_number() OVER (PARTITION BY user_id, image_id ORDER BY t_us, event_id) AS nth FROM judged WHERE NOT limited),
status AS (SELECT event_id, user_id, image_id, CASE WHEN CAST(image_id AS BIGINT) >= 90 THEN 'not_found' WHEN nth = 1 THEN 'accepted' ELSE 'repeated' END AS status FROM passed
 UNION ALL SELECT event_id, user_id, image_id, 'limited' FROM judged WHERE limited)"""


def accepted_likes(t: Tables) -> DataFrame:
    events = event_times(t)
    # Items 0-89 are still in the feed.
    items = events.filter(F.col("image_id").cast("bigint") < 90).select("image_id")
    return R.accept_likes(events, items, "user_id", "image_id", "t_us", "event_id", WINDOW, LIMIT)


@query("f1_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


@query("f2_dedup_within_post", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, sha256(text)")
def _(t: Tables) -> DataFrame:
    hashed = t.documents.select("source", "doc_id", content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
    return D.dedup_within_post(hashed, ["source"], "content_hash", ["doc_id"]).select("source", "doc_id")


@query("f3_dedup_urls_within_post", r"""
SELECT split_part(url, '.', -2) AS post, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY split_part(url, '.', -2), url""")
def _(t: Tables) -> DataFrame:
    media = t.pages.select("page_id", "url", F.element_at(F.split(without_query(F.col("url")), r"\."), -2).alias("post"))
    return D.dedup_urls_within_post(media, ["post"], "url", ["page_id"]).select("post", "page_id")


@query("d2_seen_media", """
WITH h AS (SELECT doc_id, source, sha256(text) AS hash FROM documents),
led AS (SELECT DISTINCT h.source, h.hash FROM h JOIN labels USING (doc_id))
SELECT h.doc_id, 'seen' AS state FROM h JOIN led USING (source, hash)
UNION ALL SELECT h.doc_id, 'new' AS state FROM h WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.source = h.source AND led.hash = h.hash)""")
def _(t: Tables) -> DataFrame:
    media = t.documents.select(F.lit("board").alias("source"), F.col("source").alias("gallery"), "doc_id",
                               content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
    known = media.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    ledger, _ = L.ledger_rows(known, "image", "content_hash", F.lit(None).cast("timestamp"))
    return L.flag_seen_media(media, ledger).select("doc_id", F.when(F.col("seen"), "seen").otherwise("new").alias("state"))


@query("f4_dedup_against_ledger", """
WITH h AS (SELECT source, sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2)
SELECT source, doc_id FROM h WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels USING (doc_id) WHERE d.source = h.source AND sha256(d.text) = h.hash)""")
def _(t: Tables) -> DataFrame:
    """What is left of every source after de-duplication inside it and against labelled (delivered) texts."""
    media = t.documents.select(F.lit("board").alias("source"), F.col("source").alias("gallery"), "doc_id",
                               content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
    known = media.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    ledger, _ = L.ledger_rows(known, "image", "content_hash", F.lit(None).cast("timestamp"))
    fresh = L.unseen_media(D.dedup_within_post(media, ["source", "gallery"], "content_hash", ["doc_id"]), ledger)
    return fresh.select(F.col("gallery").alias("source"), "doc_id")


@query("g0_anchors", f"WITH RECURSIVE {_anchor_sql('user_id', WINDOW, '>')} SELECT user_id, anchor FROM a")
def _(t: Tables) -> DataFrame:
    return anchors(event_times(t), ["user_id"], "t_us", WINDOW * 1_000_000)


@query("g0_anchors_busy_keys", f"WITH RECURSIVE {_anchor_sql('event_type', 600, '>')} SELECT event_type, anchor FROM a")
def _(t: Tables) -> DataFrame:
    """Five keys hold all rows and are far over the fold limit given here, so pieces and chunks are used."""
    return anchors(event_times(t), ["event_type"], "t_us", 600 * 1_000_000, fold_rows=500, chunk_rows=400, fan_in=4)


@query("f5_dedup_anchored", DEDUP_SQL)
def _(t: Tables) -> DataFrame:
    return D.dedup_anchored(event_times(t), ["user_id", "event_type"], "t_us", "event_id", GAP).select("event_id", "user_id", "event_type")


@query("f6_recent_keys", "SELECT user_id, max(epoch_us(ts)) AS t_us FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 50")
def _(t: Tables) -> DataFrame:
    return D.recent_keys(event_times(t), "user_id", "t_us", 50, "event_id")


@query("f7_first_touch", """
SELECT event_id, row_number() OVER (PARTITION BY user_id, json_extract(props, '$.k') ORDER BY ts, event_id) = 1 AS first FROM events""")
def _(t: Tables) -> DataFrame:
    return D.first_touch(event_times(t), ["user_id", "image_id"], "t_us", "event_id").select("event_id", "first")


@query("f8_sorted_query_keys", """
SELECT o_orderkey, array_to_string(list_sort(list_distinct(string_split(lower(o_orderpriority) || '-' || o_orderstatus || '-' || lower(o_orderstatus), '-'))), ',') AS keys,
 o_orderpriority AS first_url FROM orders""")
def _(t: Tables) -> DataFrame:
    words = F.split(F.concat_ws("-", F.lower("o_orderpriority"), "o_orderstatus", F.lower("o_orderstatus")), "-")
    urls = D.distinct_urls(F.array("o_orderpriority", "o_orderstatus", "o_orderpriority"))
    return t.orders.select("o_orderkey", F.array_join(D.sorted_keys(words), ",").alias("keys"), F.get(urls, F.lit(0)).alias("first_url"))


@query("g1_rate_limit", RATE_SQL)
def _(t: Tables) -> DataFrame:
    return R.rate_limit(event_times(t), ["user_id"], "t_us", "event_id", WINDOW, LIMIT).select("event_id", "user_id", "anchor", "limited")


@query("g2_accept_likes", LIKES_SQL + " SELECT event_id, status FROM status")
def _(t: Tables) -> DataFrame:
    return accepted_likes(t).select("event_id", "status")


@query("e8_like_counts", LIKES_SQL + " SELECT image_id, count(DISTINCT user_id) AS likes FROM status WHERE status = 'accepted' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return like_counts(accepted_likes(t).filter(F.col("status") == "accepted"), client="user_id")
