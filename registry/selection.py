"""Hold-back, ledger look-ups, ranking and limits over documents (listings), lineitem (media) and events (feed items)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.expr import micros
from feedops.operators import ledger as L
from feedops.operators import select as S
from feedops.plans.profiles import SourceProfile
from feedops.plans.selection import select_new_posts
from feedops.functions.urls import SINGLE_MEDIA
from feedops.session import scratch_folder
from feedops.sources import versions
from feedops.sources.tables import append_ledger, read_ledger
from registry.base import Tables, query

# Rows of lineitem are unique only over all columns; this is the page order of an order's media.
MEDIA_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
               "l_tax", "l_returnflag", "l_linestatus"]
MEDIA_ORDER_SQL = ", ".join(MEDIA_ORDER)

# The feed used by every query on recent items: 3 days, 120 items, 2,000,000 bytes, read 60 s after the last arrival.
TTL, MAX_ITEMS, MAX_BYTES = 3 * 86400, 120, 2_000_000
FEED_SQL = f"""
items AS (SELECT event_id AS seq, epoch_us(ts) AS created_us, CAST(round(value * 1000) AS BIGINT) AS bytes,
                 event_type AS gallery, user_id, event_id FROM events),
clock AS (SELECT max(created_us) + 60000000 AS now_us FROM items),
live AS (SELECT items.*, now_us FROM items, clock WHERE created_us >= now_us - {TTL * 1_000_000}),
counted AS (SELECT * FROM live ORDER BY created_us DESC, seq DESC LIMIT {MAX_ITEMS}),
summed AS (SELECT *, sum(bytes) OVER (ORDER BY created_us DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS running FROM counted),
store AS (SELECT * FROM summed WHERE running <= {MAX_BYTES})"""


def listing(t: Tables) -> DataFrame:
    return t.documents.select(
        F.lit("board").alias("source"), F.col("source").alias("gallery"), F.lit(1).alias("crawl_id"),
        (-F.col("doc_id")).alias("list_pos"), F.col("doc_id").cast("string").alias("post_id"), "doc_id",
        (F.col("n_chars") % 3 != 0).alias("has_image"),
    )


def label_ledger(t: Tables) -> DataFrame:
    labelled = t.labels.select("doc_id").join(t.documents.select("doc_id", F.col("source").alias("gallery")), "doc_id")
    rows = labelled.withColumn("source", F.lit("board"))
    return L.ledger_rows(rows, "post", "doc_id", F.lit("2025-01-01 00:00:00").cast("timestamp"))[0]


def feed_events(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("seq"), micros(F.col("ts")).alias("created_us"),
        F.round(F.col("value") * 1000).cast("bigint").alias("bytes"), F.col("event_type").alias("gallery"), "user_id", "event_id",
    )


def feed_clock(t: Tables) -> DataFrame:
    """One row: the reading time."""
    return t.events.agg((F.max(micros(F.col("ts"))) + 60_000_000).alias("now_us"))


def live_feed(t: Tables) -> DataFrame:
    return S.recent_store(feed_events(t), feed_clock(t).scalar(), TTL, MAX_ITEMS, MAX_BYTES)


PROFILE = SourceProfile("board", 3, 5, 1, 1, SINGLE_MEDIA, multi=False, telegram=False, images_only=False)
IMAGE_PROFILE = SourceProfile("board", 3, 5, 4, 10, SINGLE_MEDIA, multi=True, telegram=False, images_only=True)


def _selection_sql(where: str) -> str:
    return f"""
WITH ranked AS (SELECT source AS gallery, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn
                FROM documents WHERE {where}),
fresh AS (SELECT gallery, doc_id, row_number() OVER (PARTITION BY gallery ORDER BY doc_id DESC) AS k FROM ranked r
          WHERE rn > 3 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id))
SELECT gallery, doc_id FROM fresh WHERE k <= 5"""


@query("unseen_posts_selection", _selection_sql("true"))
def _(t: Tables) -> DataFrame:
    return select_new_posts(listing(t), label_ledger(t), PROFILE).select("gallery", "doc_id")


@query("unseen_image_posts_selection", _selection_sql("n_chars % 3 <> 0"))
def _(t: Tables) -> DataFrame:
    return select_new_posts(listing(t), label_ledger(t), IMAGE_PROFILE).select("gallery", "doc_id")


@query("c1_moderation_holdback", """
SELECT gallery, doc_id FROM (SELECT source AS gallery, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn
 FROM documents) WHERE rn > 20""")
def _(t: Tables) -> DataFrame:
    return S.moderation_holdback(listing(t), 20, ["source", "gallery", "crawl_id"], ["list_pos"]).select("gallery", "doc_id")


@query("c1_moderation_holdback_images", """
SELECT gallery, doc_id FROM (SELECT source AS gallery, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn
 FROM documents WHERE n_chars % 3 <> 0) WHERE rn > 10""")
def _(t: Tables) -> DataFrame:
    rows = listing(t).filter("has_image")
    return S.moderation_holdback(rows, 10, ["source", "gallery", "crawl_id"], ["list_pos"]).select("gallery", "doc_id")


@query("c2_next_unseen", """
SELECT gallery, doc_id FROM (SELECT source AS gallery, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn
 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE rn <= 1""")
def _(t: Tables) -> DataFrame:
    fresh = L.unseen_posts(listing(t), label_ledger(t))
    return S.next_unseen(fresh, 1, ["source", "gallery", "crawl_id"], ["list_pos"]).select("gallery", "doc_id")


@query("d1_unseen_posts", "SELECT doc_id, source AS gallery FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return L.unseen_posts(listing(t), label_ledger(t)).select("doc_id", "gallery")


@query("l3_ledger_check", "SELECT 'post:' || doc_id AS delivery_key, source AS gallery_name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    keys, _ = L.ledger_rows(listing(t), "post", "post_id", F.lit(None).cast("timestamp"))
    return L.ledger_check(keys.drop("delivered_at"), label_ledger(t)).select("delivery_key", "gallery_name")


@query("c3_cap_media_per_post", f"""
SELECT l_orderkey, l_partkey, l_suppkey, media_idx FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) - 1 AS BIGINT) AS media_idx
 FROM lineitem) WHERE media_idx < 4""")
def _(t: Tables) -> DataFrame:
    capped = S.cap_media_per_post(t.lineitem, ["l_orderkey"], MEDIA_ORDER)
    return capped.select("l_orderkey", "l_partkey", "l_suppkey", F.col("media_idx").cast("bigint").alias("media_idx"))


@query("c4_assign_batches", f"""
WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) - 1 AS BIGINT) AS media_idx
 FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, media_idx, media_idx // 3 AS batch_idx, media_idx // 3 * 3 AS start_index FROM m""")
def _(t: Tables) -> DataFrame:
    batched = S.assign_batches(t.lineitem, ["l_orderkey"], MEDIA_ORDER, size=3)
    return batched.select("l_orderkey", "l_partkey", "l_suppkey", *[F.col(c).cast("bigint").alias(c) for c in ("media_idx", "batch_idx", "start_index")])


@query("c5_newest_feed", f"WITH {FEED_SQL} SELECT seq, created_us FROM store ORDER BY created_us DESC, seq DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    return S.newest_feed(live_feed(t), 20).select("seq", "created_us")


@query("c6_recent_store", f"WITH {FEED_SQL} SELECT seq, created_us, bytes FROM store")
def _(t: Tables) -> DataFrame:
    return live_feed(t).select("seq", "created_us", "bytes")


@query("c7_downsample_frames", """
WITH f AS (SELECT conv_id AS media_id, turn AS idx, CASE WHEN role = 'user' THEN NULL ELSE length(text) END AS duration FROM conversations),
g AS (SELECT *, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY media_id) / 3.0) AS BIGINT)) AS step FROM f)
SELECT media_id, CAST(idx // step * step AS BIGINT) AS frame_idx, CAST(sum(coalesce(duration, 100)) AS BIGINT) AS duration FROM g GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    frames = t.conversations.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("frame_idx"),
                                    F.when(F.col("role") != "user", F.length("text")).alias("duration"))
    return S.downsample_frames(frames, max_frames=3)


@query("c8_first_by_position", f"""
SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) AS rn FROM lineitem) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return S.first_by_position(t.lineitem, ["l_orderkey"], MEDIA_ORDER).select("l_orderkey", "l_partkey", "l_linenumber")


_LEDGER_SQL = "led AS (SELECT 'g' || o_custkey % 3 AS gallery_name, 'post:' || o_custkey AS delivery_key, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS delivered_us, o_orderdate FROM orders)"


def order_ledger(t: Tables) -> DataFrame:
    """Delivery times of customers' posts: many rows per key."""
    rows = t.orders.select(F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("o_custkey") % 3).cast("string")).alias("gallery"),
                           "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return L.ledger_rows(rows, "post", "o_custkey", F.col("at"))[0]


@query("l1_ledger_key", f"WITH {_LEDGER_SQL} SELECT gallery_name, delivery_key, count(*) AS n FROM led GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return order_ledger(t).groupBy("gallery_name", "delivery_key").agg(F.count(F.lit(1)).alias("n"))


@query("l1_quarantine", "SELECT doc_id, source AS gallery FROM documents WHERE lang = 'en'")
def _(t: Tables) -> DataFrame:
    rows = listing(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("post_id", F.when(F.col("lang") != "en", F.col("post_id")).otherwise(""))
    return L.ledger_rows(rows, "post", "post_id", F.lit(None).cast("timestamp"))[1].select("doc_id", "gallery")


@query("l2_ledger_add", f"""WITH {_LEDGER_SQL},
old AS (SELECT DISTINCT gallery_name, delivery_key FROM led WHERE o_orderdate < DATE '1995-07-01')
SELECT gallery_name, delivery_key, min(delivered_us) AS delivered_us FROM led l
WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.gallery_name = l.gallery_name AND old.delivery_key = l.delivery_key)
GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = order_ledger(t)
    cut = F.lit("1995-07-01").cast("timestamp")
    added = L.ledger_add(rows.filter(F.col("delivered_at") < cut), rows)
    return added.select("gallery_name", "delivery_key", F.unix_micros("delivered_at").alias("delivered_us"))


@query("l4_ledger_prune", f"WITH {_LEDGER_SQL} SELECT gallery_name, delivery_key, delivered_us FROM led WHERE o_orderdate >= DATE '1998-01-01'")
def _(t: Tables) -> DataFrame:
    kept, _ = L.ledger_prune(order_ledger(t), F.lit("1998-01-01").cast("timestamp"))
    return kept.select("gallery_name", "delivery_key", F.unix_micros("delivered_at").alias("delivered_us"))


@query("e9_prune_count", "SELECT count(*) AS removed FROM orders WHERE o_orderdate < DATE '1998-01-01'")
def _(t: Tables) -> DataFrame:
    return L.prune_count(order_ledger(t), F.lit("1998-01-01").cast("timestamp"))


@query("a4_ledger_folder", f"WITH {_LEDGER_SQL} SELECT gallery_name, delivery_key, min(delivered_us) AS delivered_us FROM led GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """The ledger written to a partitioned folder, appended to and read back."""
    path = f"{scratch_folder(t.spark)}/ledger-{uuid.uuid4().hex}"
    rows, cut = order_ledger(t), F.lit("1997-01-01").cast("timestamp")
    append_ledger(L.ledger_add(t.spark.createDataFrame([], L.LEDGER_SCHEMA), rows.filter(F.col("delivered_at") < cut)), path)
    append_ledger(L.ledger_add(read_ledger(t.spark, path), rows.filter(F.col("delivered_at") >= cut)), path)
    return read_ledger(t.spark, path).select("gallery_name", "delivery_key", F.unix_micros("delivered_at").alias("delivered_us"))


@query("l4_ledger_commits", f"WITH {_LEDGER_SQL} SELECT gallery_name, delivery_key, min(delivered_us) AS delivered_us FROM led GROUP BY 1, 2 HAVING min(delivered_us) >= epoch_us(TIMESTAMP '1994-01-01')")
def _(t: Tables) -> DataFrame:
    """The ledger as numbered commits: an append, a prune and an append that falls between the prune's read and its switch."""
    root = f"{scratch_folder(t.spark)}/commits-{uuid.uuid4().hex}"
    rows, cut = order_ledger(t), F.lit("1995-01-01").cast("timestamp")
    versions.append(t.spark, root, rows.filter(F.col("delivered_at") < cut))
    versions.prune(t.spark, root, F.lit("1994-01-01").cast("timestamp"), lambda: versions.append(t.spark, root, rows.filter(F.col("delivered_at") >= cut)))
    return versions.read(t.spark, root).select("gallery_name", "delivery_key", F.unix_micros("delivered_at").alias("delivered_us"))
