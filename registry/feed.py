"""Recent feed: statistics, health, look-ups and diffs over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.expr import micros
from feedops.functions.labels import matches_source_filter, relative_age, source_of_gallery
from feedops.operators import feed as O
from registry.base import Tables, query
from registry.selection import FEED_SQL, MAX_BYTES, MAX_ITEMS, TTL, feed_clock, feed_events, live_feed

STATS_SQL = f"""{FEED_SQL},
stats AS (SELECT count(seq) AS items, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS memory_bytes, CAST({MAX_BYTES} AS BIGINT) AS memory_limit_bytes, max(created_us) AS latest_created_us,
 round((any_value(clock.now_us) - max(created_us)) / 1000000.0, 1) AS latest_age_seconds, CAST(7200 AS DOUBLE) AS uptime_seconds FROM clock LEFT JOIN store ON true)"""


def stats(t: Tables) -> DataFrame:
    now = feed_clock(t).scalar()
    return O.store_stats(live_feed(t), now, now - 7_200_000_000, MAX_BYTES)


@query("e5_store_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def _(t: Tables) -> DataFrame:
    return stats(t)


@query("e6_health", f"WITH {STATS_SQL} SELECT items, coalesce(latest_age_seconds, uptime_seconds) <= 30 AS fresh_30, coalesce(latest_age_seconds, uptime_seconds) <= 900 AS fresh_900 FROM stats")
def _(t: Tables) -> DataFrame:
    both = O.health(O.health(stats(t), 30).withColumnRenamed("fresh", "fresh_30"), 900).withColumnRenamed("fresh", "fresh_900")
    return both.select("items", "fresh_30", "fresh_900")


@query("e7_capacity", f"""WITH {STATS_SQL}
SELECT items, {MAX_ITEMS} AS max_items, round_even(memory_bytes / 1048576.0, 1) AS used_mb, round_even(memory_limit_bytes / 1048576.0, 0) AS limit_mb, CAST(72 AS DOUBLE) AS ttl_hours,
 CASE WHEN latest_age_seconds <= 30 THEN 'ok' WHEN latest_age_seconds IS NULL THEN 'late_nothing_collected' ELSE 'late' END AS state FROM stats""")
def _(t: Tables) -> DataFrame:
    return O.capacity(O.health(stats(t), 30), MAX_ITEMS, TTL)


@query("d7_likes_for_items", f"WITH {FEED_SQL} SELECT event_id, epoch_us(ts) AS t_us, (event_id - 7) IN (SELECT seq FROM store) AS found FROM events")
def _(t: Tables) -> DataFrame:
    likes = feed_events(t).select("event_id", F.col("created_us").alias("t_us"), (F.col("event_id") - 7).alias("image_id"))
    return O.likes_for_items(likes, live_feed(t).withColumnRenamed("seq", "image_id")).drop("image_id")


@query("d8_snapshot_diff", """
WITH p AS (SELECT o_orderkey AS k, o_custkey % 9 AS likes FROM orders WHERE o_orderdate < DATE '1998-06-01'),
c AS (SELECT o_orderkey AS k, o_custkey % 7 AS likes FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT coalesce(c.k, p.k) AS image_id, CASE WHEN c.k IS NULL THEN 'removed' WHEN p.k IS NULL THEN 'fresh' ELSE 'kept' END AS status,
 CASE WHEN c.k IS NOT NULL THEN greatest(p.likes, c.likes) END AS likes FROM p FULL JOIN c ON p.k = c.k""")
def _(t: Tables) -> DataFrame:
    before = t.orders.filter(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"))
    after = t.orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return O.snapshot_diff(before.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 9).alias("likes")),
                           after.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 7).alias("likes")))


@query("d8_snapshot_positions", """
WITH p AS (SELECT o_orderkey AS k, o_custkey % 9 AS likes FROM orders WHERE o_orderdate < DATE '1998-06-01'),
c AS (SELECT o_orderkey AS k, o_custkey % 7 AS likes, epoch_us(o_orderdate) AS created_us FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT coalesce(c.k, p.k) AS image_id, CASE WHEN c.k IS NULL THEN 'removed' WHEN p.k IS NULL THEN 'fresh' ELSE 'kept' END AS status,
 CASE WHEN c.k IS NOT NULL THEN greatest(p.likes, c.likes) END AS likes,
 CASE WHEN p.k IS NULL THEN row_number() OVER (PARTITION BY p.k IS NULL ORDER BY c.created_us DESC, c.k DESC) - 1 END AS position FROM p FULL JOIN c ON p.k = c.k""")
def _(t: Tables) -> DataFrame:
    """What changed, and where in the feed each fresh item goes."""
    before = t.orders.filter(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz"))
    after = t.orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return O.snapshot_changes(before.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 9).alias("likes")),
                              after.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 7).alias("likes"), micros(F.col("o_orderdate")).alias("created_us")),
                              ["created_us"])


@query("d10_lookup_item", f"""WITH {FEED_SQL}
SELECT e.event_id AS image_id, e.event_type = 'view' AS thumbnail,
 CASE WHEN s.seq IS NULL THEN NULL WHEN e.event_type = 'view' AND s.bytes > 20000 THEN 'thumb-' || s.seq ELSE 'data-' || s.seq END AS content
FROM events e LEFT JOIN store s ON s.seq = e.event_id""")
def _(t: Tables) -> DataFrame:
    live = live_feed(t).select(F.col("seq").alias("image_id"), F.concat(F.lit("data-"), "seq").alias("data_ref"),
                               F.when(F.col("bytes") > 20000, F.concat(F.lit("thumb-"), "seq")).alias("thumb_ref"))
    wanted = t.events.select(F.col("event_id").alias("image_id"), (F.col("event_type") == "view").alias("thumbnail"))
    return O.lookup_items(live, wanted)


@query("a6_feed_json", """
SELECT CAST(event_id AS VARCHAR) AS id, '/images/' || event_id AS url, CASE WHEN value > 50 THEN '/images/' || event_id || '?thumbnail=1' ELSE '/images/' || event_id END AS thumb,
 event_type AS gallery, CAST(user_id % 5 AS VARCHAR) AS likes, CAST(user_id AS VARCHAR) AS w, CAST(2 * user_id AS VARCHAR) AS h, epoch_us(ts) AS created_us FROM events""")
def _(t: Tables) -> DataFrame:
    """The JSON text is read back field by field."""
    items = feed_events(t).join(t.events.select("event_id", "value"), "event_id").select(
        F.col("event_id").cast("string").alias("image_id"), F.when(F.col("value") > 50, F.lit(9)).alias("thumb_bytes"),
        F.lit("f").alias("filename"), F.lit("t").alias("title"), F.lit("").alias("link"), "gallery", "created_us",
        (F.col("user_id") % 5).alias("likes"), F.col("user_id").alias("width"), (2 * F.col("user_id")).alias("height"))
    shape = "url string, thumb string, gallery string, likes string, w string, h string, created_at double"
    read = O.feed_json(items).select("id", F.from_json("json", shape).alias("j")).select("id", "j.*")
    return read.withColumn("created_us", F.round(F.col("created_at") * 1_000_000).cast("bigint")).drop("created_at")


@query("b21_source_of_gallery", """
SELECT doc_id, CASE WHEN starts_with(CASE WHEN doc_id % 3 = 0 THEN 'arca_' || source ELSE source END, 'arca_') THEN 'arcalive' ELSE 'dcinside' END AS origin,
 doc_id % 3 = 0 AS shown FROM documents""")
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("arca_"), "source")).otherwise(F.col("source"))
    return t.documents.select("doc_id", source_of_gallery(name).alias("origin"), matches_source_filter(name, "arcalive").alias("shown"))


@query("b22_relative_age", """
WITH c AS (SELECT max(epoch_us(ts)) + 30000000 AS now_us FROM events),
a AS (SELECT event_id, (now_us - epoch_us(ts)) // 1000000 AS s FROM events, c)
SELECT event_id, CASE WHEN s < 60 THEN '방금' WHEN s < 3600 THEN s // 60 || '분 전' WHEN s < 86400 THEN s // 3600 || '시간 전' ELSE s // 86400 || '일 전' END AS age FROM a""")
def _(t: Tables) -> DataFrame:
    now = feed_clock(t).scalar() - 30_000_000
    return feed_events(t).select("event_id", relative_age(F.col("created_us"), now).alias("age"))
