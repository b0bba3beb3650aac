"""End to end: a fetch log to the media that go out, and arrivals to the feed that is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions.media import content_hash, item_bytes
from feedops.operators.admission import admit, split_admitted
from feedops.plans.feed import FeedLimits, feed_health, serve_feed
from feedops.plans.media import resolve_media, sendable_media
from feedops.plans.profiles import SINGLE
from registry.base import Tables, query
from registry.fetchlog import DECISION_SQL, pick
from registry.media import ADMIT_SQL, LIMITS, _hex, arrivals
from registry.selection import MEDIA_ORDER_SQL

# The feed of the admitted documents: read 100 s after the last arrival.
FEED = FeedLimits(ttl_seconds=30_000, max_items=120, max_bytes=150_000, freshness_seconds=300)
SERVED_SQL = f"""{ADMIT_SQL},
clock AS (SELECT max(t) + 100 AS now FROM d),
live AS (SELECT r.doc_id, r.t, CASE WHEN size > 6000 THEN packed ELSE size END + n AS bytes, now FROM r JOIN a ON a.hash = r.hash AND a.t = r.t, clock WHERE reason IS NULL AND r.t >= now - {FEED.ttl_seconds}),
counted AS (SELECT * FROM live ORDER BY t DESC, doc_id DESC LIMIT {FEED.max_items}),
summed AS (SELECT *, sum(bytes) OVER (ORDER BY t DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM counted),
store AS (SELECT * FROM summed WHERE running <= {FEED.max_bytes})"""


def accepted(t: Tables) -> DataFrame:
    """Arrivals that are admitted, with the memory that each takes: the compressed copy where the original is too large."""
    items, _ = split_admitted(admit(arrivals(t), LIMITS, 30_000))
    kept = F.when(F.col("size") > LIMITS.feed_image_bytes, F.col("compressed_size")).otherwise(F.col("size"))
    return items.withColumn("bytes", item_bytes(kept, F.col("thumb_size")))


def clock(t: Tables) -> Column:
    return arrivals(t).agg(F.max("created_us") + 100_000_000).scalar()


@query("plan_feed_served", f"{SERVED_SQL} SELECT doc_id, CAST(t * 1000000 AS BIGINT) AS created_us, CAST(bytes AS BIGINT) AS bytes FROM store ORDER BY t DESC, doc_id DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    return serve_feed(accepted(t), clock(t), 20, FEED).select("doc_id", "created_us", F.col("bytes").cast("bigint").alias("bytes"))


@query("plan_feed_health", f"""{SERVED_SQL},
s AS (SELECT count(doc_id) AS items, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS memory_bytes, (any_value(clock.now) - max(t)) AS age FROM clock LEFT JOIN store ON true)
SELECT items, memory_bytes, coalesce(age, 60) <= {FEED.freshness_seconds} AS fresh FROM s""")
def _(t: Tables) -> DataFrame:
    now = clock(t)
    return feed_health(accepted(t), now, now - 60_000_000, FEED).select("items", "memory_bytes", "fresh")


# A line is a medium of its order with two fall-backs; part is a log of three attempts per URL, its bytes an image header and a brand.
URL_SQL = "'https://dcimg' || {0} % 1000 || '.dcinside.com/' || {0}"
SIDE_SQL = "upper(format('{:08x}', p_size * 1000))"
MEDIA_SQL = f"""media AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) - 1 AS BIGINT) AS media_idx FROM lineitem),
cands AS (SELECT l_orderkey, media_idx, 0 AS rank, l_partkey AS part FROM media
 UNION ALL SELECT l_orderkey, media_idx, 1, l_suppkey FROM media WHERE l_suppkey <> l_partkey
 UNION ALL SELECT l_orderkey, media_idx, 2, l_partkey + 1 FROM media WHERE l_suppkey <> l_partkey + 1),
tries AS (SELECT p_partkey, attempt, [404, 429, 200, 503, NULL, 408, 200, 413, 500, 429, 502][1 + (p_partkey * 7 + attempt * 3) % 11] AS status FROM part, (SELECT unnest([1, 2, 3]) AS attempt)),
dec AS (SELECT *, {DECISION_SQL} AS decision FROM tries),
judged AS (SELECT p_partkey, min(attempt) FILTER (decision <> 'retry') AS at, arg_min(decision, attempt) FILTER (decision <> 'retry') AS decision FROM dec GROUP BY 1),
bytes AS (SELECT p_partkey, [NULL, 'png', 'gif'][1 + p_size % 3] AS ext, CASE p_size % 3 WHEN 1 THEN p_size * 1000000 <= 24000000 ELSE p_size % 3 = 2 END AS valid,
 sha256(CASE p_size % 3 WHEN 1 THEN unhex('89504E470D0A1A0A0000000D49484452000003E8' || {SIDE_SQL}) WHEN 2 THEN unhex('4749463839610A000A00') ELSE unhex('25504446') END || encode(p_brand)) AS hash FROM part),
led AS (SELECT DISTINCT 'g' || p_partkey % 2 AS gallery, hash FROM part JOIN bytes USING (p_partkey) WHERE p_partkey % 40 = 0),
tried AS (SELECT c.l_orderkey, c.media_idx, c.rank, c.part, CASE WHEN b.p_partkey IS NULL THEN 'pending' ELSE coalesce(j.decision, 'exhausted') END AS verdict,
 CASE WHEN b.p_partkey IS NULL THEN 0 ELSE coalesce(j.at, 3) END AS requests, b.ext, b.valid, b.hash FROM cands c LEFT JOIN bytes b ON b.p_partkey = c.part LEFT JOIN judged j ON j.p_partkey = c.part),
spent AS (SELECT *, sum(requests) OVER (PARTITION BY l_orderkey, media_idx ORDER BY rank) AS spent, coalesce(verdict = 'success' AND ext IS NOT NULL AND valid, false) AS usable FROM tried),
best AS (SELECT l_orderkey, media_idx, arg_min(part, rank) FILTER (usable AND spent <= 6) AS part, bool_or(spent > 6) AS over, bool_or(verdict IN ('exhausted', 'pending')) AS transient FROM spent GROUP BY 1, 2),
resolved AS (SELECT best.*, b.hash, b.ext, CASE WHEN best.part IS NOT NULL AND led.hash IS NOT NULL THEN 'duplicate' WHEN best.part IS NOT NULL THEN 'ready' WHEN over OR transient THEN 'failed' ELSE 'rejected' END AS status
 FROM best LEFT JOIN bytes b ON b.p_partkey = best.part LEFT JOIN led ON led.hash = b.hash AND led.gallery = 'g' || best.l_orderkey % 3)"""


def _url(part: Column) -> Column:
    return F.concat(F.lit("https://dcimg"), (part % 1000).cast("string"), F.lit(".dcinside.com/"), part.cast("string"))


def part_bytes(t: Tables) -> DataFrame:
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452000003E8"), _hex(F.col("p_size") * 1000, 8))
    head = F.when(F.col("p_size") % 3 == 1, png).when(F.col("p_size") % 3 == 2, F.lit("4749463839610A000A00")).otherwise("25504446")
    return t.part.select("p_partkey", F.concat(F.unhex(head), F.encode("p_brand", "UTF-8")).alias("content"))


def fetch_log(t: Tables) -> DataFrame:
    attempts = part_bytes(t).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    status = pick([404, 429, 200, 503, None, 408, 200, 413, 500, 429, 502], (F.col("p_partkey") * 7 + F.col("attempt") * 3) % 11)
    return attempts.select(_url(F.col("p_partkey")).alias("url"), "attempt", F.lit("http").alias("error_kind"), status.alias("status"), F.lit(None).cast("string").alias("declared_length"), "content")


def resolved(t: Tables) -> DataFrame:
    """Every medium judged by the log and by a ledger that holds the bytes of some parts for two galleries."""
    # Of a line only its part and supplier are used, so lines that tie in these need no further order; the rest of the page order is not read.
    placed = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(placed).alias("_rank"))
    media = lines.select(
        F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("l_orderkey") % 3).cast("string")).alias("gallery"), F.col("l_orderkey").cast("string").alias("post_id"),
        (F.col("_rank") - 1).cast("bigint").alias("media_idx"), _url(F.col("l_partkey")).alias("primary_url"), F.array(_url(F.col("l_suppkey")), _url(F.col("l_partkey") + 1)).alias("fallback_urls"),
        F.lit("medium.jpg").alias("filename_hint"), F.lit("image").alias("expected_media_type"))
    known = part_bytes(t).filter("p_partkey % 40 = 0")
    gallery = F.concat(F.lit("g"), (F.col("p_partkey") % 2).cast("string"))
    ledger = known.select(F.lit("board").alias("source"), gallery.alias("gallery_name"), F.concat(F.lit("image:"), content_hash(F.col("content"))).alias("delivery_key")).distinct()
    return resolve_media(media, fetch_log(t), ledger, SINGLE)


@query("plan_media_resolved", f"""WITH {MEDIA_SQL}
SELECT CAST(l_orderkey AS VARCHAR) AS post_id, media_idx, {URL_SQL.format('part')} AS chosen_url, hash AS content_hash, 'medium.' || ext AS filename, status FROM resolved""")
def _(t: Tables) -> DataFrame:
    return resolved(t).select("post_id", "media_idx", "chosen_url", "content_hash", "filename", "status")


@query("plan_media_sent", f"""WITH {MEDIA_SQL}
SELECT CAST(l_orderkey AS VARCHAR) AS post_id, min(media_idx) AS media_idx, hash AS content_hash FROM resolved WHERE status = 'ready' GROUP BY l_orderkey, hash""")
def _(t: Tables) -> DataFrame:
    return sendable_media(resolved(t)).select("post_id", "media_idx", "content_hash")
