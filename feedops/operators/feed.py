"""Recent feed: projections, likes, diffs, statistics and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions.media import MIB
from feedops.session import pinned


def feed_items(items: DataFrame) -> DataFrame:
    """Public fields of feed items; ``created_us`` becomes float epoch seconds."""
    url = F.concat(F.lit("/images/"), F.col("image_id"))
    thumb = F.when(F.coalesce(F.col("thumb_bytes"), F.lit(0)) > 0, F.concat(url, F.lit("?thumbnail=1"))).otherwise(url)
    return items.select(
        F.col("image_id").alias("id"), url.alias("url"), thumb.alias("thumb"), "filename", "title", "link", "gallery",
        (F.col("created_us") / 1_000_000).alias("created_at"), "likes", F.col("width").alias("w"), F.col("height").alias("h"),
    )


def feed_json(items: DataFrame) -> DataFrame:
    """One JSON object per feed item."""
    shown = feed_items(items)
    return shown.select("id", F.to_json(F.struct(*shown.columns)).alias("json"))


def lookup_item(live: DataFrame, image_id: str, thumbnail: bool = False) -> DataFrame:
    """Content of one live item; no row means not found."""
    found = live.filter(F.col("image_id") == image_id)
    return found.select("image_id", _content(thumbnail).alias("content"))


def lookup_items(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """D10 for a table of requests (image_id, thumbnail); content is NULL where the item is gone."""
    joined = wanted.join(live.withColumnRenamed("image_id", "_live_id"), F.col("image_id") == F.col("_live_id"), "left_outer")
    content = F.when(F.col("thumbnail"), _content(True)).otherwise(_content(False))
    return joined.select(*[wanted[c] for c in wanted.columns], content.alias("content"))


def _content(thumbnail: bool) -> Column:
    return F.coalesce(F.col("thumb_ref"), F.col("data_ref")) if thumbnail else F.col("data_ref")


def likes_for_items(likes: DataFrame, live: DataFrame, item: str = "image_id") -> DataFrame:
    """Likes with ``found``: is the item still in the feed?"""
    known = live.select(F.col("image_id").alias("_known")).distinct()
    joined = likes.join(known, likes[item] == known["_known"], "left_outer")
    return joined.select(*[likes[c] for c in likes.columns], F.col("_known").isNotNull().alias("found"))


def like_counts(accepted: DataFrame, item: str = "image_id", client: str = "client_ip", approximate: bool = False) -> DataFrame:
    """Distinct clients per item among accepted likes."""
    counted = F.approx_count_distinct(client) if approximate else F.count_distinct(client)
    return accepted.groupBy(item).agg(counted.alias("likes"))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "image_id") -> DataFrame:
    """Removed / fresh / kept items; kept likes never go down. Order fresh rows by the feed's own columns."""
    before = previous.select(F.col(key).alias("_old_key"), F.col("likes").alias("_old_likes"))
    now = current.select(F.col(key).alias("_new_key"), F.col("likes").alias("_new_likes"))
    joined = before.join(now, F.col("_old_key") == F.col("_new_key"), "full_outer")
    status = (
        F.when(F.col("_new_key").isNull(), F.lit("removed")).when(F.col("_old_key").isNull(), F.lit("fresh")).otherwise("kept")
    )
    return joined.select(
        F.coalesce("_new_key", "_old_key").alias(key), status.alias("status"),
        F.when(F.col("_new_key").isNotNull(), F.greatest("_old_likes", "_new_likes")).alias("likes"),
    )


def with_position(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based place of every row in the given order, without one sorted task: ranges of the order, then the counts of the ranges before."""
    ranged = pinned(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per range; the window sees as many rows as there are ranges.
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_place", "_before")


def snapshot_changes(previous: DataFrame, current: DataFrame, order: Sequence[str], key: str = "image_id") -> DataFrame:
    """D8 with ``position``: the place of each fresh item among the fresh ones in feed order (``order``, newest first), NULL for others."""
    changes = snapshot_diff(previous, current, key)
    fresh = changes.filter("status = 'fresh'").join(current.select(key, *order), key)
    placed = with_position(fresh, [*[F.col(c).desc() for c in order], F.col(key).desc()]).drop(*order)
    return placed.unionByName(changes.filter("status <> 'fresh'").withColumn("position", F.lit(None).cast("bigint")))


def store_stats(live: DataFrame, now_us: Column, started_us: Column, max_bytes: int) -> DataFrame:
    """E5: one row about the feed's contents; latest and age are NULL when it is empty."""
    totals = live.agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("memory_bytes"),
        F.max("created_us").alias("latest_created_us"),
    )
    return totals.select(
        "items", "memory_bytes", F.lit(max_bytes).cast("bigint").alias("memory_limit_bytes"), "latest_created_us",
        F.bround((now_us - F.col("latest_created_us")) / 1_000_000, 1).alias("latest_age_seconds"),
        F.bround((now_us - started_us) / 1_000_000, 1).alias("uptime_seconds"),
    )


def health(stats: DataFrame, freshness_seconds: int = 900) -> DataFrame:
    """An empty feed is fresh only during the start-up grace period."""
    age = F.coalesce("latest_age_seconds", "uptime_seconds")
    return stats.withColumn("fresh", age <= freshness_seconds)


def capacity(stats: DataFrame, max_items: int, ttl_seconds: int, up: Column | bool = True) -> DataFrame:
    """Utilisation and a state label; ``stats`` carries ``fresh``."""
    alive = up if isinstance(up, Column) else F.lit(up)
    state = (
        F.when(~alive, F.lit("down"))
        .when(F.col("fresh"), F.lit("ok"))
        .when(F.col("latest_age_seconds").isNull(), F.lit("late_nothing_collected"))
        .otherwise("late")
    )
    return stats.select(
        "items", F.lit(max_items).alias("max_items"),
        F.bround(F.col("memory_bytes") / MIB, 1).alias("used_mb"),
        F.bround(F.col("memory_limit_bytes") / MIB, 0).alias("limit_mb"),
        F.lit(round(ttl_seconds / 3600, 1)).alias("ttl_hours"), state.alias("state"),
    )
