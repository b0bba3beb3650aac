"""Selection, ranking and limits.

``row_number() <= k`` filters are pushed below the shuffle by the planner as per-partition top-k, so a listing that holds a
third of all rows still sends at most k rows per map task. The complement ("all but the first n") has no such form: it is
computed from the n-th row's position instead of ranking the whole listing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank") -> DataFrame:
    """First ``k`` rows of every group, with their 1-based rank."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_by_position(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every group."""
    return top_k(rows, by, [F.col(c) for c in order], 1).drop("_rank")


def moderation_holdback(rows: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the first ``n`` rows of every listing; ``order`` must be unique within a listing and not null."""
    if n <= 0:
        return rows
    last_held = top_k(rows, by, [F.col(c) for c in order], n).filter(F.col("_rank") == n).select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.struct(*order).alias("_held_to")
    )
    same_listing = F.lit(True)
    for c in by:
        same_listing = same_listing & rows[c].eqNullSafe(last_held[f"_by_{c}"])
    beyond = F.struct(*[rows[c] for c in order]) > last_held["_held_to"]
    return rows.join(last_held, same_listing & beyond, "inner").select(*[rows[c] for c in rows.columns])


def next_unseen(rows: DataFrame, k: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``k`` remaining posts of every listing."""
    return top_k(rows, by, [F.col(c) for c in order], k).drop("_rank")


def cap_media_per_post(media: DataFrame, by: Sequence[str], order: Sequence[str], cap: int = 4) -> DataFrame:
    """First ``cap`` media of a post in page order, with their 0-based index ``media_idx``."""
    return top_k(media, by, [F.col(c) for c in order], cap).withColumn("media_idx", F.col("_rank") - 1).drop("_rank")


def number_media(media: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All media of a post with their 0-based index ``media_idx`` in page order; a post's media come from one page.

    The window sorts by the post first: keys are taken from the last, which tells most rows apart.
    """
    return media.withColumn("media_idx", F.row_number().over(Window.partitionBy(*reversed(by)).orderBy(*order)) - 1)


def assign_batches(media: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 10, cap: int | None = None) -> DataFrame:
    """C4: message batches of a post's media: ``media_idx``, ``batch_idx`` and the batch's ``start_index``.

    All media are kept, unless a ``cap`` per post is asked for (C3).
    """
    numbered = number_media(media, by, order) if cap is None else cap_media_per_post(media, by, order, cap)
    batch = F.floor(F.col("media_idx") / size)
    return numbered.withColumn("batch_idx", batch).withColumn("start_index", batch * size)


def newest_feed(items: DataFrame, limit: int = 60, created: str = "created_us", seq: str = "seq") -> DataFrame:
    """Newest items first; planned as a distributed top-k."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    return items.orderBy(F.col(created).desc(), F.col(seq).desc()).limit(limit)


def recent_store(items: DataFrame, now_us: Column, ttl_seconds: int, max_items: int, max_bytes: int,
                 created: str = "created_us", seq: str = "seq", size: str = "bytes") -> DataFrame:
    """What a feed bounded by age, count and bytes holds at ``now``.

    Arrival-by-arrival eviction equals the longest newest-first run within all three bounds. The running sum sees at most
    ``max_items`` rows, so its single partition is bounded by that parameter.
    """
    if min(ttl_seconds, max_items, max_bytes) <= 0:
        raise ValueError("feed limits must be positive")
    newest = [F.col(created).desc(), F.col(seq).desc()]
    live = items.filter(F.col(created) >= now_us - F.lit(ttl_seconds * 1_000_000))
    newest_items = live.orderBy(*newest).limit(max_items)
    running = F.sum(size).over(Window.orderBy(*newest).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest_items.withColumn("_running", running).filter(F.col("_running") <= max_bytes).drop("_running")


def downsample_frames(frames: DataFrame, media: str = "media_id", index: str = "frame_idx", duration: str = "duration",
                      max_frames: int = 20, default_duration: int = 100) -> DataFrame:
    """Keep every step-th frame; it takes over the durations of the frames skipped after it."""
    counts = frames.groupBy(media).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(media, "_media")
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_frames))
    stepped = frames.join(counts, frames[media] == counts["_media"], "inner").withColumn("_step", step)
    kept = F.floor(F.col(index) / F.col("_step")) * F.col("_step")
    return stepped.groupBy(media, kept.alias(index)).agg(
        F.sum(F.coalesce(F.col(duration), F.lit(default_duration))).cast("bigint").alias(duration)
    )
