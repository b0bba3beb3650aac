"""De-duplication (F2-F8): within a post, in anchored time windows, and by first or last touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions.urls import without_query
from feedops.operators.anchors import anchors
from feedops.operators.select import first_by_position


def dedup_within_post(media: DataFrame, post: Sequence[str], content_hash: str, order: Sequence[str]) -> DataFrame:
    """first medium of every content hash within a post; media without content are skipped."""
    return first_by_position(media.filter(F.col(content_hash).isNotNull()), [*post, content_hash], order)


def dedup_urls_within_post(media: DataFrame, post: Sequence[str], url: str, order: Sequence[str]) -> DataFrame:
    """first medium per primary URL, ignoring query and fragment."""
    keyed = media.withColumn("_url_key", without_query(F.col(url)))
    return first_by_position(keyed, [*post, "_url_key"], order).drop("_url_key")


def dedup_anchored(items: DataFrame, keys: Sequence[str], time_us: str, seq: str, gap_seconds: int = 300,
                   **sizes: int) -> DataFrame:
    """accept a key, then suppress it while less than ``gap`` has passed since the accepted row."""
    keys = list(keys)
    found = anchors(items, keys, time_us, gap_seconds * 1_000_000, closed=True, **sizes)
    at_anchor = F.lit(True)
    for k in keys:
        at_anchor = at_anchor & items[k].eqNullSafe(found[k])
    candidates = items.join(found, at_anchor & (items[time_us] == found["anchor"]), "left_semi")
    return first_by_position(candidates, [*keys, time_us], [seq])


def flag_anchored(items: DataFrame, keys: Sequence[str], time_us: str, seq: str, gap_seconds: int = 300,
                  **sizes: int) -> DataFrame:
    """F5 as a column: ``accepted`` on every row; ``seq`` must be unique."""
    accepted = dedup_anchored(items, keys, time_us, seq, gap_seconds, **sizes).select(F.col(seq).alias("_seq"))
    joined = items.join(accepted, items[seq] == accepted["_seq"], "left_outer")
    return joined.withColumn("accepted", F.col("_seq").isNotNull()).drop("_seq")


def recent_keys(touches: DataFrame, key: str, time: str, n: int, seq: str | None = None) -> DataFrame:
    """the ``n`` keys touched last; ``seq`` orders touches at the same time."""
    latest = F.max(F.struct(*[c for c in (time, seq) if c is not None])).alias("_latest")
    return touches.groupBy(key).agg(latest).orderBy(F.col("_latest").desc(), key).limit(n).select(key, f"_latest.{time}")


def first_touch(events: DataFrame, keys: Sequence[str], time: str, seq: str) -> DataFrame:
    """``first`` is true on the earliest row of every key; ``seq`` must be unique.

    The earliest row is found by a partial-aggregating minimum and matched back by its own id, so a key that holds a large
    share of the rows is never gathered in one task.
    """
    earliest = events.groupBy(*keys).agg(F.min(F.struct(time, seq)).alias("_first")).select(F.col(f"_first.{seq}").alias("_seq"))
    joined = events.join(earliest, events[seq] == earliest["_seq"], "left_outer")
    return joined.withColumn("first", F.col("_seq").isNotNull()).drop("_seq")


def distinct_urls(urls: Column) -> Column:
    """F8: first occurrence wins, order kept."""
    return F.array_distinct(urls)


def sorted_keys(keys: Column) -> Column:
    """F8: query keys sorted and distinct."""
    return F.array_sort(F.array_distinct(keys))
