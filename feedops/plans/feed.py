"""Arrivals to the served feed and its health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from feedops.functions.media import MIB
from feedops.operators.feed import health, store_stats
from feedops.operators.select import newest_feed, recent_store


@dataclass(frozen=True)
class FeedLimits:
    """Fixed default limits of the served feed."""

    ttl_seconds: int = 10_800
    max_items: int = 120
    max_bytes: int = 256 * MIB
    freshness_seconds: int = 900


def serve_feed(accepted: DataFrame, now_us: Column, limit: int = 60, limits: FeedLimits = FeedLimits()) -> DataFrame:
    live = recent_store(accepted, now_us, limits.ttl_seconds, limits.max_items, limits.max_bytes)
    return newest_feed(live, limit)


def feed_health(accepted: DataFrame, now_us: Column, started_us: Column, limits: FeedLimits = FeedLimits()) -> DataFrame:
    live = recent_store(accepted, now_us, limits.ttl_seconds, limits.max_items, limits.max_bytes)
    return health(store_stats(live, now_us, started_us, limits.max_bytes), limits.freshness_seconds)
