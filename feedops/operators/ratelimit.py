"""Per-key rate limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.operators.anchors import with_anchor
from feedops.operators.select import top_k
from feedops.session import pinned

# Likes and feed reads per client in a window of this many seconds.
WINDOW_SECONDS = 60
LIKES_MAX = 30
FEED_MAX = 120


def rate_limit(events: DataFrame, keys: Sequence[str], time_us: str, seq: str, window_seconds: int = WINDOW_SECONDS,
               max_count: int = LIKES_MAX, **sizes: int) -> DataFrame:
    """G1: add ``anchor`` (window start) and ``limited``. Every request counts, rejected ones too.

    A request is limited when more than ``max_count`` requests of its window are not later than itself. Only the
    ``max_count``-th row of a window is looked up (a per-partition top-k), never the rank of every row.
    """
    keys = list(keys)
    placed = with_anchor(events, keys, time_us, window_seconds * 1_000_000, **sizes)
    if max_count <= 0:
        return placed.withColumn("limited", F.lit(True))
    last_allowed = top_k(placed.select(*keys, "anchor", time_us, seq), [*keys, "anchor"],
                         [F.col(time_us), F.col(seq)], max_count).filter(F.col("_rank") == max_count)
    last_allowed = last_allowed.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("anchor").alias("_anchor"), F.struct(time_us, seq).alias("_last")
    )
    match = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(last_allowed[f"_{k}"]) for k in keys])
    joined = placed.join(last_allowed, match & (placed["anchor"] == last_allowed["_anchor"]), "left_outer")
    limited = F.coalesce(F.struct(placed[time_us], placed[seq]) > last_allowed["_last"], F.lit(False))
    return joined.select(*[placed[c] for c in placed.columns], limited.alias("limited"))


def accept_likes(likes: DataFrame, items: DataFrame, client: str, item: str, time_us: str, seq: str,
                 window_seconds: int = WINDOW_SECONDS, max_count: int = LIKES_MAX, item_key: str = "image_id",
                 **sizes: int) -> DataFrame:
    """Add ``status``: limited, repeated, not_found or accepted.

    A like for a missing item still uses up its (client, item) pair: the first touch is decided before the lookup. The rate limit is computed once; the first
    allowed like of every pair is a minimum that combines before the shuffle, and its item is looked up once a pair.
    """
    judged = pinned(rate_limit(likes, [client], time_us, seq, window_seconds, max_count, **sizes).drop("anchor"))
    allowed = F.when(~F.col("limited"), F.struct(time_us, seq))
    pairs = judged.groupBy(F.col(client).alias("_client"), F.col(item).alias("_item")).agg(F.min(allowed).alias("_first"))
    known = items.select(F.col(item_key).alias("_known")).distinct()
    pairs = pairs.join(known, F.col("_item") == F.col("_known"), "left_outer")
    same = judged[client].eqNullSafe(pairs["_client"]) & judged[item].eqNullSafe(pairs["_item"])
    status = (F.when(judged["limited"], F.lit("limited")).when(F.col("_known").isNull(), F.lit("not_found"))
              .when(judged[seq] == F.col(f"_first.{seq}"), F.lit("accepted")).otherwise("repeated"))
    return judged.join(pairs, same).select(*[judged[c] for c in likes.columns], status.alias("status"))
