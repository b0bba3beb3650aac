"""Feed admission (I7): the first failing rule of every arriving item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.media import MediaLimits, admission_reason
from feedops.operators.dedup import dedup_anchored
from feedops.session import pinned


def admit(items: DataFrame, limits: MediaLimits = MediaLimits(), gap_seconds: int = 300, **sizes: int) -> DataFrame:
    """Add ``reason`` (NULL = accepted). Only items that pass the content rules take part in duplicate suppression.

    Columns: seq (unique), created_us, content_hash, declared_length, size, ext, width, height, animated, compressed_size,
    thumb_size. Items are judged and hashed once: what was found is written down, so leave contents out of ``items``.
    """
    reason = admission_reason(
        F.col("declared_length"), F.col("size"), F.col("ext"), F.col("width"), F.col("height"), F.col("animated"),
        F.col("compressed_size"), F.lit(False), F.col("thumb_size"), limits,
    )
    judged = pinned(items.withColumn("reason", reason))
    passed = judged.filter(F.col("reason").isNull())
    accepted = dedup_anchored(passed, ["content_hash"], "created_us", "seq", gap_seconds, **sizes)
    accepted = accepted.select(F.col("seq").alias("_seq"))
    joined = judged.join(accepted, judged["seq"] == accepted["_seq"], "left_outer")
    repeated = judged["reason"].isNull() & F.col("_seq").isNull()
    return joined.select(*[judged[c] for c in items.columns],
                         F.when(repeated, F.lit("duplicate")).otherwise(judged["reason"]).alias("reason"))


def split_admitted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine with reason)."""
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())
