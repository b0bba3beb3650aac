"""Exact keyed state on streams (K2, K3, K5): rate limits, anchored duplicate suppression and like counts.

Every micro-batch is handled by the batch operators, so a client that sends a third of all rows is as little a problem as there. What they need of earlier batches
is a small table, written as one version per batch and read by the next: the counted requests of windows that are still open, or the rows accepted less than a gap
ago. A window that has passed falls out with the next batch, so the state is bounded by what is open, not by the number of clients ever seen.

Time is that of the rows. A row that arrives after its key's open window has begun but is older counts as arriving when that window began; within a batch, rows
are ordered by (time, id). A replayed batch reads the version before it again and writes the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.operators.dedup import dedup_anchored
from feedops.operators.ratelimit import rate_limit
from feedops.session import pinned

MICROS = 1_000_000


def previous_version(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What the batch before left behind; nothing for the first one."""
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}") if batch_id > 0 else spark.createDataFrame([], schema)


def write_version(state: DataFrame, path: str, batch_id: int) -> None:
    """Write this batch's version; the one before stays for a replay, older ones go."""
    state.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    if batch_id >= 2:
        spark = state.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _with_before(batch: DataFrame, before: DataFrame, key: str, opened: str) -> DataFrame:
    """Rows of the batch and of the state, in order of ``_order`` at equal times ``_t``: what was there before comes first."""
    known = before.groupBy(F.col(key).alias("_key")).agg(F.max(opened).alias("_open"))
    fresh = batch.join(known, batch[key].eqNullSafe(known["_key"]), "left")
    fresh = fresh.select(*[batch[c] for c in batch.columns], F.greatest("t_us", "_open").alias("_t"), F.lit(1).alias("_new"))
    rows = fresh.unionByName(before.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return pinned(rows.withColumn("_order", F.struct("_new", "id")))


def limit_schema(batch: DataFrame, key: str) -> str:
    return f"id {batch.schema['id'].dataType.simpleString()}, `{key}` {batch.schema[key].dataType.simpleString()}, _t bigint, anchor bigint"


def dedup_schema(batch: DataFrame, key: str) -> str:
    return f"id {batch.schema['id'].dataType.simpleString()}, `{key}` {batch.schema[key].dataType.simpleString()}, _t bigint"


def limit_step(batch: DataFrame, before: DataFrame, key: str, window_seconds: int, max_count: int, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """K2, one batch: (its rows with ``anchor`` and ``limited``, the state after it).

    The state holds at most ``max_count`` rows per key, those that count in a window still open: later rows are limited or not by them alone.
    """
    rows = _with_before(batch, before, key, "anchor").drop("anchor")
    judged = pinned(rate_limit(rows, [key], "_t", "_order", window_seconds, max_count, **sizes))
    open_since = judged.agg(F.max("_t")).scalar() - F.lit(window_seconds * MICROS)
    # A window whose requests are all limited still has to stay open, so its first row is kept in any case.
    counts = ~F.col("limited") | (F.col("_t") == F.col("anchor"))
    state = judged.filter(counts & (F.col("anchor") >= open_since)).select("id", key, "_t", "anchor")
    return judged.filter("_new = 1").select(*batch.columns, "anchor", "limited"), state


def dedup_step(batch: DataFrame, before: DataFrame, key: str, gap_seconds: int, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """K3, one batch: (its accepted rows, the state after it: at most one row per key, accepted less than a gap ago)."""
    rows = _with_before(batch, before, key, "_t")
    accepted = pinned(dedup_anchored(rows, [key], "_t", "_order", gap_seconds, **sizes))
    open_since = rows.agg(F.max("_t")).scalar() - F.lit(gap_seconds * MICROS)
    return accepted.filter("_new = 1").select(*batch.columns), accepted.filter(F.col("_t") > open_since).select("id", key, "_t")


def new_pairs(judged: DataFrame, stored: DataFrame, client: str, item: str) -> DataFrame:
    """K5, one batch: (client, item) pairs of allowed likes that no earlier batch has counted. Repeats within the batch combine before the shuffle."""
    pairs = judged.filter(~F.col("limited")).select(client, item).distinct()
    return pairs.join(stored, pairs[client].eqNullSafe(stored[client]) & pairs[item].eqNullSafe(stored[item]), "left_anti")


def stream_dedup_builtin(events: DataFrame, key: str, gap_seconds: int = 300) -> DataFrame:
    """K3, approximate: all in the built-in state store, but a key is released by the watermark, so late watermarks suppress for longer."""
    timed = events.withColumn("_at", F.timestamp_micros("t_us")).withWatermark("_at", f"{gap_seconds} seconds")
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")
