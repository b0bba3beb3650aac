"""Streaming jobs (K1-K7, A7): micro-batches that re-use the batch operators.

Every ``foreachBatch`` body is idempotent for its batch id: it overwrites a folder named after the batch, or appends only
keys that are not there yet. A replay after a lost driver therefore repeats work, never results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedops.operators.ledger import ledger_add
from feedops.operators.scanlog import drop_internal_requests, scan_events
from feedops.operators.select import recent_store
from feedops.plans.profiles import SourceProfile
from feedops.plans.selection import select_new_posts
from feedops.session import pinned
from feedops.sources.tables import MESSAGE_BATCH, SCAN_TIME_FORMAT, append_ledger, ledger_of, new_outbox_rows, read_ledger
from feedops.streaming.state import dedup_schema, dedup_step, limit_schema, limit_step, new_pairs, previous_version, write_version


def run_batches(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None],
                every: str | None = None) -> StreamingQuery:
    """Start ``body`` on every micro-batch; without an interval, process what is there and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(body)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_new_posts(listing_rows: DataFrame, spark: SparkSession, ledger_path: str, out_path: str, checkpoint: str, profile: SourceProfile,
                     every: str | None = None, expected: str | None = None, buffer_path: str | None = None, wait_seconds: int = 3_600) -> StreamingQuery:
    """K1: unseen posts of every poll. The ledger is read per batch, so acknowledgements made meanwhile count.

    The hold-back counts within a crawl, so a crawl is judged when all of it is there: ``expected`` names the column in which the crawler notes how many rows
    the crawl has. Rows of unfinished crawls wait in ``buffer_path``. One whose rest never comes is released when rows crawled ``wait_seconds`` later (by
    ``crawl_us``, where the rows have it) arrive. Without ``expected`` every batch must hold whole crawls.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        ready = batch
        if expected is not None:
            path = buffer_path or f"{checkpoint}-buffer"
            rows = pinned(batch.unionByName(previous_version(spark, path, batch_id, batch.schema)))
            ready, waiting = finished_crawls(rows, profile, expected, wait_seconds)
            write_version(waiting, path, batch_id)
        posts = select_new_posts(ready, ledger_of(read_ledger(spark, ledger_path), ready), profile)
        posts.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return run_batches(listing_rows, checkpoint, body, every)


def finished_crawls(rows: DataFrame, profile: SourceProfile, expected: str, wait_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows of crawls that are complete or have waited too long, rows of the others)."""
    by = list(profile.listing)
    late = F.lit(False)
    newest = F.lit(None).cast("bigint")
    if "crawl_us" in rows.columns:
        newest = F.max("crawl_us")
        late = F.coalesce(F.col("_newest") < rows.agg(F.max("crawl_us")).scalar() - F.lit(wait_seconds * 1_000_000), F.lit(False))
    crawls = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_rows"), F.max(expected).alias("_expected"), newest.alias("_newest"))
    done = crawls.filter(F.coalesce(F.col("_rows") >= F.col("_expected"), F.lit(False)) | late)
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(done[f"_{c}"]) for c in by])
    return rows.join(done, same, "left_semi"), rows.join(done, same, "left_anti")


def stream_acknowledge(ledger_rows: DataFrame, spark: SparkSession, ledger_path: str, checkpoint: str,
                       every: str | None = None) -> StreamingQuery:
    """K7: write the ledger only from acknowledged rows. A crash before this step leads to a redelivery, and a replayed
    batch finds its keys present and appends nothing."""

    def body(batch: DataFrame, batch_id: int) -> None:
        known = ledger_of(read_ledger(spark, ledger_path), batch, "gallery_name")
        append_ledger(ledger_add(known, batch), ledger_path)

    return run_batches(ledger_rows, checkpoint, body, every)


def stream_recent_store(arrivals: DataFrame, spark: SparkSession, store_path: str, checkpoint: str, *, ttl_seconds: int,
                        max_items: int, max_bytes: int, every: str | None = None, ticks: DataFrame | None = None) -> StreamingQuery:
    """K4: the bounded feed after every batch, as ``store_path/batch=N``. ``now`` is the newest arrival or tick seen.

    ``ticks`` is a stream with a column ``now_us`` (``clock_ticks``): it lets items expire while nothing arrives. Only the previous snapshot (at most
    ``max_items`` rows) and the batch are read.
    """
    items = arrivals.columns
    if ticks is not None:
        arrivals = arrivals.unionByName(ticks.select("now_us"), allowMissingColumns=True)

    def body(batch: DataFrame, batch_id: int) -> None:
        came = batch.select(*items)
        if ticks is not None:
            came = came.filter(F.col("created_us").isNotNull())
        everything = came.unionByName(previous_version(spark, store_path, batch_id, came.schema))
        now = everything.agg(F.max("created_us")).scalar()
        if ticks is not None:
            now = F.greatest(now, batch.agg(F.max("now_us")).scalar())
        kept = recent_store(everything, now, ttl_seconds, max_items, max_bytes)
        kept.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    return run_batches(arrivals, checkpoint, body, every)


def clock_ticks(spark: SparkSession) -> DataFrame:
    """A stream of the time, one row a second, for jobs that act while nothing arrives."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.unix_micros("timestamp").alias("now_us"))


def stream_rate_limit(events: DataFrame, spark: SparkSession, out_path: str, checkpoint: str, key: str, window_seconds: int, max_count: int,
                      every: str | None = None, state_path: str | None = None) -> StreamingQuery:
    """K2: rows with ``id``, ``t_us`` (epoch microseconds) and the key, plus ``anchor`` and ``limited``, as ``out_path/batch=N``."""
    path = state_path or f"{checkpoint}-state"

    def body(batch: DataFrame, batch_id: int) -> None:
        answers, state = limit_step(batch, previous_version(spark, path, batch_id, limit_schema(batch, key)), key, window_seconds, max_count)
        answers.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        write_version(state, path, batch_id)

    return run_batches(events, checkpoint, body, every)


def stream_dedup(events: DataFrame, spark: SparkSession, out_path: str, checkpoint: str, key: str, gap_seconds: int = 300,
                 every: str | None = None, state_path: str | None = None) -> StreamingQuery:
    """K3: rows accepted by the anchored rule, as ``out_path/batch=N``."""
    path = state_path or f"{checkpoint}-state"

    def body(batch: DataFrame, batch_id: int) -> None:
        accepted, state = dedup_step(batch, previous_version(spark, path, batch_id, dedup_schema(batch, key)), key, gap_seconds)
        accepted.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        write_version(state, path, batch_id)

    return run_batches(events, checkpoint, body, every)


def stream_like_counts(likes: DataFrame, spark: SparkSession, out_path: str, checkpoint: str, client: str, item: str, window_seconds: int,
                       max_count: int, every: str | None = None, state_path: str | None = None, pairs_path: str | None = None) -> StreamingQuery:
    """K5: like counts of every batch as ``out_path/batch=N``; an item's total is the sum over batches.

    The rate limit's state is bounded by the open windows. That a pair counts once for all time is decided by a join with the pairs counted so far, a table in
    ``pairs_path`` with one folder per batch; a replayed batch leaves its own folder out and writes it again.
    """
    state, pairs = state_path or f"{checkpoint}-state", pairs_path or f"{checkpoint}-pairs"

    def body(batch: DataFrame, batch_id: int) -> None:
        slim = batch.select("id", "t_us", client, item)
        judged, after = limit_step(slim, previous_version(spark, state, batch_id, limit_schema(slim, client)), client, window_seconds, max_count)
        schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (client, item))
        stored = spark.createDataFrame([], schema)
        if batch_id > 0:
            stored = spark.read.schema(f"{schema}, batch bigint").parquet(pairs).filter(F.col("batch") < batch_id).drop("batch")
        fresh = pinned(new_pairs(judged, stored, client, item))
        fresh.write.mode("overwrite").parquet(f"{pairs}/batch={batch_id}")
        fresh.groupBy(item).agg(F.count(F.lit(1)).alias("likes")).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        write_version(after, state, batch_id)

    return run_batches(likes, checkpoint, body, every)


def stream_outbox(messages: DataFrame, spark: SparkSession, outbox_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Messages to send, one folder ``outbox_path/batch=N`` per batch; a message that an earlier batch holds does not go out again.

    Its identity holds its media, so after a partial delivery the message with what is missing is a new one. Only the keys and posts of earlier batches are read; a
    replayed batch leaves its own folder out and writes it again.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        schema = ", ".join(f"{c} {batch.schema[c].dataType.simpleString()}" for c in MESSAGE_BATCH)
        sent = spark.createDataFrame([], f"{schema}, message_key string")
        if batch_id > 0:
            sent = spark.read.schema(f"{schema}, message_key string, batch bigint").parquet(outbox_path).filter(F.col("batch") < batch_id)
        fresh = new_outbox_rows(batch, sent, gather=True)  # zstd: it halves the hex digits of keys, which snappy leaves
        fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{outbox_path}/batch={batch_id}")

    return run_batches(messages, checkpoint, body, every)


def stream_scan_events(log: DataFrame, out_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """K6: stateless classification, appended as JSON lines."""
    writer = scan_events(drop_internal_requests(log)).writeStream.format("json").option("path", out_path)
    writer = writer.option("timestampFormat", SCAN_TIME_FORMAT).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
