"""Fan-out, delivery outcomes and acknowledgement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions.labels import display_link, display_title, footer

POST = ("source", "gallery", "post_id")
# Settings tables up to so many rows are sent to every executor.
BROADCAST_ROWS = 50_000
# Transports, outcomes and reasons.
DISCORD, TELEGRAM, WEB = "discord", "telegram", "web_gallery"
SUCCEEDED, FAILED, PARTIAL, SKIPPED, QUEUED = "succeeded", "failed", "partial", "skipped", "queued"


def attach_gallery_config(posts: DataFrame, config: DataFrame) -> DataFrame:
    """D3: add base_url, channel_ids and the configured type; posts of unknown galleries drop out.

    The config has one row per gallery and is counted: a join by gallery would gather a busy gallery's posts in one task.
    """
    wanted = config.select("gallery", "base_url", "channel_ids", F.col("source").alias("config_source"))
    return posts.join(counted_broadcast(wanted), "gallery", "inner")


def counted_broadcast(few: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``few``, to be sent to every executor if it has at most ``most`` rows; the count is a job of its own. Else the planner joins as it sees fit."""
    return F.broadcast(few) if few.count() <= most else few


def delivery_outcome(requested: Column, delivered: Column) -> Column:
    """E1."""
    return (
        F.when((F.size(requested) == F.size(delivered)) & (F.size(requested) > 0), F.lit(SUCCEEDED))
        .when(F.size(delivered) > 0, F.lit(PARTIAL))
        .otherwise(FAILED)
    )


def delivery_reason(outcome: Column) -> Column:
    """E1."""
    return F.when(outcome != SUCCEEDED, F.lit("send_failed"))


def batch_requests(media: DataFrame, post: Sequence[str] = POST, media_id: str = "media_id") -> DataFrame:
    """One row per message batch with its media ids in order (a batch holds a bounded number of media)."""
    # Media that come numbered by post are nearly in this order; collecting by an aggregate would sort them twice.
    batch = Window.partitionBy(*reversed(post), "batch_idx").orderBy("media_idx", media_id)
    whole = batch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    collected = media.select(*post, "batch_idx", "channel_ids", F.row_number().over(batch).alias("_place"),
                             F.collect_list(F.struct(F.col(media_id).cast("string").alias("_id"))).over(whole).alias("_media"))
    return collected.filter("_place = 1").select(*post, "batch_idx", "channel_ids", F.col("_media._id").alias("requested_media"))


def fan_out(media: DataFrame, *, telegram: bool = False, telegram_chat: str = "", web_always: bool = False,
            post: Sequence[str] = POST, media_id: str = "media_id") -> DataFrame:
    """One row per message to send: batch x channel, plus per-medium rows of the other transports.

    ``media`` carries ``batch_idx``, ``media_idx`` and the gallery's ``channel_ids``. All messages of a batch are generated
    from the batch's own row, so media are grouped once whatever the number of transports.
    """
    def message(transport: str, destination: Column, requested: Column, eligible: bool) -> Column:
        return F.struct(F.lit(transport).alias("transport"), destination.alias("destination_id"),
                        requested.alias("requested_media"), F.lit(eligible).alias("ack_eligible"))

    to_send = [F.transform("channel_ids", lambda c: message(DISCORD, c, F.col("requested_media"), True))]
    if telegram:
        to_send.append(F.transform("requested_media", lambda m: message(TELEGRAM, F.lit(telegram_chat), F.array(m), True)))
    if web_always:
        to_send.append(F.transform("requested_media", lambda m: message(WEB, F.col("gallery"), F.array(m), False)))
    batches = batch_requests(media, post, media_id)
    return batches.select(*post, "batch_idx", F.explode(F.concat(*to_send)).alias("_m")).select(*post, "batch_idx", "_m.*")


def web_requests(media: DataFrame, post: Sequence[str] = POST, media_id: str = "media_id") -> DataFrame:
    """Feed rows, one per medium; they never count towards acknowledgement."""
    return (
        media.withColumn("requested_media", F.array(F.col(media_id).cast("string")))
        .withColumn("transport", F.lit(WEB)).withColumn("destination_id", F.col("gallery"))
        .withColumn("ack_eligible", F.lit(False))
    )


def delivered_pairs(deliveries: DataFrame, by: Sequence[str] = POST) -> DataFrame:
    """Distinct delivered media ids as rows (never one array per post, which could grow without bound)."""
    return (
        deliveries.filter(F.col("transport") == DISCORD)
        .select(*by, F.explode("delivered_media").alias("media_id"))
        .distinct()
    )


def web_rows_for_delivered(media: DataFrame, deliveries: DataFrame, post: Sequence[str] = POST,
                           media_id: str = "media_id") -> DataFrame:
    """D4, multi profile: all media of an acknowledged batch, otherwise only the delivered ones."""
    batch = [*post, "batch_idx"]
    acked = acknowledged(deliveries, batch).filter("acknowledged").drop("acknowledged").withColumn("_acked", F.lit(True))
    done = delivered_pairs(deliveries, batch).select(*batch, F.col("media_id").alias(media_id)).withColumn("_done", F.lit(True))
    marked = media.withColumn(media_id, F.col(media_id).cast("string")).join(acked, batch, "left_outer")
    kept = marked.join(done, [*batch, media_id], "left_outer").filter(F.coalesce(F.col("_acked"), F.col("_done"), F.lit(False)))
    return web_requests(kept.drop("_acked", "_done"), post, media_id)


def web_outcome(enabled: Column, data_bytes: Column) -> Column:
    """Outcome of handing a medium to the feed: struct(outcome, reason)."""
    return F.when(~enabled, F.struct(F.lit(SKIPPED).alias("outcome"), F.lit("gallery_disabled").alias("reason"))).when(
        F.coalesce(data_bytes, F.lit(0)) == 0, F.struct(F.lit(SKIPPED).alias("outcome"), F.lit("empty_media").alias("reason"))
    ).otherwise(F.struct(F.lit(QUEUED).alias("outcome"), F.lit(None).cast("string").alias("reason")))


def merge_results(*results: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Concatenation that keeps duplicates; rows sort by (part, their ordinal)."""
    parts = [r.withColumn("part", F.lit(i)) for i, r in enumerate(results)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged if ordinal in merged.columns else merged.withColumn(ordinal, F.lit(0))


def resolve_destination(deliveries: DataFrame, channels: DataFrame) -> DataFrame:
    """A destination that is not a known channel fails, and still counts as eligible."""
    known = channels.select(F.col("channel_id").alias("_known")).distinct()
    joined = deliveries.join(counted_broadcast(known), deliveries["destination_id"] == known["_known"], "left_outer")
    missing = F.col("_known").isNull()
    return (
        joined.withColumn("outcome", F.when(missing, F.lit(FAILED)).otherwise(F.col("outcome")))
        .withColumn("reason", F.when(missing, F.lit("channel_not_found")).otherwise(F.col("reason")))
        .withColumn("delivered_media", F.when(missing, F.array().cast("array<string>")).otherwise(F.col("delivered_media")))
        .drop("_known")
    )


def _acked() -> Column:
    return F.coalesce(F.bool_or(F.col("ack_eligible") & (F.col("outcome") == SUCCEEDED)), F.lit(False))


def acknowledged(deliveries: DataFrame, by: Sequence[str] = POST) -> DataFrame:
    """Any eligible destination fully succeeded. Partial and feed rows never acknowledge."""
    return deliveries.groupBy(*by).agg(_acked().alias("acknowledged"))


def post_ack(posts: DataFrame, media: DataFrame, deliveries: DataFrame, multi: bool, post: Sequence[str] = POST) -> DataFrame:
    """Is the post done? ``posts`` has ``has_image`` and ``page_available``; ``media.status`` is one of
    ready, duplicate, rejected (both final) or failed (to be tried again)."""
    post = list(post)
    resolution = media.groupBy(*post).agg(
        F.count(F.lit(1)).alias("_media"),
        F.count_if(F.col("status") == "ready").alias("_ready"),
        F.coalesce(F.every(F.col("status") != "failed"), F.lit(True)).alias("_resolved"),
    )
    joined = posts.join(resolution, post, "left_outer").join(acknowledged(deliveries, post), post, "left_outer")
    n_media, ready = F.coalesce("_media", F.lit(0)), F.coalesce("_ready", F.lit(0))
    resolved, acked = F.coalesce("_resolved", F.lit(True)), F.coalesce("acknowledged", F.lit(False))
    if multi:
        verdict = (
            F.when(~F.col("page_available"), F.lit(False))
            .when(n_media == 0, F.lit(True))
            .when(ready == 0, resolved)
            .otherwise(acked & resolved)
        )
    else:
        verdict = (
            F.when(~F.col("has_image"), F.lit(True))
            .when(~F.col("page_available") | (n_media == 0) | ~resolved, F.lit(False))
            .when(ready == 0, F.lit(True))
            .otherwise(acked)
        )
    return joined.select(*[posts[c] for c in posts.columns], verdict.alias("post_acknowledged"))


def media_to_record(media: DataFrame, deliveries: DataFrame, multi: bool, post: Sequence[str] = POST,
                    content_hash: str = "content_hash") -> DataFrame:
    """Media whose hash goes to the ledger: the delivered ones (multi), or all of an acknowledged post (single)."""
    if multi:
        done = delivered_pairs(deliveries, post).withColumnRenamed("media_id", content_hash)
        return media.join(done, [*post, content_hash], "left_semi")
    return media.join(acknowledged(deliveries, post).filter("acknowledged"), list(post), "left_semi")


def message_fields(media: DataFrame, source_label: Column, post: Sequence[str] = POST) -> DataFrame:
    """Title, link and footer only on a post's first medium; the footer counts that batch's media.

    The window covers one batch, whose size the batching already bounds.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(*post, "batch_idx"))
    first = F.col("media_idx") == 0
    return (
        media.withColumn("batch_size", size)
        .withColumn("message_title", F.when(first, F.col("title")))
        .withColumn("message_url", F.when(first, F.col("link")))
        .withColumn("message_footer", F.when(first, footer(source_label, F.col("batch_size"))))
    )


def feed_fields(media: DataFrame) -> DataFrame:
    """Title and link a medium carries in the feed."""
    return media.withColumn("feed_title", display_title(F.col("title"), F.col("media_idx"))).withColumn(
        "feed_link", display_link(F.col("link"), F.col("media_idx"))
    )
