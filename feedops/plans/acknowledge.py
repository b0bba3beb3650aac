"""Delivery log to ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.operators.delivery import POST, media_to_record, post_ack
from feedops.operators.ledger import ledger_rows
from feedops.plans.profiles import SourceProfile


def acknowledge(posts: DataFrame, media: DataFrame, deliveries: DataFrame, profile: SourceProfile, now: Column) -> DataFrame:
    """Ledger rows of finished posts and delivered media.

    With the multi profile a partial delivery records the delivered media but not the post, so the next poll selects the
    post again and only what is missing goes out.
    """
    done = post_ack(posts, media, deliveries, profile.multi).filter("post_acknowledged")
    post_rows, _ = ledger_rows(done, "post", "post_id", now)
    sent = media.filter(F.col("status") == "ready").select(*POST, "content_hash")
    media_rows, _ = ledger_rows(media_to_record(sent, deliveries, profile.multi), "image", "content_hash", now)
    return post_rows.unionByName(media_rows)
