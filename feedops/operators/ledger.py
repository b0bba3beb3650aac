"""Delivery ledger as a keyed table (D1, D2, L1-L4): ``source, gallery_name, delivery_key, delivered_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions.labels import ledger_key

LEDGER_KEYS = ["source", "gallery_name", "delivery_key"]
LEDGER_SCHEMA = "source string, gallery_name string, delivery_key string, delivered_at timestamp"


def _in_ledger(rows: DataFrame, ledger: DataFrame, kind: str, identifier: str, how: str) -> DataFrame:
    match = (
        (rows["source"] == ledger["source"])
        & (rows["gallery"] == ledger["gallery_name"])
        & (ledger_key(kind, rows[identifier].cast("string")) == ledger["delivery_key"])
    )
    return rows.join(ledger, match, how)


def unseen_posts(posts: DataFrame, ledger: DataFrame, post_id: str = "post_id") -> DataFrame:
    """Posts whose key is not in the ledger."""
    return _in_ledger(posts, ledger, "post", post_id, "left_anti")


def seen_media(media: DataFrame, ledger: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """Media already delivered to this source and gallery; the same image elsewhere is new."""
    return _in_ledger(media, ledger, "image", content_hash, "left_semi")


def unseen_media(media: DataFrame, ledger: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """D2/F4, the other half."""
    return _in_ledger(media, ledger, "image", content_hash, "left_anti")


def flag_seen_media(media: DataFrame, ledger: DataFrame, content_hash: str = "content_hash", name: str = "seen") -> DataFrame:
    """D2 as a column: both halves in one join, so a hash is computed once; never null.

    The hash itself is the first key, not the ledger's spelling of it: rows come apart by it, and stay together by it for what follows.
    """
    spelled = ledger_key("image", F.lit("-"))
    prefix = F.substring(spelled, F.lit(1), F.length(spelled) - 1)
    own = F.substring("delivery_key", F.length(spelled), F.length("delivery_key"))
    images = ledger.filter(F.startswith("delivery_key", prefix) & (own != ""))
    known = images.select(own.alias("_known_hash"), F.col("gallery_name").alias("_known_gallery"), F.col("source").alias("_known_source")).distinct()
    match = (
        (media[content_hash].cast("string") == known["_known_hash"])
        & (media["gallery"] == known["_known_gallery"])
        & (media["source"] == known["_known_source"])
    )
    joined = media.join(known, match, "left_outer")
    return joined.select(*[media[c] for c in media.columns if c != name], F.col("_known_hash").isNotNull().alias(name))


def ledger_check(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """L3: given keys that are present."""
    return keys.join(ledger.select(*LEDGER_KEYS), LEDGER_KEYS, "left_semi")


def ledger_rows(rows: DataFrame, kind: str, identifier: str, delivered_at: Column) -> tuple[DataFrame, DataFrame]:
    """L1: (valid ledger rows, quarantined input rows with an empty source, gallery or identifier)."""
    key = ledger_key(kind, F.col(identifier).cast("string"))
    valid = F.coalesce((F.col("source") != "") & (F.col("gallery") != "") & key.isNotNull(), F.lit(False))
    good = rows.filter(valid).select("source", F.col("gallery").alias("gallery_name"), key.alias("delivery_key"),
                                     delivered_at.alias("delivered_at"))
    return good, rows.filter(~valid)


def ledger_add(ledger: DataFrame, new_rows: DataFrame) -> DataFrame:
    """L2: the rows to append: one per key not present yet, with its earliest time. Re-running adds nothing."""
    first = new_rows.groupBy(*LEDGER_KEYS).agg(F.min("delivered_at").alias("delivered_at"))
    return first.join(ledger.select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti")


def ledger_prune(ledger: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """L4: (rows to keep, one-row count of rows strictly older than ``before``)."""
    old = F.col("delivered_at") < before
    return ledger.filter(~old), prune_count(ledger, before)


def prune_count(ledger: DataFrame, before: Column) -> DataFrame:
    """E9."""
    return ledger.filter(F.col("delivered_at") < before).agg(F.count(F.lit(1)).alias("removed"))
