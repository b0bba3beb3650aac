"""Listing pages to new posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.operators.extract import extract_rows_hybrid, extract_rows_table
from feedops.operators.ledger import unseen_posts
from feedops.operators.select import moderation_holdback, next_unseen
from feedops.plans.profiles import SourceProfile


def listing_rows(pages: DataFrame, profile: SourceProfile) -> DataFrame:
    """Rows of crawled listings (``page_id, gallery, crawl_id, html``): source, gallery, crawl_id, list_pos, post."""
    keep = ("gallery", "crawl_id")
    rows = extract_rows_hybrid(pages, keep=keep) if profile.multi else extract_rows_table(pages, keep=keep)
    if not profile.multi:
        rows = rows.filter(~F.col("is_notice"))
    return rows.filter(F.col("link").isNotNull()).select(
        F.lit(profile.source).alias("source"), *keep, "list_pos", "post_id", "link", "title", "has_image"
    )


def select_new_posts(rows: DataFrame, ledger: DataFrame, profile: SourceProfile) -> DataFrame:
    """Hold-back, then the ledger, then the first new posts; the order matters: held rows count whether seen or not."""
    by, order = profile.listing, ["list_pos"]
    eligible = rows.filter(F.col("has_image")) if profile.images_only else rows
    held = moderation_holdback(eligible, profile.holdback, by, order)
    return next_unseen(unseen_posts(held, ledger), profile.posts_per_poll, by, order)
