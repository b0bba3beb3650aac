"""Post pages and a fetch log to prepared media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions.fetch import PAGE_POLICY, RetryPolicy, classify_attempt
from feedops.functions.expr import packed, unpacked
from feedops.functions.media import MediaLimits, content_hash, fix_extension, image_dims, oversize_reason, pixel_gate, sniff_type
from feedops.operators.dedup import dedup_urls_within_post, dedup_within_post
from feedops.operators.delivery import POST
from feedops.operators.extract import extract_media_all, extract_media_first, media_candidates
from feedops.operators.fetchlog import media_status, ranked_candidates, request_verdict, resolve_candidates
from feedops.operators.ledger import flag_seen_media
from feedops.operators.select import cap_media_per_post
from feedops.functions.urls import filename_hint
from feedops.plans.profiles import SourceProfile


def media_of_posts(post_pages: DataFrame, profile: SourceProfile) -> DataFrame:
    """Candidates of every post: keys, media_idx, primary_url, fallback_urls, filename_hint, expected_media_type."""
    if not profile.multi:
        found = extract_media_first(post_pages, keep=(*POST, "post_url"), policy=profile.policy)
        return found.select(*POST, F.lit(0).alias("media_idx"), "primary_url", "fallback_urls", "filename_hint",
                            F.lit("image").alias("expected_media_type"))
    tags = media_candidates(extract_media_all(post_pages, keep=POST), profile.policy)
    capped = cap_media_per_post(dedup_urls_within_post(tags, POST, "primary_url", ["img_pos"]), POST, ["img_pos"], profile.media_per_post)
    numbered = F.concat(F.lit("arca_"), F.col("post_id"), F.lit("_"), F.col("media_idx").cast("string"), F.lit(".jpg"))
    return capped.select(*POST, "media_idx", "primary_url", "fallback_urls",
                         filename_hint(F.col("primary_url"), numbered).alias("filename_hint"),
                         F.lit("image").alias("expected_media_type"))


def fetched_urls(fetch_log: DataFrame, policy: RetryPolicy = PAGE_POLICY, limits: MediaLimits = MediaLimits(),
                 request: str | None = None) -> DataFrame:
    """One row per URL: verdict, requests, and what the deciding answer's bytes are.

    ``request`` names a column that grows from poll to poll, in a log that holds several runs of one URL: each run is
    judged on its own, and the latest counts. Bytes are reduced to type, hash and size before the group-by, so no content is shuffled.
    """
    runs = [request] if request else []
    ext = sniff_type(F.col("content"))
    dims = image_dims(F.col("content"), ext)
    described = fetch_log.select(
        "url", *runs, "attempt", classify_attempt(F.col("error_kind"), F.col("status"), policy).alias("decision"),
        oversize_reason(F.col("declared_length"), F.octet_length("content"), limits.download_bytes).isNull().alias("size_ok"),
        ext.alias("ext"), content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").alias("size"), dims.alias("_d"),
    ).withColumn("valid", pixel_gate(F.col("_d.width"), F.col("_d.height"), limits.source_pixels))
    judged = request_verdict(described, ["url", *runs], policy, carry=["size_ok", "ext", "valid", "content_hash", "size"])
    if not runs:
        return judged
    facts = [c for c in judged.columns if c not in ("url", request)]
    latest = judged.groupBy("url").agg(F.max(F.struct(request, *facts)).alias("_run"))
    return latest.select("url", *[F.col(f"_run.{c}").alias(c) for c in facts])


def resolve_media(media: DataFrame, fetch_log: DataFrame, ledger: DataFrame, profile: SourceProfile,
                  policy: RetryPolicy = PAGE_POLICY, limits: MediaLimits = MediaLimits(), request: str | None = None) -> DataFrame:
    """Every medium with status, chosen URL, content hash and corrected file name; ``request`` as in ``fetched_urls``."""
    # A medium's keys travel as one string, the post first, which a sort compares, and a hash as its bytes: half as long as its digits.
    keys = ["post_id", "media_idx", "gallery", "source"]
    fetched = fetched_urls(fetch_log, policy, limits, request).withColumn("content_hash", F.unhex("content_hash"))
    # A medium without one of its keys has no result.
    tried = media.dropna(subset=keys).select(packed([F.col(k) for k in keys]).alias("_medium"), "primary_url", "fallback_urls", "filename_hint", "expected_media_type")
    verdicts = resolve_candidates(ranked_candidates(tried), fetched, ["_medium"], profile.policy, carry=["content_hash", "size", "ext"], keep=["filename_hint"])
    values = unpacked(F.col("_medium"), [media.schema[k].dataType.simpleString() for k in keys])
    resolved = verdicts.withColumns(dict(zip(keys, values, strict=True))).drop("_medium").withColumn("content_hash", F.lower(F.hex("content_hash")))
    marked = flag_seen_media(resolved, ledger, name="_seen")
    return marked.select(
        *POST, "media_idx", "chosen_url", "content_hash", "size", "ext", fix_extension(F.col("filename_hint"), F.col("ext")).alias("filename"),
        media_status(F.col("verdict"), F.col("_seen")).alias("status"),
    )


def sendable_media(resolved: DataFrame) -> DataFrame:
    """Media to deliver: ready ones, one per content hash and post."""
    return dedup_within_post(resolved.filter(F.col("status") == "ready"), POST, "content_hash", ["media_idx"])
