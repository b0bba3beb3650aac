"""Verdicts over a log of fetch attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions.fetch import PAGE_POLICY, PERMANENT, RETRY, SUCCESS, RetryPolicy
from feedops.functions.media import expected_type_ok
from feedops.functions.urls import UrlPolicy, is_allowed_url

# Candidates tried per medium and requests spent on one chain.
MAX_CANDIDATES = 4
MAX_REQUESTS = 6
EXHAUSTED, PENDING = "exhausted", "pending"


def request_verdict(attempts: DataFrame, by: Sequence[str], policy: RetryPolicy = PAGE_POLICY, attempt: str = "attempt",
                    decision: str = "decision", carry: Sequence[str] = ()) -> DataFrame:
    """H7: ``verdict`` and ``requests`` spent per logical request.

    The first attempt that is not a retry decides; without one the request is exhausted after ``max_attempts`` (pending
    before). ``carry`` columns are taken from the deciding attempt. All of it is one partial-aggregating group-by.
    """
    counted = attempts.filter(F.col(attempt) <= policy.max_attempts)
    deciding = F.when(F.col(decision) != RETRY, F.struct(F.col(attempt).alias("at"), F.col(decision).alias("verdict"), *carry))
    summary = counted.groupBy(*by).agg(F.min(deciding).alias("_d"), F.max(attempt).alias("_last"))
    undecided = F.when(F.col("_last") >= policy.max_attempts, F.lit(EXHAUSTED)).otherwise(PENDING)
    return summary.select(
        *by, F.coalesce("_d.verdict", undecided).alias("verdict"), F.coalesce("_d.at", "_last").alias("requests"),
        *[F.col(f"_d.{c}").alias(c) for c in carry],
    )


def candidates_with_fetches(candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """``fetches`` has one row per URL (from ``request_verdict``).

    A log is never sent to every executor: it grows with the candidates, and the planner judges it by the compressed files it comes from.
    """
    renamed = fetches.withColumnRenamed("url", "_url").hint("merge")
    return candidates.join(renamed, candidates["url"] == renamed["_url"], "left_outer").drop("_url")


def ranked_candidates(media: DataFrame) -> DataFrame:
    """One row per distinct candidate URL of a medium: ``cand_rank`` (0 = primary), ``url``."""
    urls = F.array_distinct(F.concat(F.array("primary_url"), F.coalesce(F.col("fallback_urls"), F.array().cast("array<string>"))))
    kept = [c for c in media.columns if c not in ("primary_url", "fallback_urls")]
    return media.select(*kept, F.posexplode(urls).alias("cand_rank", "url"))


def resolve_candidates(candidates: DataFrame, fetches: DataFrame, by: Sequence[str], policy: UrlPolicy | None,
                       max_candidates: int = MAX_CANDIDATES, max_requests: int = MAX_REQUESTS, carry: Sequence[str] = (),
                       keep: Sequence[str] = ()) -> DataFrame:
    """H8: per medium ``verdict`` (chosen / budget_exceeded / exhausted / rejected), ``chosen_url`` and its rank.

    ``candidates``: by..., cand_rank, url, expected_media_type. ``fetches``: url, verdict, requests, size_ok, ext, valid; its
    ``carry`` columns are taken from the chosen URL's row.
    Ranks count from 0 without gaps, as ``ranked_candidates`` gives them, so the cut to ``max_candidates`` needs no ranking and
    comes first. What is left meets its fetches, and a medium is brought together and sorted once, for a running sum over at most that
    many steps; its verdict stands on its first row. Only a usable candidate brings its URL and ``carry`` there.
    With ``keep``, columns of the medium itself, every candidate of rank 0 has its row and these columns; they travel with it alone.
    """
    if max_candidates < 1 or max_requests < 1:
        raise ValueError("max_candidates and max_requests must be at least 1")
    by, keep = list(by), list(keep)
    first = F.col("cand_rank") == 0
    needed = [*by, "cand_rank", "url", "expected_media_type", *[F.when(first, F.col(c)).alias(c) for c in keep]]
    tried = candidates_with_fetches(candidates.filter(F.col("cand_rank") < max_candidates).select(*needed), fetches)
    tried = tried.withColumn("_allowed", F.lit(True) if policy is None else is_allowed_url(F.col("url"), policy))
    allowed = F.col("_allowed")
    usable = (
        allowed & (F.col("verdict") == SUCCESS) & F.col("size_ok") & F.col("ext").isNotNull() & F.col("valid")
        & expected_type_ok(F.col("expected_media_type"), F.col("ext"))
    )
    transient = allowed & ~F.coalesce(F.col("verdict"), F.lit(PENDING)).isin(SUCCESS, PERMANENT)
    spent = F.coalesce(F.when(allowed, F.col("requests")), F.lit(0)).cast("bigint")
    # Requests and a transient failure are one number, and only a usable candidate brings more: little is shuffled for the others.
    steps = tried.select(
        *by, "cand_rank", (2 * spent + F.coalesce(transient, F.lit(False)).cast("bigint")).alias("_cost"),
        F.when(usable, F.struct(F.col("url").alias("_url"), *[F.col(c).alias(f"_with_{c}") for c in carry])).alias("_usable"), *keep,
    )
    whole = Window.partitionBy(*by)
    in_order = whole.orderBy("cand_rank")
    places = [] if keep else [F.row_number().over(in_order).alias("_place")]
    steps = steps.select("*", F.sum(F.shiftright("_cost", 1)).over(in_order).alias("_running"), *places)
    taken = F.struct("cand_rank", *[F.col(f"_usable.{c}").alias(c) for c in ("_url", *[f"_with_{c}" for c in carry])])
    ends = steps.select(
        *by, *keep, (first if keep else F.col("_place") == 1).alias("_end"),
        F.min(F.when(F.col("_usable").isNotNull() & (F.col("_running") <= max_requests), taken)).over(whole).alias("_chosen"),
        F.max("_running").over(whole).alias("_total"), F.max(F.col("_cost").bitwiseAND(F.lit(1))).over(whole).alias("_unsettled"),
    ).filter("_end")
    verdict = (
        F.when(F.col("_chosen").isNotNull(), F.lit("chosen"))
        .when(F.col("_total") > max_requests, F.lit("budget_exceeded"))
        .when(F.col("_unsettled") == 1, F.lit(EXHAUSTED))
        .otherwise("rejected")
    )
    return ends.select(*by, *keep, verdict.alias("verdict"), F.col("_chosen._url").alias("chosen_url"), F.col("_chosen.cand_rank").alias("chosen_rank"),
                       *[F.col(f"_chosen._with_{c}").alias(c) for c in carry])


def media_status(verdict: Column, already_seen: Column) -> Column:
    """H9: ready, duplicate, rejected (final) or failed (try the post again)."""
    return (
        F.when((verdict == "chosen") & already_seen, F.lit("duplicate"))
        .when(verdict == "chosen", F.lit("ready"))
        .when(verdict == "rejected", F.lit("rejected"))
        .otherwise("failed")
    )


def media_resolved(status: Column) -> Column:
    """H9: everything but a failure settles the medium."""
    return status != "failed"


