"""Fetch-log columns: status classes, challenge pages, back-off and Retry-After."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedops.functions.expr import contains_any, let

SUCCESS, RETRY, PERMANENT, BLOCKED = "success", "retry", "permanent_failure", "blocked"

# Text that marks a browser challenge, how much of a body is searched, month names of HTTP dates.
CHALLENGE_MARKERS = (
    "/cdn-cgi/challenge-platform/",
    "__cf_chl_",
    "cf-chl-",
    "cloudflare ray id",
    "attention required! | cloudflare",
)
CHALLENGE_PAIR = ("just a moment", "cloudflare")
CHALLENGE_CHARS = 131_072
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


@dataclass(frozen=True)
class RetryPolicy:
    """Checked on the driver, then turned into literals."""

    max_attempts: int = 3
    retry_statuses: frozenset[int] = field(default_factory=lambda: frozenset({408, 429}))
    backoff: str = "exponential"
    base_delay: float = 1.0
    max_delay: float = 30.0
    jitter: float = 0.0
    request_interval: float = 0.0

    def __post_init__(self) -> None:
        problems = []
        if self.max_attempts < 1:
            problems.append("max_attempts must be 1 or more")
        if self.backoff not in ("linear", "exponential"):
            problems.append("backoff must be linear or exponential")
        if min(self.base_delay, self.max_delay, self.request_interval) < 0:
            problems.append("delays must not be negative")
        if not 0.0 <= self.jitter <= 1.0:
            problems.append("jitter must lie between 0 and 1")
        if not all(isinstance(s, int) and 100 <= s <= 599 for s in self.retry_statuses):
            problems.append("retry_statuses must be HTTP status codes")
        if problems:
            raise ValueError("; ".join(problems))


# Pages and media are retried with a lower ceiling than the default.
PAGE_POLICY = RetryPolicy(max_delay=4.0)


def classify_status(status: Column, policy: RetryPolicy = PAGE_POLICY) -> Column:
    """H1."""
    again = status.isNull() | (status >= 500)
    if policy.retry_statuses:
        again = again | status.isin(*sorted(policy.retry_statuses))
    return F.when(again, F.lit(RETRY)).when((status >= 400) & (status < 500), F.lit(PERMANENT)).otherwise(SUCCESS)


def header(headers: Column, name: str) -> Column:
    """Value of the first header with this name in any case, trimmed."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.trim(F.get(entries, F.lit(0))["value"])


def is_challenge(content_type: Column, body: Column) -> Column:
    """H2: an HTML answer whose beginning carries challenge markers."""

    def check(text: Column) -> Column:
        html = F.lower(F.coalesce(content_type, F.lit(""))).contains("html") | text.contains("<html")
        pair = text.contains(CHALLENGE_PAIR[0]) & text.contains(CHALLENGE_PAIR[1])
        return html & (contains_any(text, CHALLENGE_MARKERS) | pair)

    return let(F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(CHALLENGE_CHARS))), check)


def classify_response(status: Column, content_type: Column, body: Column, policy: RetryPolicy = PAGE_POLICY) -> Column:
    """H3: a challenge page is blocked whatever its status."""
    return F.when(is_challenge(content_type, body), F.lit(BLOCKED)).otherwise(classify_status(status, policy))


def classify_attempt(error_kind: Column, status: Column, policy: RetryPolicy = PAGE_POLICY) -> Column:
    """H3 for logged errors: ``challenge``, ``other`` (not a transport error), else by status.

    A transport error has no status and is retried.
    """
    return (
        F.when(error_kind == "challenge", F.lit(BLOCKED))
        .when(error_kind == "other", F.lit(PERMANENT))
        .otherwise(classify_status(status, policy))
    )


def backoff_delay(attempt: Column, policy: RetryPolicy = PAGE_POLICY, seed: int | None = None) -> Column:
    """H4: delay before the retry after ``attempt`` (1-based); jitter is applied before the ceiling."""
    if policy.backoff == "linear":
        raw = attempt * F.lit(policy.base_delay)
    else:
        raw = F.pow(F.lit(2.0), attempt - 1) * F.lit(policy.base_delay)
    if policy.jitter:
        raw = raw * (F.lit(1 - policy.jitter) + F.rand(seed) * F.lit(2 * policy.jitter))
    return F.when(attempt >= 1, F.least(F.lit(policy.max_delay), raw))


# Hours from UTC of the named zones in mail dates; other names count as UTC.
ZONE_HOURS = {"AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
# Dates without a zone: ``Wed Jan  1 03:04:05 2025``.
_ASCTIME = r"(?i)^(?:[a-z]+\s+)?([a-z]{3})\s+(\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s+(\d{4})$"


def _zone_minutes(name: Column) -> Column:
    hours = F.element_at(F.create_map(*[F.lit(v) for pair in ZONE_HOURS.items() for v in pair]), F.upper(name))
    return F.coalesce(hours, F.lit(0)) * 60


def _http_date_us(text: Column) -> Column:
    """Epoch microseconds of ``[Day,] 02 Jan 2025 03:04:05 GMT|EST|+HHMM`` or ``[Day] Jan 02 03:04:05 2025``; NULL if it is not such a date."""
    text = F.regexp_replace(text, _ASCTIME, "$2 $1 $4 $3 GMT")
    pattern = r"(?i)^(?:[a-z]+,?\s+)?(\d{1,2})[\s-]([a-z]{3})[a-z]*[\s-](\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([a-z]*|[+-]\d{4})$"

    def moment(p: Column) -> Column:
        def number(index: int) -> Column:
            return F.get(p, F.lit(index)).try_cast("int")

        short_year = number(2)
        year = F.when(short_year < 69, short_year + 2000).when(short_year < 100, short_year + 1900).otherwise(short_year)
        zone = F.get(p, F.lit(6))
        offset = F.when(
            zone.rlike(r"^[+-]"),
            (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))
            * F.when(zone.startswith("-"), F.lit(-1)).otherwise(1),
        ).otherwise(_zone_minutes(zone))
        at = F.try_make_timestamp(year, _month(F.get(p, F.lit(1))), number(0), number(3), number(4),
                                  F.coalesce(number(5), F.lit(0)).cast("decimal(16,6)"), F.lit("UTC"))
        return F.unix_micros(at) - offset.cast("bigint") * 60_000_000

    pieces = F.split(F.regexp_replace(text, pattern, ",".join(f"${i}" for i in range(1, 8))), ",", -1)
    return F.when(text.rlike(pattern), let(pieces, moment))


def _month(name: Column) -> Column:
    at = F.instr(F.lit(MONTHS), F.lower(name))
    return F.when((at > 0) & (at % 3 == 1), F.floor((at + 2) / 3).cast("int"))


def parse_retry_after(value: Column, now_us: Column) -> Column:
    """H5: seconds to wait from a header value in seconds or as an HTTP date; NULL when absent, invalid or past."""
    text = F.trim(F.coalesce(value, F.lit("")))
    seconds = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(?i)[+-]?inf(inity)?$"), text.try_cast("double")).otherwise(
        (_http_date_us(text) - now_us) / 1_000_000
    )
    return F.when(seconds >= 0, seconds)


def retry_delay(attempt: Column, status: Column, retry_after: Column, now_us: Column,
                policy: RetryPolicy = PAGE_POLICY) -> Column:
    """H6: Retry-After counts only for 429; the result lies in [request_interval, max_delay] (interval wins)."""
    asked = F.when(status == 429, parse_retry_after(retry_after, now_us))
    delay = F.coalesce(asked, backoff_delay(attempt, policy))
    return F.greatest(F.lit(policy.request_interval), F.least(F.lit(policy.max_delay), delay))
