"""Scanner events from a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.expr import evaluated
from feedops.functions.labels import client_ip
from feedops.functions.scan import classified, is_browser_or_preview, matched_signature, normalize_path, response_shape
from feedops.operators.dedup import sorted_keys

SCAN_EVENT_SCHEMA = (
    "timestamp timestamp, event_id string, source_ip string, user_agent string, method string, path string, "
    "query_keys array<string>, category string, matched_signature string, status_code int, response_shape string"
)


def drop_internal_requests(log: DataFrame, path: str = "path") -> DataFrame:
    """Private ingest requests never reach derived tables."""
    return log.filter(~F.col(path).startswith("/internal/"))


def scan_events(log: DataFrame) -> DataFrame:
    """Matched requests as events. The id is a hash of the row, so a re-run or a retried task yields the same id."""
    parts = F.struct(matched_signature(F.col("user_agent")).alias("signature"), is_browser_or_preview(F.col("user_agent")).alias("browser"), normalize_path(F.col("path")).alias("path"))
    staged = evaluated(log, "_p", parts)
    matched = evaluated(staged, "_m", classified(F.col("_p.signature"), F.col("_p.browser"), F.col("_p.path"))).filter(F.col("_m.category").isNotNull())
    event_id = F.left(F.sha2(F.concat_ws("\x1f", F.col("id").cast("string"), F.unix_micros("ts").cast("string"),
                                         "user_agent", "method", "path"), 256), F.lit(32))
    return matched.select(
        F.col("ts").alias("timestamp"), event_id.alias("event_id"),
        client_ip(F.col("header_ip"), F.col("socket_ip")).alias("source_ip"),
        "user_agent", "method", "path", sorted_keys(F.col("query_keys")).alias("query_keys"),
        F.col("_m.category").alias("category"), F.col("_m.matched_signature").alias("matched_signature"),
        F.col("status_code").cast("int").alias("status_code"),
        response_shape(F.col("path"), F.col("status_code")).alias("response_shape"),
    )
