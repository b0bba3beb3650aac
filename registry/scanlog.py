"""Request-log classification over events: user agents and paths are assigned by event id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions import scan as J
from feedops.functions.labels import client_ip
from feedops.operators.scanlog import drop_internal_requests, scan_events
from feedops.session import scratch_folder
from feedops.sources.tables import read_scan_events, write_scan_events
from registry.base import Tables, query

AGENTS = ["Mozilla/5.0 Chrome/131.0 Safari/537.36", "GPTBot/1.1", "python-requests/2.31", "CURL/8.4", "Googlebot/2.1", "", "meta-externalagent/1",
          "Mozilla/5.0 (compatible; AhrefsBot/7.0) Chrome/1", "custom-client", "Go-http-client/1.1 httpx", "TelegramBot (like TwitterBot)"]
PATHS = ["/", "/.env", "/.Git/Config/", "wp-admin", "/cgi-bin/x.sh", "/api/v1/", "//v1/models", "/graphql", "/actuator", "/Actuator/beans", "/robots.txt", "/feed",
         "/internal/images", "/health/", "/metrics", "/wp-login.php", "/openapi.json", "/api/v1/chat/completions", "/images/abc", "/trace", "/docs//", "///", "/actuatorx", "/internal"]
AGENT_SQL = "[" + ", ".join(f"'{a}'" for a in AGENTS) + f"][1 + event_id % {len(AGENTS)}]"
PATH_SQL = "[" + ", ".join(f"'{p}'" for p in PATHS) + f"][1 + (event_id // {len(AGENTS)}) % {len(PATHS)}]"


def _strings(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


LOG_SQL = f"""log AS (SELECT event_id AS id, ts, {AGENT_SQL} AS user_agent, {PATH_SQL} AS path, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '10.0.0.' || user_id END AS header_ip,
 CASE WHEN user_id % 5 = 0 THEN NULL ELSE '192.168.0.' || user_id END AS socket_ip, CASE WHEN user_id % 2 = 0 THEN 404 ELSE 200 END AS status_code FROM events),
norm AS (SELECT *, CASE WHEN ltrim(path, '/') = '' THEN '/' ELSE '/' || trim(path, '/') END AS shown,
 list_filter([{_strings(J.CRAWLER_SIGNATURES)}], lambda s: contains(lower(user_agent), lower(s)))[1] AS signature,
 len(list_filter([{_strings(J.BROWSER_TOKENS)}], lambda s: contains(lower(user_agent), s))) > 0 AS browser FROM log),
cat AS (SELECT *, CASE WHEN signature IS NULL AND browser THEN NULL WHEN lower(shown) IN ({_strings(J.CREDENTIAL_PATHS)}) THEN 'credential-hunter'
 WHEN lower(shown) IN ({_strings(J.EXPLOIT_PATHS)}) OR starts_with(lower(shown), '/cgi-bin/') THEN 'exploit-scanner' WHEN lower(shown) IN ({_strings(J.API_PATHS)}) THEN 'api-scanner'
 WHEN lower(shown) IN ({_strings(J.PROBE_PATHS)}) OR starts_with(lower(shown), '/actuator/') THEN 'probe' WHEN signature IS NOT NULL THEN 'ai-crawler' END AS category FROM norm),
shaped AS (SELECT *, CASE WHEN category = 'ai-crawler' AND lower(shown) <> '/robots.txt' THEN signature WHEN category IS NOT NULL THEN shown END AS matched_signature,
 CASE WHEN lower(shown) IN ('/api/v1/chat/completions', '/v1/chat/completions') THEN 'decoy-chat-completion' WHEN lower(shown) IN ('/api/v1/models', '/v1/models') THEN 'decoy-model-list'
 WHEN lower(shown) = '/graphql' THEN 'decoy-graphql' WHEN lower(shown) IN ('/openapi.json', '/swagger.json') THEN 'decoy-openapi' WHEN lower(shown) = '/.git/config' THEN 'decoy-git-config'
 WHEN lower(shown) IN ({_strings(J.CREDENTIAL_PATHS)}) THEN 'decoy-credentials' WHEN starts_with(lower(shown), '/actuator') THEN 'decoy-actuator'
 WHEN lower(shown) IN ('/wp-admin', '/wp-login.php', '/admin') THEN 'decoy-login' WHEN lower(shown) IN ('/api', '/api/v1', '/v1', '/v2') THEN 'decoy-api-index'
 WHEN status_code = 404 THEN 'decoy-not-found' ELSE 'decoy-generic' END AS response_shape,
 coalesce(CASE WHEN header_ip <> '' THEN header_ip END, socket_ip, 'unknown') AS source_ip FROM cat)"""


def request_log(events: DataFrame) -> DataFrame:
    agent = F.get(F.array(*[F.lit(a) for a in AGENTS]), (F.col("event_id") % len(AGENTS)).cast("int"))
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.floor(F.col("event_id") / len(AGENTS)) % len(PATHS)).cast("int"))
    who = F.col("user_id").cast("string")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), agent.alias("user_agent"), path.alias("path"),
        F.when(F.col("user_id") % 3 == 0, F.lit("")).when(F.col("user_id") % 3 == 1, F.concat(F.lit("10.0.0."), who)).alias("header_ip"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("192.168.0."), who)).alias("socket_ip"),
        F.lit("GET").alias("method"), F.array(F.lit("token"), F.col("event_type"), F.lit("page"), F.lit("page")).alias("query_keys"),
        F.when(F.col("user_id") % 2 == 0, F.lit(404)).otherwise(200).alias("status_code"))


SCAN_SQL = f"""WITH {LOG_SQL} SELECT epoch_us(s.ts) AS t_us, source_ip, user_agent, path, array_to_string(list_sort(list_distinct(['token', event_type, 'page'])), ',') AS query_keys,
 category, matched_signature, response_shape, 32 AS id_length FROM shaped s JOIN events ON event_id = s.id WHERE category IS NOT NULL"""


def shown_events(found: DataFrame) -> DataFrame:
    return found.select(F.unix_micros("timestamp").alias("t_us"), "source_ip", "user_agent", "path", F.array_join("query_keys", ",").alias("query_keys"),
                        "category", "matched_signature", "response_shape", F.length("event_id").alias("id_length"))


@query("a8_drop_internal_requests", f"WITH {LOG_SQL} SELECT id, path FROM log WHERE NOT starts_with(path, '/internal/')")
def _(t: Tables) -> DataFrame:
    return drop_internal_requests(request_log(t.events)).select("id", "path")


@query("b25_client_ip", f"WITH {LOG_SQL} SELECT id, source_ip FROM shaped")
def _(t: Tables) -> DataFrame:
    return request_log(t.events).select("id", client_ip(F.col("header_ip"), F.col("socket_ip")).alias("source_ip"))


@query("j1_matched_signature", f"WITH {LOG_SQL} SELECT id, signature FROM norm")
def _(t: Tables) -> DataFrame:
    return request_log(t.events).select("id", J.matched_signature(F.col("user_agent")).alias("signature"))


@query("j2_is_browser_or_preview", f"WITH {LOG_SQL} SELECT id, browser FROM norm")
def _(t: Tables) -> DataFrame:
    return request_log(t.events).select("id", J.is_browser_or_preview(F.col("user_agent")).alias("browser"))


@query("j3_normalize_path", f"WITH {LOG_SQL} SELECT id, shown AS path FROM norm")
def _(t: Tables) -> DataFrame:
    return request_log(t.events).select("id", J.normalize_path(F.col("path")).alias("path"))


@query("j4_classify_request", f"WITH {LOG_SQL} SELECT id, category, matched_signature FROM shaped")
def _(t: Tables) -> DataFrame:
    return request_log(t.events).select("id", J.classify_request(F.col("user_agent"), F.col("path")).alias("m")).select("id", "m.*")


@query("j5_response_shape", f"WITH {LOG_SQL} SELECT id, response_shape FROM shaped")
def _(t: Tables) -> DataFrame:
    return request_log(t.events).select("id", J.response_shape(F.col("path"), F.col("status_code")).alias("response_shape"))


@query("j6_scan_events", SCAN_SQL)
def _(t: Tables) -> DataFrame:
    return shown_events(scan_events(request_log(t.events)))


@query("a5_scan_event_lines", SCAN_SQL)
def _(t: Tables) -> DataFrame:
    """Events appended to JSON lines and read back."""
    path = f"{scratch_folder(t.spark)}/events-{uuid.uuid4().hex}"
    write_scan_events(scan_events(request_log(t.events)), path)
    return shown_events(read_scan_events(t.spark, path))
