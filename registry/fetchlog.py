"""Fetch attempts: lineitem and part as attempt logs, documents as response bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions import fetch as H
from feedops.functions.labels import safe_error_label
from feedops.functions.media import oversize_reason
from feedops.functions.urls import SINGLE_MEDIA
from feedops.operators import fetchlog as O
from feedops.operators.dedup import dedup_urls_within_post
from registry.base import Tables, query
from registry.selection import MEDIA_ORDER, MEDIA_ORDER_SQL

STATUSES = [200, 404, 429, 503, None, 408, 301, 413, 500]
STATUS_SQL = "[200, 404, 429, 503, NULL, 408, 301, 413, 500][1 + l_partkey % 9]"
DECISION_SQL = "CASE WHEN status IS NULL OR status IN (408, 429) OR status >= 500 THEN 'retry' WHEN status BETWEEN 400 AND 499 THEN 'permanent_failure' ELSE 'success' END"
RETRY_AFTER = ["12", "", "-1", "junk", "0.5", "Wed, 01 Jan 2025 00:00:30 GMT", " 7 ", "1e1", "Wed, 01 Jan 2025 02:00:03 +0200", "Tue, 31 Dec 2024 23:59:59 GMT",
               "Wed, 01 Jan 2025 00:01:00 EST", "Wed Jan  1 00:00:20 2025", "inf"]
RETRY_AFTER_SQL = "[12.0, NULL, NULL, NULL, 0.5, 30.0, 7.0, 10.0, 3.0, NULL, 18060.0, 20.0, CAST('inf' AS DOUBLE)][1 + l_suppkey % 13]"
NOW_US = 1_735_689_600_000_000  # 2025-01-01 00:00:00 UTC


def pick(values: list, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _numbered(lines: DataFrame, rank: str) -> DataFrame:
    """All lines of an order, numbered from 1; the operators cut where their rules say so."""
    return lines.withColumn(rank, F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*MEDIA_ORDER)))


def attempts(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("status", pick(STATUSES, F.col("l_partkey") % 9)).withColumn(
        "retry_after", pick(RETRY_AFTER, F.col("l_suppkey") % 13))


@query("h1_classify_status", f"SELECT l_orderkey, l_partkey, status, {DECISION_SQL} AS decision FROM (SELECT *, {STATUS_SQL} AS status FROM lineitem)")
def _(t: Tables) -> DataFrame:
    return attempts(t).select("l_orderkey", "l_partkey", "status", H.classify_status(F.col("status")).alias("decision"))


CHALLENGE_SQL = """b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Text/HTML; charset=utf-8' ELSE 'text/plain' END AS content_type,
 CASE WHEN doc_id % 3 = 0 THEN '<HTML>' ELSE '' END || text || CASE doc_id % 5 WHEN 0 THEN ' Just a Moment... CloudFlare' WHEN 1 THEN ' just a moment' WHEN 2 THEN ' __CF_chl_x' ELSE '' END AS body,
 CASE WHEN doc_id % 4 = 0 THEN 503 ELSE 200 END AS status FROM documents),
l AS (SELECT *, lower(body) AS low FROM b),
c AS (SELECT *, (contains(lower(content_type), 'html') OR contains(low, '<html')) AND (contains(low, '/cdn-cgi/challenge-platform/') OR contains(low, '__cf_chl_') OR contains(low, 'cf-chl-')
 OR contains(low, 'cloudflare ray id') OR contains(low, 'attention required! | cloudflare') OR (contains(low, 'just a moment') AND contains(low, 'cloudflare'))) AS challenge FROM l)"""


def bodies(t: Tables) -> DataFrame:
    tail = pick([" Just a Moment... CloudFlare", " just a moment", " __CF_chl_x", "", ""], F.col("doc_id") % 5)
    return t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("Text/HTML; charset=utf-8")).otherwise("text/plain").alias("content_type"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("<HTML>")).otherwise(""), "text", tail).alias("body"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(503)).otherwise(200).alias("status"))


@query("h2_is_challenge", f"WITH {CHALLENGE_SQL} SELECT doc_id, challenge FROM c")
def _(t: Tables) -> DataFrame:
    return bodies(t).select("doc_id", H.is_challenge(F.col("content_type"), F.col("body")).alias("challenge"))


@query("h3_classify_response", f"WITH {CHALLENGE_SQL} SELECT doc_id, CASE WHEN challenge THEN 'blocked' WHEN status >= 500 THEN 'retry' ELSE 'success' END AS decision FROM c")
def _(t: Tables) -> DataFrame:
    return bodies(t).select("doc_id", H.classify_response(F.col("status"), F.col("content_type"), F.col("body")).alias("decision"))


@query("h3_classify_attempt", f"""
SELECT l_orderkey, l_partkey, error_kind, CASE error_kind WHEN 'challenge' THEN 'blocked' WHEN 'other' THEN 'permanent_failure' ELSE {DECISION_SQL} END AS decision
FROM (SELECT *, {STATUS_SQL} AS status, CASE l_linenumber WHEN 1 THEN 'challenge' WHEN 2 THEN 'other' ELSE 'http' END AS error_kind FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 1, F.lit("challenge")).when(F.col("l_linenumber") == 2, F.lit("other")).otherwise("http")
    rows = attempts(t).withColumn("error_kind", kind)
    return rows.select("l_orderkey", "l_partkey", "error_kind", H.classify_attempt(F.col("error_kind"), F.col("status")).alias("decision"))


LINEAR = H.RetryPolicy(backoff="linear", base_delay=0.5, max_delay=3.0)


@query("h4_backoff_delay", """
SELECT l_orderkey, l_linenumber, least(4.0, pow(2, l_linenumber - 1)) AS exponential, CAST(least(3.0, 0.5 * l_linenumber) AS DOUBLE) AS linear FROM lineitem""")
def _(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", H.backoff_delay(n).alias("exponential"), H.backoff_delay(n, LINEAR).alias("linear"))


@query("h5_parse_retry_after", f"SELECT l_orderkey, l_suppkey, CAST({RETRY_AFTER_SQL} AS DOUBLE) AS seconds FROM lineitem")
def _(t: Tables) -> DataFrame:
    headers = F.create_map(F.lit("Content-Type"), F.lit("x"), F.lit("retry-AFTER"), F.col("retry_after"))
    seconds = H.parse_retry_after(H.header(headers, "Retry-After"), F.lit(NOW_US))
    return attempts(t).select("l_orderkey", "l_suppkey", seconds.alias("seconds"))


@query("h6_retry_delay", f"""
SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, CAST(greatest(0, least(4.0, coalesce(CASE WHEN {STATUS_SQL} = 429 THEN {RETRY_AFTER_SQL} END, least(4.0, pow(2, l_linenumber - 1))))) AS DOUBLE) AS delay FROM lineitem""")
def _(t: Tables) -> DataFrame:
    delay = H.retry_delay(F.col("l_linenumber"), F.col("status"), F.col("retry_after"), F.lit(NOW_US))
    return attempts(t).select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", delay.alias("delay"))


@query("h7_request_verdict", f"""
WITH a AS (SELECT *, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) AS attempt FROM lineitem),
d AS (SELECT *, {DECISION_SQL} AS decision FROM a WHERE attempt <= 3),
f AS (SELECT l_orderkey, min(attempt) FILTER (decision <> 'retry') AS first_at, max(attempt) AS last, arg_min(decision, attempt) FILTER (decision <> 'retry') AS decision FROM d GROUP BY 1)
SELECT l_orderkey, coalesce(decision, CASE WHEN last >= 3 THEN 'exhausted' ELSE 'pending' END) AS verdict, coalesce(first_at, last) AS requests FROM f""")
def _(t: Tables) -> DataFrame:
    logged = _numbered(attempts(t), "attempt")
    verdicts = O.request_verdict(logged.withColumn("decision", H.classify_status(F.col("status"))), ["l_orderkey"])
    return verdicts.withColumn("requests", F.col("requests").cast("bigint"))


# H8: an order is a medium, its lines are candidates in order; part is the fetch log with up to three attempts per URL.
FETCH_SQL = f"""lines AS (SELECT *, CASE l_suppkey % 5 WHEN 0 THEN 'http' ELSE 'https' END || '://dcimg' || CASE WHEN l_suppkey % 7 = 0 THEN 'x' ELSE '' END || l_partkey % 1000 || '.dcinside.com/' || l_partkey AS url FROM lineitem),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, url ORDER BY {MEDIA_ORDER_SQL}) AS dup FROM lines) WHERE dup = 1),
cands AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) - 1 AS cand_rank FROM firsts),
tries AS (SELECT p_partkey, p_size, attempt, [404, 429, 200, 503, NULL, 408, 200, 413, 500, 429, 502][1 + (p_partkey * 7 + attempt * 3) % 11] AS status FROM part, (SELECT unnest([1, 2, 3]) AS attempt)),
dec AS (SELECT *, {DECISION_SQL} AS decision FROM tries),
fetched AS (SELECT p_partkey, any_value(p_size) AS p_size, min(attempt) FILTER (decision <> 'retry') AS at, arg_min(decision, attempt) FILTER (decision <> 'retry') AS decision FROM dec GROUP BY 1),
tried AS (SELECT c.l_orderkey, c.url, c.cand_rank, c.l_partkey, starts_with(c.url, 'https') AND l_suppkey % 7 <> 0 AS allowed, coalesce(f.at, 3) AS requests, coalesce(f.decision, 'exhausted') AS verdict,
 f.p_size % 11 <> 0 AS size_ok, f.p_size % 13 <> 0 AS valid, [NULL, 'jpg', 'png', 'gif', 'webp'][1 + f.p_size % 5] AS ext, [NULL, 'image', 'image/JPEG', 'png'][1 + c.l_linenumber % 4] AS expected
 FROM cands c JOIN fetched f ON f.p_partkey = c.l_partkey),
spent AS (SELECT *, sum(CASE WHEN allowed THEN requests ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY cand_rank) AS spent,
 allowed AND verdict = 'success' AND size_ok AND valid AND ext IS NOT NULL AND (expected IS NULL OR expected = 'image' OR (expected = 'image/JPEG' AND ext = 'jpg') OR expected = ext) AS usable FROM tried WHERE cand_rank < 4),
h8 AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (usable AND spent <= 6) > 0 THEN 'chosen' WHEN bool_or(spent > 6) THEN 'budget_exceeded'
 WHEN bool_or(allowed AND verdict = 'exhausted') THEN 'exhausted' ELSE 'rejected' END AS verdict, arg_min(url, cand_rank) FILTER (usable AND spent <= 6) AS chosen_url FROM spent GROUP BY 1)"""


def chain_candidates(t: Tables) -> DataFrame:
    url = F.concat(F.when(F.col("l_suppkey") % 5 == 0, F.lit("http")).otherwise("https"), F.lit("://dcimg"),
                   F.when(F.col("l_suppkey") % 7 == 0, F.lit("x")).otherwise(""), (F.col("l_partkey") % 1000).cast("string"),
                   F.lit(".dcinside.com/"), F.col("l_partkey").cast("string"))
    firsts = dedup_urls_within_post(t.lineitem.withColumn("url", url), ["l_orderkey"], "url", MEDIA_ORDER)
    ranked = _numbered(firsts, "_rank")
    expected = pick([None, "image", "image/JPEG", "png"], F.col("l_linenumber") % 4)
    return ranked.select("l_orderkey", "url", "l_partkey", (F.col("_rank") - 1).alias("cand_rank"), expected.alias("expected_media_type"))


def part_fetches(t: Tables) -> DataFrame:
    """One row per part: verdict, requests and facts about the fetched bytes."""
    log = t.part.select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    status = pick([404, 429, 200, 503, None, 408, 200, 413, 500, 429, 502], (F.col("p_partkey") * 7 + F.col("attempt") * 3) % 11)
    decided = log.withColumn("decision", H.classify_status(status)).withColumn("size_ok", F.col("p_size") % 11 != 0).withColumn(
        "valid", F.col("p_size") % 13 != 0).withColumn("ext", pick([None, "jpg", "png", "gif", "webp"], F.col("p_size") % 5))
    return O.request_verdict(decided, ["p_partkey"], carry=["size_ok", "valid", "ext"])


def url_fetches(t: Tables) -> DataFrame:
    """The same facts keyed by URL: every spelling of a part's URL has that part's answers."""
    starts = F.explode(F.array(*[F.lit(s) for s in ("http://dcimg", "http://dcimgx", "https://dcimg", "https://dcimgx")]))
    number = (F.col("p_partkey") % 1000).cast("string")
    url = F.concat(F.col("start"), number, F.lit(".dcinside.com/"), F.col("p_partkey").cast("string"))
    return part_fetches(t).withColumn("start", starts).withColumn("url", url).drop("start", "p_partkey")


@query("d9_candidates_with_fetches", f"WITH {FETCH_SQL} SELECT l_orderkey, url, CAST(cand_rank AS BIGINT) AS cand_rank, verdict, requests FROM tried")
def _(t: Tables) -> DataFrame:
    joined = O.candidates_with_fetches(chain_candidates(t), url_fetches(t))
    return joined.select("l_orderkey", "url", F.col("cand_rank").cast("bigint").alias("cand_rank"), "verdict", "requests")


@query("h8_resolve_candidates", f"WITH {FETCH_SQL} SELECT * FROM h8")
def _(t: Tables) -> DataFrame:
    verdicts = O.resolve_candidates(chain_candidates(t), url_fetches(t), ["l_orderkey"], SINGLE_MEDIA)
    return verdicts.select("l_orderkey", "verdict", "chosen_url")


@query("h9_media_resolved", f"""WITH {FETCH_SQL},
s AS (SELECT l_orderkey, CASE WHEN verdict = 'chosen' AND l_orderkey % 3 = 0 THEN 'duplicate' WHEN verdict = 'chosen' THEN 'ready' WHEN verdict = 'rejected' THEN 'rejected' ELSE 'failed' END AS status FROM h8)
SELECT l_orderkey, status, status <> 'failed' AS resolved FROM s""")
def _(t: Tables) -> DataFrame:
    verdicts = O.resolve_candidates(chain_candidates(t), url_fetches(t), ["l_orderkey"], SINGLE_MEDIA)
    marked = verdicts.withColumn("status", O.media_status(F.col("verdict"), F.col("l_orderkey") % 3 == 0))
    return marked.select("l_orderkey", "status", O.media_resolved(F.col("status")).alias("resolved"))


@query("h10_oversize_reject", """
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'declared_invalid' WHEN doc_id % 5 = 2 THEN 'declared_too_large' WHEN doc_id % 5 = 3 AND octet_length(encode(text)) > 2000 THEN 'declared_too_large'
 WHEN octet_length(encode(text)) > 2000 THEN 'body_too_large' END AS reason FROM documents""")
def _(t: Tables) -> DataFrame:
    size = F.octet_length("text")
    declared = F.when(F.col("doc_id") % 5 == 3, size.cast("string")).otherwise(pick([None, "12 kB", "99999999999999999999", "", ""], F.col("doc_id") % 5))
    return t.documents.select("doc_id", oversize_reason(declared, size, 2000).alias("reason"))


@query("h11_policy_limits", f"""
SELECT l_orderkey, l_partkey, status, CASE WHEN status = 404 OR status IS NULL OR status >= 500 THEN 'retry' WHEN status BETWEEN 400 AND 499 THEN 'permanent_failure' ELSE 'success' END AS decision
FROM (SELECT *, {STATUS_SQL} AS status FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    """A policy other than the default; invalid ones raise before any job starts (see the tests)."""
    policy = H.RetryPolicy(max_attempts=1, retry_statuses=frozenset({404}))
    return attempts(t).select("l_orderkey", "l_partkey", "status", H.classify_status(F.col("status"), policy).alias("decision"))


@query("b17_safe_error_label", f"SELECT l_orderkey, l_partkey, 'HTTPError' || coalesce('(status=' || {STATUS_SQL} || ')', '') AS label FROM lineitem")
def _(t: Tables) -> DataFrame:
    return attempts(t).select("l_orderkey", "l_partkey", safe_error_label(F.lit("HTTPError"), F.col("status")).alias("label"))
