"""Request-log columns: scanner signatures, categories and response shapes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedops.functions.expr import let

# Crawler and script signatures, in matching order.
CRAWLER_SIGNATURES = (
    "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "anthropic-ai", "Claude-Web", "Google-Extended",
    "GoogleOther", "Bytespider", "PerplexityBot", "Perplexity-User", "cohere-ai", "Amazonbot", "Applebot-Extended",
    "CCBot", "Diffbot", "ImagesiftBot", "Meta-ExternalAgent", "meta-externalagent", "FacebookBot", "Falkor", "awario",
    "Barkrowler", "DataForSeoBot", "AhrefsBot", "SemrushBot", "MJ12bot", "PetalBot", "PiplBot", "Scrapy",
    "python-requests", "python-urllib", "curl", "wget", "Go-http-client", "okhttp", "httpclient", "PostmanRuntime",
    "insomnia", "httpx", "aiohttp", "node-fetch", "undici", "axios",
)
# Browser, link-preview and search-engine tokens.
BROWSER_TOKENS = (
    "chrome/", "chromium/", "crios/", "safari/", "firefox/", "fxios/", "edg/", "edge/", "edgios/", "edga/",
    "samsungbrowser/", "discordbot", "facebookexternalhit", "kakao", "telegram", "naver", "googlebot", "bingbot",
    "applebot", "testclient",
)
# Paths by category.
CREDENTIAL_PATHS = (
    "/.env", "/.git/config", "/.aws/credentials", "/credentials.json", "/config.json", "/wp-config.php",
)
EXPLOIT_PATHS = (
    "/cgi-bin", "/wp-admin", "/wp-login.php", "/admin", "/phpinfo.php", "/server-status", "/manager/html", "/trace",
    "/console",
)
API_PATHS = (
    "/api", "/api/v1", "/v1", "/v2", "/graphql", "/openapi.json", "/swagger.json", "/swagger-ui", "/docs", "/redoc",
    "/api/v1/chat/completions", "/v1/chat/completions", "/api/v1/models", "/v1/models", "/completions", "/embed",
    "/invoke", "/predictions",
)
PROBE_PATHS = ("/actuator", "/actuator/env", "/actuator/health", "/health", "/debug", "/metrics")


def _alternation(words: Sequence[str]) -> str:
    """A pattern for any of ``words``, grouped by first letter; within a letter the given order stays."""
    letters: dict[str, list[str]] = {}
    for word in dict.fromkeys(words):
        letters.setdefault(word[:1], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in letters.items())


def matched_signature(user_agent: Column, signatures: Sequence[str] = CRAWLER_SIGNATURES) -> Column:
    """First listed signature contained in the user agent in any case, else NULL.

    One pass over the agent finds, at every place, what begins there; the list's order then decides among the few that were found.
    """
    listed = {s.lower(): s for s in reversed(signatures)}
    lower = list(dict.fromkeys(s.lower() for s in signatures))
    found = F.regexp_extract_all(F.lower(F.coalesce(user_agent, F.lit(""))), F.lit(f"(?=({_alternation(lower)}))"), F.lit(1))
    first = F.array_position(F.array(*[F.lit(s) for s in lower]), F.get(F.array_intersect(F.array(*[F.lit(s) for s in lower]), found), F.lit(0)))
    return F.get(F.array(*[F.lit(listed[s]) for s in lower]), (first - 1).cast("int"))


def is_browser_or_preview(user_agent: Column, tokens: Sequence[str] = BROWSER_TOKENS) -> Column:
    """J2."""
    return F.lower(F.coalesce(user_agent, F.lit(""))).rlike(_alternation(tokens))


def normalize_path(path: Column) -> Column:
    """One leading slash, no trailing ones."""
    rooted = F.concat(F.lit("/"), F.regexp_replace(path, "^/+", ""))
    return F.when(rooted == "/", rooted).otherwise(F.regexp_replace(rooted, "/+$", ""))


def classified(signature: Column, browser: Column, path: Column) -> Column:
    """J4 from its parts: struct(category, matched_signature), both NULL for ordinary traffic."""
    low = F.lower(path)
    category = (
        F.when(signature.isNull() & browser, F.lit(None).cast("string"))
        .when(low.isin(*CREDENTIAL_PATHS), F.lit("credential-hunter"))
        .when(low.isin(*EXPLOIT_PATHS) | low.startswith("/cgi-bin/"), F.lit("exploit-scanner"))
        .when(low.isin(*API_PATHS), F.lit("api-scanner"))
        .when(low.isin(*PROBE_PATHS) | low.startswith("/actuator/"), F.lit("probe"))
        .when(signature.isNotNull(), F.lit("ai-crawler"))
    )
    by_agent = (category == "ai-crawler") & (low != "/robots.txt")
    matched = F.when(by_agent, signature).when(category.isNotNull(), path)
    return F.struct(category.alias("category"), matched.alias("matched_signature"))


def classify_request(user_agent: Column, path: Column) -> Column:
    """struct(category, matched_signature), both NULL for ordinary traffic."""
    parts = F.struct(matched_signature(user_agent).alias("signature"), is_browser_or_preview(user_agent).alias("browser"), normalize_path(path).alias("path"))
    return let(parts, lambda s: classified(s["signature"], s["browser"], s["path"]))


def response_shape(path: Column, status: Column) -> Column:
    """Label of the answer given for a path."""
    low = F.lower(F.concat(F.lit("/"), F.regexp_replace(path, "^/+", "")))
    trimmed = F.regexp_replace(low, "/+$", "")

    def shape(p: Column) -> Column:
        return (
            F.when(p.isin("/api/v1/chat/completions", "/v1/chat/completions"), F.lit("decoy-chat-completion"))
            .when(p.isin("/api/v1/models", "/v1/models"), F.lit("decoy-model-list"))
            .when(p == "/graphql", F.lit("decoy-graphql"))
            .when(p.isin("/openapi.json", "/swagger.json"), F.lit("decoy-openapi"))
            .when(p == "/.git/config", F.lit("decoy-git-config"))
            .when(p.isin(*CREDENTIAL_PATHS), F.lit("decoy-credentials"))
            .when(p.startswith("/actuator"), F.lit("decoy-actuator"))
            .when(p.isin("/wp-admin", "/wp-login.php", "/admin"), F.lit("decoy-login"))
            .when(p.isin("/api", "/api/v1", "/v1", "/v2"), F.lit("decoy-api-index"))
            .when(status == 404, F.lit("decoy-not-found"))
            .otherwise("decoy-generic")
        )

    return let(F.when(trimmed == "", F.lit("/")).otherwise(trimmed), shape)
