"""URL columns: parts, resolution, allow-lists, variants, canonical links.

All of it stays in the JVM. The split follows the generic URI grammar by one regular expression per part, so user info,
ports and odd hosts are seen exactly as written instead of being rejected by a stricter parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedops.functions.expr import first_nonblank, let

_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@dataclass(frozen=True)
class UrlPolicy:
    """Which media hosts are acceptable.

    A host passes when it is listed, or ends with a suffix and (if given) its first label fully matches ``label``.
    ``strict_user`` rejects an empty user name (``https://@host``) too.
    """

    hosts: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    label: str | None = None
    strict_user: bool = False


# The media hosts of the two source profiles.
MULTI_MEDIA = UrlPolicy(hosts=("arca.live", "ac-o.arca.live", "ac.arca.live"), suffixes=(".namu.la",))
SINGLE_MEDIA = UrlPolicy(suffixes=(".dcinside.com", ".dcinside.co.kr"), label="dcimg[0-9]*|[0-9]+", strict_user=True)
# Site roots, origin and thumbnail hosts, and the known original extensions.
SINGLE_BASE = "https://gall.dcinside.com"
MULTI_BASE = "https://arca.live"
ORIGIN_HOST = "ac-o.arca.live"
THUMBNAIL_HOST = "ac.arca.live"
PREVIEW_HOST_PATTERN = r"^ac-p[0-9]*\.namu\.la$"
PREVIEW_ORIGIN_HOST = "ac-o.namu.la"
ORIGINAL_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")


_SEPARATOR = "\x01"
_PARTS = ("scheme", "authority", "path", "query", "fragment")


def clean(url: Column) -> Column:
    """Drop what URL parsers ignore: leading blanks or control characters, and tabs or newlines anywhere."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_parts(url: Column | str) -> Column:
    """struct(raw, scheme, authority, path, query, fragment); missing parts are empty strings.

    One regular expression marks the borders and one split cuts them; a Python string is parsed on the driver.
    """
    if isinstance(url, str):
        found = re.match(_URI, url).groups(default="")
        return F.struct(F.lit(url).alias("raw"), F.lit(found[0].lower()).alias("scheme"),
                        *[F.lit(v).alias(n) for v, n in zip(found[1:], _PARTS[1:], strict=True)])
    marked = _SEPARATOR.join(f"${i}" for i in range(1, 6))

    def split(u: Column) -> Column:
        pieces = F.split(F.regexp_replace(u, _URI, marked), _SEPARATOR, -1)

        def named(p: Column) -> Column:
            return F.struct(u.alias("raw"), F.lower(F.get(p, F.lit(0))).alias("scheme"),
                            *[F.get(p, F.lit(i)).alias(name) for i, name in enumerate(_PARTS) if i])

        return let(pieces, named)

    return let(clean(url), split)


def host_of(authority: Column) -> Column:
    return F.lower(F.ltrim(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*|[^:]*)", 1), F.lit("[")))


def _has_port(authority: Column) -> Column:
    """True for any text after the host's colon; a bare trailing colon is not a port."""
    return authority.contains(":") & authority.rlike(r"^(?:.*@)?(?:\[[^\]]*\]|[^:]*):.+$")


def _has_user(authority: Column) -> Column:
    """True for a user or password; an empty one (``https://@host``) does not count."""
    return authority.contains("@") & ~authority.rlike(r"^:?@[^@]*$")


def unsplit(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    url = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        F.when((authority != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    if fragment is None:
        return url
    return F.concat(url, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def _fold_segments(segments: Column) -> Column:
    """Remove ``.`` and ``..`` from an array of path segments and join it again."""
    empty = F.array().cast("array<string>")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    joined = F.array_join(F.concat(F.aggregate(segments, empty, step), tail), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def resolve(base: Column | str, href: Column) -> Column:
    """Resolve a possibly relative reference against a base URL."""

    def joined(pair: Column) -> Column:
        b, r = pair["b"], pair["r"]
        directory = F.regexp_replace(b["path"], r"[^/]*$", "")
        merged = F.concat(F.when(directory == "", F.lit("/")).otherwise(directory), r["path"])
        relative = F.regexp_replace(merged, r"/{2,}", "/")
        path = F.when(r["path"].startswith("/"), r["path"]).otherwise(relative)
        folded = _fold_segments(F.split(path, "/", -1))
        query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        return (
            F.when(r["raw"] == "", b["raw"])
            .when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), r["raw"])
            .when(r["authority"] != "", unsplit(b["scheme"], r["authority"], r["path"], r["query"], r["fragment"]))
            .when(r["path"] == "", unsplit(b["scheme"], b["authority"], b["path"], query, r["fragment"]))
            .otherwise(unsplit(b["scheme"], b["authority"], folded, r["query"], r["fragment"]))
        )

    return let(F.struct(url_parts(base).alias("b"), url_parts(href).alias("r")), joined)


def _policy_pattern(policy: UrlPolicy) -> str:
    """The whole policy as one pattern: scheme, user, host, no port, and the end of the authority."""
    anything = r"[^/?#@:\[\]]*"
    hosts = [re.escape(host) for host in policy.hosts]
    for suffix in policy.suffixes:
        front = anything if policy.label is None else rf"(?:{policy.label})(?:\.{anything})?"
        hosts.append(front + re.escape(suffix))
    user = "" if policy.strict_user else "(?::?@)?"
    return rf"(?i)^https://{user}(?:{'|'.join(hosts)}):?(?:[/?#]|$)"


def is_allowed_url(url: Column, policy: UrlPolicy) -> Column:
    """Https, no user info, no port, and an acceptable host."""
    return F.coalesce(clean(url).rlike(_policy_pattern(policy)), F.lit(False))


def query_param(query: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; NULL if there is none."""
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def post_id_from_query(url: Column, name: str = "no") -> Column:
    """B5, single profile: the post number is a query parameter."""
    return let(url_parts(url), lambda p: query_param(p["query"], name))


def post_id_from_path(url: Column, pattern: str = r"/b/[^/]+/([0-9]+)") -> Column:
    """B5, multi profile: the post number is a path segment; NULL when absent."""
    found = F.regexp_extract(url, pattern, 1)
    return F.when(found != "", found)


def canonical_link(base: str, href: Column, host: str, scheme: str = "https") -> Column:
    """Absolute link on exactly this host without user, port or fragment; else NULL."""

    def check(p: Column) -> Column:
        good = (
            (p["scheme"] == scheme)
            & (host_of(p["authority"]) == host)
            & ~_has_user(p["authority"])
            & ~_has_port(p["authority"])
        )
        return F.when(good, unsplit(p["scheme"], p["authority"], p["path"], p["query"]))

    return F.when(href != "", let(url_parts(resolve(base, href)), check))


def board_link(base: str, href: Column, host: str, param: str = "no") -> Column:
    """B6, single profile: only the host and the presence of the post number are checked."""

    def check(p: Column) -> Column:
        good = (host_of(p["authority"]) == host) & query_param(p["query"], param).isNotNull()
        return F.when(good, p["raw"])

    return let(url_parts(resolve(base, href)), check)


def original_variant(url: Column) -> Column:
    """Preview host to origin host, and ask for the original file except on the thumbnail host."""

    def build(p: Column) -> Column:
        host = host_of(p["authority"])
        authority = F.when(host.rlike(PREVIEW_HOST_PATTERN), F.lit(PREVIEW_ORIGIN_HOST)).otherwise(p["authority"])
        keep = (host == THUMBNAIL_HOST) | F.array_contains(F.split(p["query"], "&"), "type=orig")
        query = (
            F.when(keep, p["query"])
            .when(p["query"] == "", F.lit("type=orig"))
            .otherwise(F.concat(F.lit("type=orig&"), p["query"]))
        )
        return unsplit(p["scheme"], authority, p["path"], query)

    return let(url_parts(url), build)


def thumbnail_variant(url: Column) -> Column:
    """Origin-host URL moved to the thumbnail host without ``type=`` parameters; other URLs unchanged."""

    def build(p: Column) -> Column:
        kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~q.startswith("type="))
        moved = unsplit(p["scheme"], F.lit(THUMBNAIL_HOST), p["path"], F.array_join(kept, "&"))
        return F.when(host_of(p["authority"]) == ORIGIN_HOST, moved).otherwise(p["raw"])

    return let(url_parts(url), build)


def extension_variant(url: Column, extension: Column) -> Column:
    """The same URL with its last path extension replaced; unchanged if the last segment has none."""

    def build(p: Column) -> Column:
        has_extension = F.regexp_extract(p["path"], r"([^/]*)$", 1).contains(".")
        path = F.concat(F.regexp_replace(p["path"], r"[^.]*$", ""), extension)
        return F.when(has_extension, unsplit(p["scheme"], p["authority"], path, p["query"])).otherwise(p["raw"])

    return let(url_parts(url), build)


def ordered_candidates(data_original: Column, src: Column, data_orig: Column, base: str = MULTI_BASE,
                       policy: UrlPolicy = MULTI_MEDIA) -> Column:
    """Allowed URLs of one media element in download order (first is primary, the rest are fallbacks)."""
    wanted = F.regexp_replace(F.lower(F.coalesce(data_orig, F.lit(""))), r"^\.+", "")
    extension = F.when(wanted.isin(*ORIGINAL_EXTENSIONS), wanted).otherwise("")
    sources = F.filter(F.array(F.coalesce(data_original, F.lit("")), F.coalesce(src, F.lit(""))), lambda s: s != "")

    def variants(source: Column) -> Column:
        def from_resolved(resolved: Column) -> Column:
            def from_original(original: Column) -> Column:
                return F.when(
                    extension != "", F.array(extension_variant(original, extension), original, resolved)
                ).otherwise(F.array(original, resolved))

            return let(original_variant(resolved), from_original)

        return let(resolve(base, source), from_resolved)

    allowed = F.array_distinct(F.filter(F.flatten(F.transform(sources, variants)), lambda u: is_allowed_url(u, policy)))

    def with_thumbnail(urls: Column) -> Column:
        head = F.get(urls, F.lit(0))

        def insert(thumb: Column) -> Column:
            new = ~F.array_contains(urls, thumb) & is_allowed_url(thumb, policy)
            return F.when(new, F.concat(F.array(head, thumb), F.slice(urls, 2, F.greatest(F.size(urls), F.lit(1))))).otherwise(urls)

        return F.when(F.size(urls) == 0, urls).otherwise(let(thumbnail_variant(head), insert))

    return let(allowed, with_thumbnail)


def without_query(url: Column) -> Column:
    """F3 key: scheme, authority and path only."""
    bare = F.regexp_replace(clean(url), r"(?s)[?#].*$", "")
    scheme_end = F.instr(bare, ":")
    return F.concat(F.lower(F.substring(bare, F.lit(1), scheme_end)), F.substring(bare, scheme_end + 1, F.length(bare)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and keeps malformed input as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_basename(url: Column) -> Column:
    return let(url_parts(url), lambda p: basename(unquote(p["path"])))


def filename_hint(url: Column, default: Column, label: Column | None = None, limit: int | None = None) -> Column:
    """Element text if any, else the URL's file name, else a default; optionally cut."""
    choices = [url_basename(url), default]
    if label is not None:
        choices.insert(0, F.trim(label))
    name = first_nonblank(*choices)
    return F.left(name, F.lit(limit)) if limit is not None else name


def mask_credentials(url: Column) -> Column:
    """Hide ``user:password@`` in text that will be logged."""
    return F.regexp_replace(url, r"//[^/@]+@", "//***:***@")


def safe_link(url: Column) -> Column:
    """Site-relative or http(s) links only; anything else becomes an empty string."""
    good = url.rlike(r"^/([^/]|$)") | url.rlike(r"(?i)^https?://")
    return F.when(F.coalesce(good, F.lit(False)), url).otherwise("")


def source_urls(post_url: Column, *attributes: Column) -> Column:
    """Distinct resolved URLs of one element, in attribute order."""
    present = F.filter(F.array(*[F.coalesce(a, F.lit("")) for a in attributes]), lambda a: a != "")
    return F.array_distinct(F.transform(present, lambda a: resolve(post_url, a)))


