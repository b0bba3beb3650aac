"""Text and display columns: titles, message fields, ages, sources, safe labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field limits of a feed item, and the two source names.
FILENAME_LIMIT, TITLE_LIMIT, LINK_LIMIT, GALLERY_LIMIT = 255, 500, 2048, 100
SINGLE_SOURCE, MULTI_SOURCE = "dcinside", "arcalive"
MULTI_GALLERY_PREFIX = "arca_"
# Display texts for ages and footers.
AGE_NOW, AGE_MINUTES, AGE_HOURS, AGE_DAYS = "방금", "분 전", "시간 전", "일 전"
FOOTER_SEPARATOR, FOOTER_COUNT = " · ", "개 이미지"


def safe_error_label(error_type: Column, status: Column) -> Column:
    """Type and status only, never the URL or the body."""
    return F.concat(
        error_type,
        F.when(status.isNotNull(), F.concat(F.lit("(status="), status.cast("string"), F.lit(")"))).otherwise(""),
    )


def cut(text: Column, limit: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(limit))


def truncate_fields(item_id: Column, filename: Column, title: Column, link: Column, gallery: Column) -> dict[str, Column]:
    """Stored field lengths; a missing file name falls back to the id."""
    named = F.when(F.coalesce(filename, F.lit("")) == "", item_id).otherwise(filename)
    return {
        "filename": cut(named, FILENAME_LIMIT),
        "title": cut(title, TITLE_LIMIT),
        "link": cut(link, LINK_LIMIT),
        "gallery": cut(gallery, GALLERY_LIMIT),
    }


def display_title(title: Column, index: Column) -> Column:
    """Later items of a post carry their number."""
    return F.when(index == 0, title).otherwise(F.concat(title, F.lit(" - "), (index + 1).cast("string")))


def display_link(link: Column, index: Column) -> Column:
    """Only the first item links back."""
    return F.when(index == 0, F.coalesce(link, F.lit(""))).otherwise("")


def footer(source_label: Column, batch_size: Column) -> Column:
    return F.concat(source_label, F.lit(FOOTER_SEPARATOR), batch_size.cast("string"), F.lit(FOOTER_COUNT))


def source_of(config_type: Column) -> Column:
    """Source name from the gallery's configured type."""
    return F.when(F.coalesce(config_type, F.lit("")) == "arca", F.lit(MULTI_SOURCE)).otherwise(SINGLE_SOURCE)


def source_of_gallery(gallery: Column) -> Column:
    """The feed page goes by the gallery's name prefix."""
    return F.when(F.coalesce(gallery, F.lit("")).startswith(MULTI_GALLERY_PREFIX), F.lit(MULTI_SOURCE)).otherwise(
        SINGLE_SOURCE
    )


def matches_source_filter(gallery: Column, wanted: str) -> Column:
    """An empty filter shows everything."""
    if wanted == "":
        return F.lit(True)
    return source_of_gallery(gallery) == (MULTI_SOURCE if wanted == MULTI_SOURCE else SINGLE_SOURCE)


def relative_age(created_us: Column, now_us: Column) -> Column:
    """Coarse age label from two epoch-microsecond columns."""
    seconds = F.floor((now_us - created_us) / 1_000_000)
    return (
        F.when(seconds < 60, F.lit(AGE_NOW))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(AGE_MINUTES)))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(AGE_HOURS)))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(AGE_DAYS)))
    )


def aspect_ratio(width: Column, height: Column) -> Column:
    """Height over width, 1 when either is unknown."""
    return F.when((width > 0) & (height > 0), height / width).otherwise(F.lit(1.0))


def client_ip(header_ip: Column, socket_ip: Column) -> Column:
    """Proxy header first, then the socket, then a fixed placeholder."""
    return F.coalesce(F.when(header_ip != "", header_ip), F.when(socket_ip != "", socket_ip), F.lit("unknown"))


def ledger_key(kind: str, identifier: Column) -> Column:
    """L1: namespaced key; NULL for an empty or missing identifier (callers quarantine those rows)."""
    if kind not in ("post", "image"):
        raise ValueError("ledger keys are of kind 'post' or 'image'")
    return F.when(identifier != "", F.concat(F.lit(f"{kind}:"), identifier))
