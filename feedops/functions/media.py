"""Media columns: signatures, file names, sizes, dimensions and admission rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedops.functions.expr import let
from feedops.functions.urls import basename

MIB = 1024 * 1024


@dataclass(frozen=True)
class MediaLimits:
    """Fixed default limits; two different pixel limits exist on purpose (source and feed)."""

    discord_bytes: int = 10 * MIB
    telegram_bytes: int = 10 * MIB
    download_bytes: int = 15 * MIB
    ingest_bytes: int = 12 * MIB
    feed_image_bytes: int = 12 * MIB
    feed_total_bytes: int = 256 * MIB
    source_pixels: int = 24_000_000
    feed_pixels: int = 12_000_000
    thumbnail_width: int = 480


def sniff_type(content: Column) -> Column:
    """File extension by leading bytes, NULL when not a recognised image."""

    def by_head(head: Column) -> Column:
        return (
            F.when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
            .when(head.startswith("FFD8FF"), F.lit("jpg"))
            .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
            .when(head.startswith("424D"), F.lit("bmp"))
        )

    return let(F.hex(F.substring(content, 1, 12)), by_head)


def media_type(extension: Column) -> Column:
    """MIME type of a sniffed extension."""
    return F.concat(F.lit("image/"), F.when(extension == "jpg", F.lit("jpeg")).otherwise(extension))


def expected_type_ok(expected: Column, extension: Column) -> Column:
    """No expectation, the generic ``image``, or the sniffed extension itself."""
    bare = F.regexp_replace(F.lower(expected), "^image/", "")
    wanted = F.when(bare == "jpeg", F.lit("jpg")).otherwise(bare)
    return F.when(F.coalesce(expected, F.lit("")) == "", F.lit(True)).otherwise(
        (wanted == "image") | (wanted == F.coalesce(extension, F.lit("")))
    )


def fix_extension(filename: Column, extension: Column) -> Column:
    """Make the file name's extension agree with the sniffed one."""
    pattern = r"(?s)^(\.*[^.].*)(\.[^.]*)$"

    def build(name: Column) -> Column:
        found = F.lower(F.regexp_extract(name, pattern, 2))
        stem = F.when(found == "", name).otherwise(F.regexp_extract(name, pattern, 1))
        same = (found == F.concat(F.lit("."), extension)) | ((extension == "jpg") & (found == ".jpeg"))
        return F.when(same, name).otherwise(F.concat(stem, F.lit("."), extension))

    cut = F.left(basename(F.coalesce(filename, F.lit(""))), F.lit(255))
    return F.when(extension.isNotNull(), let(F.when(cut == "", F.lit("image")).otherwise(cut), build))


def content_hash(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content, 256)


def is_gif(filename: Column, content_head_type: Column) -> Column:
    """GIF by the last dotted part of the name, or by signature."""
    return (F.lower(F.regexp_extract(filename, r"(?s)\.([^.]*)$", 1)) == "gif") | F.coalesce(
        content_head_type == "gif", F.lit(False)
    )


def size_plan(size: Column, gif: Column, compressed_size: Column, limits: MediaLimits = MediaLimits()) -> Column:
    """struct(is_gif, discord, telegram) with fits / compress / reuse per destination.

    The second destination reuses the first one's compressed result when that was made and fits.
    """
    over_discord = size > limits.discord_bytes
    over_telegram = size > limits.telegram_bytes
    reuse = over_discord & F.coalesce(compressed_size <= limits.telegram_bytes, F.lit(False))
    return F.struct(
        gif.alias("is_gif"),
        F.when(over_discord, F.lit("compress")).otherwise("fits").alias("discord"),
        F.when(~over_telegram, F.lit("fits")).when(reuse, F.lit("reuse")).otherwise("compress").alias("telegram"),
    )


def initial_scale(target: Column, size: Column, gif: Column) -> Column:
    """First down-scale guess; the square root is rounded half to even at one decimal."""
    cap = F.when(gif, F.lit(1.0)).otherwise(0.8)
    return F.least(cap, F.bround(F.sqrt(target / size), 1) + F.lit(0.1))


def recompress_target(size: Column, limit: Column) -> Column:
    """The destination's limit if known and smaller, else half the size."""
    return F.when((F.coalesce(limit, F.lit(0)) > 0) & (limit < size), limit).otherwise(F.floor(size / 2))


def web_payload_choice(original_size: Column, limits: MediaLimits = MediaLimits()) -> Column:
    """I4: send the original up to the ingest limit, the compressed copy beyond it or when there is none."""
    fits = (F.coalesce(original_size, F.lit(0)) > 0) & (original_size <= limits.ingest_bytes)
    return F.when(fits, F.lit("original")).otherwise("compressed")


def _number(content: Column, start: int, length: int, little: bool) -> Column:
    digits = F.hex(F.substring(content, start, length))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(length))])
    return F.conv(digits, 16, 10).cast("bigint")


# Segment headers looked at per block of the walk; nearly every file is decided in the first block.
_BLOCK = 64


def _jpeg_step(content: Column, state: Column) -> Column:
    """One segment header further: struct(at, width, height, open); SOF0-15 without DHT, JPG and DAC are frame headers."""

    def moved(at: Column | None, width: Column | None = None, height: Column | None = None) -> Column:
        values = (state["at"] if at is None else at, width, height, at is not None)
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for v, (n, t) in zip(values, _WALK)])

    def read(head: Column) -> Column:
        kind, at = F.substring(head, 3, 2), state["at"]
        number = lambda start: F.conv(F.substring(head, start, 4), 16, 10)
        frame = kind.between("C0", "CF") & ~kind.isin("C4", "C8", "CC")
        return (
            F.when((F.length(head) < 18) | ~head.startswith("FF") | kind.isin("D9", "DA"), moved(None))
            .when(kind == "FF", moved(at + 1))
            .when(kind.between("D0", "D8") | (kind == "01"), moved(at + 2))
            .when(frame, moved(None, number(15), number(11)))
            .otherwise(moved(at + 2 + number(5).cast("bigint")))
        )

    # The header is bound by a lambda, so it is cut out of the file once per step.
    head = F.hex(content.substr(state["at"].cast("int") + 1, F.lit(9)))
    return F.when(state["open"], F.get(F.transform(F.array(head), read), 0)).otherwise(state)


_WALK = (("at", "bigint"), ("width", "bigint"), ("height", "bigint"), ("open", "boolean"))


def _jpeg_dims(content: Column) -> Column:
    """Walk the segment headers of a file, nine bytes at a time, until a frame header; struct with NULL sizes where none is found.

    A step moves at least one byte, so blocks for the file's length always suffice; a decided file's further blocks are empty.
    """
    nothing = F.lit(None).cast("bigint")
    start = F.struct(F.lit(2).cast("bigint").alias("at"), nothing.alias("width"), nothing.alias("height"), F.coalesce(F.hex(F.substring(content, 1, 2)) == "FFD8", F.lit(False)).alias("open"))
    steps, none = F.sequence(F.lit(1), F.lit(_BLOCK)), F.array().cast("array<int>")
    block = lambda state, _: F.aggregate(F.when(state["open"], steps).otherwise(none), state, lambda s, _: _jpeg_step(content, s))
    first = block(start, None)
    blocks = F.sequence(F.lit(0), (F.octet_length(content) / _BLOCK).cast("int"))
    bound = lambda s: F.aggregate(F.when(s["open"], blocks).otherwise(none), s, block)
    return F.get(F.transform(F.array(first), bound), 0)


def image_dims(content: Column, extension: Column, jpeg: bool = True) -> Column:
    """struct(width, height) from the header; NULL fields when unreadable.

    All formats are read in the JVM, from the few bytes that hold a header.
    """
    png = (_number(content, 17, 4, False), _number(content, 21, 4, False))
    gif = (_number(content, 7, 2, True), _number(content, 9, 2, True))
    signed_height = _number(content, 23, 4, True)
    bmp = (_number(content, 19, 4, True), F.when(signed_height >= 1 << 31, F.lit(1 << 32) - signed_height).otherwise(signed_height))
    kind = F.hex(F.substring(content, 13, 4))
    packed = _number(content, 22, 4, True)
    webp = tuple(
        F.when(kind == "56503858", _number(content, 25 + 3 * axis, 3, True) + 1)
        .when(kind == "56503820", _number(content, 27 + 2 * axis, 2, True).bitwiseAND(F.lit(0x3FFF)))
        .when(kind == "5650384C", F.shiftright(packed, 14 * axis).bitwiseAND(F.lit(0x3FFF)) + 1)
        for axis in (0, 1)
    )
    choices = {"png": png, "gif": gif, "bmp": bmp, "webp": webp}
    if jpeg:
        walked = _jpeg_dims(F.when(extension == "jpg", content))
        choices["jpg"] = (walked["width"], walked["height"])

    def pick(axis: int) -> Column:
        branch = F.lit(None).cast("bigint")
        for name, pair in choices.items():
            branch = F.when(extension == name, pair[axis]).otherwise(branch)
        return branch

    return F.struct(pick(0).alias("width"), pick(1).alias("height"))


def pixel_gate(width: Column, height: Column, max_pixels: int) -> Column:
    """Both sides positive and the area within the limit."""
    return F.coalesce((width > 0) & (height > 0) & (width * height <= max_pixels), F.lit(False))


def needs_thumbnail(width: Column, animated: Column, thumbnail_width: int = MediaLimits.thumbnail_width) -> Column:
    """I8: wide still images only; a width of 0 turns thumbnails off."""
    if thumbnail_width <= 0:
        return F.lit(False)
    return (width > thumbnail_width) & ~animated


def thumbnail_box(thumbnail_width: int = MediaLimits.thumbnail_width) -> Column:
    """I8: bounding box of a thumbnail, four times as tall as wide."""
    return F.struct(F.lit(thumbnail_width).alias("width"), F.lit(4 * thumbnail_width).alias("height"))


def item_bytes(data_bytes: Column, thumb_bytes: Column) -> Column:
    """Memory held by a feed item."""
    return data_bytes + F.coalesce(thumb_bytes, F.lit(0))


def oversize_reason(declared: Column, actual: Column, limit: int) -> Column:
    """declared_invalid / declared_too_large / body_too_large, NULL when acceptable."""
    text = F.trim(F.coalesce(declared, F.lit("")))
    # Whole numbers too long for a bigint are larger than any limit.
    number = F.coalesce(text.try_cast("bigint"), F.lit(2**62))
    return (
        F.when((text != "") & ~text.rlike(r"^[+-]?[0-9]+$"), F.lit("declared_invalid"))
        .when((text != "") & (number > limit), F.lit("declared_too_large"))
        .when(actual > limit, F.lit("body_too_large"))
    )


def admission_reason(declared: Column, size: Column, extension: Column, width: Column, height: Column,
                     animated: Column, compressed_size: Column, duplicate: Column, thumb_size: Column,
                     limits: MediaLimits = MediaLimits()) -> Column:
    """The first rule an arriving item fails, NULL when it is admitted.

    A still image over the per-image limit needs its compressed size to be judged; without one the answer is
    ``needs_compress``.
    """
    text = F.trim(F.coalesce(declared, F.lit("")))
    invalid = (text != "") & ~text.rlike(r"^[+-]?[0-9]+$")
    declared_size = F.coalesce(text.try_cast("bigint"), F.lit(2**62))
    image_limit = min(limits.feed_image_bytes, limits.feed_total_bytes)
    supported = F.coalesce(extension.isin("jpg", "png", "gif", "webp"), F.lit(False))
    oversize = size > image_limit
    kept = F.when(oversize, compressed_size).otherwise(size)
    return (
        F.when(invalid, F.lit("400_invalid_length"))
        .when((text != "") & (declared_size > limits.ingest_bytes), F.lit("413_declared_too_large"))
        .when(size > limits.ingest_bytes, F.lit("413_body_too_large"))
        .when(~supported, F.lit("415_unsupported_format"))
        .when(~pixel_gate(width, height, limits.feed_pixels), F.lit("415_too_many_pixels"))
        .when(oversize & (animated | (extension == "gif")), F.lit("413_animated_too_large"))
        .when(oversize & compressed_size.isNull(), F.lit("needs_compress"))
        .when(kept > image_limit, F.lit("413_image_too_large"))
        .when(duplicate, F.lit("duplicate"))
        .when(item_bytes(kept, thumb_size) > limits.feed_total_bytes, F.lit("413_over_capacity"))
    )
