"""Signatures, sizes, dimensions and admission: documents as media, with a header in front of every text's bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions import media as M
from feedops.operators.admission import admit
from feedops.sources.blobs import hash_blobs
from registry.base import Tables, query
from registry.columns import pick_columns

KIND_SQL = "['png', 'jpg', 'gif', 'webp', 'bmp', NULL, NULL][1 + doc_id % 7]"
LIMITS = M.MediaLimits(discord_bytes=4000, telegram_bytes=3000, download_bytes=15000, ingest_bytes=9000, feed_image_bytes=6000,
                       feed_total_bytes=9000, source_pixels=4_000_000, feed_pixels=3_000_000)
# Width and height that the made header of a document claims.
SIZE_SQL = "CAST(1 + n_chars % 2000 AS BIGINT) AS width, CAST(1 + doc_id % 3000 AS BIGINT) AS height"


def _hex(value, digits: int, little: bool = False):
    big = F.lpad(F.hex(value), digits, "0")
    if not little:
        return big
    return F.concat(*[F.substring(big, i, 2) for i in range(digits - 1, 0, -2)])


def with_content(documents: DataFrame) -> DataFrame:
    """``content``: a header by document number, then the whole text."""
    w, h = 1 + F.col("n_chars") % 2000, 1 + F.col("doc_id") % 3000
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8))
    # A JPEG with an application segment in front of the frame header.
    jpg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC2001108"), _hex(h, 4), _hex(w, 4), F.lit("03"))
    gif = F.concat(F.lit("474946383961"), _hex(w, 4, True), _hex(h, 4, True))
    webp = F.concat(F.lit("524946460000000057454250565038580A00000000000000"), _hex(w - 1, 6, True), _hex(h - 1, 6, True))
    bmp = F.concat(F.lit("424D0000000000000000000000000000"), F.lit("0000"), _hex(w, 8, True), _hex(h, 8, True))
    head = pick_columns(F.col("doc_id") % 7, [png, jpg, gif, webp, bmp, F.lit("25504446"), F.lit("")])
    return documents.withColumn("content", F.concat(F.unhex(head), F.encode("text", "UTF-8")))


@query("b13_sniff_type", f"SELECT doc_id, {KIND_SQL} AS ext, 'image/' || CASE {KIND_SQL} WHEN 'jpg' THEN 'jpeg' ELSE {KIND_SQL} END AS media_type FROM documents")
def _(t: Tables) -> DataFrame:
    ext = M.sniff_type(F.col("content"))
    return with_content(t.documents).select("doc_id", ext.alias("ext"), M.media_type(ext).alias("media_type"))


@query("b14_expected_type_ok", f"""
WITH k AS (SELECT doc_id, {KIND_SQL} AS ext, [NULL, 'image', 'Image/JPEG', 'png'][1 + doc_id % 4] AS expected FROM documents)
SELECT doc_id, expected IS NULL OR expected = 'image' OR (expected = 'Image/JPEG' AND coalesce(ext, '') = 'jpg') OR (expected = 'png' AND coalesce(ext, '') = 'png') AS ok FROM k""")
def _(t: Tables) -> DataFrame:
    expected = pick_columns(F.col("doc_id") % 4, [F.lit(None).cast("string"), F.lit("image"), F.lit("Image/JPEG"), F.lit("png")])
    return with_content(t.documents).select("doc_id", M.expected_type_ok(expected, M.sniff_type(F.col("content"))).alias("ok"))


@query("i1_size_plan", f"""
WITH s AS (SELECT doc_id, octet_length(encode(text)) AS size, {KIND_SQL} AS ext, doc_id % 2 = 0 AS small FROM documents)
SELECT doc_id, coalesce(ext = 'gif', false) AS is_gif, CASE WHEN size > 4000 THEN 'compress' ELSE 'fits' END AS discord,
 CASE WHEN size <= 3000 THEN 'fits' WHEN size > 4000 AND small THEN 'reuse' ELSE 'compress' END AS telegram FROM s""")
def _(t: Tables) -> DataFrame:
    rows = with_content(t.documents).withColumn("ext", M.sniff_type(F.col("content")))
    gif = M.is_gif(F.lit("file.dat"), F.col("ext"))
    plan = M.size_plan(F.octet_length("text"), gif, F.when(F.col("doc_id") % 2 == 0, F.lit(2500)).otherwise(3500), LIMITS)
    return rows.select("doc_id", plan.alias("p")).select("doc_id", "p.*")


@query("i2_initial_scale", """
SELECT doc_id, least(CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, round_even(sqrt(1000.0::DOUBLE / octet_length(encode(text))), 1) + 0.1::DOUBLE) AS scale FROM documents WHERE octet_length(encode(text)) > 0""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("size", F.octet_length("text")).filter("size > 0")
    return rows.select("doc_id", M.initial_scale(F.lit(1000.0), F.col("size"), F.col("doc_id") % 2 == 0).alias("scale"))


@query("i3_recompress_target", """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND 1000 * (doc_id % 3) < size THEN 1000 * (doc_id % 3) ELSE size // 2 END AS target FROM (SELECT doc_id, octet_length(encode(text)) AS size FROM documents)""")
def _(t: Tables) -> DataFrame:
    limit = F.when(F.col("doc_id") % 3 > 0, 1000 * (F.col("doc_id") % 3))
    return t.documents.select("doc_id", M.recompress_target(F.octet_length("text"), limit).alias("target"))


@query("i4_web_payload_choice", "SELECT doc_id, CASE WHEN octet_length(encode(text)) BETWEEN 1 AND 9000 THEN 'original' ELSE 'compressed' END AS payload FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.web_payload_choice(F.octet_length("text"), LIMITS).alias("payload"))


@query("i5_image_dims", f"""
SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN width END AS width, CASE WHEN doc_id % 7 < 5 THEN height END AS height FROM (SELECT doc_id, {SIZE_SQL} FROM documents)""")
def _(t: Tables) -> DataFrame:
    rows = with_content(t.documents).select("doc_id", "content", M.sniff_type(F.col("content")).alias("ext"))
    return rows.select("doc_id", M.image_dims(F.col("content"), F.col("ext")).alias("d")).select("doc_id", "d.*")


@query("i6_pixel_gate", f"""
SELECT doc_id, width * height <= 24000 AS source_ok, (width - 1) * height BETWEEN 1 AND 12000 AS feed_ok FROM (SELECT doc_id, {SIZE_SQL} FROM documents)""")
def _(t: Tables) -> DataFrame:
    w, h = 1 + F.col("n_chars") % 2000, 1 + F.col("doc_id") % 3000
    return t.documents.select("doc_id", M.pixel_gate(w, h, 24_000).alias("source_ok"), M.pixel_gate(w - 1, h, 12_000).alias("feed_ok"))


@query("i8_needs_thumbnail", f"SELECT doc_id, width > 480 AND doc_id % 3 <> 0 AS thumbnail FROM (SELECT doc_id, {SIZE_SQL} FROM documents)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.needs_thumbnail(1 + F.col("n_chars") % 2000, F.col("doc_id") % 3 == 0).alias("thumbnail"))


@query("i9_item_bytes", "SELECT doc_id, octet_length(encode(text)) + CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS bytes FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.item_bytes(F.octet_length("text"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))).alias("bytes"))


# Arrivals 100 s apart, duplicates suppressed for 30,000 s.
ADMIT_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS hash, {KIND_SQL} AS ext, {SIZE_SQL}, doc_id * 100 AS t,
 ['', 'ten', '9001', ''][1 + doc_id % 4] AS declared, doc_id % 2 = 0 AS animated, CASE WHEN doc_id % 5 < 3 THEN octet_length(encode(text)) * (1 + doc_id % 5) // 3 END AS packed FROM documents),
r AS (SELECT *, CASE WHEN declared = 'ten' THEN '400_invalid_length' WHEN declared = '9001' THEN '413_declared_too_large' WHEN size > 9000 THEN '413_body_too_large'
 WHEN ext IS NULL OR ext = 'bmp' THEN '415_unsupported_format' WHEN width * height > 3000000 THEN '415_too_many_pixels' WHEN size > 6000 AND (animated OR ext = 'gif') THEN '413_animated_too_large'
 WHEN size > 6000 AND packed IS NULL THEN 'needs_compress' WHEN size > 6000 AND packed > 6000 THEN '413_image_too_large'
 WHEN CASE WHEN size > 6000 THEN packed ELSE size END + n > 9000 THEN '413_over_capacity' END AS reason FROM (SELECT d.*, CASE WHEN doc_id % 2 = 1 THEN 4000 ELSE 0 END AS n FROM d)),
ok AS (SELECT * FROM r WHERE reason IS NULL),
a AS (SELECT hash, min(t) AS t FROM ok GROUP BY 1 UNION ALL SELECT ok.hash, min(ok.t) FROM ok JOIN a ON ok.hash = a.hash AND ok.t >= a.t + 30000 GROUP BY 1)"""


def arrivals(t: Tables) -> DataFrame:
    return with_content(t.documents).select(
        "doc_id", F.col("doc_id").alias("seq"), (F.col("doc_id") * 100_000_000).alias("created_us"), M.content_hash(F.encode("text", "UTF-8")).alias("content_hash"),
        F.octet_length("text").alias("size"), M.sniff_type(F.col("content")).alias("ext"), (1 + F.col("n_chars") % 2000).alias("width"),
        (1 + F.col("doc_id") % 3000).alias("height"), (F.col("doc_id") % 2 == 0).alias("animated"),
        pick_columns(F.col("doc_id") % 4, [F.lit(""), F.lit("ten"), F.lit("9001"), F.lit("")]).alias("declared_length"),
        F.when(F.col("doc_id") % 5 < 3, F.floor(F.octet_length("text") * (1 + F.col("doc_id") % 5) / 3)).alias("compressed_size"),
        F.when(F.col("doc_id") % 2 == 1, F.lit(4000)).alias("thumb_size"))


@query("i7_admit", f"""{ADMIT_SQL}
SELECT r.doc_id, CASE WHEN r.reason IS NULL AND a.t IS NULL THEN 'duplicate' ELSE r.reason END AS reason FROM r LEFT JOIN a ON a.hash = r.hash AND a.t = r.t""")
def _(t: Tables) -> DataFrame:
    return admit(arrivals(t), LIMITS, 30_000).select("doc_id", "reason")


@query("a3_read_blobs")
def _(t: Tables) -> DataFrame:
    """The table files of the scale themselves, as fetched files; DuckDB views do not name their folder, hence no SQL."""
    found = hash_blobs(t.spark, t.folder, 1 << 30, "*.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content_hash")
