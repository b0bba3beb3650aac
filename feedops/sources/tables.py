"""Readers and writers (A1-A7). Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedops.functions.labels import source_of
from feedops.operators.ledger import LEDGER_SCHEMA
from feedops.operators.scanlog import SCAN_EVENT_SCHEMA

GALLERY_SCHEMA = "map<string, struct<base_url string, channel_ids array<string>, type string>>"
# The columns of one message batch, the finest first: sorted by them, rows mostly differ in their first bytes.
MESSAGE_BATCH = ("post_id", "batch_idx", "gallery", "source")
PAGE_SCHEMA = "page_id bigint, url string, html string"
OUTBOX_SCHEMA = (
    "source string, gallery string, post_id string, batch_idx bigint, transport string, destination_id string, "
    "requested_media array<string>, ack_eligible boolean"
)


def parse_gallery_config(texts: DataFrame, column: str = "value") -> DataFrame:
    """A1: one row per gallery from JSON objects (gallery -> settings); a plain JSON reader would make each gallery a column."""
    parsed = texts.select(F.explode(F.from_json(column, GALLERY_SCHEMA)).alias("gallery", "c"))
    return parsed.select("gallery", "c.base_url", "c.channel_ids", source_of(F.col("c.type")).alias("source"))


def read_gallery_config(spark: SparkSession, path: str) -> DataFrame:
    """A1."""
    return parse_gallery_config(spark.read.text(path, wholetext=True))


def gallery(config: DataFrame, name: str) -> DataFrame:
    """A1: one gallery's settings; an unknown name is an error."""
    found = config.filter(F.col("gallery") == name)
    if found.isEmpty():
        raise KeyError(f"unknown gallery: {name}")
    return found


def read_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    """A2: crawled pages; only the requested columns are read."""
    return spark.read.schema(schema).parquet(path)


def stream_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """A2 as a stream over a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_blobs(spark: SparkSession, path: str, max_bytes: int, glob: str = "*") -> DataFrame:
    """A3: fetched files; the length filter is pushed into the source, so larger files are never opened.

    The body check repeats the limit on what was really read.
    """
    return blob_files(spark, path, max_bytes, glob).filter(F.octet_length("content") <= max_bytes).select("path", "length", "content")


def blob_files(spark: SparkSession, path: str, max_bytes: int, glob: str = "*") -> DataFrame:
    """A3 by the length alone: a file is only opened where its content is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= max_bytes)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A4: the ledger folder is partitioned by source and gallery, so per-gallery reads prune."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """A4: append rows from ``ledger_add``."""
    _by_gallery(rows).write.mode("append").partitionBy("source", "gallery_name").parquet(path)


def _by_gallery(rows: DataFrame) -> DataFrame:
    """Gather a gallery's rows in few files; the adaptive rebalance splits a gallery that is too large for one task."""
    return rows.hint("rebalance", "source", "gallery_name")


def ledger_of(ledger: DataFrame, rows: DataFrame, gallery: str = "gallery") -> DataFrame:
    """A4: only the ledger partitions of the galleries in ``rows`` (dynamic partition pruning when ``rows`` is small)."""
    wanted = rows.select("source", F.col(gallery).alias("gallery_name")).distinct()
    return ledger.join(wanted, ["source", "gallery_name"], "left_semi")


def write_ledger_version(ledger: DataFrame, root: str) -> str:
    """A4/L4: write a whole new version next to the old one and return its path (readers switch afterwards)."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    _by_gallery(ledger).write.mode("errorifexists").partitionBy("source", "gallery_name").parquet(path)
    return path


# Fixed value: event times in JSON lines, to the microsecond with a numeric offset.
SCAN_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def write_scan_events(events: DataFrame, path: str) -> None:
    """A5: append JSON lines."""
    events.write.mode("append").option("timestampFormat", SCAN_TIME_FORMAT).json(path)


def read_scan_events(spark: SparkSession, path: str) -> DataFrame:
    """A5."""
    return spark.read.schema(SCAN_EVENT_SCHEMA).option("timestampFormat", SCAN_TIME_FORMAT).json(path)


def new_outbox_rows(messages: DataFrame, sent: DataFrame, gather: bool = False) -> DataFrame:
    """Messages not in the outbox yet, one per (post, batch, transport, destination, media).

    Where ``sent`` names the messages' post and batch, both sides are brought together by these, which needs no shuffle where they come by post; a
    batch has few messages. Within it they are sorted once by key, those sent before those offered, and one that follows its like is left out. Of a key
    128 bits are compared. ``gather`` is for sides that do not come by post: messages travel side by side with their post's and get their keys after.
    """
    by = MESSAGE_BATCH if set(MESSAGE_BATCH) <= set(sent.columns) else ("_key",)
    digest = F.unhex(F.substring("message_key", 1, 32))
    known = sent.withColumn("_key", digest).select(*dict.fromkeys((*by, "_key")))
    fields = [c for c in messages.columns if c != "message_key"]
    if gather and by == MESSAGE_BATCH:
        messages, known = messages.repartition(*by), known.repartition(*by)
    offered = messages.withColumn("message_key", message_key()).withColumn("_key", digest).withColumn("_sent", F.lit(False))
    both = offered.unionByName(known.withColumn("_sent", F.lit(True)), allowMissingColumns=True)
    before = F.lag("_key").over(Window.partitionBy(*by).orderBy("_key", F.desc("_sent")))
    fresh = both.withColumn("_before", before).filter(~F.col("_sent") & ~F.col("_key").eqNullSafe(F.col("_before")))
    return fresh.select("message_key", *fields)


def message_key() -> Column:
    """Identity of one message. Its media are part of it: after a partial delivery, the message with the media still missing is another one."""
    media = F.array_join(F.sort_array("requested_media"), "\x1e")
    parts = ["source", "gallery", "post_id", F.col("batch_idx").cast("string"), "transport", "destination_id", media]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def write_outbox(messages: DataFrame, path: str, batch_id: int) -> None:
    """Messages of one micro-batch. Overwriting its own partition makes a replayed batch harmless."""
    messages.withColumn("message_key", message_key()).dropDuplicates(["message_key"]).write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/batch={batch_id}"
    )
