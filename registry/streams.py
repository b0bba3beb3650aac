"""The streaming operators, run to the end of the given tables (available-now) and read back.

Sources are file streams over a table's file; results go to a fresh folder below the session's checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.expr import micros
from feedops.operators.ledger import LEDGER_SCHEMA, ledger_rows
from feedops.session import scratch_folder
from feedops.sources.tables import append_ledger, read_scan_events
from feedops.streaming import jobs
from registry.base import Tables, query
from registry.dedup import DEDUP_SQL, GAP, LIMIT, RATE_SQL, WINDOW, _limit_sql
from registry.delivery import FAN_OUT_SQL, joined, messages
from registry.scanlog import SCAN_SQL, request_log, shown_events
from registry.selection import FEED_SQL, MAX_BYTES, MAX_ITEMS, PROFILE, TTL, _LEDGER_SQL, _selection_sql, label_ledger


def incoming(t: Tables, name: str) -> DataFrame:
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def folders(t: Tables) -> tuple[str, str]:
    """(result folder, checkpoint folder) of one run."""
    root = f"{scratch_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def event_stream(t: Tables) -> DataFrame:
    return incoming(t, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", micros(F.col("ts")).alias("t_us"),
                                        F.get_json_object("props", "$.k").alias("image_id"))


@query("k1_stream_new_posts", _selection_sql("true"))
def _(t: Tables) -> DataFrame:
    """Every crawl is spread over six files, and every batch takes one of them."""
    out, checkpoint = folders(t)
    append_ledger(label_ledger(t), f"{out}-ledger")
    listing = t.documents.select(
        F.lit("board").alias("source"), F.col("source").alias("gallery"), F.lit(1).alias("crawl_id"), (-F.col("doc_id")).alias("list_pos"),
        F.col("doc_id").cast("string").alias("post_id"), "doc_id", F.lit(True).alias("has_image"))
    sizes = t.documents.groupBy(F.col("source").alias("gallery")).agg(F.count(F.lit(1)).alias("crawl_rows"))
    listing = listing.join(sizes, listing["gallery"].eqNullSafe(sizes["gallery"])).drop(sizes["gallery"])
    listing.repartition(6, "doc_id").write.parquet(f"{out}-landing")
    rows = t.spark.readStream.schema(listing.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}-landing")
    jobs.stream_new_posts(rows, t.spark, f"{out}-ledger", out, checkpoint, PROFILE, expected="crawl_rows").awaitTermination()
    return t.spark.read.schema("gallery string, doc_id bigint").parquet(out).select("gallery", "doc_id")


@query("k2_stream_rate_limit", RATE_SQL)
def _(t: Tables) -> DataFrame:
    out, checkpoint = folders(t)
    jobs.stream_rate_limit(event_stream(t), t.spark, out, checkpoint, "user_id", WINDOW, LIMIT).awaitTermination()
    found = t.spark.read.schema("id bigint, user_id bigint, anchor bigint, limited boolean").parquet(out)
    return found.select(F.col("id").alias("event_id"), "user_id", "anchor", "limited")


@query("k3_stream_dedup", DEDUP_SQL)
def _(t: Tables) -> DataFrame:
    out, checkpoint = folders(t)
    keyed = event_stream(t).withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    jobs.stream_dedup(keyed, t.spark, out, checkpoint, "key", GAP).awaitTermination()
    return t.spark.read.schema("id bigint, user_id bigint, event_type string").parquet(out).select(F.col("id").alias("event_id"), "user_id", "event_type")


@query("a7_stream_outbox", f"""WITH {FAN_OUT_SQL} SELECT DISTINCT gallery, post_id, batch_idx, transport, destination_id, requested_media FROM messages""")
def _(t: Tables) -> DataFrame:
    """Every message is offered in two of six batches and goes out once. Each offer lands as files by post, and a batch takes a third of them."""
    out, checkpoint = folders(t)
    parts = 3 * -(-int(t.spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    offered = messages(t, parts)
    offered.write.parquet(f"{out}-landing")
    landed = t.spark.read.schema(offered.schema).parquet(f"{out}-landing")
    third = max(1, -(-len(landed.inputFiles()) // 3))
    landed.repartition(parts, "post_id").write.mode("append").parquet(f"{out}-landing")
    stream = t.spark.readStream.schema(offered.schema).option("maxFilesPerTrigger", third).parquet(f"{out}-landing")
    jobs.stream_outbox(stream, t.spark, out, checkpoint).awaitTermination()
    found = t.spark.read.schema(offered.schema).parquet(out)
    return found.select("gallery", "post_id", "batch_idx", "transport", "destination_id", joined("requested_media"))


@query("k4_stream_recent_store", f"WITH {FEED_SQL.replace('+ 60000000', '')} SELECT seq, created_us, bytes FROM store")
def _(t: Tables) -> DataFrame:
    out, checkpoint = folders(t)
    arrivals = incoming(t, "events").select(F.col("event_id").alias("seq"), micros(F.col("ts")).alias("created_us"),
                                            F.round(F.col("value") * 1000).cast("bigint").alias("bytes"))
    jobs.stream_recent_store(arrivals, t.spark, out, checkpoint, ttl_seconds=TTL, max_items=MAX_ITEMS, max_bytes=MAX_BYTES).awaitTermination()
    stored = t.spark.read.schema("seq bigint, created_us bigint, bytes bigint, batch bigint").parquet(out)
    newest = stored.agg(F.max("batch")).first()[0]  # every batch holds the whole bounded store; the last one counts
    return stored.where(F.col("batch") == newest).drop("batch")


@query("k5_stream_like_counts", _limit_sql(WINDOW, LIMIT) + " SELECT image_id, count(DISTINCT user_id) AS likes FROM judged WHERE NOT limited GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out, checkpoint = folders(t)
    jobs.stream_like_counts(event_stream(t), t.spark, out, checkpoint, "user_id", "image_id", WINDOW, LIMIT).awaitTermination()
    return t.spark.read.schema("image_id string, likes bigint").parquet(out).groupBy("image_id").agg(F.sum("likes").alias("likes"))


@query("k6_stream_scan_events", SCAN_SQL + " AND NOT starts_with(path, '/internal/')")
def _(t: Tables) -> DataFrame:
    out, checkpoint = folders(t)
    jobs.stream_scan_events(request_log(incoming(t, "events")), out, checkpoint).awaitTermination()
    return shown_events(read_scan_events(t.spark, out))


@query("k7_stream_acknowledge", f"WITH {_LEDGER_SQL} SELECT gallery_name, delivery_key, min(delivered_us) AS delivered_us FROM led GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """Acknowledged posts become ledger rows once, however often the same rows are offered."""
    out, checkpoint = folders(t)
    t.spark.createDataFrame([], LEDGER_SCHEMA).write.partitionBy("source", "gallery_name").parquet(out)
    rows = incoming(t, "orders").select(F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("o_custkey") % 3).cast("string")).alias("gallery"),
                                        "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    acknowledged, _ = ledger_rows(rows, "post", "o_custkey", F.col("at"))
    for attempt in ("first", "replay"):
        jobs.stream_acknowledge(acknowledged, t.spark, out, f"{checkpoint}-{attempt}").awaitTermination()
    found = t.spark.read.schema(LEDGER_SCHEMA).parquet(out)
    return found.select("gallery_name", "delivery_key", F.unix_micros("delivered_at").alias("delivered_us"))
