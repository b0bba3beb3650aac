"""Fan-out, outcomes and acknowledgement: lineitem as media and delivery attempts of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.media import fix_extension
from feedops.operators import delivery as D
from feedops.operators import select as S
from feedops.plans.acknowledge import acknowledge
from feedops.plans.profiles import MULTI
from feedops.session import scratch_folder
from feedops.sources.tables import new_outbox_rows, parse_gallery_config, read_gallery_config
from registry.base import Tables, query
from registry.selection import MEDIA_ORDER, MEDIA_ORDER_SQL

# Three galleries of the config; a fourth one used by the media is unknown to it.
CONFIG_JSON = ('{"g0": {"base_url": "https://a.example/g0", "channel_ids": ["c1", "c2"]}, '
               '"g1": {"base_url": "https://a.example/g1", "channel_ids": ["c2"], "type": "arca"}, '
               '"g2": {"base_url": "https://a.example/g2", "channel_ids": ["c3", "c1", "c9"]}}')
CONFIG_SQL = """config AS (SELECT * FROM (VALUES ('g0', 'https://a.example/g0', ['c1', 'c2'], 'dcinside'),
 ('g1', 'https://a.example/g1', ['c2'], 'arcalive'), ('g2', 'https://a.example/g2', ['c3', 'c1', 'c9'], 'dcinside')) AS c(gallery, base_url, channel_ids, config_source))"""
# A medium is identified by its line's attributes.
MEDIA_ID_SQL = "l_partkey || '-' || l_suppkey || '-' || l_linenumber"
BATCH = 3
MEDIA_SQL = f"""{CONFIG_SQL},
m0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS post_id, 'g' || l_orderkey % 4 AS gallery, {MEDIA_ID_SQL} AS media_id, 'title ' || l_orderkey AS title,
  'https://a.example/' || l_orderkey AS link, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {MEDIA_ORDER_SQL}) - 1 AS BIGINT) AS media_idx FROM lineitem),
m AS (SELECT *, media_idx // {BATCH} AS batch_idx FROM m0)"""


def config(t: Tables) -> DataFrame:
    return parse_gallery_config(t.spark.createDataFrame([(CONFIG_JSON,)], "value string"))


def batched_media(t: Tables, parts: int | None = None) -> DataFrame:
    # The post's own columns come first: ranking, batching and grouping then share one shuffle on them.
    media = t.lineitem.select(
        F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("l_orderkey") % 4).cast("string")).alias("gallery"),
        F.col("l_orderkey").cast("string").alias("post_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("media_id"),
        F.concat(F.lit("title "), "l_orderkey").alias("title"), F.concat(F.lit("https://a.example/"), "l_orderkey").alias("link"), *MEDIA_ORDER)
    if parts:
        media = media.repartition(parts, "post_id")  # the numbering's window then needs no shuffle of its own
    batched = S.assign_batches(media, D.POST, MEDIA_ORDER, BATCH).drop(*MEDIA_ORDER)
    return batched.withColumn("media_idx", F.col("media_idx").cast("bigint")).withColumn("batch_idx", F.col("batch_idx").cast("bigint"))


def joined(name: str):
    return F.array_join(name, ",").alias(name)


@query("d3_attach_gallery_config", f"""WITH {CONFIG_SQL}
SELECT o_orderkey, 'g' || o_orderkey % 4 AS gallery, base_url, config_source, array_to_string(channel_ids, ',') AS channel_ids
FROM orders JOIN config ON config.gallery = 'g' || o_orderkey % 4""")
def _(t: Tables) -> DataFrame:
    posts = t.orders.select("o_orderkey", F.concat(F.lit("g"), (F.col("o_orderkey") % 4).cast("string")).alias("gallery"))
    return D.attach_gallery_config(posts, config(t)).select("o_orderkey", "gallery", "base_url", "config_source", joined("channel_ids"))


FAN_OUT_SQL = f"""{MEDIA_SQL},
batches AS (SELECT gallery, post_id, batch_idx, string_agg(media_id, ',' ORDER BY media_idx) AS requested_media FROM m GROUP BY ALL),
messages AS (SELECT b.gallery, post_id, batch_idx, 'discord' AS transport, unnest(channel_ids) AS destination_id, requested_media FROM batches b JOIN config USING (gallery)
 UNION ALL SELECT gallery, post_id, batch_idx, 'telegram', 'chat', media_id FROM m WHERE gallery IN (SELECT gallery FROM config)
 UNION ALL SELECT gallery, post_id, batch_idx, 'web_gallery', gallery, media_id FROM m WHERE gallery IN (SELECT gallery FROM config))"""


def messages(t: Tables, parts: int | None = None) -> DataFrame:
    """``parts`` sets the number of partitions, by post."""
    return D.fan_out(D.attach_gallery_config(batched_media(t, parts), config(t)), telegram=True, telegram_chat="chat", web_always=True)


@query("d4_fan_out", f"WITH {FAN_OUT_SQL} SELECT * FROM messages")
def _(t: Tables) -> DataFrame:
    return messages(t).select("gallery", "post_id", "batch_idx", "transport", "destination_id", joined("requested_media"))


@query("a7_delivery_outbox", f"""WITH {FAN_OUT_SQL}
SELECT DISTINCT gallery, post_id, batch_idx, transport, destination_id, requested_media FROM messages WHERE NOT (transport = 'discord' AND destination_id = 'c1')""")
def _(t: Tables) -> DataFrame:
    """Messages still to send when one channel has all of its own already; every message is offered twice."""
    from feedops.sources.tables import message_key

    offered = messages(t)
    sent = offered.filter("transport = 'discord' AND destination_id = 'c1'").withColumn("message_key", message_key())
    twice = offered.withColumn("_offer", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_offer")
    fresh = new_outbox_rows(twice, sent)
    return fresh.select("gallery", "post_id", "batch_idx", "transport", "destination_id", joined("requested_media"))


@query("b20_message_fields", f"""WITH {MEDIA_SQL}
SELECT post_id, media_id, media_idx, count(*) OVER (PARTITION BY post_id, batch_idx) AS batch_size,
 CASE WHEN media_idx = 0 THEN title END AS message_title, CASE WHEN media_idx = 0 THEN link END AS message_url,
 CASE WHEN media_idx = 0 THEN 'board · ' || count(*) OVER (PARTITION BY post_id, batch_idx) || '개 이미지' END AS message_footer FROM m""")
def _(t: Tables) -> DataFrame:
    fields = D.message_fields(batched_media(t), F.col("source"))
    return fields.select("post_id", "media_id", "media_idx", "batch_size", "message_title", "message_url", "message_footer")


@query("b19_display_title", f"""WITH {MEDIA_SQL}
SELECT post_id, media_id, CASE WHEN media_idx = 0 THEN title ELSE title || ' - ' || media_idx + 1 END AS feed_title,
 CASE WHEN media_idx = 0 THEN link ELSE '' END AS feed_link FROM m""")
def _(t: Tables) -> DataFrame:
    return D.feed_fields(batched_media(t)).select("post_id", "media_id", "feed_title", "feed_link")


# One delivery per lineitem: the return flag says how much arrived, the supplier which destination it was.
DELIVERY_SQL = """d AS (SELECT CAST(l_orderkey AS VARCHAR) AS post_id, 'g' || l_orderkey % 4 AS gallery, l_linenumber AS ordinal, 'c' || l_suppkey % 5 AS destination_id,
  ['a' || l_partkey % 3, 'b' || l_partkey % 3] AS requested_media,
  CASE l_returnflag WHEN 'A' THEN ['a' || l_partkey % 3, 'b' || l_partkey % 3] WHEN 'R' THEN ['a' || l_partkey % 3] ELSE [] END AS delivered_media,
  l_suppkey % 5 <> 4 AS ack_eligible, l_linestatus, l_shipdate FROM lineitem),
o AS (SELECT *, CASE WHEN len(requested_media) = len(delivered_media) THEN 'succeeded' WHEN len(delivered_media) > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM d)"""


def deliveries(t: Tables) -> DataFrame:
    a, b = (F.concat(F.lit(x), (F.col("l_partkey") % 3).cast("string")) for x in "ab")
    delivered = F.when(F.col("l_returnflag") == "A", F.array(a, b)).when(F.col("l_returnflag") == "R", F.array(a)).otherwise(
        F.array().cast("array<string>"))
    rows = t.lineitem.select(
        F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("l_orderkey") % 4).cast("string")).alias("gallery"),
        F.col("l_orderkey").cast("string").alias("post_id"), F.col("l_linenumber").alias("ordinal"), F.lit("discord").alias("transport"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("destination_id"), F.array(a, b).alias("requested_media"),
        delivered.alias("delivered_media"), (F.col("l_suppkey") % 5 != 4).alias("ack_eligible"), "l_linestatus", "l_shipdate")
    outcome = D.delivery_outcome(F.col("requested_media"), F.col("delivered_media"))
    return rows.withColumn("outcome", outcome).withColumn("reason", D.delivery_reason(F.col("outcome")))


@query("e1_delivery_outcome", f"WITH {DELIVERY_SQL} SELECT post_id, ordinal, destination_id, outcome, CASE WHEN outcome <> 'succeeded' THEN 'send_failed' END AS reason FROM o")
def _(t: Tables) -> DataFrame:
    return deliveries(t).select("post_id", "ordinal", "destination_id", "outcome", "reason")


@query("e2_acknowledged", f"WITH {DELIVERY_SQL} SELECT post_id, bool_or(ack_eligible AND outcome = 'succeeded') AS acknowledged FROM o GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.acknowledged(deliveries(t), ["post_id"])


STATUS_SQL = """media AS (SELECT CAST(l_orderkey AS VARCHAR) AS post_id, 'a' || l_partkey % 3 AS content_hash,
  CASE WHEN l_linenumber = 1 AND l_linestatus = 'O' THEN 'failed' WHEN l_quantity < 10 THEN 'duplicate' WHEN l_quantity < 15 THEN 'rejected' ELSE 'ready' END AS status FROM lineitem),
res AS (SELECT post_id, count(*) AS n, count(*) FILTER (status = 'ready') AS ready, bool_and(status <> 'failed') AS resolved FROM media GROUP BY 1),
acks AS (SELECT post_id, bool_or(ack_eligible AND outcome = 'succeeded') AS ack FROM o GROUP BY 1),
posts AS (SELECT CAST(o_orderkey AS VARCHAR) AS post_id, o_orderstatus <> 'F' AS has_image, o_orderpriority <> '5-LOW' AS page_available FROM orders),
p AS (SELECT posts.*, coalesce(n, 0) AS n, coalesce(ready, 0) AS ready, coalesce(resolved, true) AS resolved, coalesce(ack, false) AS ack
 FROM posts LEFT JOIN res USING (post_id) LEFT JOIN acks USING (post_id))"""
MULTI_ACK_SQL = "CASE WHEN NOT page_available THEN false WHEN n = 0 THEN true WHEN ready = 0 THEN resolved ELSE ack AND resolved END"


def posts(t: Tables) -> DataFrame:
    return t.orders.select(
        F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("o_orderkey") % 4).cast("string")).alias("gallery"),
        F.col("o_orderkey").cast("string").alias("post_id"), (F.col("o_orderstatus") != "F").alias("has_image"),
        (F.col("o_orderpriority") != "5-LOW").alias("page_available"))


def media_status(t: Tables) -> DataFrame:
    status = (F.when((F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "O"), F.lit("failed")).when(F.col("l_quantity") < 10, F.lit("duplicate"))
              .when(F.col("l_quantity") < 15, F.lit("rejected")).otherwise("ready"))
    return t.lineitem.select(
        F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("l_orderkey") % 4).cast("string")).alias("gallery"),
        F.col("l_orderkey").cast("string").alias("post_id"), F.concat(F.lit("a"), (F.col("l_partkey") % 3).cast("string")).alias("content_hash"),
        status.alias("status"))


@query("e3_post_ack_multi", f"WITH {DELIVERY_SQL}, {STATUS_SQL} SELECT post_id, {MULTI_ACK_SQL} AS post_acknowledged FROM p")
def _(t: Tables) -> DataFrame:
    return D.post_ack(posts(t), media_status(t), deliveries(t), multi=True).select("post_id", "post_acknowledged")


@query("e3_post_ack_single", f"""WITH {DELIVERY_SQL}, {STATUS_SQL}
SELECT post_id, CASE WHEN NOT has_image THEN true WHEN NOT page_available OR n = 0 OR NOT resolved THEN false WHEN ready = 0 THEN true ELSE ack END AS post_acknowledged FROM p""")
def _(t: Tables) -> DataFrame:
    return D.post_ack(posts(t), media_status(t), deliveries(t), multi=False).select("post_id", "post_acknowledged")


@query("e4_delivered_media", f"WITH {DELIVERY_SQL} SELECT DISTINCT post_id, unnest(delivered_media) AS media_id FROM o")
def _(t: Tables) -> DataFrame:
    return D.delivered_pairs(deliveries(t), ["post_id"])


@query("e4_ledger_rows_after_delivery", f"""WITH {DELIVERY_SQL}, {STATUS_SQL},
done AS (SELECT DISTINCT post_id, unnest(delivered_media) AS content_hash FROM o)
SELECT 'g' || CAST(post_id AS BIGINT) % 4 AS gallery_name, 'post:' || post_id AS delivery_key, count(*) AS n FROM p WHERE {MULTI_ACK_SQL} GROUP BY ALL
UNION ALL SELECT 'g' || CAST(post_id AS BIGINT) % 4, 'image:' || content_hash, count(*) FROM media JOIN done USING (post_id, content_hash) WHERE status = 'ready' GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    rows = acknowledge(posts(t), media_status(t), deliveries(t), MULTI, F.lit("2025-01-01").cast("timestamp"))
    return rows.groupBy("gallery_name", "delivery_key").agg(F.count(F.lit(1)).alias("n"))


@query("d4_web_rows_for_delivered", f"""WITH {DELIVERY_SQL},
acked AS (SELECT post_id FROM o GROUP BY 1 HAVING bool_or(ack_eligible AND outcome = 'succeeded')),
done AS (SELECT DISTINCT post_id, unnest(delivered_media) AS media_id FROM o),
m AS (SELECT CAST(l_orderkey AS VARCHAR) AS post_id, 'a' || l_partkey % 3 AS media_id, l_linenumber AS media_idx FROM lineitem)
SELECT post_id, media_id, media_idx, 'web_gallery' AS transport FROM m
WHERE post_id IN (SELECT post_id FROM acked) OR (post_id, media_id) IN (SELECT (post_id, media_id) FROM done)""")
def _(t: Tables) -> DataFrame:
    media = t.lineitem.select(
        F.lit("board").alias("source"), F.concat(F.lit("g"), (F.col("l_orderkey") % 4).cast("string")).alias("gallery"),
        F.col("l_orderkey").cast("string").alias("post_id"), F.lit(0).alias("batch_idx"),
        F.concat(F.lit("a"), (F.col("l_partkey") % 3).cast("string")).alias("media_id"), F.col("l_linenumber").alias("media_idx"))
    rows = D.web_rows_for_delivered(media, deliveries(t).withColumn("batch_idx", F.lit(0)))
    return rows.select("post_id", "media_id", "media_idx", "transport")


@query("d5_merge_results", f"""WITH {DELIVERY_SQL}
SELECT post_id, ordinal, destination_id, 0 AS part FROM o WHERE l_linestatus = 'O' UNION ALL SELECT post_id, ordinal, destination_id, 1 FROM o WHERE l_linestatus = 'F'
UNION ALL SELECT post_id, ordinal, destination_id, 2 FROM o WHERE l_linestatus = 'O'""")
def _(t: Tables) -> DataFrame:
    rows = deliveries(t)
    opened, final = rows.filter("l_linestatus = 'O'"), rows.filter("l_linestatus = 'F'")
    return D.merge_results(opened, final, opened).select("post_id", "ordinal", "destination_id", "part")


@query("d6_resolve_destination", f"""WITH {DELIVERY_SQL}
SELECT post_id, ordinal, destination_id, CASE WHEN destination_id IN ('c0', 'c4') THEN 'failed' ELSE outcome END AS outcome,
 CASE WHEN destination_id IN ('c0', 'c4') THEN 'channel_not_found' WHEN outcome <> 'succeeded' THEN 'send_failed' END AS reason,
 CASE WHEN destination_id IN ('c0', 'c4') THEN 0 ELSE len(delivered_media) END AS delivered, ack_eligible FROM o""")
def _(t: Tables) -> DataFrame:
    known = config(t).select(F.explode("channel_ids").alias("channel_id"))
    rows = D.resolve_destination(deliveries(t), known)
    return rows.select("post_id", "ordinal", "destination_id", "outcome", "reason", F.size("delivered_media").cast("bigint").alias("delivered"), "ack_eligible")


@query("a1_gallery_config", """
SELECT s_name AS gallery, 'https://a.example/' || s_suppkey AS base_url, 'c' || s_nationkey || ',c' || s_suppkey AS channel_ids,
 CASE WHEN s_nationkey % 2 = 0 THEN 'arcalive' ELSE 'dcinside' END AS source FROM supplier""")
def _(t: Tables) -> DataFrame:
    """One config file per nation, written as one JSON object and opened again."""
    settings = F.struct(
        F.concat(F.lit("https://a.example/"), "s_suppkey").alias("base_url"),
        F.array(F.concat(F.lit("c"), "s_nationkey"), F.concat(F.lit("c"), "s_suppkey")).alias("channel_ids"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("arca")).alias("type"))
    texts = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("s_name", settings)))).alias("value"))
    path = f"{scratch_folder(t.spark)}/galleries-{uuid.uuid4().hex}"
    texts.write.partitionBy("s_nationkey").text(path)
    return read_gallery_config(t.spark, path).select("gallery", "base_url", joined("channel_ids"), "source")


@query("b15_fix_extension", r"""
WITH n AS (SELECT p_partkey, 'dir/' || replace(p_name, ' ', '.') || CASE p_size % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '' ELSE '.png' END AS filename,
 CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'gif' END AS ext FROM part),
b AS (SELECT *, regexp_extract(filename, '([^/]*)$', 1) AS base FROM n),
s AS (SELECT *, lower(regexp_extract(base, '^(\.*[^.].*)(\.[^.]*)$', 2)) AS cur FROM b)
SELECT p_partkey, CASE WHEN cur = '.' || ext OR (ext = 'jpg' AND cur = '.jpeg') THEN base
 WHEN cur = '' THEN base || '.' || ext ELSE left(base, length(base) - length(cur)) || '.' || ext END AS fixed FROM s""")
def _(t: Tables) -> DataFrame:
    size = F.col("p_size") % 4
    name = F.concat(F.lit("dir/"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.when(size == 0, F.lit(".JPG")).when(size == 1, F.lit(".jpeg"))
                    .when(size == 2, F.lit("")).otherwise(".png"))
    ext = F.when(F.col("p_partkey") % 3 == 0, F.lit("jpg")).when(F.col("p_partkey") % 3 == 1, F.lit("png")).otherwise("gif")
    return t.part.select("p_partkey", fix_extension(name, ext).alias("fixed"))
