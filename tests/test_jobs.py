"""Readers, writers and streams on real folders; a stream's result equals the batch result."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from feedops.functions.expr import micros
from feedops.operators import dedup, ledger, ratelimit, scanlog, select
from feedops.plans.profiles import SINGLE
from feedops.sources import blobs, tables
from feedops.streaming import jobs, state
from tests.test_operators import rows, table

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gallery_config(spark, tmp_path):
    path = tmp_path / "galleries.json"
    path.write_text('{"a": {"base_url": "u1", "channel_ids": ["1", "2"]},\n "b": {"base_url": "u2", "channel_ids": [], "type": "arca"}}', encoding="utf-8")
    config = tables.read_gallery_config(spark, str(path))
    assert [tuple(r) for r in config.orderBy("gallery").collect()] == [("a", "u1", ["1", "2"], "dcinside"), ("b", "u2", [], "arcalive")]
    assert tables.gallery(config, "b").first().base_url == "u2"
    with pytest.raises(KeyError):
        tables.gallery(config, "c")


def test_oversize_blobs_are_not_opened(spark, tmp_path):
    for name, size in (("small.png", 10), ("edge.png", 20), ("large.png", 21), ("other.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = tables.read_blobs(spark, str(tmp_path), 20, "*.png")
    assert rows(found.select(F.element_at(F.split("path", "/"), -1), "length")) == [("edge.png", 20), ("small.png", 10)]
    assert "LessThanOrEqual(length,20)" in plan(found)


def test_large_blobs_are_hashed_without_being_held(spark, tmp_path):
    """Four files of 1,060 MB at once ended an executor of 10 GB: a file was held about three times over."""
    mark = b"\xef\xbb\xbf"
    noise = bytes(random.Random(1).choices(b"\r\n\0A\xc8\xff", k=200_000))
    files = {"small.png": b"ab", "a b+c%41.gz": mark + b"x\r\ny\n", "feeds.png": b"\n\n\n\n", "mark.txt": mark + b"abc", "end.png": b"abc\n", "open.png": b"abcd", "packed.gz": gzip.compress(noise),
             "noise.parquet": noise, "noise.bz2": noise + b"\n", "no ending": b"abc\ndef\n", "over.png": b"x" * 300_000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        found = blobs.hash_blobs(spark, str(tmp_path), 250_000, whole_bytes=3)
        hashed = rows(found.select(F.element_at(F.split("path", "/"), -1), "length", "content_hash"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    del files["over.png"]
    assert hashed == sorted((name, len(c), hashlib.sha256(c).hexdigest()) for name, c in files.items())
    opened = [line for line in plan(blobs.hash_blobs(spark, str(tmp_path), 250_000, "*.png", 3)).splitlines() if "FileScan" in line]
    assert ["binaryFile" in line and "LessThanOrEqual(length,3)" in line or "FileScan text" in line for line in opened] == [True, True]


def test_ledger_folder(spark, tmp_path):
    path = str(tmp_path / "ledger")
    new = table(spark, [("s", "g", "post:1"), ("s", "h", "post:1"), ("s", "g", "post:1")], "source string, gallery_name string, delivery_key string").withColumn(
        "delivered_at", F.lit("2025-01-01").cast("timestamp"))
    spark.createDataFrame([], ledger.LEDGER_SCHEMA).write.partitionBy("source", "gallery_name").parquet(path)
    for expected in (2, 0):
        added = ledger.ledger_add(tables.read_ledger(spark, path), new)
        assert added.count() == expected
        tables.append_ledger(added, path)
    one_gallery = tables.read_ledger(spark, path).filter("source = 's' and gallery_name = 'g'")
    assert one_gallery.count() == 1
    assert "PartitionFilters: [isnotnull(source" in plan(one_gallery)
    kept, _ = ledger.ledger_prune(tables.read_ledger(spark, path), F.lit("2025-01-02").cast("timestamp"))
    version = tables.write_ledger_version(kept, str(tmp_path / "versions"))
    assert os.path.isdir(version)


def test_scan_event_lines(spark, tmp_path):
    path = str(tmp_path / "events")
    log = table(spark, [(1, "curl/8", "/.env", "ü")], "id bigint, user_agent string, path string, header_ip string").select(
        "*", F.lit("2025-01-01 00:00:00.123456").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("socket_ip"), F.lit("GET").alias("method"),
        F.array(F.lit("b"), F.lit("a")).alias("query_keys"), F.lit(200).alias("status_code"))
    events = scanlog.scan_events(log)
    tables.write_scan_events(events, path)
    tables.write_scan_events(events, path)
    back = tables.read_scan_events(spark, path)
    assert back.count() == 2 and back.exceptAll(events.unionByName(events)).count() == 0
    line = spark.read.text(path).first().value
    assert line.startswith('{"timestamp":"2025-01-01T00:00:00.123456+00:00"') and "ü" in line


def test_outbox_is_idempotent(spark, tmp_path):
    messages = table(spark, [("s", "g", "1", 0, "discord", "c", ["a"], True), ("s", "g", "1", 0, "discord", "c", ["a"], True), ("s", "g", "1", 0, "telegram", "c", ["a"], True),
                             ("s", "g", "1", 0, "telegram", "c", ["b"], True)], tables.OUTBOX_SCHEMA)
    path = str(tmp_path / "outbox")
    for _ in range(2):
        tables.write_outbox(messages, path, 0)
    sent = spark.read.parquet(path)
    assert sent.count() == 3
    assert tables.new_outbox_rows(messages, sent).count() == 0


def test_outbox_sends_what_a_partial_delivery_left(spark):
    def offered(*media):
        return table(spark, [("s", "g", "1", 0, "discord", "c", list(media), True)], tables.OUTBOX_SCHEMA)

    sent = offered("a", "b").withColumn("message_key", tables.message_key())
    assert [r.requested_media for r in tables.new_outbox_rows(offered("b"), sent).collect()] == [["b"]]
    assert tables.new_outbox_rows(offered("b", "a"), sent).count() == 0


def test_outbox_compares_within_a_post_without_a_shuffle(spark):
    m = ("s", "g", "1", 0, "discord", "c", ["a", "b"], True)
    others = [("s", "g", "2", 0, *m[4:]), ("s", "h", "1", 0, *m[4:]), ("s", "g", "1", 1, *m[4:]), ("s", "g", "1", 0, "telegram", "c", ["a"], True),
              (None, "g", None, None, None, "c", [None, "a"], None), (None, "g", None, None, None, "d", None, None)]
    offers = [m, (*m[:6], ["b", "a"], True), *others, *others]
    offered = table(spark, offers, tables.OUTBOX_SCHEMA).repartition(4, "post_id")
    sent = table(spark, [m, m, others[0], others[4], ("s", "x", "9", 0, *m[4:])], tables.OUTBOX_SCHEMA).withColumn("message_key", tables.message_key()).repartition(4, "post_id")
    for known in (sent, sent.select("message_key")):
        for gather in (False, True):
            fresh = tables.new_outbox_rows(offered, known, gather=gather)
            assert fresh.columns == ["message_key", *offered.columns]
            assert sorted(map(str, fresh.drop("message_key").collect())) == sorted(str(r) for r in table(spark, [others[i] for i in (1, 2, 3, 5)], tables.OUTBOX_SCHEMA).collect())
    plan = tables.new_outbox_rows(offered, sent)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the two of the test itself
    none = table(spark, [], tables.OUTBOX_SCHEMA).withColumn("message_key", tables.message_key())
    assert tables.new_outbox_rows(offered, none).count() == 7 and tables.new_outbox_rows(none.drop("message_key"), sent).count() == 0


def test_outbox_query_lands_offers_by_post(spark, tmp_path):
    """Messages are numbered, batched and landed with one shuffle, by post; every one goes out once."""
    from registry import delivery, streams
    from registry.base import QUERIES, Tables

    lines = spark.range(400).selectExpr(
        "id div 4 l_orderkey", "id % 7 l_partkey", "id % 3 l_suppkey", "cast(id % 4 as int) l_linenumber", "1.0D l_quantity", "2.0D l_extendedprice", "0.0D l_discount",
        "0.0D l_tax", "'N' l_returnflag", "'O' l_linestatus", "date '2020-01-01' l_shipdate")
    lines.unionByName(lines.limit(20)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    offered = delivery.messages(Tables(spark, str(tmp_path)), 6)
    assert offered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert offered.rdd.getNumPartitions() == 6
    plain = delivery.messages(Tables(spark, str(tmp_path)))
    assert offered.exceptAll(plain).isEmpty() and plain.exceptAll(offered).isEmpty()
    wanted = plain.withColumn("requested_media", streams.joined("requested_media")).drop("source", "ack_eligible").distinct()
    found = QUERIES["a7_stream_outbox"](spark, str(tmp_path))
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
    folder = os.path.dirname(found.inputFiles()[0].removeprefix("file://")).split("/out/")[0]
    assert batches(f"{folder}/out") == [f"batch={i}" for i in range(6)]
    assert spark.read.parquet(f"{folder}/out-landing").count() == 2 * plain.count()
    assert [spark.read.schema(found.schema).parquet(f"{folder}/out/batch={i}").isEmpty() for i in range(6)] == [False] * 3 + [True] * 3
    assert all(".zstd." in f for f in found.inputFiles())


@pytest.fixture
def landing(spark, tmp_path):
    """Events of the smallest scale in six files, in time order by file name and shuffled inside."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("user_id"), micros(F.col("ts")).alias("t_us"), F.col("event_type").alias("name"),
        F.get_json_object("props", "$.k").alias("image_id"))
    path = str(tmp_path / "landing")
    total = events.count()
    for part in range(6):
        block = events.filter((F.col("id") >= part * total // 6) & (F.col("id") < (part + 1) * total // 6))
        block.orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(path)
    # File streams take older files first.
    files = sorted((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(os.path.join(path, f)))
    for i, f in enumerate(files):
        os.utime(os.path.join(path, f), (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def incoming(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def batches(path):
    return sorted((f for f in os.listdir(path) if f.startswith("batch=")), key=lambda f: int(f[6:]))


def test_stream_limits_equal_batch(spark, landing, tmp_path):
    batch = spark.read.parquet(landing)
    jobs.stream_rate_limit(incoming(spark, landing), spark, str(tmp_path / "a"), str(tmp_path / "cpa"), "user_id", 86_400, 4).awaitTermination()
    want = ratelimit.rate_limit(batch, ["user_id"], "t_us", "id", 86_400, 4)
    assert rows(spark.read.parquet(str(tmp_path / "a")), "id", "limited", "anchor") == rows(want, "id", "limited", "anchor")
    jobs.stream_dedup(incoming(spark, landing), spark, str(tmp_path / "b"), str(tmp_path / "cpb"), "name", 7_200).awaitTermination()
    accepted = spark.read.parquet(str(tmp_path / "b"))
    assert rows(accepted, "id") == rows(dedup.dedup_anchored(batch, ["name"], "t_us", "id", 7_200), "id")
    assert len(batches(tmp_path / "a")) == 6 and batches(tmp_path / "cpa-state") == ["batch=4", "batch=5"]
    out = str(tmp_path / "c")
    query = state.stream_dedup_builtin(incoming(spark, landing), "name", 7_200).writeStream.format("parquet").option("path", out)
    query.option("checkpointLocation", str(tmp_path / "cpc")).trigger(availableNow=True).start().awaitTermination()
    assert 0 < spark.read.parquet(out).count() <= accepted.count()


def test_state_holds_what_is_open(spark):
    """State falls once windows have passed; a late row counts as arriving when its key's open window began."""
    schema = "id bigint, t_us bigint, k string"
    second = 1_000_000
    none = spark.createDataFrame([], "id bigint, k string, _t bigint, anchor bigint")
    first = table(spark, [(i, i * second, f"k{i % 50}") for i in range(500)] + [(900, 499 * second, None)], schema)
    answers, open_ = state.limit_step(first, none, "k", 60, 1)
    assert answers.count() == 501 and answers.filter("limited").count() == 250 and open_.count() == 12
    late = table(spark, [(1000, 400 * second, "k49"), (1001, 520 * second, "k49"), (1002, 600 * second, "new")], schema)
    answers, open_ = state.limit_step(late, open_, "k", 60, 1)
    assert rows(answers, "id", "limited", "anchor") == [(1000, True, 449 * second), (1001, False, 520 * second), (1002, False, 600 * second)]
    assert rows(open_, "id") == [(1002,)]
    none = none.drop("anchor")
    accepted, open_ = state.dedup_step(first, none, "k", 30)
    accepted, open_ = state.dedup_step(table(spark, [(1, 499 * second + 1, "k49"), (2, 499 * second, None), (3, 529 * second, "k49")], schema), open_, "k", 30)
    assert rows(accepted, "id") == [(3,)] and rows(open_, "id") == [(3,)]


def test_split_crawl_waits_for_its_rest(spark, tmp_path):
    """A crawl over several batches gives the posts of the whole crawl; one without its rest is released after a while."""
    ledger_path, landing = str(tmp_path / "ledger"), str(tmp_path / "rows")
    spark.createDataFrame([("dcinside", "g", "post:20", None)], ledger.LEDGER_SCHEMA).write.partitionBy("source", "gallery_name").parquet(ledger_path)
    schema = "source string, gallery string, crawl_id int, list_pos int, post_id string, has_image boolean, crawl_rows int, crawl_us bigint"
    crawl = [("dcinside", "g", 1, i, str(i), True, 25, 0) for i in range(25)]
    cut_off = [("dcinside", "h", 1, i, f"h{i}", True, 99, 0) for i in range(25)]
    later = [("dcinside", "g", 2, i, f"x{i}", True, 21, 7_200_000_000) for i in range(21)]
    for i, part in enumerate([crawl[20:], cut_off + crawl[:9], crawl[9:20], later]):
        table(spark, part, schema).coalesce(1).write.mode("append").parquet(landing)
        newest = max((os.path.join(landing, f) for f in os.listdir(landing) if f.endswith(".parquet")), key=os.path.getctime)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    out = str(tmp_path / "out")
    jobs.stream_new_posts(incoming(spark, landing), spark, ledger_path, out, str(tmp_path / "cp"), SINGLE, expected="crawl_rows").awaitTermination()
    assert [rows(spark.read.parquet(f"{out}/{b}"), "post_id") for b in batches(out)] == [[], [], [("21",)], [("h20",), ("x20",)]]


def test_idle_store_empties(spark, tmp_path):
    """Ticks alone expire items."""
    items, clock = str(tmp_path / "items"), str(tmp_path / "ticks")
    table(spark, [(1, 1_000_000, 5), (2, 50_000_000, 5)], "seq bigint, created_us bigint, bytes bigint").coalesce(1).write.parquet(items)
    limits = {"ttl_seconds": 100, "max_items": 10, "max_bytes": 100}
    for i, now in enumerate([60_000_000, 120_000_000, 500_000_000]):
        table(spark, [(now,)], "now_us bigint").coalesce(1).write.mode("append").parquet(clock)
        arrivals = spark.readStream.schema("seq bigint, created_us bigint, bytes bigint").parquet(items)
        ticks = spark.readStream.schema("now_us bigint").parquet(clock)
        jobs.stream_recent_store(arrivals, spark, str(tmp_path / "store"), str(tmp_path / "cp"), ticks=ticks, **limits).awaitTermination()
        assert rows(spark.read.parquet(str(tmp_path / f"store/batch={i}")), "seq") == [[(1,), (2,)], [(2,)], []][i]
    assert jobs.clock_ticks(spark).isStreaming


def test_outbox_stream_sends_once_and_retries_what_is_missing(spark, tmp_path):
    landing, out = str(tmp_path / "messages"), str(tmp_path / "outbox")
    schema = tables.OUTBOX_SCHEMA
    whole = ("dcinside", "g", "1", 0, "discord", "c1", ["a", "b"], True)
    offers = [[whole, whole, (*whole[:5], "c2", ["a"], True)], [whole, (*whole[:6], ["b"], True)], [(*whole[:6], ["b", "a"], True)]]
    for i, part in enumerate(offers):
        table(spark, part, schema).coalesce(1).write.mode("append").parquet(landing)
        newest = max((os.path.join(landing, f) for f in os.listdir(landing) if f.endswith(".parquet")), key=os.path.getctime)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
        jobs.stream_outbox(spark.readStream.schema(schema).parquet(landing), spark, out, str(tmp_path / "cp")).awaitTermination()
    assert [spark.read.parquet(f"{out}/{b}").count() for b in batches(out)] == [2, 1, 0]
    # Another stream over the same folder of messages replays batch 0: it leaves its own folder out.
    jobs.stream_outbox(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing), spark, out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(f"{out}/batch=0").count() == 2 and spark.read.parquet(out).select("message_key").distinct().count() == spark.read.parquet(out).count() == 3


def test_stream_store_and_likes_equal_batch(spark, landing, tmp_path):
    batch = spark.read.parquet(landing)

    def items(df):
        return df.select(F.col("id").alias("seq"), F.col("t_us").alias("created_us"), (F.col("id") % 50 + 1).alias("bytes"))

    limits = {"ttl_seconds": 5 * 86_400, "max_items": 60, "max_bytes": 1_000}
    jobs.stream_recent_store(items(incoming(spark, landing)), spark, str(tmp_path / "store"), str(tmp_path / "cp1"), **limits).awaitTermination()
    now = batch.agg(F.max("t_us")).first()[0]
    want = select.recent_store(items(batch), F.lit(now), limits["ttl_seconds"], 60, 1_000)
    assert rows(spark.read.parquet(str(tmp_path / "store/batch=5")), "seq") == rows(want, "seq")
    jobs.stream_like_counts(incoming(spark, landing), spark, str(tmp_path / "likes"), str(tmp_path / "cp2"), "user_id", "image_id", 86_400, 4).awaitTermination()
    counts = spark.read.parquet(str(tmp_path / "likes")).groupBy("image_id").agg(F.sum("likes").alias("likes"))
    passed = ratelimit.rate_limit(batch, ["user_id"], "t_us", "id", 86_400, 4).filter("not limited")
    assert rows(counts) == rows(passed.groupBy("image_id").agg(F.count_distinct("user_id").alias("likes")))


def test_stream_posts_and_acknowledgement(spark, tmp_path):
    ledger_path, landing = str(tmp_path / "ledger"), str(tmp_path / "rows")
    spark.createDataFrame([("dcinside", "g", "post:20", None)], ledger.LEDGER_SCHEMA).write.partitionBy("source", "gallery_name").parquet(ledger_path)
    listing = table(spark, [("dcinside", "g", 1, i, str(i), True) for i in range(25)],
                    "source string, gallery string, crawl_id int, list_pos int, post_id string, has_image boolean")
    listing.coalesce(1).write.parquet(landing)
    out = str(tmp_path / "out")
    jobs.stream_new_posts(incoming(spark, landing), spark, ledger_path, out, str(tmp_path / "cp1"), SINGLE).awaitTermination()
    assert rows(spark.read.parquet(out), "post_id") == [("21",)]
    done = spark.readStream.schema(spark.read.parquet(out).schema).parquet(out)
    keyed, _ = ledger.ledger_rows(done, "post", "post_id", F.lit("2025-01-01").cast("timestamp"))
    for attempt in range(2):
        jobs.stream_acknowledge(keyed, spark, ledger_path, str(tmp_path / f"cp-ack{attempt}")).awaitTermination()
    assert rows(tables.read_ledger(spark, ledger_path), "delivery_key") == [("post:20",), ("post:21",)]


def test_stream_scan_events(spark, landing, tmp_path):
    def log(df):
        return df.select("id", F.timestamp_micros("t_us").alias("ts"), F.lit("curl/8").alias("user_agent"), F.concat(F.lit("/"), "name").alias("path"),
                         F.lit("").alias("header_ip"), F.lit("1.1.1.1").alias("socket_ip"), F.lit("GET").alias("method"), F.array("name").alias("query_keys"), F.lit(200).alias("status_code"))

    jobs.stream_scan_events(log(incoming(spark, landing)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = scanlog.scan_events(log(spark.read.parquet(landing)))
    assert rows(tables.read_scan_events(spark, str(tmp_path / "out")), "event_id", "timestamp") == rows(want, "event_id", "timestamp")


def test_latest_run_of_a_url_counts(spark):
    from feedops.plans.media import fetched_urls

    runs = {"a": [(1, 1, 404), (2, 1, 200)], "b": [(1, 1, 503), (1, 2, 503), (1, 3, 503), (2, 1, 200)], "c": [(1, 1, 200), (2, 1, 404)]}
    log = table(spark, [(u, r, n, status, None, None, bytearray(b"x")) for u, rows in runs.items() for r, n, status in rows],
                "url string, request_id int, attempt int, status int, error_kind string, declared_length string, content binary")
    found = {r.url: (r.verdict, r.requests) for r in fetched_urls(log, request="request_id").collect()}
    assert found == {"a": ("success", 1), "b": ("success", 1), "c": ("permanent_failure", 1)}


def test_ledger_commits_lose_nothing(spark, tmp_path):
    """An append between a prune's read and its switch stays; two writers never publish the same number."""
    from feedops.sources import versions

    root = str(tmp_path / "ledger")

    def ledger_of_days(*days):
        return table(spark, [("dcinside", "g", f"post:{d}", f"2025-01-{d:02d} 00:00:00") for d in days], "source string, gallery_name string, delivery_key string, at string").select(
            "source", "gallery_name", "delivery_key", F.to_timestamp("at").alias("delivered_at"))

    def keys(names=None):
        return sorted(r.delivery_key for r in versions.read(spark, root, names).collect())

    assert versions.folders(spark, root) == (0, []) and keys() == []
    assert versions.append(spark, root, ledger_of_days(1, 5)) == 1 and versions.append(spark, root, ledger_of_days(5, 9)) == 2
    assert keys() == ["post:1", "post:5", "post:9"]
    before = versions.folders(spark, root)[1]
    number = versions.prune(spark, root, F.lit("2025-01-06").cast("timestamp"), lambda: versions.append(spark, root, ledger_of_days(2, 7)))
    assert number == 4 and keys() == ["post:2", "post:7", "post:9"]
    assert keys(before) == ["post:1", "post:5", "post:9"]
    assert not versions.commit(spark, root, 4, []) and versions.folders(spark, root)[0] == 4
    with pytest.raises(versions.ConflictError):
        cutoff = F.lit("2025-01-03").cast("timestamp")
        versions.prune(spark, root, cutoff, lambda: versions.prune(spark, root, cutoff))
    assert keys() == ["post:7", "post:9"] and versions.drop_unused(spark, root, keep=1) >= 3 and keys() == ["post:7", "post:9"]
