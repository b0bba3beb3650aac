"""Approximate nearest neighbours by shifted space-filling curves.

Every vector gets a key in each of ``ORDERINGS`` Hilbert orders: a random projection to a few dimensions, shifted, cut into cells so fine (``CELL_BITS``) that near copies keep
an order of their own within every ordering; the id only breaks what ties are left. Rows are range-partitioned
by order and key and sorted; a query meets the rows at most a window of places (``WINDOW_SHARE`` of the rows, ``WINDOW`` at least) before or after it in each order, also those of the ranges next to
its own, and is ranked by exact distance; the best of all orders are merged.

Equal vectors are one class of which only the smallest ids are needed, so a vector that a third of all rows share is one point of the curve. Keys and
sorting are linear in the rows; the distances of one query are in proportion to the rows, as recall of vectors without structure asks: see the README for measured figures. ``window``
and ``orderings`` are parameters, and a fixed ``window`` makes all the work linear.

Results by case: vectors that are null, empty, zero, of another length than most, or hold a null or non-finite component take no part, as queries or candidates; a null id takes
no part; rows that repeat whole are one; an id with several vectors is one query and one candidate, at its nearest; ties go to the smaller id; with few
rows every candidate is found; further columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.llm.registry import Tables, query
from feedops.session import pinned

ORDERINGS, DIMENSIONS, CELL_BITS = 16, 8, 48
WINDOW, RANGE_ROWS, MAX_RANGES = 2048, 16384, 4096
CUT_SAMPLE = 64
WINDOW_SHARE = 0.04
NEAREST, QUERY_STEP = 10, 100
SEED = 11
BLOCK = 2048


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n x dimensions, each below 2^bits), as unsigned 64-bit."""
    x = _curve(cells, bits)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | ((c >> np.uint64(level)) & np.uint64(1))
    return key


def deep_keys(cells: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
    """The same places at any number of bits, as bytes that sort alike, with the id behind them as the last tie-break."""
    width = (bits + 7) // 8
    planes = np.stack([np.unpackbits(c.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :], axis=1) for c in _curve(cells, bits)], 2)
    place = np.packbits(planes.reshape(len(cells), -1), axis=1)
    last = (ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([place, last], 1)


def _curve(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Numbers whose bits, interleaved from the highest, are the places along the curve."""
    x = [c.astype(np.uint64) for c in cells.T]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)  # exchange the low bits with the first axis, or else invert those
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    twist = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        twist ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    return [c ^ twist for c in x]


def usable(vector: Column, length: int) -> Column:
    """True for vectors of the given length without null or non-finite components, and with one that is not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) == length) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)


def _keyed(classes: DataFrame, length: int, centre: np.ndarray, spread: np.ndarray, orderings: int, dimensions: int, bits: int, seed: int) -> DataFrame:
    """(ordering, key, class_id, asked, vector): a row per class and ordering."""
    random = np.random.default_rng(seed)
    axes = random.standard_normal((orderings, length, dimensions))
    shifts = random.uniform(0, 1, (orderings, dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), length)
            for k in range(orderings):
                # Eight standard deviations of the projection fill the cells, and the shift moves them by up to one more.
                scale = np.sqrt((axes[k] ** 2 * spread[:, None] ** 2).sum(0)) + 1e-12
                place = ((vectors - centre) @ axes[k] / scale + 4 + shifts[k]) / 9
                cells = np.clip(place * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64)
                key = deep_keys(cells, bits, batch.column("class_id").to_numpy())
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.shape[1]), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), column, *[batch.column(c) for c in ("class_id", "asked", "vector")]],
                                                 ["ordering", "key", "class_id", "asked", "vector"])

    return classes.select("class_id", "asked", "vector").mapInArrow(run, "ordering int, key binary, class_id long, asked boolean, vector array<double>")


def _ranged(keyed: DataFrame, rows: int, range_rows: int) -> DataFrame:
    """Adds ``part``, the range of the row's key in its ordering, and ``home``: queries also visit the ranges on either side, as guests."""
    ranges = max(1, min(MAX_RANGES, rows // range_rows))
    if ranges == 1:
        return keyed.withColumn("part", F.lit(0)).withColumn("home", F.lit(True))
    # Some CUT_SAMPLE keys a range and ordering, by hash, of which each CUT_SAMPLE-th is a cut: what an ordering sorts for it is bounded by MAX_RANGES.
    sampled = keyed.where(F.pmod(F.xxhash64("ordering", "key"), F.lit(max(1, rows // (CUT_SAMPLE * ranges)))) == 0).select("ordering", "key")
    sampled = sampled.withColumn("_place", F.row_number().over(Window.partitionBy("ordering").orderBy("key"))).withColumn("_n", F.count("*").over(Window.partitionBy("ordering")))
    number = lambda place: F.floor(place * F.lit(ranges) / F.col("_n"))
    cuts = sampled.where((F.col("_place") < F.col("_n")) & (number(F.col("_place")) > number(F.col("_place") - 1))).groupBy("ordering").agg(F.sort_array(F.collect_list("key")).alias("cuts"))
    bounds = {r["ordering"]: np.array([bytes(c) for c in r["cuts"]], object) for r in cuts.collect()}  # orderings x ranges keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, key = batch.column("ordering").to_numpy(), batch.column("key").to_numpy(zero_copy_only=False)
            part = np.zeros(len(key), np.int32)
            for k in np.unique(order):
                at = order == k
                part[at] = np.searchsorted(bounds[k], key[at], side="right") if k in bounds else 0
            home = pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.ones(len(part), bool))], [*batch.schema.names, "part", "home"])
            yield home
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for step in (-1, 1):
                guests = np.flatnonzero(asked & (part + step >= 0) & (part + step < ranges))
                moved = pa.RecordBatch.from_arrays([*batch.columns, pa.array(part + np.int32(step)), pa.array(np.zeros(len(part), bool))], home.schema.names)
                yield moved.take(pa.array(guests))

    return keyed.mapInArrow(run, "ordering int, key binary, class_id long, asked boolean, vector array<double>, part int, home boolean")


def nearest_in(queries: np.ndarray, candidates: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and distances of its ``k`` nearest among ``candidates[low:high]``, ties included."""
    out = []
    for q, a, b in zip(queries, low.tolist(), high.tolist()):
        distance = np.sqrt(((candidates[a:b] - q) ** 2).sum(1))
        at = np.arange(len(distance)) if len(distance) <= k else np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        out.append((a + at, distance[at]))
    return out


def _window_search(rows: DataFrame, length: int, window: int, k: int) -> DataFrame:
    """(query_class, class_id, score): the best of every query's window in every range it visits. ``rows`` are sorted by ordering, part and key.

    A task holds one block and a window on either side, whatever the size of its range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        group = None

        def search(rows: dict[str, np.ndarray], begin: int, end: int) -> pa.RecordBatch:
            """Windows of the queries at ``begin`` to ``end``. Places count home rows only, so that guests widen no window."""
            home = np.concatenate([[0], np.cumsum(rows["home"])])
            at = begin + np.flatnonzero(rows["asked"][begin:end])
            candidates, ids = rows["vector"][rows["home"]], rows["class_id"][rows["home"]]
            low, high = np.maximum(home[at] - window, 0), np.minimum(home[at] + window + 1, len(candidates))
            found = nearest_in(rows["vector"][at], candidates, low, high, k)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows["class_id"][at], [len(p) for p, _ in found])), pa.array(np.concatenate([ids[p] for p, _ in found] or [np.zeros(0, np.int64)])),
                                               pa.array(np.concatenate([d for _, d in found] or [np.zeros(0)]))], ["query_class", "class_id", "score"])

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

        done = 0  # rows at the front of ``held`` whose queries are answered

        def advance(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, done
            if not held:
                return
            rows = joined()
            n, home = len(rows["home"]), np.cumsum(rows["home"])
            ready = n if last else int(np.searchsorted(home, home[-1] - window, side="left")) if n else 0
            if ready > done and (last or ready - done >= BLOCK):
                yield search(rows, done, ready)
                drop = 0 if last else int(np.searchsorted(home, home[ready - 1] - window - 1, side="left"))
                held = [] if last else [{c: v[drop:] for c, v in rows.items()}]
                done = 0 if last else ready - drop
            elif last:
                held, done = [], 0
            else:
                held = [rows]

        for batch in batches:
            data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("ordering", "part", "class_id", "asked", "home")}
            data["vector"] = _matrix(batch.column("vector"), length)
            code = data["ordering"].astype(np.int64) << 32 | data["part"]
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    if code[a] != group:
                        yield from advance(True)
                        group = code[a]
                    held.append({c: v[a:b] for c, v in data.items() if c not in ("ordering", "part")})
                    if sum(len(h["home"]) for h in held) >= 2 * window + 2 * BLOCK:
                        yield from advance(False)
        yield from advance(True)

    return rows.mapInArrow(run, "query_class long, class_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, bits: int = CELL_BITS,
           window: int | None = None, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    length = sizes[0]["length"] if sizes else 0
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), length)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asked"))
    # Of equal vectors the k + 1 smallest ids can matter; the window keeps no more of any task's rows.
    first = rows.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"))
    classes = pinned(first)
    n = classes.count()
    rank = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.select("vector", "vec_id").distinct().withColumn("_place", F.row_number().over(rank)).where(F.col("_place") <= k + 1)
    members = pinned(kept.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("class_id", F.hash("vector").alias("_hash"), "ids"))
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    if window is None:
        # A query meets its own range and those beside it, so a range holds a window, whatever its cuts are off.
        window = max(WINDOW, math.ceil(n * WINDOW_SHARE))
        range_rows = max(range_rows, 2 * window)
    moments = classes.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("s")).orderBy("i").collect()
    centre, spread = (np.array([r[c] for r in moments]) for c in ("m", "s"))
    # Classes of one id with several vectors need a name of their own: the vector's hash beside the smallest id.
    named = classes.withColumn("_hash", F.hash("vector"))
    keyed = _keyed(named, length, centre, spread, orderings, dimensions, bits, seed)
    ranged = _ranged(keyed, n, range_rows).repartition("ordering", "part").sortWithinPartitions("ordering", "part", "key", "class_id")
    pairs = _window_search(ranged, length, window, k + 1)
    # Each query class keeps its k + 1 best classes: its own is among them.
    pairs = pairs.groupBy("query_class", "class_id").agg(F.min("score").alias("score"))
    best = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("query_class").orderBy("score", "class_id"))).where(F.col("_place") <= k + 1)
    found = best.join(members.groupBy("class_id").agg(F.flatten(F.collect_list("ids")).alias("ids")), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("_place", F.row_number().over(Window.partitionBy("query_class").orderBy("score", "vec_id"))).where(F.col("_place") <= k + 1)
    # Queries of one class share its list; each leaves itself out.
    asked = rows.where("asked").select("vec_id", "vector").distinct().join(classes.select("vector", "class_id"), "vector").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class"))
    answers = asked.join(found.select("query_class", "vec_id", "score"), "query_class").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    placed = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return placed.select("query_id", "rank", "vec_id", "score")


@query("op1_ann")
def _query(t: Tables) -> DataFrame:
    return search(t.embeddings.select("vec_id", "embedding"), F.col("vec_id") % QUERY_STEP == 0)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
