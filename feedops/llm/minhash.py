"""Near-duplicate documents by b-bit MinHash: bands of minima give candidates, packed low bits estimate their similarity, full shingle sets confirm.

Documents with equal shingle sets are one class. Classes are compared within band buckets, first with one member of a bucket each (twice, with different
ones), then, only in buckets that still hold more than one component, every member outside the bucket's first component with all members of
other components. So a large group of copies costs a row per member, not per pair, and no link between components is left out.

Results by case: a null, empty or blank text has no shingles, is linked with nothing and is its own component; with fewer words than a shingle the whole
sequence is one shingle; repeated rows are equal documents; a null id belongs to its component but never names it, unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.llm import bloom
from feedops.llm.graph import components, release
from feedops.llm.hashing import as_text, mix, released, slices, words
from feedops.llm.registry import Tables, carrying, query
from feedops.session import pinned

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, BITS = 24, 4, 4
MINIMA = BANDS * ROWS
# Estimates this far below the threshold are not looked at: more than five standard deviations of an estimate from 96 minima.
MARGIN = 0.25
# A document's shingles also mark so many bits; bits that one document alone has bound what two can share.
MAP_BITS = 2048
# Up to so many dropped rows (16 bytes each) are sent to every executor; more are joined.
BROADCAST_ROWS = 2_000_000
_RANDOM = np.random.default_rng(7)
_XOR = _RANDOM.integers(1, 1 << 63, MINIMA, dtype=np.uint64)
_TIMES = _RANDOM.integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
_PLACE = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ONES = np.uint64(0x1111111111111111)


def shingles(texts: pa.Array, start: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the rows, with repeats, and where each row begins in them."""
    hashes, first = words(texts, start, end)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(end - start), counts)
    at = first[row] + (np.arange(bounds[-1]) - bounds[row])
    width = np.minimum(n[row], size)
    value = width.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        value = value + np.where(width > k, padded[at + k] * _PLACE[k], np.uint64(0))
    return mix(value), bounds


def _distinct(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _node(found: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return np.array([mix(found).sum(), mix(found ^ np.uint64(0xD1B54A32D192ED03)).sum()], np.uint64).tobytes()


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, node, n_shingles, bands, packed, marks) per document; node, bands, packed and marks are null without shingles."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column("text"))
            for a, b in slices(texts):
                values, bounds = shingles(texts, a, b, size)
                sets = _distinct(values, bounds)
                full = np.flatnonzero(np.diff(bounds))
                minima = np.zeros((len(full), MINIMA), np.uint64)
                for k in range(MINIMA if len(full) else 0):
                    minima[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _TIMES[k], bounds[full])
                banded = minima.reshape(len(full), BANDS, ROWS)
                keys = np.full((len(full), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + banded[:, :, r] * _PLACE[r + 1])
                low = (mix(minima) & np.uint64((1 << BITS) - 1)).reshape(len(full), MINIMA * BITS // 64, 64 // BITS)
                packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
                place = dict(zip(full.tolist(), range(len(full))))
                keys, packed = keys.view(np.int64), packed.view(np.int64)
                marks = np.zeros((len(full), MAP_BITS), bool)
                for i, k in place.items():
                    marks[k, sets[i] % np.uint64(MAP_BITS)] = True
                marks = np.packbits(marks, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([keys[place[i]] if i in place else None for i in range(b - a)], pa.list_(pa.int64())),
                    pa.array([packed[place[i]] if i in place else None for i in range(b - a)], pa.list_(pa.int64())),
                    pa.array([marks[place[i]] if i in place else None for i in range(b - a)], pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "node", "n_shingles", "bands", "packed", "marks"])

    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    return rows.mapInArrow(released(run), f"doc_id {id_type}, text_key long, node binary, n_shingles long, bands array<long>, packed array<long>, marks array<long>")


def text_key() -> Column:
    return F.xxhash64("text")


# A class's signature, marks, size, and how many of its shingles have no bit of their own, as plain longs: generated code compares them without arrays.
LANES, MAP_WORDS = MINIMA * BITS // 64, MAP_BITS // 64
SKETCH = [*(f"p{i}" for i in range(LANES)), *(f"m{i}" for i in range(MAP_WORDS)), "size", "spare"]


def sketch(prefix: str) -> list[Column]:
    """``SKETCH`` of rows with packed, marks and n; never null, so that comparing needs no null checks either."""
    marked = F.aggregate("marks", F.lit(0).cast("long"), lambda s, m: s + F.bit_count(m))
    values = [*(F.col("packed")[i] for i in range(LANES)), *(F.col("marks")[i] for i in range(MAP_WORDS)), F.col("n"), F.col("n") - marked]
    return [F.coalesce(v, F.lit(0).cast("long")).alias(prefix + name) for v, name in zip(values, SKETCH)]


def estimate(a: str, b: str) -> Column:
    """Similarity from the signatures of two sketches, given by their prefixes, corrected for low bits that agree by chance."""
    total = F.lit(0)
    for i in range(LANES):
        x = F.col(f"{a}p{i}").bitwiseXOR(F.col(f"{b}p{i}"))
        for k in (1, 2):  # a lane of four bits is left with its lowest bit set where any of them was
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(int(_ONES))))
    chance = 0.5**BITS
    return ((1 - total / F.lit(float(MINIMA))) - chance) / (1 - chance)


def may_link(a: str, b: str, percent: int) -> Column:
    """False only for sketches that cannot be similar enough: every bit that one set marks alone is a shingle that the other lacks."""
    both = F.lit(0)
    for i in range(MAP_WORDS):
        both = both + F.bit_count(F.col(f"{a}m{i}").bitwiseAND(F.col(f"{b}m{i}")))
    shared = F.least(F.col(f"{a}spare"), F.col(f"{b}spare")) + both
    return 100 * shared >= percent * (F.col(f"{a}size") + F.col(f"{b}size") - shared)


def alike(a: str, b: str, percent: int) -> Column:
    """Whether signatures, then marks, leave room for a link."""
    return (estimate(a, b) >= percent / 100 - MARGIN) & may_link(a, b, percent)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) for the wanted (node, text_key): sorted 64-bit hashes. A Bloom filter keeps other texts out of the shuffle."""
    keys = wanted.select("text_key").distinct()
    blocks = bloom.block_count(wanted.count())
    rows = docs.select("text", text_key().alias("text_key"))
    if blocks * bloom.BLOCK_BYTES <= bloom.BROADCAST_BYTES:
        rows = bloom.probe(rows, "text_key", bloom.build(keys, "text_key", blocks), blocks, "_possible").where("_possible").drop("_possible")
    # One text of a key is enough; the node is computed again, so a collision of keys can only lose a candidate's check, never invent a link.
    rows = rows.dropDuplicates(["text_key"]).join(keys, "text_key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column("text"))
            for a, b in slices(texts):
                found = _distinct(*shingles(texts, a, b, size))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(released(run), "node binary, shingles binary").dropDuplicates(["node"])


def near(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches leave room for a link."""
    left, right = classes.select(F.col("node").alias("a"), *sketch("_a_")), classes.select(F.col("node").alias("b"), *sketch("_b_"))
    return pairs.join(left, "a").join(right, "b").where(alike("_a_", "_b_", percent)).select("a", "b")


def confirmed(docs: DataFrame, classes: DataFrame, near: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs ``near`` (a, b) whose shingle sets are similar enough."""
    near = pinned(near)
    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = pinned(_sets(docs, pinned(nodes.join(classes.select("node", "text_key"), "node")), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_sa"), batch.column("_sb")):
                u, v = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
    return full.mapInArrow(released(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    rows = pinned(signatures(docs, size))
    classes = pinned(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"),
                                                                          F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.first("marks").alias("marks"),
                                                                          F.min("n_shingles").alias("n")))
    keys = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").drop("last")
    members = pinned(keys.join(shared, "bucket"))

    star = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = pinned(confirmed(docs, classes, near(classes, star, percent), size, percent))
    roots = components(links)

    def labelled() -> DataFrame:
        """Members of buckets that hold more than one component, with their component and the bucket's first one."""
        own = members.join(roots, "node", "left").select("bucket", "band", "node", "first", F.coalesce("root", "node").alias("root"))
        open_ = own.groupBy("bucket").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("bucket")
        return pinned(own.join(open_, "bucket"))

    def merged(pairs: DataFrame) -> DataFrame:
        """Components with the confirmed ones of the near ``pairs``: what is known so far is a star per component."""
        more = pinned(confirmed(docs, classes, pairs, size, percent))
        release(docs.sparkSession)
        return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    # A second star per bucket, around another member.
    left = labelled()
    order = F.struct(F.xxhash64("node", F.lit(2)).alias("place"), "node", "root")
    hubs = left.where("node <> first").groupBy("bucket").agg(F.min(order).alias("hub"))
    star = left.join(hubs, "bucket").where("root <> hub.root and node <> first")
    roots = merged(near(classes, _ordered(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))), percent))
    # What is still apart: members outside the first member's component, with all members of other components. The join itself compares signatures,
    # then marks, so that pairs that cannot be linked, nearly all of them by now, are neither made nor shuffled.
    left = labelled()
    full = pinned(left.join(classes.select("node", "bands", *sketch("_b_")), "node"))
    main = left.where("node = first").select("bucket", F.col("root").alias("_main"))
    own = [F.col(f"_b_{name}").alias(f"_a_{name}") for name in SKETCH]
    apart = full.join(main, "bucket").where("root <> _main").select("bucket", F.col("node").alias("a"), F.col("root").alias("_root"), "band", F.col("bands").alias("_bands"), *own)
    other = full.select(F.col("bucket").alias("_bucket"), F.col("node").alias("b"), "root", "bands", *[f"_b_{name}" for name in SKETCH])
    # A pair is made in the first bucket that it shares, once.
    again = F.arrays_overlap(F.slice("_bands", F.lit(1), F.col("band")), F.slice("bands", F.lit(1), F.col("band")))
    rest = apart.join(other, (F.col("bucket") == F.col("_bucket")) & (F.col("_root") != F.col("root")) & alike("_a_", "_b_", percent) & ~again)
    roots = merged(_ordered(rest))

    named = classes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id")
    with_set = rows.where("node is not null").join(named, "node").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = rows.where("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; of rows that repeat id and text, one."""
    return carrying(docs, ("doc_id", "text"), lambda rows: _single(rows, size, percent))


def _single(docs: DataFrame, size: int, percent: int) -> DataFrame:
    decided = near_duplicates(docs, size, percent).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).agg(F.min("kept").alias("_kept"), F.count("*").alias("_rows"))
    odd = pinned(decided.where("not _kept or _rows > 1").select("_id", "_text", "_kept"))
    if odd.count() <= BROADCAST_ROWS:
        odd = F.broadcast(odd)
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_text")), "left")
    single = marked.where("_kept is null").select(docs.columns)
    return single.unionByName(marked.where("_kept").dropDuplicates(["_id", "_text"]).select(docs.columns))


# Every pair of different sets that share a shingle, and the components by recursion.
SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
 ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS found FROM d),
c AS (SELECT row_number() OVER () AS node, found, len(found) AS n FROM (SELECT DISTINCT found FROM s WHERE len(found) > 0)),
g AS (SELECT node, n, unnest(found) AS shingle FROM c),
shared AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS n FROM g a JOIN g b USING (shingle) WHERE a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
linked AS (SELECT a, b FROM shared WHERE 100 * n >= 80 * (na + nb - n)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked UNION ALL SELECT node, node FROM c),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
first AS (SELECT node, min(doc_id) AS doc_id FROM c JOIN s USING (found) GROUP BY 1),
component AS (SELECT r.a AS node, min(f.doc_id) AS component_id FROM reach r JOIN first f ON f.node = r.b GROUP BY 1)
SELECT s.doc_id, len(s.found) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.found = s.found LEFT JOIN component k ON k.node = c.node"""


@query("op4_minhash", SQL)
def _query(t: Tables) -> DataFrame:
    return near_duplicates(t.documents).select("doc_id", "n_shingles", "component_id", "kept")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
