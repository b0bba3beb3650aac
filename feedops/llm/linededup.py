"""Line de-duplication by a segment-partition edit join.

A line of at least ``MIN_CHARS`` characters is a repeat if an earlier line of the corpus (by document id, then place) is equal or within ``EDITS`` edits of it.
Lines are compared stripped. Equal lines are one class. Every class is cut into EDITS + 1 segments; two lines within EDITS edits share one of
them, at nearly the same place, so each line probes the segments of lines of its own length and up to EDITS shorter. Candidates that share a
segment are compared in the order of their bucket's members, in rounds whose reach squares (up to 4, 16, 256, 65,536 members), and a line
leaves as soon as an earlier one is found: a bucket of near copies costs a row per member. A banded bit-parallel edit distance verifies.

Results by case: null and empty texts have no lines; shorter lines are never repeats and stay; of equal lines at the same place (a repeated row) the row is one and
stays; a null id comes after all others; an empty table gives no rows. Further columns are passed through by ``drop_repeated_lines`` and not read otherwise.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedops.llm import bloom
from feedops.llm.hashing import Rolling, as_text, mix, released, slices
from feedops.llm.registry import Tables, carrying, query
from feedops.session import pinned

EDITS, MIN_CHARS = 2, 20
MAX_ROUNDS = 40
LAST_ID = (1 << 63) - 1
# A worker remembers so many lines whose segments it has already sent.
SEEN_LINES = 200_000
# Tables of repeats up to so many rows (documents) are sent to every executor; larger ones are joined.
BROADCAST_ROWS = 500_000


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, shift, shorter): a line looks for segment ``segment`` of lines ``shorter`` characters shorter, ``shift`` characters from that segment's place.

    The multi-match-aware choice: more than ``segment`` edits before it, or more than what is left after it, would make an earlier or later segment match.
    """
    found = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                found.append((i, shift, shorter))
    return found


def segment_bounds(length: np.ndarray, parts: int) -> np.ndarray:
    """Begin of every segment and the end, one column each: the last segments are the longer ones."""
    base, longer = length // parts, length % parts
    at = [np.zeros_like(length)]
    for i in range(parts):
        at.append(at[-1] + base + (i >= parts - longer))
    return np.stack(at, 1)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 where it is larger: bit-parallel within a band around the diagonal.

    A column of the table is kept as bits of vertical differences of the band's cells only; the band moves down a row with every column, and its lowest
    cell, later the last row, carries the distance.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    start, end = 0, 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    if n <= most:
        return min(most + 1, _small_distance(a, b))
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    # Bit p of column j stands for row j + most - (width - 1 - p) of the table; rows from 1 on differ by one in the column before the first.
    plus, minus, distance, last = full & ~((1 << (width - most - 1)) - 1), 0, most, top
    for j in range(1, m + 1):
        match, shift = rows.get(b[j - 1], 0), j + most - width
        match = (match >> shift if shift >= 0 else match << -shift) & full
        zero = (((match & plus) + plus) ^ plus | match | minus) & full
        right_plus, right_minus = minus | ~(zero | plus) & full, zero & plus
        if j <= n - most:
            distance += not zero & top
            if distance > 2 * most + m - n:
                return most + 1
        else:
            last >>= 1
            distance += bool(right_plus & last) - bool(right_minus & last)
        zero >>= 1
        plus, minus = (right_minus | ~(zero | right_plus)) & full, zero & right_plus
    return min(distance, most + 1)


def _small_distance(a: str, b: str) -> int:
    """The plain table, for a few characters."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and of every stripped line: its text's number, its number in the text, begin and end."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    feeds = np.flatnonzero(data == 10)
    # A text of k line feeds has k + 1 lines; counting feeds per text keeps empty texts and closing feeds apart.
    per_text = np.diff(np.searchsorted(feeds, rows)) + 1
    row = np.repeat(np.arange(len(texts)), per_text)
    first = np.concatenate([[0], np.cumsum(per_text)])
    number = np.arange(first[-1]) - first[row]
    begin, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    begin[first[:-1]], end[first[1:] - 1] = rows[:-1], rows[1:]
    inner = np.ones(len(row), bool)
    inner[first[:-1]] = False
    begin[inner] = feeds + 1
    inner = np.ones(len(row), bool)
    inner[first[1:] - 1] = False
    end[inner] = feeds
    solid = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = b > a
    begin[some], end[some] = solid[a[some]], solid[b[some] - 1] + 1
    end[~some] = begin[~some]
    return data, row, number, begin, end


def _rolling(data: np.ndarray) -> Rolling:
    return Rolling(data, values=mix(data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def _parities(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range two 64-bit maps of odd counts: of its characters, and of its pairs of neighbours. An edit changes at most two bits of one, four of the other."""
    codes = mix(data.astype(np.uint64) + np.uint64(1))
    pairs = mix(codes[:-1] + codes[1:] * np.uint64(0x9E3779B97F4A7C15)) if len(codes) else codes
    single, double = (np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (x >> np.uint64(58)))]) if len(x) else np.zeros(1, np.uint64) for x in (codes, pairs))
    return (single[end] ^ single[begin]).view(np.int64), (double[np.maximum(end - 1, begin)] ^ double[begin]).view(np.int64)


def line_places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(line, id, text_key, number) of every line of at least ``min_chars`` characters; ``line`` is a 64-bit hash, ``id`` the document's, nulls last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, keys = as_text(batch.column("text")), batch.column("id").to_numpy(), batch.column("text_key").to_numpy()
            for a, b in slices(texts):
                data, row, number, begin, end = _lines(texts[a:b].to_pylist())
                long = np.flatnonzero(end - begin >= min_chars)
                line = _rolling(data).ranges(begin[long], end[long]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(ids[a + row[long]]), pa.array(keys[a + row[long]]), pa.array(number[long].astype(np.int32))], ["line", "id", "text_key", "number"])

    return _slim(docs).mapInArrow(released(run), "line long, id long, text_key long, number int")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("text_key"))


def segment_keys(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(key, line, held): ``key`` names a segment's text, number and line length; ``held`` where the line itself has that segment there."""
    wanted = probes(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = as_text(batch.column("text"))
            for a, b in slices(texts):
                data, _, _, begin, end = _lines(texts[a:b].to_pylist())
                long = np.flatnonzero(end - begin >= min_chars)
                rolling = _rolling(data)
                line = rolling.ranges(begin[long], end[long])
                line, index = np.unique(line, return_index=True)
                new = np.fromiter((x not in seen for x in line.tolist()), bool, len(line))
                if len(seen) < SEEN_LINES:
                    seen.update(line[new].tolist())
                line, at = line[new], long[index[new]]
                start, stop = begin[at], end[at]
                keys, lines, held = [], [], []
                for shorter in range(edits + 1):
                    length = stop - start - shorter
                    fits = length >= min_chars
                    bounds = segment_bounds(length, edits + 1)
                    for i, shift, _ in (w for w in wanted if w[2] == shorter):
                        x, y = start + bounds[:, i] + shift, start + bounds[:, i + 1] + shift
                        ok = fits & (x >= start) & (y <= stop)
                        hashed = rolling.ranges(x[ok], y[ok])
                        keys.append(mix(hashed + length[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)))
                        lines.append(line[ok])
                        held.append(np.full(int(ok.sum()), shorter == 0 and shift == 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(lines).view(np.int64)), pa.array(np.concatenate(held))], ["key", "line", "held"])

    return docs.select("text").mapInArrow(released(run), "key long, line long, held boolean")


def _line_texts(docs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """(line, content, singles, doubles) of the given lines, with their parity maps; a Bloom filter keeps other lines out of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column("text"))
            for a, b in slices(texts):
                rows = texts[a:b].to_pylist()
                data, _, _, begin, end = _lines(rows)
                long = np.flatnonzero(end - begin >= min_chars)
                line, index = np.unique(_rolling(data).ranges(begin[long], end[long]).view(np.int64), return_index=True)
                joined, at = "".join(rows), long[index]
                content = pa.array([joined[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(line), content, *map(pa.array, _parities(data, begin[at], end[at]))], ["line", "content", "singles", "doubles"])

    found = docs.select("text").mapInArrow(released(run), "line long, content string, singles long, doubles long")
    return _possible(found, "line", lines).join(lines, "line", "left_semi").dropDuplicates(["line"])


def _possible(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among ``keys``; all rows where the filter would be too large to send."""
    blocks = bloom.block_count(keys.count())
    if blocks * bloom.BLOCK_BYTES > bloom.BROADCAST_BYTES:
        return rows
    return bloom.probe(rows, key, bloom.build(keys, key, blocks), blocks, "_possible").where("_possible").drop("_possible")


def late_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line): lines within ``edits`` edits of another one that comes first. ``firsts``: (line, first)."""
    segments = segment_keys(docs, edits, min_chars)
    live = segments.groupBy("key").agg(F.min("line").alias("_a"), F.max("line").alias("_b"), F.max("held").alias("_held")).where("_held and _a <> _b").select("key")
    live = pinned(live)
    found = _possible(segments, "key", live).join(live, "key", "left_semi").groupBy("key", "line").agg(F.max("held").alias("held"))
    rank = Window.partitionBy("key").orderBy("first")
    found = pinned(found)
    contents = pinned(_line_texts(docs, found.select("line").distinct(), min_chars))
    members = found.join(firsts, "line").join(contents.drop("content"), "line").withColumn("place", F.row_number().over(rank))
    members = pinned(members.select("key", "line", "held", "place", "singles", "doubles"))
    most = members.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    # Lines that differ in more bits than the edits can change are no pair.
    close = (F.bit_count(F.col("singles").bitwiseXOR(F.col("_singles"))) <= 2 * edits) & (F.bit_count(F.col("doubles").bitwiseXOR(F.col("_doubles"))) <= 4 * edits)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance(x, y, edits) <= edits for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist())]
            yield batch.select(["line"]).filter(pa.array(near, pa.bool_()))

    late, low, high = None, 1, 2
    for _ in range(MAX_ROUNDS):
        if low > most:
            break
        open_ = members if late is None else members.join(late, "line", "left_anti")
        earlier = members.where(F.col("place").between(low, high - 1)).select("key", F.col("line").alias("other"), F.col("held").alias("_held"), F.col("place").alias("_place"),
                                                                                   F.col("singles").alias("_singles"), F.col("doubles").alias("_doubles"))
        pairs = open_.where(F.col("place") > low).join(earlier, "key").where("place > _place and (held or _held)").where(close).select("line", "other").distinct()
        pairs = pairs.join(contents.select("line", F.col("content").alias("_x")), "line").join(contents.select(F.col("line").alias("other"), F.col("content").alias("_y")), "other")
        now = pairs.select("line", "_x", "_y").mapInArrow(released(check), "line long").distinct()
        late = pinned(now if late is None else late.unionByName(now))
        low, high = high, 2 * high if high < 4 else high * high
    return late if late is not None else members.select("line").limit(0)


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_key, repeated) for the documents with repeated lines; ``repeated`` has their numbers, from 0, in order."""
    places = pinned(line_places(docs, min_chars))
    place = F.struct("id", "text_key", "number")
    firsts = pinned(places.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    late = late_lines(docs, firsts.select("line", "first"), edits, min_chars).withColumn("_late", F.lit(True))
    marks = firsts.join(late, "line", "left").where("_late or first <> last").select("line", "first", F.coalesce("_late", F.lit(False)).alias("_late"))
    repeats = places.join(marks, "line").where(F.col("_late") | (F.col("first") != place)).select("id", "text_key", "number").distinct()
    return repeats.groupBy("id", "text_key").agg(F.array_sort(F.collect_list("number")).alias("repeated"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines, and ``_repeated``: the numbers of the lines that went (null if none; in place of a given column of that name)."""
    return carrying(docs, ("doc_id", "text", "n_chars"), lambda rows: _dropped(rows, edits, min_chars), ["_repeated"])


def _dropped(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    found = pinned(repeated_lines(docs, edits, min_chars)).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("repeated").alias("_repeated"))
    rows, numbers = found.agg(F.count("*"), F.coalesce(F.sum(F.size("_repeated")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and numbers <= 8 * BROADCAST_ROWS:
        found = F.broadcast(found)
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_repeated", i)), "\n")
    text = F.when(F.col("_repeated").isNotNull(), kept).otherwise(F.col("text"))
    out = {"text": text} | ({"n_chars": F.when(F.col("_repeated").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return docs.join(found, same, "left").withColumns(out).select(*docs.columns, "_repeated")


@query("op3_line_dedup")
def _query(t: Tables) -> DataFrame:
    out = drop_repeated_lines(t.documents)
    return out.select("doc_id", F.coalesce(F.size("_repeated"), F.lit(0)).cast("long").alias("n_repeated"), F.coalesce(F.array_join(F.col("_repeated").cast("array<string>"), ","), F.lit("")).alias("repeated_lines"),
                      F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
