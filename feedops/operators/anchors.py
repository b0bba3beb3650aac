"""Greedy window starts per key, exact for any key size.

A key's first event is an anchor; after that, the first event more than ``gap`` after the current anchor is the next one.
That is sequential inside a key, so the work is arranged such that no task ever holds a whole busy key:

* Time is cut into cells of ``gap + 1`` microseconds. A cell holds at most one anchor, and the anchor of any event lies in
  the event's own cell or the one before it. Finding an event's anchor is therefore an equi-join on (key, cell).
* Keys with few events are folded inside one aggregate, in the JVM.
* Busy keys are cut where two neighbouring cells lie further apart than the gap: a new anchor starts there whatever came
  before. Small pieces are folded like small keys.
* A long unbroken piece is cut into chunks of consecutive cells with a bounded number of events. Each chunk is reduced, in
  parallel, to the function "last anchor before the chunk -> last anchor inside it"; these functions are small step
  functions, composed in a tree, and the resulting entry anchors are sent back to the chunks.
* Where a single cell is already too large for one task, every time is given a pointer to the first time after its window, by a range-partitioned lookup.
  Joining the pointers with themselves doubles their reach, so n windows take log2(n) rounds.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.session import pinned

FOLD_ROWS = 10_000
CELL_ROWS = 1_000_000
CHUNK_ROWS = 4_000_000
FAN_IN = 64
_NO_ANCHOR = -(2**61)


def strict_gap(gap_us: int, closed: bool) -> int:
    """Integer ``g`` such that a new anchor needs ``t - anchor > g`` (``closed``: ``t - anchor >= gap_us``)."""
    return gap_us - 1 if closed else gap_us


def _floor_div(value: Column, width: int) -> Column:
    """Exact integer floor division, also for times before 1970."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def anchors(events: DataFrame, keys: Sequence[str], time_us: str, gap_us: int, closed: bool = False, *,
            fold_rows: int = FOLD_ROWS, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS,
            fan_in: int = FAN_IN) -> DataFrame:
    """Anchor times per key: ``keys..., anchor`` (epoch microseconds).

    Runs one counting job to find busy keys; everything else stays lazy unless there are some.
    """
    keys = list(keys)
    gap = strict_gap(gap_us, closed)
    times = events.select(*keys, F.col(time_us).alias("_t"))
    busy = pinned(times.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_rows).select(*keys))
    if busy.isEmpty():
        return _folded(times, keys, gap)
    calm = times.join(busy, _same(times, busy, keys), "left_anti")
    crowded = times.join(busy, _same(times, busy, keys), "left_semi")
    return _folded(calm, keys, gap).unionByName(
        _busy_anchors(crowded, keys, gap, fold_rows, cell_rows, chunk_rows, fan_in)
    )


def anchors_by_cell(found: DataFrame, keys: Sequence[str], gap_us: int, closed: bool = False) -> DataFrame:
    """``keys..., _cell, _own, _prev``: the anchor inside each cell and the one in the cell before."""
    keys = list(keys)
    cell = _floor_div(F.col("anchor"), strict_gap(gap_us, closed) + 1)
    spread = found.withColumn("_lag", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_cell", cell + F.col("_lag"))
    return spread.groupBy(*keys, "_cell").agg(
        F.max(F.when(F.col("_lag") == 0, F.col("anchor"))).alias("_own"),
        F.max(F.when(F.col("_lag") == 1, F.col("anchor"))).alias("_prev"),
    )


def with_anchor(events: DataFrame, keys: Sequence[str], time_us: str, gap_us: int, closed: bool = False,
                **sizes: int) -> DataFrame:
    """Every event with the anchor of its window, as column ``anchor``."""
    keys = list(keys)
    found = anchors(events, keys, time_us, gap_us, closed, **sizes)
    cells = anchors_by_cell(found, keys, gap_us, closed)
    placed = events.withColumn("_cell", _floor_div(F.col(time_us), strict_gap(gap_us, closed) + 1))
    own_first = F.when(cells["_own"] <= placed[time_us], cells["_own"]).otherwise(cells["_prev"])
    match = _same(placed, cells, keys) & (placed["_cell"] == cells["_cell"])
    return placed.join(cells, match, "inner").select(*[placed[c] for c in events.columns], own_first.alias("anchor"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """NULL-safe key equality: a missing key is a group of its own, as in a group-by."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _fold(times: Column, gap: int) -> Column:
    """Anchors of one sorted array of times."""
    none = F.array().cast("array<bigint>")

    def step(found: Column, t: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        return F.when(F.coalesce(t - last > gap, F.lit(True)), F.concat(found, F.array(t))).otherwise(found)

    return F.aggregate(times, none, step)


def _folded(times: DataFrame, groups: Sequence[str], gap: int) -> DataFrame:
    gathered = times.groupBy(*groups).agg(F.array_sort(F.collect_set("_t")).alias("_times"))
    return gathered.select(*groups, F.explode(_fold(F.col("_times"), gap)).alias("anchor"))


def _busy_anchors(times: DataFrame, keys: list[str], gap: int, fold_rows: int, cell_rows: int, chunk_rows: int,
                  fan_in: int) -> DataFrame:
    times = times.withColumn("_cell", _floor_div(F.col("_t"), gap + 1))
    # One row per (key, cell): the windows below see at most time span / gap rows per key, however busy it is.
    cells = times.groupBy(*keys, "_cell").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    in_order = Window.partitionBy(*keys).orderBy("_cell")
    cut_here = F.coalesce(F.col("_lo") - F.lag("_hi").over(in_order) > gap, F.lit(True))
    cells = cells.withColumn("_start", F.when(cut_here, F.col("_lo"))).withColumn("_piece", F.max("_start").over(in_order))
    piece = Window.partitionBy(*keys, "_piece")
    cells = (
        cells.withColumn("_cells", F.count(F.lit(1)).over(piece))
        .withColumn("_rows", F.sum("_n").over(piece))
        .withColumn("_fattest", F.max("_n").over(piece))
        .withColumn("_before", F.sum("_n").over(piece.orderBy("_cell")) - F.col("_n"))
        .withColumn("_chunk", _floor_div(F.col("_before"), chunk_rows))
        .withColumn("_kind", F.when(F.col("_cells") == 1, F.lit("single")).when(F.col("_rows") <= fold_rows, F.lit("fold"))
                    .when(F.col("_fattest") <= cell_rows, F.lit("chunk")).otherwise("round"))
    )
    cells = pinned(cells.select(*keys, "_cell", "_piece", "_chunk", "_kind"))
    kinds = {row["_kind"]: row["_chunks"] for row in
             cells.groupBy("_kind").agg(F.max("_chunk").alias("_chunks")).collect()}
    wide = [*keys, "_piece"]
    parts = [cells.filter("_kind = 'single'").select(*keys, F.col("_piece").alias("anchor"))]

    def members(kind: str) -> DataFrame:
        chosen = cells.filter(F.col("_kind") == kind)
        match = _same(times, chosen, keys) & (times["_cell"] == chosen["_cell"])
        return times.join(chosen, match, "inner").select(*[times[k] for k in keys], "_t", "_piece", "_chunk")

    if "fold" in kinds:
        parts.append(_folded(members("fold"), wide, gap).select(*keys, "anchor"))
    if "chunk" in kinds:
        parts.append(_chunked(members("chunk"), keys, gap, int(kinds["chunk"]) + 1, fan_in))
    if "round" in kinds:
        parts.append(_doubling(members("round"), keys, gap))
    return reduce(DataFrame.unionByName, parts)


def _successors(times: DataFrame, gap: int) -> DataFrame:
    """``_w, _node, _next``: the first time more than ``gap`` after every time of a piece, null where there is none.

    Times and the places asked for are cut into ranges together, so that a busy piece lies in many tasks. A place without a time behind it in its own range
    takes the first one of the ranges after it, from one row per range and piece.
    """
    asked = times.select("_w", (F.col("_t") + gap).alias("_at"), F.col("_t").alias("_node"), F.lit(None).cast("bigint").alias("_there"))
    there = times.select("_w", F.col("_t").alias("_at"), F.lit(None).cast("bigint").alias("_node"), F.col("_t").alias("_there"))
    ranged = pinned(asked.unionByName(there).repartitionByRange("_w", "_at").withColumn("_part", F.spark_partition_id()))
    firsts = ranged.groupBy("_w", "_part").agg(F.min("_there").alias("_first"))
    later = Window.partitionBy("_w").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_later", F.min("_first").over(later)).select("_w", "_part", "_later")
    # From the latest back; at equal times the place comes first, since its time has to lie after it.
    behind = Window.partitionBy("_w", "_part").orderBy(F.col("_at").desc(), F.col("_there").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_here", F.min("_there").over(behind)).filter(F.col("_node").isNotNull())
    return found.join(firsts, ["_w", "_part"]).select("_w", "_node", F.coalesce("_here", "_later").alias("_next"))


def _doubling(times: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Anchors of pieces with cells too large for a task, in as many rounds as the number of their windows has bits.

    Level k leads 2^k windows on. It is needed only at the pieces' first times and at times that level k-1 leads to, so levels shrink as paths meet. Going back
    down, every level doubles the anchors found. A time that many paths lead to is a skewed join key, which adaptive execution splits.
    """
    times = times.select(F.struct(*keys, "_piece").alias("_w"), "_t").distinct()
    root = F.col("_node") == F.col("_w._piece")

    def reached(level: DataFrame) -> DataFrame:
        """The rows of ``level`` at first times and at times that it leads to itself."""
        targets = level.select("_w", F.col("_next").alias("_node")).distinct()
        return level.filter(root).unionByName(level.filter(~root).join(targets, ["_w", "_node"], "left_semi"))

    level = pinned(_successors(times, gap).filter(F.col("_next").isNotNull()))
    levels = []
    while not level.filter(root).isEmpty():
        levels.append(level)
        onward = level.select("_w", F.col("_node").alias("_next"), F.col("_next").alias("_far"))
        level = pinned(reached(level).join(onward, ["_w", "_next"]).select("_w", "_node", F.col("_far").alias("_next")))
    found = times.select("_w").distinct().select("_w", F.col("_w._piece").alias("_node"))
    for level in reversed(levels):
        both = F.explode(F.array_compact(F.array("_node", "_next")))
        found = found.join(level, ["_w", "_node"], "left").select("_w", both.alias("_node"))
    return found.select(*[F.col(f"_w.`{k}`").alias(k) for k in keys], F.col("_node").alias("anchor"))


# --- chunk functions: sorted arrays (start, exit). An entry anchor ``a`` leads to the first start > a + gap, and from there
# --- to its exit; without such a start the chunk holds no anchor and ``a`` stays the last one.


def _chunk_function(t: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one chunk of sorted distinct times."""
    following = np.searchsorted(t, t + gap, side="right")
    last = t.copy()
    # Successors lie in later cells, so whole cells can be filled at once from the back.
    cell = t // (gap + 1)
    edges = np.append(np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)), len(t))
    for begin, end in zip(edges[-2::-1], edges[:0:-1], strict=True):
        nxt = following[begin:end]
        inside = nxt < len(t)
        last[begin:end] = np.where(inside, last[np.minimum(nxt, len(t) - 1)], t[begin:end])
    # Reachable starts: the first cell, and the first time after it.
    reach = min(int(edges[1]) + 1, len(t))
    return _compressed(t[:reach], last[:reach])


def _compressed(start: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keep the last start of every run with the same exit."""
    keep = np.append(leave[1:] != leave[:-1], True)
    return start[keep], leave[keep]


def _apply(start: np.ndarray, leave: np.ndarray, entry: np.ndarray, gap: int) -> np.ndarray:
    at = np.searchsorted(start, entry + gap, side="right")
    return np.where(at < len(start), leave[np.minimum(at, len(start) - 1)], entry)


def _composed(parts: list[tuple[np.ndarray, np.ndarray]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    start, leave = parts[-1]
    for head, head_leave in reversed(parts[:-1]):
        through = _apply(start, leave, head_leave, gap)
        # An entry that passes the head chunk untouched lies wholly before the next one: only its first start matters.
        start, leave = _compressed(np.append(head, start[:1]), np.append(through, leave[:1]))
    return start, leave


def _split(frame: pd.DataFrame) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    frame = frame.sort_values(["_chunk", "_s"])
    chunk, begin = np.unique(frame["_chunk"].to_numpy(), return_index=True)
    starts = np.split(frame["_s"].to_numpy(), begin[1:])
    exits = np.split(frame["_x"].to_numpy(), begin[1:])
    return chunk, list(zip(starts, exits, strict=True))


def _chunked(times: DataFrame, keys: list[str], gap: int, chunks: int, fan_in: int) -> DataFrame:
    wide = [*keys, "_piece"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in times.select(*wide).schema.fields)
    times = pinned(times.select(*wide, "_chunk", "_t").distinct())

    def tagged(like: pd.DataFrame, chunk: object, **columns: object) -> pd.DataFrame:
        size = len(next(iter(columns.values())))
        head = {name: pd.Series([like[name].iloc[0]] * size, dtype=object) for name in wide}
        return pd.DataFrame({**head, "_chunk": chunk, **columns})

    def summarise(frame: pd.DataFrame) -> pd.DataFrame:
        start, leave = _chunk_function(np.sort(frame["_t"].to_numpy()), gap)
        return tagged(frame, frame["_chunk"].iloc[0], _s=start, _x=leave)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        start, leave = _composed(_split(frame)[1], gap)
        return tagged(frame, frame["_parent"].iloc[0], _s=start, _x=leave)

    def walk(frame: pd.DataFrame, entry: int) -> pd.DataFrame:
        chunk, functions = _split(frame)
        entries = []
        for start, leave in functions:
            entries.append(entry)
            entry = int(_apply(start, leave, np.array([entry]), gap)[0])
        return tagged(frame, chunk, _in=np.array(entries, dtype="int64"))

    def walk_top(frame: pd.DataFrame) -> pd.DataFrame:
        return walk(frame, _NO_ANCHOR)

    def walk_down(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return walk(frame, int(entry["_in"].iloc[0]))

    def place(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(frame["_t"].to_numpy())
        at = int(np.searchsorted(t, int(entry["_in"].iloc[0]) + gap, side="right"))
        found = []
        while at < len(t):
            found.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + gap, side="right"))
        return tagged(frame, frame["_chunk"].iloc[0], anchor=np.array(found, dtype="int64"))

    function_schema = f"{names}, _chunk bigint, _s bigint, _x bigint"
    entry_schema = f"{names}, _chunk bigint, _in bigint"
    with_parent = F.expr(f"_chunk div {fan_in}")
    levels = [pinned(times.groupBy(*wide, "_chunk").applyInPandas(summarise, function_schema))]
    while chunks > fan_in:
        chunks = -(-chunks // fan_in)
        upper = levels[-1].withColumn("_parent", with_parent).groupBy(*wide, "_parent")
        levels.append(pinned(upper.applyInPandas(compose, function_schema)))
    entries = levels[-1].groupBy(*wide).applyInPandas(walk_top, entry_schema)
    for level in reversed(levels[:-1]):
        parents = entries.withColumnRenamed("_chunk", "_parent").groupBy(*wide, "_parent")
        children = level.withColumn("_parent", with_parent).groupBy(*wide, "_parent")
        entries = children.cogroup(parents).applyInPandas(walk_down, entry_schema)
    placed = times.groupBy(*wide, "_chunk").cogroup(entries.groupBy(*wide, "_chunk"))
    return placed.applyInPandas(place, f"{names}, _chunk bigint, anchor bigint").select(*keys, "anchor")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
