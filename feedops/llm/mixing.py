"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's documents are each taken ``floor(target / size)`` times; the rest of the target is filled in the order of a seeded hash of the document, and the
one document in which it ends is taken in part. So every source comes within a word of its target. Results by case: a null or empty text has size 0 and
takes 0 words; a null source is a source of its own, after all others; an empty table gives no rows; rows that repeat whole are equally treated;
with a total of 0 every target is 0. Columns of the documents other than doc_id, text and source are passed through by ``mix`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.llm.registry import Tables, carrying, query
from feedops.session import pinned

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = 20240229
CELLS_BITS = 12
# The plan has a row per source; up to this many rows it is sent to every executor.
BROADCAST_SOURCES = 100_000
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the source as a key that is never null, the size, and the place of the document in the seeded order (63 bits)."""
    return docs.withColumns({
        "_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "_size": size_of(F.col("text")),
        "_place": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 63) - 1)),
    })


def _with_plan(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """Rows with their source's plan; a hot source is never gathered in one task."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "_source")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.col("_place"), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"]).drop("_salt")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(_source, source_size, target): water-filling of the total by cyclic weights, each source stopping at ``max_epochs`` times its size.

    Every round shares what the full sources leave by weight among the others; at most one round per source, in practice a handful.
    The only ordering is that of the source names, over one row per source.
    """
    # Keys begin with "s", or are "n" for no source: the order of code points, that one last.
    order = Window.orderBy(F.col("_source") == "n", F.col("_source"))
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rows = pinned(sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("_cap", cap))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        is_full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        got = rows.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("_cap"))), F.sum(F.when(~is_full, F.col("_weight")))).first()
        if got[0] == full or not got[2]:
            break
        full, level = got[0], max(level, (total - (got[1] or 0.0)) / got[2])
    return rows.select("_source", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))


def mixing_plan(keyed: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """(_source, source_size, target, whole, _cut, _part) and its number of rows, from rows of (_source, _size, _place).

    ``whole`` repetitions for all; one more for places below ``_cut``; ``_part`` words of the document at ``_cut``. Found by sums over 2^12 cells
    of the places (combined before the shuffle), then over the places of one cell per source.
    """
    by_source = keyed.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    plan = targets(by_source, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = pinned(plan.withColumn("_rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")))
    sources = plan.count()
    cell = F.shiftright(F.col("_place"), 63 - CELLS_BITS)
    before = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.withColumn("_cell", cell).groupBy("_source", "_cell").agg(F.sum("_size").alias("_words"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    ends = _bounded(cells.join(plan.select("_source", "_rest"), "_source").where("_before < _rest and _before + _words >= _rest"), sources)
    ends = ends.select("_source", "_cell", (F.col("_rest") - F.col("_before")).alias("_left"))
    inside = keyed.withColumn("_cell", cell).join(ends, ["_source", "_cell"])
    at = Window.partitionBy("_source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    units = inside.groupBy("_source", "_place").agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows"), F.first("_left").alias("_left"))
    units = units.withColumn("_before", F.coalesce(F.sum("_words").over(at), F.lit(0)))
    cut = units.where("_before < _left and _before + _words >= _left")
    cut = cut.select("_source", F.col("_place").alias("_cut"), F.expr("cast(round((_left - _before) / _rows) as bigint)").alias("_part"))
    plan = plan.join(cut, "_source", "left").select("_source", "source_size", "target", "whole", "_cut", "_part")
    return pinned(plan), sources


def _bounded(plan: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan


def taken(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """Rows with ``_copies`` whole repetitions and ``_words_of_last`` words of a further, partial one."""
    joined = _with_plan(rows, plan, sources)
    copies = F.col("whole") + F.when(F.col("_place") < F.col("_cut"), 1).otherwise(0)
    last = F.when(F.col("_place") == F.col("_cut"), F.least(F.col("_part"), F.col("_size"))).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("_copies", copies).withColumn("_words_of_last", last)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for every repetition; a partial one has the first words of its text."""
    return carrying(docs, ("doc_id", "text", "source", "lang", "n_chars"), lambda rows: _mixed(rows, weights, max_epochs, seed))


def _mixed(docs: DataFrame, weights: Sequence[float], max_epochs: float, seed: int) -> DataFrame:
    keyed = _keyed(docs, seed)
    plan, sources = mixing_plan(pinned(keyed.select("_source", "_size", "_place")), weights, max_epochs)
    rows = taken(keyed, plan, sources)
    repetitions = (F.col("_copies") + F.when(F.col("_words_of_last") > 0, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.greatest(repetitions, F.lit(1))))).where(F.col("_turn") <= repetitions)
    partial = (F.col("_words_of_last") > 0) & (F.col("_words_of_last") < F.col("_size")) & (F.col("_turn") == repetitions)
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("_words_of_last"), F.lit(1)).cast("int")), " ")
    out = {"text": F.when(partial, part).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(partial, F.length(part)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(out).select(docs.columns)


@query("op7_mixing")
def _query(t: Tables) -> DataFrame:
    rows = pinned(_keyed(t.documents, SEED).select("doc_id", "_source", "_size", "_place"))
    plan, sources = mixing_plan(rows)
    words = F.col("_copies") * F.col("_size") + F.col("_words_of_last")
    return taken(rows, plan, sources).select("doc_id", F.col("_size").alias("size"), "source_size", "target", words.alias("taken"))
