"""Small Column helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Nested Column helpers would otherwise repeat their argument at every use and grow the tree exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A filter on a computed column is pushed below the projection and repeats its expression there; a generator is not
    crossed. Worth it for expensive expressions only.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def first_nonblank(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    result = F.lit(False)
    for needle in needles:
        result = result | text.contains(needle)
    return result


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp column, zoned or not (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def packed(columns: Sequence[Column]) -> Column:
    """Several values as one string, which tells them apart whatever they hold: all texts, then the lengths of all but the last. NULL if one is."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*texts, *[F.concat(F.lit(","), F.length(t).cast("string")) for t in texts[:-1]])


def unpacked(text: Column, types: Sequence[str]) -> list[Column]:
    """The values in ``packed``, with their types."""
    n = len(types) - 1
    tail = F.substring_index(text, ",", -n)
    ends = F.transform(F.split(tail, ","), lambda size: size.cast("int"))
    sizes = [F.get(ends, F.lit(i)) for i in range(n)]
    starts = [F.lit(1)]
    for size in sizes:
        starts.append(starts[-1] + size)
    sizes.append(F.length(text) - F.length(tail) - starts[-1])
    return [F.substring(text, at, size).cast(kind) for at, size, kind in zip(starts, sizes, types, strict=True)]
