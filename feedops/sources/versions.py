"""A4/L4: a ledger as numbered commits, so that readers see whole states and an append during a prune is not lost.

A commit is a small file that names the data folders of the ledger. It is written aside and renamed to the next number, which fails if another writer has taken
that number. An append then tries again on top of what is there now. A prune rewrites the folders that it has read; folders that were appended meanwhile stay as
they are beside its result. Data folders are never changed, so a reader of an older commit is not disturbed; ``drop_unused`` removes what no commit kept names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from feedops.operators.ledger import LEDGER_SCHEMA, ledger_add, ledger_prune

TRIES = 20


class ConflictError(RuntimeError):
    """Other writers were faster every time."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """(number, data folders) of the latest commit; (0, []) before the first."""
    place, system = _files(spark, f"{root}/_commits")
    numbers = [int(s.getPath().getName()) for s in system.listStatus(place) if s.getPath().getName().isdigit()] if system.exists(place) else []
    if not numbers:
        return 0, []
    names = [r[0] for r in spark.read.text(f"{root}/_commits/{max(numbers):012d}").collect()]
    return max(numbers), [n for n in names if n]


def commit(spark: SparkSession, root: str, number: int, names: list[str]) -> bool:
    """Publish ``names`` as commit ``number``; false if that number is taken. One of any number of writers gets it."""
    aside, system = _files(spark, f"{root}/_commits/.{uuid.uuid4().hex}")
    target, _ = _files(spark, f"{root}/_commits/{number:012d}")
    out = system.create(aside, False)
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        # Without the overwrite option, renaming onto an existing file is an error.
        context.rename(system.makeQualified(aside), system.makeQualified(target), spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as error:
        if "already exist" not in str(error).lower():
            raise
        system.delete(aside, False)
        return False
    return True


def read(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """The ledger as of the latest commit, or of the given folders."""
    names = folders(spark, root)[1] if names is None else names
    if not names:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    parts = [spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/{n}") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _write(rows: DataFrame, root: str) -> str:
    name = f"data-{uuid.uuid4().hex}"
    rows.hint("rebalance", "source", "gallery_name").write.partitionBy("source", "gallery_name").parquet(f"{root}/{name}")
    return name


def append(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """L2: add the rows whose keys are not there yet; returns the commit's number. Tried again on top of what other writers add meanwhile."""
    for _ in range(TRIES):
        number, names = folders(spark, root)
        if commit(spark, root, number + 1, [*names, _write(ledger_add(read(spark, root, names), rows), root)]):
            return number + 1
    raise ConflictError(root)


def prune(spark: SparkSession, root: str, before: Column, meanwhile: Callable[[], None] | None = None) -> int:
    """L4: leave out rows delivered before ``before``; returns the commit's number. ``meanwhile`` runs between writing and publishing (for tests)."""
    _, names = folders(spark, root)
    kept, _ = ledger_prune(read(spark, root, names), before)
    written = _write(kept, root)
    if meanwhile is not None:
        meanwhile()
    for _ in range(TRIES):
        number, now = folders(spark, root)
        if not set(names) <= set(now):
            raise ConflictError(f"{root}: pruned by somebody else")
        if commit(spark, root, number + 1, [written, *[n for n in now if n not in names]]):
            return number + 1
    raise ConflictError(root)


def drop_unused(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Remove commits but the last ``keep`` and the data folders that none of these names, if no writer is at work; returns how many folders went."""
    latest, _ = folders(spark, root)
    named: set[str] = set()
    for number in range(max(1, latest - keep + 1), latest + 1):
        named |= {r[0] for r in spark.read.text(f"{root}/_commits/{number:012d}").collect()}
    for number in range(1, latest - keep + 1):
        place, system = _files(spark, f"{root}/_commits/{number:012d}")
        system.delete(place, False)
    place, system = _files(spark, root)
    old = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
    for path in old:
        system.delete(path, True)
    return len(old)
