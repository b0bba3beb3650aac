"""Registration of this subpackage's queries with their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("ann", "urlfilter", "linededup", "minhash", "quality", "licence", "mixing", "packing", "rules", "chat", "merkle", "pii", "alignment")
# Texts are large: a batch handed to a Python worker is bounded by bytes.
BATCH_BYTES = 4 * 1024 * 1024
FURTHER = "further_columns"


class Tables:
    """The given tables of one scale; every access is a plain Parquet scan that Spark prunes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    apply_settings(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def carrying(docs: DataFrame, used: Sequence[str], run: Callable[[DataFrame], DataFrame], added: Sequence[str] = ()) -> DataFrame:
    """``run`` on ``docs`` whose columns other than ``used`` are carried in one struct, so no working name can meet them; they come back as they were.

    ``added`` are the columns that ``run`` adds; where ``docs`` has one of that name, the added one takes its place.
    """
    others = [c for c in docs.columns if c not in used]
    held = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(FURTHER)] if others else []
    out = run(docs.select(*[c for c in docs.columns if c in used], *held))
    given = [F.col(f"`{c}`") if c in used else F.col(f"{FURTHER}.`{c}`").alias(c) for c in docs.columns if c not in added]
    return out.select(*given, *added)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(tables)``; ``sql`` is the equivalent DuckDB statement, if there is one."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(prepared(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"feedops.llm.{name}")
    return QUERIES, ORACLES
