"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw documents.

Byte trigrams fall into ``BUCKETS`` buckets; smoothed bucket shares of the trusted documents and of the whole corpus give each bucket a log ratio, and a text is
kept if the mean over its trigrams is at least ``THRESHOLD``. Counts cover every document, every decision depends on its text and these
counts alone. Results by case: a null or empty text has no words and fails; without trusted documents every ratio is 0 and passes; repeated rows
count and are judged each; null ids are never trusted; further columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from feedops.llm.hashing import Rolling, as_text, mix, raw, slices, word_bounds
from feedops.llm.registry import Tables, carrying, query

BITS = 14
BUCKETS = 1 << BITS
THRESHOLD = -0.3
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
# What counts as a symbol.
SYMBOLS = b"#*$%&|<>"
# Up to so many trusted ids (8 bytes each) are sent to every executor; more are joined.
BROADCAST_IDS = 4_000_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _buckets(data: np.ndarray) -> np.ndarray:
    n = max(0, len(data) - 2)
    value = (data[:n].astype(np.uint32) << np.uint32(16)) | (data[1 : n + 1].astype(np.uint32) << np.uint32(8)) | data[2 : n + 2]
    return (value * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _inside(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` trigram places lie within one row."""
    inside = np.ones(n, bool)
    for back in (1, 2):
        at = rows[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    return inside


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    bounds = np.minimum(bounds, len(values))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_counts(data: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row of a slice; all of them whole-text."""
    n = len(rows) - 1
    if not len(data):
        return {c: np.zeros(n, np.int64) for c in COUNTS}
    begin, stop, first = word_bounds(data, rows)
    rolling = Rolling(data)
    out = {"n_words": np.diff(first)}
    code_point = (data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(code_point)])
    out["word_chars"] = _row_sums(sums[stop] - sums[begin], first)
    out["n_symbols"] = _row_sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), rows)
    # Lines with a word, equal to an earlier line of the row.
    feeds = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([rows[:-1], feeds + 1])), np.sort(np.concatenate([feeds, rows[1:]]))
    worded = np.searchsorted(begin, ends) > np.searchsorted(begin, starts)
    starts, ends = starts[worded], ends[worded]
    row = np.searchsorted(rows, starts, side="right") - 1
    _, index = np.unique(mix(rolling.ranges(starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[index], minlength=n)
    # Words inside three-word windows that occur twice or more in the row.
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(begin) > 2:
        word = rolling.ranges(begin, stop)
        row = np.searchsorted(rows, begin, side="right") - 1
        windows = np.flatnonzero(row[2:] == row[:-2])
        value = word[windows] + word[windows + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[windows + 2] * np.uint64(0x165667B19E3779F9)
        _, inverse, count = np.unique(mix(value + row[windows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        repeated = windows[count[inverse] > 1]
        covered = np.zeros(len(begin), bool)
        for k in range(3):
            covered[repeated + k] = True
        out["n_repeat_words"] = _row_sums(covered, first)
    return out


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Bucket counts, one row for the whole corpus and one for its trusted documents; ``trusted`` has the column doc_id."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    marked = ids.withColumn("_trusted", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        marked = F.broadcast(marked)
    rows = docs.select("doc_id", "text").join(marked, "doc_id", "left").select("text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trust, texts = batch.column("_trusted").to_numpy(zero_copy_only=False), as_text(batch.column("text"))
            for a, b in slices(texts):
                data, at = raw(texts, a, b)
                found = _buckets(data)
                inside = _inside(at, len(found))
                counts[0] += np.bincount(found[inside], minlength=BUCKETS)
                good = np.repeat(trust[a:b], np.diff(at))[: len(found)]
                counts[1] += np.bincount(found[inside & good], minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "n", "good"])

    # The result has at most BUCKETS rows, however large the corpus.
    found = rows.mapInArrow(run, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[:, found["bucket"].to_numpy(np.int64)] = found[["n", "good"]].to_numpy(float).T
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw_share, good_share = ((c + 1) / (c.sum() + BUCKETS) for c in counts)
    return np.log(good_share / raw_share)


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, the counts, ``llr`` (0 for texts under three bytes), ``base_failed`` and ``kept`` (in place of given columns of those names)."""
    return carrying(docs, ("doc_id", "text"), lambda rows: _judged(rows, ratios, threshold), [*COUNTS, "llr", "base_failed", "kept"])


def _judged(docs: DataFrame, ratios: np.ndarray, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_text(batch.column("text"))
            parts: list[dict[str, np.ndarray]] = []
            for a, b in slices(texts):
                data, at = raw(texts, a, b)
                part = text_counts(data, at)
                found = _buckets(data)
                value = np.where(_inside(at, len(found)), ratios[found], 0.0)
                part["llr"] = _row_sums(value, at) / np.maximum(1, np.diff(at) - 2)
                parts.append(part)
            out = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in [*COUNTS, "llr"]}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[c].astype(np.int64)) for c in COUNTS], pa.array(out["llr"])], [*batch.schema.names, *COUNTS, "llr"])

    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in COUNTS], StructField("llr", DoubleType())])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return docs.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


@query("op9_quality_rules")
def _query(t: Tables) -> DataFrame:
    ratios = log_ratios(ngram_counts(t.documents, trusted_of(t.labels)))
    return judge(t.documents.select("doc_id", "text"), ratios).drop("text")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
