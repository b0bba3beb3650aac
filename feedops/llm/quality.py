"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

Indicators are scaled by the log ratio of their counts in the two classes, and a linear hinge-loss model is fitted to them by dual coordinate descent;
a sigmoid fitted to the margins turns them into scores. Indicators: hashed byte trigrams, hashed 4-grams of byte shapes (letter, capital, digit, space,
and so on), and trigrams of "this word equals the one before". Only texts are looked at, and always whole.

The model is fitted in one task on at most ``SAMPLE`` labelled rows (half of them of either class where there are enough), chosen by a hash of the id; the
bound is a parameter. Results by case: null and empty texts are scored like a text without n-grams; ids and labels that are null are not learned from; a label table without both
classes gives every text the share of label 1 (1.0 without any label); repeated rows are scored each; further columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from feedops.llm.hashing import Rolling, as_text, raw, released, slices, word_bounds
from feedops.llm.registry import Tables, carrying, query

SAMPLE = 16_000
TRIGRAM_BITS, SHAPE_BITS = 15, 13
N_FEATURES = (1 << TRIGRAM_BITS) + (1 << SHAPE_BITS) + 8
EPOCHS, COST = 10, 1.0
_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[97:123], _SHAPES[65:91], _SHAPES[48:58], _SHAPES[128:] = 97, 65, 48, 97


def _grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    size = len(data) - n + 1
    value = np.zeros(size, np.uint32)
    for i in range(n):
        value = (value << np.uint32(8)) | data[i : size + i]
    return (value * np.uint32(2654435761)) >> np.uint32(32 - bits)


def indicators(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and the mask of the features of every text. The mask is reused for the next row."""
    seen = np.zeros(N_FEATURES, bool)
    for start, end in slices(texts):
        data, rows = raw(texts, start, end)
        trigrams = _grams(data, 3, TRIGRAM_BITS) if len(data) > 2 else np.zeros(0, np.int64)
        shapes = _grams(_SHAPES[data], 4, SHAPE_BITS) + np.uint32(1 << TRIGRAM_BITS) if len(data) > 3 else np.zeros(0, np.int64)
        if len(data):
            begin, stop, first = word_bounds(data, rows)
            hashes = Rolling(data).ranges(begin, stop)
            same = np.zeros(len(hashes), np.int64)
            same[1:] = hashes[1:] == hashes[:-1]
        for k in range(end - start):
            a, b = rows[k], rows[k + 1]
            seen[:] = False
            if b - a > 2:
                seen[trigrams[a : b - 2]] = True
            if b - a > 3:
                seen[shapes[a : b - 3]] = True
            if b > a and first[k + 1] - first[k] > 3:
                s = same[first[k] + 1 : first[k + 1]]
                seen[N_FEATURES - 8 + (s[:-2] * 4 + s[1:-1] * 2 + s[2:])] = True
            yield start + k, seen


def fit_margin(rows: list[np.ndarray], good: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(log-count ratios, weights of the plain indicators, bias); rows are scaled to unit length."""
    counts = np.ones((2, N_FEATURES))
    for x, g in zip(rows, good):
        counts[int(g), x] += 1
    counts /= counts.sum(1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    y = np.where(good, 1.0, -1.0)
    scaled = [ratio[x] / max(1e-9, np.sqrt((ratio[x] ** 2).sum())) for x in rows]
    upper = cost * weight
    w, bias, alpha, random = np.zeros(N_FEATURES), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            x, z = rows[k], scaled[k]
            gradient = y[k] * (w[x] @ z + bias) - 1
            new = min(max(alpha[k] - gradient / 2.0, 0.0), upper[k])  # a row and the bias have length 1 each
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[x] += step * z
                bias += step
                alpha[k] = new
    return ratio, w * ratio, bias


def fit_sigmoid(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic model of the margin, by Newton steps with a small ridge."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    # The usual smoothed targets keep the slope finite where the classes are separable.
    n1, n0 = (good * weight).sum(), (~good * weight).sum()
    target, theta = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-6 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    """One row with the model, from a bounded sample of (label, features, share): ``share`` is the number of labelled rows of the class."""
    rows = [np.frombuffer(x, np.uint16).astype(np.int64) for x in sample["features"]]
    good = sample["label"].to_numpy() == 1
    both = 0 < good.sum() < len(good)
    if not both:
        p = float(good.mean())
        model = np.concatenate([np.zeros(2 * N_FEATURES), [0.0, 0.0, np.log((p + 1e-6) / (1 - p + 1e-6))]])
        return pd.DataFrame({"model": [model.tobytes()]})
    # The sigmoid is fitted to margins that its rows had no part in: two halves, each judged by the other's model.
    share = sample["share"].to_numpy(float)
    weight = np.where(good, share[good][0] / good.sum(), share[~good][0] / (~good).sum())
    weight = weight * len(weight) / weight.sum()
    even = np.ones(len(rows))
    margin, half = np.zeros(len(rows)), np.arange(len(rows)) % 2 == 0
    for part in (half, ~half):
        at = np.flatnonzero(~part)
        if not 0 < good[at].sum() < len(at):
            at = np.arange(len(rows))
        ratio, w, bias = fit_margin([rows[i] for i in at], good[at], even[at])
        margin[part] = [w[x].sum() / max(1e-9, np.sqrt((ratio[x] ** 2).sum())) + bias for x in (rows[i] for i in np.flatnonzero(part))]
    slope, intercept = fit_sigmoid(margin, good, weight)
    ratio, w, bias = fit_margin(rows, good, even)
    return pd.DataFrame({"model": [np.concatenate([w, ratio, [bias, slope, intercept]]).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The model, from ``labels`` (doc_id, label 0 or 1). Only the ids of the bounded sample are sent to the executors."""
    given = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return np.concatenate([np.zeros(2 * N_FEATURES), [0.0, 0.0, 30.0]]).tobytes()
    # Half the sample for either class, or what there is of the smaller one and the rest of the larger.
    few = min(shares.get(0, 0), shares.get(1, 0), sample // 2)
    chosen = None
    for label, n in sorted(shares.items()):
        most = min(n, max(few, min(sample // 2, n), sample - few if few < sample // 2 else 0))
        part = given.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("share", F.lit(n).cast("double"))
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "share")
    # An id may have any number of rows: one of each, the smallest, is left before they meet in one task.
    each = _with_features(picked).groupBy("doc_id").agg(F.min(F.struct("features", "label", "share")).alias("_row")).select("doc_id", "_row.*")
    fitted = each.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda s: _fit(s.sort_values("doc_id").reset_index(drop=True)), "model binary").first()
    return fitted["model"] if fitted else np.concatenate([np.zeros(2 * N_FEATURES), [0.0, 0.0, 30.0]]).tobytes()


def _with_features(picked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(seen).astype(np.uint16).tobytes() for _, seen in indicators(as_text(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("share"), pa.array(found, pa.binary())], ["doc_id", "label", "share", "features"])

    types = dict(picked.dtypes)
    return picked.mapInArrow(released(run), f"doc_id {types['doc_id']}, label {types['label']}, share double, features binary")


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """All columns of ``docs`` and ``_score``, from 0 to 1 (in place of a given column of that name)."""
    return carrying(docs, ("doc_id", "text"), lambda rows: _scored(rows, model), ["_score"])


def _scored(docs: DataFrame, model: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(model, np.float64)
        w, squared = values[:N_FEATURES], values[N_FEATURES : 2 * N_FEATURES] ** 2
        bias, slope, intercept = values[2 * N_FEATURES :]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, seen in indicators(as_text(batch.column("text"))):
                at = np.flatnonzero(seen)
                margin = w[at].sum() / max(1e-9, np.sqrt(squared[at].sum())) + bias
                out[row] = 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "_score"])

    return docs.mapInArrow(released(run), StructType([*docs.schema.fields]).add("_score", DoubleType()))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1. A null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))


@query("op5_quality")
def _query(t: Tables) -> DataFrame:
    model = train(t.documents, training_labels(t.labels))
    scored = score(t.documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
