"""Every stage on tables that hold its working names, nulls, repeated rows, or no rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedops.llm import linededup, minhash, mixing, quality, rules

WORKING = ["_score", "_key", "_id", "_repeated", "_late", "_text", "_kept", "_rows", "_size", "_place", "_source", "_turn", "_salt", "_copies", "_part", "_cut", "llr", "n_words", "kept",
           "base_failed", "line", "node", "text_key", "id", "first", "label", "share", "whole", "target", "source_size", "further_columns"]
GIVEN = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "this is a line of more than twenty characters number "


def given(spark, full: bool):
    texts = [f"{LINE}{i % 3}\nanother line of words {i} and {i * 7} and yet more\nshort" for i in range(12)] + [None, "", " ", "\n\n", "word " * 60, f"{LINE}0"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 6 == 0 else i) for i, t in enumerate(texts)]
    rows = [*rows, rows[3], rows[3], (None, "a null id has a text of its own", None, None, None), (None, None, None, None, None)] if full else []
    docs = spark.createDataFrame(rows, GIVEN)
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in WORKING])


def model() -> bytes:
    return np.concatenate([np.ones(2 * quality.N_FEATURES), [0.1, 1.0, 0.0]]).astype(np.float64).tobytes()


STAGES = {
    "quality": (lambda d: quality.score(d, model()), ["_score"]),
    "lines": (linededup.drop_repeated_lines, ["_repeated"]),
    "near_duplicates": (lambda d: minhash.drop_near_duplicates(d, size=5), []),
    "mix": (mixing.mix, []),
    "rules": (lambda d: rules.judge(d, np.zeros(rules.BUCKETS)), [*rules.COUNTS, "llr", "base_failed", "kept"]),
}


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("name", STAGES)
def test_given_columns_come_back(spark, name, full):
    stage, added = STAGES[name]
    docs = given(spark, full)
    out = stage(docs)
    assert sorted(out.columns) == sorted([*[c for c in docs.columns if c not in added], *added])
    found = out.collect()
    assert full == bool(found)
    for row in found:
        for c in WORKING:
            if c not in added:
                assert row[c] == f"{c}:{'null' if row['doc_id'] is None else row['doc_id']}"
    plain = stage(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    narrow = [c for c in ("doc_id", "text", "lang", "source", "n_chars", *added)]
    assert sorted(repr([r[c] for c in narrow]) for r in found) == sorted(repr([r[c] for c in narrow]) for r in plain)
