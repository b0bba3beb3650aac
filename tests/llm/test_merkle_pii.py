"""Merkle manifest and personal data against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedops.llm import merkle, pii, registry

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, level string, tree int, draw int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, more: int = 0) -> str:
    doc, source, lang, n, text = row
    values = (doc, source, lang, None if n is None else n + more, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes: list[str], at: int) -> tuple[str, list]:
    """The root of ``nodes`` and the (side, sibling) steps of one of them."""
    steps = []
    while len(nodes) > 1:
        other = at ^ 1
        steps.append(("left" if at % 2 else "right", nodes[other]) if other < len(nodes) else ("none", ""))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at //= 2
    return nodes[0], steps


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted([r for r in rows if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    leaves = {x: [leaf(r) for r in trees[x]] for x in langs}
    subroots = {x: climb(leaves[x], 0)[0] for x in langs}
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            steps = climb(leaves[x], i)[1] + climb(list(subroots.values()), k)[1]
            root = climb(list(subroots.values()), k)[0]
            found = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for side, sibling in steps:
                found = h(sibling, found) if side == "left" else h(found, sibling) if side == "right" else h(found)
            out.append((r[0], leaf(r), subroots[x], root, h(*[s for _, s in steps]), found, found == root))
    return sorted(out, key=repr)


def given(sizes: dict) -> list[tuple]:
    draw = random.Random(4)
    rows = [(draw.randint(-5, 10**6), draw.choice(["a", None, "é"]), lang, draw.choice([None, 3, 2**63 - 1]), draw.choice([None, "", "x\ny", "ñ" * 50])) for lang, n in sizes.items() for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 300, None: 1, "de": 257, "é": 2, "z": 0, "": 5}, {None: 17}, {f"l{i:03}": 1 + i % 3 for i in range(70)}])
def test_manifest_against_plain_trees(spark, sizes):
    rows = given(sizes)
    rows += rows[:2] + [(None, None, rows[0][2], None, None)] * 3
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)
    found = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest(rows)


def test_nodes_beyond_the_broadcast_are_salted(spark, monkeypatch):
    rows = given({"en": 40, "de": 9})
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)
    want = sorted(merkle.manifest(docs).collect(), key=repr)
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    assert sorted(merkle.manifest(docs).collect(), key=repr) == want and all(r["verified"] for r in want)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).collect() == []


RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            odd = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            good = (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and odd % 10 == 0, 8 <= len(digits) <= 15)[k]
            if good:
                out.append((k, m.start(), m.end()))
    return out


PIECES = ["a", "é.b", "x@y", "@", ".com", "..", "1.2.3.4", "256", ".", "0001", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (427) 555-5262", "+", "555", "(", ")", "\n", "%", "漢", "4" * 30, "a.b@c-d.e.f@g.h", "()"]


def test_base_spans_are_those_of_the_rules():
    draw = random.Random(9)
    for _ in range(5000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 9)))
        assert pii.base_spans(text) == plain_base(text), repr(text)


def test_long_unbroken_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.document(text)


def test_expectation_maximisation_finds_the_better_labelers():
    draw = np.random.default_rng(3)
    truth = draw.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.6, 0.55, 0.8, 0.5])
    cast = np.where(draw.random((20_000, 6)) < right, truth[:, None] + 1, 2 - truth[:, None])
    votes, n = np.unique((cast * 3 ** np.arange(5, -1, -1)).sum(1), return_counts=True)
    p, rates = pii.reliabilities(votes, np.zeros(len(votes), bool), n.astype(float))
    assert np.abs(rates[1, :, 2] - right).max() < 0.03 and np.abs(rates[0, :, 1] - right).max() < 0.03
    assert abs((p * n).sum() / n.sum() - 0.4) < 0.03


def test_votes_add_what_the_rules_miss(spark):
    true = [f"so thon call +1 ({200 + i}) 555-{1000 + i} 4{i:015d} end" for i in range(40)]
    hidden = ["call me on (427) 555-5262 please", "my card 4111 1111 1111 1111 1.2.3.4 there", "mail jane.doe [at] example [dot] com now"]
    clean = ['token = "a3a1b97e25e5c1059743005344d08a6b96b1"', "nothing to see", "in 2020 there were 1234567 of 99", "", None, "version 1.2.3", "ratio 3:4 at dot"]
    base = [f"a{i}@mail.example.com and +1 (427) 555-{1000 + i}, 4111111111111111 from 10.20.30.{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(true + hidden + clean + base)] + [(None, "x@y.de")]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, spans string, kind int")).collect()}
    for doc, text in rows:
        kept = [(s["kind"], s["begin"], s["end"]) for s in found[doc] if s["base"]]
        assert kept == plain_base(text or "")
        spans = sorted((s["begin"], s["end"]) for s in found[doc] if not s["base"])
        assert all(e <= b for (_, e), (b, _) in zip(spans, spans[1:]))
        if text in clean:
            assert found[doc] == []
    for text in hidden[:2]:
        doc = next(d for d, t in rows if t == text)
        assert any(not s["base"] for s in found[doc]), text


def test_personal_data_of_no_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_counts_the_base_spans_of_each_kind(spark, tmp_path):
    rows = [(1, "1.2.3.4 5.6.7.8 and 9.9.9.9"), (2, "4111111111111111"), (3, "+1 (427) 555-5262, a@b.de, c@d.de, 10.0.0.1"), (4, "999.1.1.1"), (5, ""), (6, None), (None, "x@y.de")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in registry.QUERIES["op13_pii"](spark, str(tmp_path)).collect()}
    for doc, text in rows:
        spans = sorted(plain_base(text or ""))
        assert [found[doc][f"n_{name}"] for name in pii.KINDS] == [sum(k == kind for k, _, _ in spans) for kind in range(4)], text
        assert found[doc]["base_sha256"] == h(",".join(f"{pii.KINDS[k]}:{b}:{e}" for k, b, e in spans))
