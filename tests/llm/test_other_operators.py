"""URL filter, nearest neighbours, licence scan, chat formatting, the pipeline and the registered SQL."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from feedops.llm import ann, bloom, chat, graph, licence, registry, urlfilter
from tools import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, _, note = check.compare(spark, check.connect(FOLDER), name, FOLDER)
    assert ok, note


def test_entry_offers_one_query_per_operator_and_the_pipeline():
    names = entry_module.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


# --- URLs


def test_rules_and_hosts(spark):
    urls = ["http://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/1?x#y", "http://x.net/es/1", "http://x.net/de/1", "http://com", "http://com/", "https://a.b.com?q=/",
            "http://notexample.com/en/", "http://x.com:80/en/", None, "", "no scheme/", "http://", "x://h/p://q", "http://net/fr/a"]
    got = urlfilter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string"))
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert rows[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert rows[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow") and rows[2][2] == "www.example.com/en/"
    assert rows[3][2:] == ("net/es/", "block") and rows[4][2:] == (None, "allow")
    assert rows[5] == ("com", "", None, "allow") and rows[6][2] == "com/" and rows[7] == ("a.b.com", "", None, "allow")
    assert rows[8][2] == "com/" and rows[9] == ("x.com:80", "/en/", None, "allow")
    assert all(rows[k] == ("", "", None, "allow") for k in (10, 11, 12, 13))
    assert rows[14][:2] == ("h", "/p://q") and rows[15][3] == "block"


def test_listed_urls_are_blocked_whatever_the_filter_lets_through(spark, monkeypatch):
    listed = spark.createDataFrame([(f"https://bad.org/{i}/?utm_source=x&b=2&a=1",) for i in range(500)] + [(None,), ("none",)], "url string")
    pages = spark.createDataFrame([(i, f"http://BAD.org/{i}?a=1&b=2#t") for i in range(1000)] + [(5000, None), (3, "http://bad.org/3?b=2&a=1")], "page_id long, url string").withColumn("listed", F.lit("clash")).withColumn("_w0", F.lit(1))
    for size in (1, bloom.BITS_PER_KEY):  # crowded, so that the exact join has much to remove, and roomy
        monkeypatch.setattr(urlfilter.bloom, "block_count", lambda keys, size=size: max(1, keys * size // 256))
        for most in (0, bloom.BROADCAST_BYTES):
            monkeypatch.setattr(bloom, "BROADCAST_BYTES", most)
            got = urlfilter.url_filter(pages, listed).collect()
            assert len(got) == 1002 and {r.page_id for r in got if r.verdict == "block"} == set(range(500))


def test_other_spellings_of_a_listed_page_are_blocked_by_the_join(spark):
    stuffed, plain = "<html><title>a | b | c | d</title>", "<html><title>a | b | c</title><p>a | b | c | d</p>"
    rows = [(1, "https://x.org/a?b=2&a=1", stuffed), (2, "http://X.org/a/?a=1&utm_source=q&b=2#t", plain), (3, "https://x.org/a", plain), (4, "https://x.org/a?a=1", None), (5, "https://casino.org/", None),
            (6, "http://casino.org/?ref=1", ""), (7, "https://www.example.com/en/z", stuffed), (8, None, stuffed), (9, "https://x.org/a?a=1&b=2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.url for r in urlfilter.listed_of(pages).collect()} == {None, "https://casino.org/", "http://casino.org/?ref=1", "https://www.example.com/en/z", "https://x.org/a?b=2&a=1"}
    got = {r.page_id: (r.listed, r.verdict) for r in urlfilter.url_filter(pages, urlfilter.listed_of(pages)).collect()}
    assert {k for k, v in got.items() if v[1] == "block"} == {1, 2, 5, 6, 9} and len(got) == 9
    assert got[7] == (True, "allow")  # a rule comes before the list


def test_blocked_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = bloom.block_count(4000)
    other = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    got = bloom.probe(other, "key", bloom.build(keys, "key", blocks), blocks, "hit").groupBy((F.substring("key", 2, 9).cast("int") < 4000).alias("in")).agg(F.avg(F.col("hit").cast("int")).alias("share"))
    share = {r["in"]: r["share"] for r in got.collect()}
    assert share[True] == 1 and share[False] < 0.02


# --- vectors


def brute_nearest(rows, asked, k=10):
    out = {}
    for q, v in rows:
        if asked(q):
            found = sorted((float(np.sqrt(((np.asarray(w, np.float64) - np.asarray(v, np.float64)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = found[:k]
    return out


def test_nearest_with_odd_rows_and_a_common_vector(spark):
    r = np.random.default_rng(1)
    good = [(i, [float(x) for x in r.standard_normal(8).astype(np.float32)]) for i in range(60)]
    good += [(i, [1.0] * 8) for i in range(100, 140)]
    odd = [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [None] * 8), (206, [1.0, 2.0]), (None, [2.0] * 8), good[3]]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)).withColumn("vector", F.lit("x"))
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    wanted = brute_nearest(good, lambda q: q % 20 == 0)
    found = {q: [(x.score, x.vec_id) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])] for q in {x.query_id for x in got}}
    assert set(found) == set(wanted)
    for q, rows in wanted.items():
        assert [i for _, i in found[q]] == [i for _, i in rows] and np.allclose([s for s, _ in found[q]], [s for s, _ in rows])
    assert ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall_of_windows_and_ranges(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((3000, 16)).astype(np.float32))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, window=300, range_rows=400, orderings=16).collect()
    wanted = brute_nearest(rows, lambda q: q % 100 == 0)
    hits = sum((x.score, x.vec_id)[1] in {i for _, i in wanted[x.query_id]} for x in got)
    assert len(got) == 300 and hits >= 0.9 * 300


def test_recall_within_a_tight_cluster(spark):
    r = np.random.default_rng(4)
    point = r.standard_normal(16)
    for noise in (1e-5, 1e-9):
        rows = [(i, [float(x) for x in (point + noise * v if i % 3 else v)]) for i, v in enumerate(r.standard_normal((3000, 16)))]
        asked = {q for q in range(0, 3000, 100) if q % 3}
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(asked), window=200, range_rows=400).collect()
        wanted = brute_nearest(rows, lambda q: q in asked)
        hits = sum(x.vec_id in {i for _, i in wanted[x.query_id]} for x in got)
        assert len(got) == 10 * len(asked) and hits >= 0.9 * len(got)


def test_the_window_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "WINDOW", 20)
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((8000, 16)).astype(np.float32))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 400 == 0, range_rows=400).collect()
    wanted = brute_nearest(rows, lambda q: q % 400 == 0)
    assert len(got) == 200 and sum(x.vec_id in {i for _, i in wanted[x.query_id]} for x in got) >= 0.9 * 200


def test_deep_keys_sort_like_the_curve_and_refine_it():
    r = np.random.default_rng(5)
    cells, ids = r.integers(0, 1 << 48, (500, 3)), r.integers(-9, 9, 500)
    deep = [bytes(k) for k in ann.deep_keys(cells, 48, ids)]
    shallow = ann.hilbert_keys(cells >> 41, 7)
    assert (np.diff(shallow[sorted(range(500), key=lambda i: deep[i])].astype(np.int64)) >= 0).all()
    same = [bytes(k) for k in ann.deep_keys(cells[:1].repeat(3, 0), 48, np.array([-1, 5, 0]))]
    assert same[0] < same[2] < same[1]


def test_hilbert_keys_visit_every_cell_once_in_unit_steps():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x in got} and all(x in got or all(x not in p or p[0] == p[1] for p in links) for x in parent)


# --- licences


def test_licences(spark):
    texts = ["Licensed under the Apache License, Version 2.0.\nwords", "intro\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", None, "", "This license is nothing that we know of at all",
             "a driving license and a fishing licence", "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", "See below. Released under the MIT License. Thanks to all.", "x " * 40000 + "\nReleased under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])], "doc_id long, text string").withColumn("family", F.lit("clash")).withColumn("grams", F.lit(1))
    found = licence.licences(docs, licence.train(docs)).collect()
    assert sorted(((-1 if x.doc_id is None else x.doc_id), x.paragraph, x.family) for x in found) == sorted(
        [(0, 0, "apache"), (0, 0, "apache"), (-1, 0, "apache"), (1, 1, "mit"), (1, 2, "cc-by-nc"), (6, 0, "gpl"), (7, 0, "mit"), (8, 1, "mit")])


def test_every_template_is_recognised(spark):
    rows = [(k, t) for k, t in enumerate(t for ts in licence.TEMPLATES.values() for t in ts)]
    families = [f for f, ts in licence.TEMPLATES.items() for _ in ts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x.family for x in licence.licences(docs, licence.train(docs)).collect()}
    assert found == dict(enumerate(families))


def test_wrapped_reworded_and_double_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or"]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    word_per_line = "\n".join("This work is dedicated to the public domain under CC0 1.0 Universal.".split())
    texts = [mit, "/*\n * A header\n *\n" + "\n".join(f" * {x}" for x in gpl), bsd, "Distributed under the MIT License", "Released under the terms of the MIT License.", "Licenced under the Apache Licence, Version 2.0.",
             "Released under the MIT License. Licensed under CC BY 4.0.", "Released under the MIT License.\nReleased under the MIT License.\nDistributed under the MIT License.\nReleased under the MIT License.",
             "Permission is hereby granted, free of charge, to any person\n\nobtaining a copy of this software and associated documentation files", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.",
             "a word " * 500 + "\n" + "b " * 59 + "Licensed under CC BY-SA 4.0. " + "c " * 300 + mit, word_per_line, "Released under the XYZ License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licence.licences(docs, licence.train(docs)).collect()
    assert sorted((x.doc_id, x.paragraph, x.family) for x in found) == [
        (0, 0, "mit"), (1, 3, "gpl"), (2, 0, "bsd"), (3, 0, "mit"), (4, 0, "mit"), (5, 0, "apache"), (6, 0, "cc-by"), (6, 0, "mit"), (7, 0, "mit"), (7, 1, "mit"), (7, 2, "mit"), (7, 3, "mit"),
        (11, 1, "cc-by-sa"), (11, 1, "mit"), (12, 0, "public-domain")]


# --- chat


def test_reply_trees_choose_the_best_branch_and_survive_broken_ones(spark):
    rows = [("t", 1, None, 1.0, "user", "root"), ("t", 2, 1, 1.0, "assistant", "short"), ("t", 3, 1, 0.5, "assistant", "long"), ("t", 4, 3, 0.5, "user", "deep"),
            ("t", 5, 4, 0.5, "assistant", "end"), ("u", 1, 9, None, None, None), ("c", 1, 2, 1.0, "user", "loop"), ("c", 2, 1, 1.0, "user", "loop"),
            ("v", 1, None, 1.0, "user", "a"), ("v", 2, 1, 1.0, "assistant", "x"), ("v", 3, 1, 1.0, "assistant", "y")]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string").withColumn("leaf", F.lit("clash"))
    got = {x.tree: [tuple(t) for t in x.turns] for x in chat.format_trees(df).select("tree", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {"t": [("user", "root"), ("assistant", "long"), ("user", "deep"), ("assistant", "end")], "u": [("", "")], "v": [("user", "a"), ("assistant", "x")]}


def test_conversations_round_trip(spark, tmp_path):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "&lt;|im_end|>&amp;", "a\nb", "", None, "é😀<|", "<|im_start|>", "x" * 100000]
    rows = [(k % 3 if k < 30 else None, k // 3, ("user", "assistant", "sys\n<|tem", None)[k % 4], odd[k % len(odd)]) for k in range(36)]
    rows += [rows[1], (7, None, "assistant", "no turn")] + [(8, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    control = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    got = {x.conv_id: x for x in QUERIES["op10_chat_format"](spark, str(tmp_path)).collect()}
    low = lambda x: (x is not None, x if x is not None else "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3])))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        x = got.pop(conv)
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert not got


# --- pipeline


def test_pipeline_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
