"""Operators on texts against brute-force versions, with nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from feedops.llm import linededup, minhash, mixing, packing, quality, registry, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _source string, node string"


def documents(spark, texts, sources=None):
    """A table of documents with two further columns whose names the operators use inside."""
    registry.prepared(spark)
    rows = [(i, t, "en", (sources[k] if sources else "s"), None if t is None else len(t), "x", "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def invented(n, seed=0, words=("ab", "cde", "f", "ghij", "Kl", "é", "mn,", "op.")):
    r = random.Random(seed)
    return [" ".join(r.choice(words) + r.choice(("", "x", "yz")) for _ in range(r.randint(1, 120))) for _ in range(n)]


# --- near-duplicates


def shingle_set(text, size=4):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute_components(texts, size=4, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            u, v = sets[a][1], sets[b][1]
            if u and v and 100 * len(u & v) >= percent * len(u | v):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return {(i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)}


def near_copies(seed=5):
    r, out = random.Random(seed), []
    bases = [t.split(" ") for t in invented(12, seed) if t.count(" ") > 40]
    for base in bases:
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(999)}"
            out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = list(enumerate(near_copies() + invented(20, 9) + [None, "", " \t\n", "a b", "A B", "a b c", "long " * 3000, "long " * 3001]))
    texts += [(texts[3][0], texts[3][1]), (None, texts[5][1]), (None, None)]
    got = minhash.near_duplicates(documents(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter({k: n for k, n in _counted(texts).items()})
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def _counted(texts):
    wanted = brute_components(texts)
    by_row = {(i, n): c for i, n, c in wanted}
    return Counter((i, len(shingle_set(t)), by_row[(i, len(shingle_set(t)))]) for i, t in texts)


def test_a_dense_group_of_partly_linked_copies_is_whole(spark):
    # Every copy differs from the base in its own places, so copies are linked with the base or not, and rarely with each other.
    r, base = random.Random(3), [f"b{i}" for i in range(120)]
    texts = []
    for k in range(160):
        copy = list(base)
        for i in r.sample(range(120), r.randint(0, 6)):
            copy[i] = f"n{k}-{i}"
        texts.append((k + 1, " ".join(copy)))
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_one_document_of_a_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(7, text), (3, text), (3, text), (9, text + " end"), (1, "other words here are few"), (2, None)])
    kept = minhash.drop_near_duplicates(docs, size=5)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_bounds_and_estimates_of_pairs(spark):
    # Six words of sixteen lanes: equal ones, ones with two lanes apart, and ones without an equal lane, which is fewer than agree by chance.
    same, two, none = [0x123, 5, 0, 0, 0, -1], [0x120, 0x85, 0, 0, 0, -1], [~0x123, ~5, -1, -1, -1, 0]
    marks = [0] * minhash.MAP_WORDS

    def pairs(rows):
        """Pairs of (packed, marks, n) as two sketches side by side."""
        sides = spark.createDataFrame([(i, k, *side) for i, row in enumerate(rows) for k, side in enumerate(row)], "i int, side int, packed array<long>, marks array<long>, n long")
        return sides.where("side = 0").select("i", *minhash.sketch("x")).join(sides.where("side = 1").select("i", *minhash.sketch("y")), "i").orderBy("i")

    found = pairs([((same, marks, 1), (other, marks, 1)) for other in (same, two, none)]).select(minhash.estimate("x", "y")).collect()
    assert [r[0] for r in found] == pytest.approx([1.0, (94 / 96 - 1 / 16) / (15 / 16), -1 / 15])
    rows = [((same, [0, 5, *marks[2:]], 2), (same, [0, 5, *marks[2:]], 2)), ((same, [7, *marks[1:]], 3), (same, [56, *marks[1:]], 3))]
    assert [r[0] for r in pairs(rows).select(minhash.may_link("x", "y", 10)).collect()] == [True, False]


# --- lines


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, text, times, letters="abé"):
    text = list(text)
    for _ in range(times):
        at, kind = r.randrange(len(text) + 1), r.randrange(3)
        if kind == 0:
            text.insert(at, r.choice(letters))
        elif text:
            text[min(at, len(text) - 1) : min(at, len(text) - 1) + 1] = [] if kind == 1 else [r.choice(letters)]
    return "".join(text)


def test_banded_edit_distance():
    r = random.Random(1)
    for _ in range(8000):
        most = r.choice((1, 2, 3))
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 40)))
        b = edited(r, a, r.randint(0, 5))
        assert linededup.edit_distance(a, b, most) == min(most + 1, plain_distance(a, b))


def brute_repeats(texts, edits=2, min_chars=20):
    lines = []
    for i, t in texts:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\v\f")
            if len(line) >= min_chars:
                lines.append(((linededup.LAST_ID if i is None else i), i, k, line))
    lines.sort(key=lambda x: (x[0], x[2]))
    return {(i, k) for n, (_, i, k, line) in enumerate(lines) if any(linededup.edit_distance(line, o[3], edits) <= edits for o in lines[:n] if (o[1], o[2]) != (i, k))}


def test_repeated_lines_equal_brute_force(spark):
    r = random.Random(2)
    pool = [edited(r, "".join(r.choice("abcdefgh ") for _ in range(r.randint(15, 60))).strip(), 0) for _ in range(25)]
    texts = [(i, "\n".join(edited(r, r.choice(pool), r.choice((0, 0, 1, 2, 3))) for _ in range(r.randint(1, 6)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "\n\n"), (103, f"  {pool[0]}\t\n short \n"), (None, pool[1] + "\n" + "z" * 30000), (104, "z" * 30001), (105, "the first line of this text is new\nthe first line of this text is new")]
    texts.append(texts[-1])
    got = linededup.drop_repeated_lines(documents(spark, texts)).collect()
    assert {(x.doc_id, k) for x in got for k in (x["_repeated"] or [])} == brute_repeats(texts)
    by_id = {i: t for i, t in texts}
    for x in got:
        gone = set(x["_repeated"] or [])
        whole = by_id[x.doc_id]
        assert x.text == (whole if not gone else "\n".join(line for k, line in enumerate(whole.split("\n")) if k not in gone))
        assert x.n_chars == (None if x.text is None else len(x.text)) and x.node == "y"
    assert len(got) == len(texts)


def test_many_near_copies_of_a_line(spark):
    # All share two segments with the first, most are no pair: rounds go on until every member is decided.
    r = random.Random(4)
    head = "a common first part of the line that is shared by all of them "
    texts = [(i, head + "".join(r.choice("xyz") for _ in range(12))) for i in range(150)]
    got = {(x.doc_id, k) for x in linededup.drop_repeated_lines(documents(spark, texts)).collect() for k in (x["_repeated"] or [])}
    assert got == brute_repeats(texts)
    assert linededup.drop_repeated_lines(documents(spark, texts).limit(0)).count() == 0


# --- packing


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = list(enumerate(invented(60, 3) + [None, "", "It's  ONE two\x1cthree ΑΣ İ <|endoftext|> 3.14,, é \U0001f600!?", "word " * 5000, "a" * 3000, "x\n\ny\t.z"]))
    texts += [texts[0], (None, "null id"), (None, "null id")]
    pieces = [r for r in packing.pack(documents(spark, texts), path, group_rows=20).collect()]
    by_place, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length
        by_place.setdefault((p.doc_id, p.doc_tokens), Counter())[(p.start, tuple(ids))] += 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    wanted = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    for (i, ids), n in wanted.items():
        found = by_place[(i, len(ids))]
        for start in range(0, len(ids), packing.LENGTH):
            assert found[(start, ids[start : start + packing.LENGTH])] >= n
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in wanted.items())
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert packing.pack(documents(spark, texts).limit(0), path).count() == 0


def test_first_fit_decreasing_equals_the_plain_rule():
    r = np.random.default_rng(1)
    for n in (1, 2, 37, 300):
        sizes = r.integers(1, 100, n)
        bins, offsets, used = packing.first_fit_decreasing(sizes, 100)
        room, plain = [], {}
        for k in np.argsort(-sizes, kind="stable").tolist():
            b = next((i for i, free in enumerate(room) if free >= sizes[k]), None)
            if b is None:
                room.append(100)
                b = len(room) - 1
            plain[k] = (b, 100 - room[b])
            room[b] -= int(sizes[k])
        assert used == len(room) and all(plain[k] == (bins[k], offsets[k]) for k in range(n))


# --- quality rules


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    texts = list(enumerate(invented(40, 8) + [None, "", "\n", "a\nb\na\n\n a\n", "x y z x y z x y z", "é# | b\x1f c", "w " * 20000, "ab"]))
    texts += [texts[3], (None, "n")]
    docs = documents(spark, texts)
    trusted = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long")
    counts = rules.ngram_counts(docs, trusted)
    raw, good = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    buckets = [[int(b) for b in rules._buckets(np.frombuffer((t or "").encode(), np.uint8))] for _, t in texts]
    for (i, _), found in zip(texts, buckets):
        for b in found:
            raw[b] += 1
            good[b] += i in (1, 2, 3)
    assert (counts[0] == raw).all() and (counts[1] == good).all()
    ratios = rules.log_ratios(counts)
    wanted = Counter()
    for (i, t), found in zip(texts, buckets):
        c = counts_of(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        mean = sum(ratios[b] for b in found) / max(1, len(found))
        wanted[(i, *c, failed, not failed and mean >= rules.THRESHOLD)] += 1
    got = rules.judge(docs.select("doc_id", "text"), ratios).collect()
    assert Counter((r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed, r.kept) for r in got) == wanted
    assert rules.judge(docs.select("doc_id", "text").limit(0), ratios).count() == 0
    assert not rules.log_ratios(rules.ngram_counts(docs, trusted.limit(0))).any()


# --- quality classifier


def junk(n, seed):
    r = random.Random(seed)
    return [" ".join(w.upper() + "!!" for w in t.split(" ")) if r.random() < 0.5 else " ".join(t.split(" ")[:1] * 30) for t in invented(n, seed)]


def test_classifier_learns_and_scores_every_text(spark):
    texts = list(enumerate(invented(300, 1) + junk(100, 2)))
    docs = documents(spark, texts + [(900, None), (901, ""), (None, "some words"), (5, texts[5][1])])
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in texts] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0 or doc_id is null"))
    got = {r.doc_id: r["_score"] for r in quality.score(docs, model).collect()}
    held = [i for i, _ in texts if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == (i < 300) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and quality.score(docs, model).count() == 404
    assert quality.train(docs, labels.where("doc_id % 3 <> 0 or doc_id is null")) == model


def test_rows_of_one_id_do_not_meet_in_the_fit(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    met, apply = [], PandasGroupedOpsMixin.applyInPandas
    docs = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1)] + [(i, i % 2) for i in range(300, 400)], "doc_id long, label int")
    for kind in {PandasGroupedOpsMixin, type(docs.groupBy())}:
        monkeypatch.setattr(kind, "applyInPandas", lambda self, *a, **b: (met.append(self._df.count()), apply(self, *a, **b))[1], raising=False)
    model = quality.train(docs, labels)
    assert met == [101] and quality.train(docs, labels) == model


def test_classifier_without_two_classes(spark):
    docs = documents(spark, [(1, "a b c d e"), (2, None)])
    one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert all(r["_score"] > 0.9 for r in quality.score(docs, quality.train(docs, one)).collect())
    assert all(r["_score"] > 0.9 for r in quality.score(docs, quality.train(docs, one.limit(0))).collect())


def test_held_out_rows(spark):
    ids = [0, 1, 2, 17, 10**12, -5]
    got = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id"))).collect()
    assert [r[1] for r in got] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids] + [False]


# --- mixing


def water_filling(sizes, weights, most):
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = sum(weights[i] for i in open_)
        target = [most * sizes[i] if i in full else rest * weights[i] / share for i in range(len(sizes))]
        over = {i for i in open_ if target[i] >= most * sizes[i]}
        if not over - full:
            return target
        full |= over
        if len(full) == len(sizes):
            return [most * s for s in sizes]


def test_mixing_reaches_its_targets(spark):
    r = random.Random(6)
    sources = [r.choice(["a", "b", "tiny", "ä", None, "Z"]) for _ in range(200)]
    texts = [(i, " ".join("w" for _ in range(1 if s == "tiny" else r.randint(0, 300)))) for i, s in enumerate(sources)] + [(500, None), (501, "x y"), (501, "x y")]
    sources += ["a", "b", "b"]
    docs = documents(spark, texts, sources)
    keyed = mixing._keyed(docs, mixing.SEED)
    plan, count = mixing.mixing_plan(keyed)
    order = sorted({s for s in sources if s is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for (_, t), s in zip(texts, sources) if s == name) for name in order]
    wanted = dict(zip(order, water_filling(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(order))], 3)))
    assert count == len(order)
    used = Counter()
    for x in mixing.taken(keyed, plan, count).collect():
        words = x["_copies"] * x["_size"] + x["_words_of_last"]
        assert 0 <= words <= 3 * x["_size"] and x["target"] == pytest.approx(wanted[x["source"]])
        used[x["source"]] += words
    assert all(abs(used[s] - wanted[s]) <= 2 for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for x in mixed.collect():
        words[x.source] += len(WORD.findall(x.text or ""))
        assert x.n_chars == (None if x.text is None else len(x.text))
    assert words == used
    again = Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert again == Counter(map(tuple, mixed.collect()))


def test_mixing_of_nothing(spark):
    assert mixing.mix(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).count() == 0


def test_tiny_tables_pass_every_registered_query_that_reads_documents(spark, tmp_path):
    """No query fails on empty tables."""
    docs = documents(spark, [(1, "a")]).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    builds, _ = registry.load()
    for name, build in builds.items():
        assert build(spark, str(tmp_path)).count() == (1 if name == "op10_chat_format" else 0), name
