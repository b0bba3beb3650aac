"""Cross-tokenizer alignment against plain tokenization of whole texts, and the laws of the fragments."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from feedops.llm import alignment
from feedops.llm.alignment import Fragment, Pair, compose, compose_all, fragment

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["the", "Retour", " ", "  ", "\n", "\n\n ", "\t", "1234", "é", "ñandú", "汉字", "🙂", "'s", "n't", "...", "<|endoftext|>", "</s>", "<0x41>", " ", "　", "​", "᠎", "\r\n", "a" * 30,
         "_", "\x1c", "\x00", "x@y.z", "́", "ﬁ", "İ"]


@pytest.fixture(scope="module")
def pair() -> Pair:
    return Pair(*FILES)


def plainly(pair: Pair, text: str | None) -> tuple | None:
    """Groups and links of one text, token by token."""
    if not text:
        return None
    (a,), (b,) = pair.ids([" " + text])
    whole = (" " + text).encode()
    if pair.a.joined(a) != whole or pair.b.joined(b) != whole:
        return None
    spans = []
    for ids, vocabulary in ((a, pair.a), (b, pair.b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(vocabulary.bytes[i])))
        spans.append(out)
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, begin = [], 0
    for end in ends:
        groups.append([",".join(str(i) for i, (p, q) in zip(ids, s) if begin < q <= end) for ids, s in zip((a, b), spans)])
        begin = end
    links = [(x, y) for x, (p, q) in zip(a, spans[0]) for y, (r, s) in zip(b, spans[1]) if p < s and r < q]
    return len(a), len(b), len(groups), ";".join("|".join(g) for g in groups), links


def odd_texts(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) + draw.choice(["", " ", ""]) for _ in range(draw.randint(1, 14))) for _ in range(n)]


def test_words_give_the_tokens_of_whole_texts(pair):
    texts = odd_texts(1, 3000) + odd_texts(1, 50) + ["", " ", "  ", "a ", " a", "a  ", "\n", " \n ", "▁", "a ▁b", "word"]
    words, found = alignment.Words(pair, 2_000), []
    for i in range(0, len(texts), 400):
        found += alignment.aligned(words, texts[i : i + 400])
    for text, row in zip(texts, found, strict=True):
        want = plainly(pair, text)
        if want is None:
            assert row[:5] == (0, 0, 0, 0, ""), repr(text)
            continue
        assert row[:3] == want[:3] and row[3] == len(want[4]), repr(text)
        assert row[4] == hashlib.sha256(want[3].encode()).hexdigest(), repr(text)
        assert dict(zip(row[5].tolist(), row[6].tolist())) == Counter((x << 16) | y for x, y in want[4]), repr(text)


def finished(f: Fragment) -> bytes:
    return (alignment.group_text(f.prefix_a, f.prefix_b) + f.closed)[:-1]


def test_any_cut_gives_the_same_fragment(pair):
    draw = random.Random(2)
    for text in odd_texts(3, 150):
        want = plainly(pair, text)
        if want is None:
            continue
        size = len((" " + text).encode())
        cuts = sorted({0, size, *(draw.randint(0, size) for _ in range(draw.randint(0, 6)))})
        parts = [fragment(pair, " " + text, p, q) for p, q in zip(cuts, cuts[1:])]
        found = compose_all(parts)
        assert finished(found) == want[3].encode() and found.n_closed + 1 == want[2]
        assert (found.n_a, found.n_b, found.n_links) == (want[0], want[1], len(want[4]))
        left = parts[0]
        for p in parts[1:]:
            left = compose(left, p)
        assert finished(left) == finished(found) and left.codes.tolist() == found.codes.tolist() and left.times.tolist() == found.times.tolist()


def test_composition_is_associative_with_identity(pair):
    text = " " + "Entien thwh 123 ñandú 汉字 retour's " * 3
    size = len(text.encode())
    x, y, z = fragment(pair, text, 0, 5), fragment(pair, text, 5, 40), fragment(pair, text, 40, size)
    left, right = compose(compose(x, y), z), compose(x, compose(y, z))
    for name in Fragment.__dataclass_fields__:
        assert np.array_equal(getattr(left, name), getattr(right, name))
    for one in (compose(Fragment(), x), compose(x, Fragment())):
        assert all(np.array_equal(getattr(one, n), getattr(x, n)) for n in Fragment.__dataclass_fields__)


def test_ranges_carry_whole_stretches():
    for text in [*odd_texts(5, 200), "x" * 5000, "ab " * 700]:
        data = (" " + text).encode()
        at = 0
        for stretch, first, last in alignment.ranges(text, 16, 64):
            begin = at - first
            assert data[begin : begin + len(stretch.encode())] == stretch.encode() and stretch[0] == " " and first < last
            at += last - first
        assert at == len(data)


def expected(pair: Pair, rows: list[tuple]) -> list[tuple]:
    found = [plainly(pair, text) for _, text in rows]
    holds = Counter(link for f in found if f for link in set(f[4]))
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(holds[x] == most[x[0]] for x in f[4])
        out.append((doc, f[0], f[1], f[2], len(f[4]), n_best, sum(holds[x] for x in f[4]), hashlib.sha256(f[3].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [1_000_000, 20])
def test_table_against_brute_force(spark, pair, frequent):
    texts = [*odd_texts(7, 60), None, "", "▁ is no blank", "the hot text of many rows"] + ["the hot text of many rows"] * 30
    long_ones = [" ".join(odd_texts(8, 40)), "thonre is was " * 300, "x" * 3000 + " end"]
    rows = [(i, t) for i, t in enumerate(texts + long_ones)] + [(None, "a null id"), (0, texts[0])]
    docs = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], "doc_id long, text string, key string, codes int, n_a int")
    found = alignment.align(docs, *FILES, long_text=400, range_bytes=100, frequent=frequent)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == expected(pair, rows)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *FILES).collect() == []
