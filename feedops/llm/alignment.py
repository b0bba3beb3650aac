"""Cross-tokenizer alignment: two tokenizers' tokens of one text, cut into groups where both end, and the tokens that overlap.

The aligned form of a byte range is a ``Fragment``: the tokens before its first common end (open prefix), the closed groups between common ends, and the tokens
after the last one (open suffix). Fragments of neighbouring ranges compose: the left one's suffix and the right one's prefix close a group. Composition is
associative and the empty fragment is its identity, so ranges can be cut anywhere, also through tokens, handled in different tasks and reduced in a tree.

* Long texts are cut into byte ranges. A range carries the few bytes around it up to places where both tokenizers must end a token (a blank after something
  that is no blank), so its tokens are those of the whole text; a token belongs to the range that it ends in. Ranges are dealt out over the tasks and their
  fragments composed 16 at a time, so no task holds the tokens of a very long text; only its aligned form, of the text's own size, meets in its row.
* Shorter texts are handled within one task, a batch at a time: the same places cut them into words, each different word is tokenized once, for as long as
  the task remembers it, and a text's groups are those of its words in a row.
* A pair's count is the number of documents that hold it linked. Pairs are counted in the tasks first, then by one shuffle. The most frequent ones (a bounded
  number) are sent to every task; the others, each held by few documents, are joined by a shuffle. Both ways are exact.

Results by case: a null or empty text, or one whose token bytes differ from its own (a text that holds U+2581), has no tokens and zeros; null ids are kept; rows
that repeat are documents each; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.registry import Tables, query
from feedops.session import pinned

# Texts of more code points are cut into ranges of about so many bytes; a range ends up to ``REACH`` bytes later where no safe place is nearer.
LONG_TEXT, RANGE_BYTES, REACH = 65_536, 16_384, 4_096
FAN_IN = 16
# Texts of so many code points are handled at once.
SLICE = 1_000_000
# Words that a task remembers (about 300 bytes each).
MOST_WORDS = 300_000
# Pairs that every task holds in memory (13 bytes each).
FREQUENT_PAIRS = 1_000_000
# Different pairs that a task counts before it hands them on.
COUNTED_AT_ONCE = 2_000_000
# A blank may follow these and still be part of the same stretch of blanks for some tokenizer.
_BLANKS = r"\s\u180e\u200b\ufeff"
_BLANK_RUN = re.compile(f"[{_BLANKS}] ")
_SAFE = re.compile(f"(?<=[^{_BLANKS}])(?= .)", re.S)
# Words that are tokenized on their own: a blank at the end, or characters that a tokenizer may change.
_ODD_WORD = re.compile(f"[{_BLANKS}]\\Z|[\u2581\\x00-\\x08\\x0b-\\x1f]")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Bytes and numbers of bytes of every token id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.bytes, self.sizes = tokens, np.array([len(t) for t in tokens], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Pair:
    """Both tokenizers. ``a`` gets a blank and the text, ``b`` the text, to which it adds the blank itself."""

    def __init__(self, byte_level_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_level_file)
        self._a.encode_special_tokens = True
        plain, size = byte_level(), self._a.get_vocab_size(with_added_tokens=True)
        tokens = [self._a.id_to_token(i) or "" for i in range(size)]
        self.a = Vocabulary([bytes(plain[c] for c in t) if all(c in plain for c in t) else t.encode() for t in tokens])
        self._b = SentencePieceProcessor(model_file=piece_file)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # An id and what follows it, padded with zero bytes: separators within a group, after its A ids and after the group.
        self.marked = {mark: np.array([b"%d%c" % (i, ord(mark)) for i in range(max(size, len(pieces)))], "S8") for mark in ",|;"}

    def ids(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A and B ids of stretches of text that each begin with a blank."""
        found = self._a.encode_batch_fast(stretches, add_special_tokens=False)
        return [e.ids for e in found], self._b.encode([s[1:] for s in stretches], num_threads=1)

    def tokens(self, stretch: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of one stretch, or none if a tokenizer's bytes are not the stretch's own."""
        (a,), (b,) = self.ids([stretch])
        data = stretch.encode()
        return (np.array(a, np.int64), np.array(b, np.int64)) if self.a.joined(a) == data and self.b.joined(b) == data else None

    def text_of(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marked ids in output order, their groups): ``a1,a2|b1;`` group by group. Every group has tokens of both."""
        mark_a = np.r_[group_a[1:] == group_a[:-1], False]
        mark_b = np.r_[group_b[1:] == group_b[:-1], False]
        out = np.empty(len(a) + len(b), "S8")
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        out[at_a] = np.where(mark_a, self.marked[","][a], self.marked["|"][a])
        out[at_b] = np.where(mark_b, self.marked[","][b], self.marked[";"][b])
        groups = np.empty(len(out), np.int64)
        groups[at_a], groups[at_b] = group_a, group_b
        return out, groups


def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << 16) | b


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ends, common ends) of two rising sequences."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    return both[~again], both[again]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, A index, B index) of every overlapping pair: each stretch between two neighbouring ends of any kind is one overlap."""
    ends = merged(ends_a, ends_b)[0]
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Fragment:
    """The aligned form of a byte range; ``closed`` is the text of the closed groups, each followed by a semicolon."""

    prefix_a: np.ndarray = field(default_factory=_none)
    prefix_b: np.ndarray = field(default_factory=_none)
    cut: bool = False
    closed: bytes = b""
    n_closed: int = 0
    suffix_a: np.ndarray = field(default_factory=_none)
    suffix_b: np.ndarray = field(default_factory=_none)
    n_a: int = 0
    n_b: int = 0
    n_links: int = 0
    codes: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)
    whole: bool = True


def group_text(a: np.ndarray, b: np.ndarray) -> bytes:
    return b"%s|%s;" % (",".join(map(str, a.tolist())).encode(), ",".join(map(str, b.tolist())).encode())


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    codes, at = np.unique(np.r_[x.codes, y.codes], return_inverse=True)
    times = np.bincount(at, np.r_[x.times, y.times], len(codes)).astype(np.int64) if len(codes) else _none()
    out = Fragment(n_a=x.n_a + y.n_a, n_b=x.n_b + y.n_b, n_links=x.n_links + y.n_links, codes=codes, times=times, whole=x.whole and y.whole, cut=x.cut or y.cut)
    join = lambda p, q: np.r_[p, q].astype(np.int64)
    if not x.cut:
        out.prefix_a, out.prefix_b = join(x.prefix_a, y.prefix_a), join(x.prefix_b, y.prefix_b)
        out.closed, out.n_closed, out.suffix_a, out.suffix_b = y.closed, y.n_closed, y.suffix_a, y.suffix_b
        return out
    out.prefix_a, out.prefix_b = x.prefix_a, x.prefix_b
    a, b = join(x.suffix_a, y.prefix_a), join(x.suffix_b, y.prefix_b)
    if y.cut:
        out.closed, out.n_closed = x.closed + group_text(a, b) + y.closed, x.n_closed + 1 + y.n_closed
        out.suffix_a, out.suffix_b = y.suffix_a, y.suffix_b
    else:
        out.closed, out.n_closed, out.suffix_a, out.suffix_b = x.closed, x.n_closed, a, b
    return out


def compose_all(parts: list[Fragment]) -> Fragment:
    """Neighbours in pairs, level by level."""
    while len(parts) > 1:
        parts = [compose(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else Fragment()


def fragment(pair: Pair, stretch: str, first: int, last: int) -> Fragment:
    """The fragment of the byte range (first, last] of a stretch that begins and ends at safe places: of the tokens that end in it."""
    found = pair.tokens(stretch)
    if found is None:
        return Fragment(whole=False)
    a, b = found
    ends_a, ends_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
    ends, link_a, link_b = overlaps(ends_a, ends_b)
    inside = (ends > first) & (ends <= last)
    codes, times = tallied(code(a[link_a[inside]], b[link_b[inside]]))
    mine_a, mine_b = (ends_a > first) & (ends_a <= last), (ends_b > first) & (ends_b <= last)
    a, b, ends_a, ends_b = a[mine_a], b[mine_b], ends_a[mine_a], ends_b[mine_b]
    out = Fragment(n_a=len(a), n_b=len(b), n_links=int(inside.sum()), codes=codes, times=times)
    common = merged(ends_a, ends_b)[1]
    if not len(common):
        out.prefix_a, out.prefix_b = a, b
        return out
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    out.cut, out.n_closed = True, len(common) - 1
    out.prefix_a, out.prefix_b = a[group_a == 0], b[group_b == 0]
    out.suffix_a, out.suffix_b = a[group_a == len(common)], b[group_b == len(common)]
    mid_a, mid_b = (group_a > 0) & (group_a < len(common)), (group_b > 0) & (group_b < len(common))
    marked, _ = pair.text_of(a[mid_a], b[mid_b], group_a[mid_a], group_b[mid_b])
    out.closed = marked.tobytes().replace(b"\0", b"")
    return out


def ranges(text: str, size: int = RANGE_BYTES, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(stretch, first, last) of the byte ranges of a blank and ``text``; each stretch begins and ends at safe places around its range.

    Ranges end every ``size`` bytes, within tokens as it falls, except that one within an unbroken stretch of more than ``reach`` bytes ends after it.
    """
    whole = " " + text
    data = whole.encode()
    # Where each safe place is, in code points and in bytes.
    points = [0, *(m.start() for m in _SAFE.finditer(whole)), len(whole)]
    if len(data) == len(whole):
        places = np.array(points)
    else:
        before, places = 0, []
        for p, q in zip([0, *points], points):
            before += len(whole[p:q].encode())
            places.append(before)
        places = np.array(places)
    out, start = [], 0
    while start < len(data):
        stop = min(start + size, len(data))
        left, right = places[np.searchsorted(places, stop, "right") - 1], places[np.searchsorted(places, stop, "left")]
        if right - left > reach:
            stop = int(right)
        begin, end = places[np.searchsorted(places, start, "right") - 1], places[np.searchsorted(places, stop, "left")]
        out.append((data[begin:end].decode(), start - int(begin), stop - int(begin)))
        start = stop
    return out


def words_of(text: str) -> list[str]:
    """The stretches of a blank and ``text`` between its safe places; each begins with a blank."""
    if text[:1] != " " and text[-1:] != " " and not _BLANK_RUN.search(text):
        return [" " + w for w in text.split(" ")]
    return [w for w in _SAFE.split(" " + text) if w]


class Words:
    """Aligned forms of different words, by number: numbers of tokens, groups and links, text of the groups and pairs. Held for one task and up to a number of words."""

    def __init__(self, pair: Pair, most: int = MOST_WORDS) -> None:
        self.pair, self.most = pair, most
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.counts, self.codes, self.first_link = np.zeros((5, 0), np.int64), _none(), np.zeros(1, np.int64)

    def numbers(self, rows: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the words of every row; words not seen before are aligned first."""
        seen = set().union(*rows)
        new = list(seen - self.index.keys())
        if len(self.index) + len(new) > self.most:
            self._forget()
            new = list(seen)
        if new:
            self._learn(new)
        get = self.index.__getitem__
        return [np.array(list(map(get, row)), np.int64) for row in rows]

    def _learn(self, words: list[str]) -> None:
        """Append (tokens of A, of B, groups, links, 1 if it has no tokens), groups and pairs of every word."""
        pair, n = self.pair, len(words)
        self.index.update(zip(words, range(len(self.index), len(self.index) + n)))
        plain = [i for i, w in enumerate(words) if not _ODD_WORD.search(w)]
        ids = self._together([words[i] for i in plain])
        if ids is None:
            plain, ids = [], (_none(), _none(), _none(), _none())
        number = np.array(plain, np.int64)
        parts_a, parts_b, at_a, at_b = [ids[0]], [ids[1]], [number[ids[2]]], [number[ids[3]]]
        bad = np.zeros(n, np.int64)
        for i in sorted(set(range(n)) - set(plain)):
            found = pair.tokens(words[i])
            if found is None:
                bad[i] = 1
                continue
            for part, at, tokens in ((parts_a, at_a, found[0]), (parts_b, at_b, found[1])):
                part.append(tokens)
                at.append(np.full(len(tokens), i))
        a, b, word_a, word_b = (np.concatenate(x) for x in (parts_a, parts_b, at_a, at_b))
        if len(parts_a) > 1:
            by_a, by_b = np.argsort(word_a, kind="stable"), np.argsort(word_b, kind="stable")
            a, b, word_a, word_b = a[by_a], b[by_b], word_a[by_a], word_b[by_b]
        ends_a, ends_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
        _, common = merged(ends_a, ends_b)
        _, link_a, link_b = overlaps(ends_a, ends_b)
        word_of_group = word_a[np.searchsorted(ends_a, common)]
        n_links = np.bincount(word_a[link_a], minlength=n)
        counts = [np.bincount(word_a, minlength=n), np.bincount(word_b, minlength=n), np.bincount(word_of_group, minlength=n), n_links, bad]
        marked, groups = pair.text_of(a, b, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b))
        sizes = np.bincount(word_of_group[groups], np.char.str_len(marked), n) if len(marked) else np.zeros(n)
        cuts = np.r_[0, np.cumsum(sizes)].astype(np.int64).tolist()
        data = marked.tobytes().replace(b"\0", b"")
        self.text += [data[p:q] for p, q in zip(cuts, cuts[1:])]
        self.counts = np.hstack([self.counts, np.stack(counts)])
        self.codes = np.r_[self.codes, code(a[link_a], b[link_b])]
        self.first_link = np.r_[self.first_link, self.first_link[-1] + np.cumsum(n_links)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of all words in a row and the word of each: every word begins at a safe place, so it keeps its own tokens."""
        found = self.pair.tokens("".join(words)) if words else (_none(), _none())
        if found is None:
            return None
        bounds = np.cumsum([len(w.encode()) for w in words])
        return (*found, *(np.searchsorted(bounds, np.cumsum(v.sizes[ids])) for v, ids in zip((self.pair.a, self.pair.b), found)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]


def aligned(words: Words, texts: list[str]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, hash of the groups, codes, times) of every text; zeros and an empty hash where it has no tokens."""
    rows = words.numbers([words_of(t) if t else [] for t in texts])
    first = np.r_[0, np.cumsum([len(r) for r in rows])]
    flat = np.concatenate(rows) if rows else _none()
    sums = np.stack([_sums(x[flat], first) for x in words.counts], axis=1).tolist()
    for row, (n_a, n_b, n_groups, n_links, bad) in zip(rows, sums):
        if bad or not n_a:
            yield 0, 0, 0, 0, "", _none(), _none()
            continue
        digest = hashlib.sha256(b"".join(map(words.text.__getitem__, row.tolist()))[:-1]).hexdigest()
        length = words.counts[3][row]
        at = np.repeat(words.first_link[row] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(n_links)
        yield n_a, n_b, n_groups, n_links, digest, *tallied(words.codes[at])


_DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
_FRAGMENT = ("prefix_a binary, prefix_b binary, cut boolean, closed binary, n_closed long, suffix_a binary, suffix_b binary, n_a long, n_b long, n_links long, "
             "codes binary, times binary, whole boolean")
_ARRAYS = ("prefix_a", "prefix_b", "suffix_a", "suffix_b", "codes", "times")
_TYPES = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}


def _schema(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))]


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def _fragment_row(f: Fragment) -> list:
    return [_packed(getattr(f, n)) if n in _ARRAYS else getattr(f, n) for n, _ in _schema(_FRAGMENT)]


def _fragment_of(row: dict) -> Fragment:
    return Fragment(**{n: _unpacked(row[n]) if n in _ARRAYS else row[n] for n, _ in _schema(_FRAGMENT)})


def _batch(rows: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _short(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(key, doc_id, document columns) of texts that one task handles."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        words, schema = Words(Pair(*files)), [("key", pa.int64()), ("doc_id", to_arrow_type(id_type)), *_schema(_DOCUMENT)]

        def out(keys: list, texts: list) -> pa.RecordBatch:
            return _batch([[*k, *r[:5], _packed(r[5]), _packed(r[6])] for k, r in zip(keys, aligned(words, texts))], schema)

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()), batch.column("text")):
                text = text.as_py() or ""
                if keys and size + len(text) > SLICE:
                    yield out(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
            if keys:
                yield out(keys, texts)

    return docs.select("key", "doc_id", "text").mapInArrow(run, f"key long, doc_id {id_type.simpleString()}, {_DOCUMENT}")


def _long(docs: DataFrame, files: tuple[str, str], range_bytes: int) -> DataFrame:
    """(key, doc_id, document columns) of long texts: ranges over all tasks, then fragments composed in a tree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "place", "last_place", "stretch", "first", "last"]
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                found = ranges(text.as_py(), range_bytes)
                for i in range(0, len(found), 64):
                    part = found[i : i + 64]
                    columns = [[key] * len(part), range(i, i + len(part)), [len(found) - 1] * len(part), *zip(*part)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "stretch" else pa.int64()) for n, c in zip(names, columns)], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, schema = Pair(*files), [("key", pa.int64()), ("place", pa.int64()), *_schema(_FRAGMENT)]
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch([[r["key"], r["place"], *_fragment_row(fragment(pair, r["stretch"], r["first"], r["last"]))]], schema)

    def reduce(keys: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        found = compose_all([_fragment_of(r) for r in rows])
        schema = [("key", pa.int64()), ("place", pa.int64()), *_schema(_FRAGMENT)]
        return pa.Table.from_batches([_batch([[rows[0]["key"], rows[0]["place"] // FAN_IN, *_fragment_row(found)]], schema)])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("key", pa.int64()), *_schema(_DOCUMENT)]
        for batch in batches:
            for r in batch.to_pylist():
                f = _fragment_of(r)
                if not f.whole:
                    yield _batch([[r["key"], 0, 0, 0, 0, "", b"", b""]], schema)
                    continue
                text = group_text(f.prefix_a, f.prefix_b) + f.closed
                yield _batch([[r["key"], f.n_a, f.n_b, f.n_closed + 1, f.n_links, hashlib.sha256(text[:-1]).hexdigest(), r["codes"], r["times"]]], schema)

    parts = pinned(docs.select("key", "text").mapInArrow(cut, "key long, place long, last_place long, stretch string, first long, last long").repartition("key", "place"))
    most = parts.agg(F.max("last_place")).first()[0] or 0
    found = parts.mapInArrow(align, f"key long, place long, {_FRAGMENT}")
    while True:
        # Each step leaves one fragment where there were 16; a text of one range passes through it once.
        found = found.groupBy("key", F.expr(f"place div {FAN_IN}")).applyInArrow(reduce, f"key long, place long, {_FRAGMENT}")
        if most < FAN_IN:
            break
        most //= FAN_IN
    return found.mapInArrow(close, f"key long, {_DOCUMENT}").join(docs.select("key", "doc_id"), "key")


def pair_counts(documents: DataFrame) -> DataFrame:
    """(code, count, best): in how many documents each pair is linked, and whether no pair with the same A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            codes, n = tallied(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches:
            for data in batch.column("codes"):
                held.append(np.frombuffer(data.as_py(), "<u4"))
                size += len(held[-1])
                if size > COUNTED_AT_ONCE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = documents.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.shiftright("code", 16).alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", F.shiftright("code", 16)).join(most, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def frequency_floor(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs have that count or more."""
    classes = counts.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, floor = 0, 1
    for bits, n in sorted(((r["bits"], r["n"]) for r in classes), reverse=True):
        total += n
        if total > most:
            floor = 1 << bits
            break
    return floor


def with_counts(documents: DataFrame, counts: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """``documents`` with n_best and count_sum instead of their pairs. ``counts`` are looked up in memory where frequent, else by a join."""
    floor = frequency_floor(counts, frequent)
    table = counts.where(F.col("count") >= floor).toPandas().sort_values("code")
    known = documents.sparkSession.sparkContext.broadcast((table["code"].to_numpy(np.uint32), table["count"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    others = [c for c in documents.columns if c not in ("codes", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, best = known.value
        for batch in batches:
            sums, rare = [], []
            for data, often in zip(batch.column("codes"), batch.column("times")):
                mine, times = np.frombuffer(data.as_py(), "<u4"), np.frombuffer(often.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(codes, mine), max(0, len(codes) - 1))
                hit = codes[at] == mine if len(codes) else np.zeros(len(mine), bool)
                sums.append((int((times[hit] * best[at[hit]]).sum()), int((times[hit] * count[at[hit]]).sum())))
                rare.append([{"code": c, "times": n} for c, n in zip(mine[~hit].tolist(), times[~hit].tolist())])
            n_best, total = zip(*sums) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()),
                                              pa.array(rare, pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())])))], [*others, "n_best", "count_sum", "rare"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name in others)
    found = documents.mapInArrow(run, f"{ddl}, n_best long, count_sum long, rare array<struct<code:long,times:long>>")
    if floor == 1:
        return found.drop("rare")
    found = pinned(found)
    rare = found.select("key", F.explode("rare").alias("l")).select("key", "l.code", "l.times").join(counts.where(F.col("count") < floor), "code")
    rare = rare.groupBy("key").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_sum"))
    more = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return found.drop("rare").join(rare, "key", "left").select(*others, *more)


def align(docs: DataFrame, byte_level_file: str, piece_file: str, long_text: int = LONG_TEXT, range_bytes: int = RANGE_BYTES, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    files = (byte_level_file, piece_file)
    # A row's place in the scan: two passes over the same files number them alike.
    keyed = docs.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id())
    is_long = F.coalesce(F.length("text") > long_text, F.lit(False))
    found = _short(keyed.where(~is_long), files).unionByName(_long(keyed.where(is_long), files, range_bytes))
    documents = pinned(found)
    return with_counts(documents, pinned(pair_counts(documents)), frequent).drop("key")


@query("op11_alignment")
def _query(t: Tables) -> DataFrame:
    import public_tokenizers

    found = align(t.documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
