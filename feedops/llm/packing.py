"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, on its own in each randomised group of documents.

Every document becomes its token ids and one end id. Whole stretches of ``length`` ids are sequences of their own; what is left of the documents of a group is
packed, longest first, each into the first open sequence that has room. Groups are drawn by a hash of id, text and place in the scan, so that
copies of a row are spread; they hold about ``GROUP_ROWS`` documents and are cut at ``GROUP_PIECES`` pieces. Results by case: a null or empty text is the end id alone;
null ids are kept; rows that repeat are packed each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.hashing import as_text, released, slices
from feedops.llm.registry import Tables, query

LENGTH, END_ID = 2048, 1
GROUP_ROWS, GROUP_PIECES = 1024, 8192
# Words whose ids a task remembers: two generations of so many (about 150 bytes each).
CACHE_WORDS = 300_000
CHUNK = 5000
# Fixed value: how the vocabulary marks the last piece of a unit.
WORD_END = "</w>"
# ASCII marks that the tokenizer neither joins with letters nor reads as a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Token ids of single words as bytes (little-endian unsigned 32-bit), remembered for a bounded number of words.

    The tokenizer never joins what blanks or line feeds separate, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.most = Tokenizer.from_file(path), {"": b""}, {}, CACHE_WORDS
        vocabulary = self.tokenizer.get_vocab()
        # The ids that end a unit.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, cores: list[str]) -> None:
        """Ids of words of letters only, many in one call: each is one unit for the tokenizer."""
        for i in range(0, len(cores), CHUNK):
            chunk = cores[i : i + CHUNK]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(chunk):
                data, stops = ids.tobytes(), (4 * stops).tolist()
                self.young.update((w, data[p:q]) for w, p, q in zip(chunk, [0, *stops], stops))
            else:
                self.young.update(zip(chunk, self._encode(chunk)))

    def learn(self, words: set[str]) -> None:
        """Make sure that the ids of all ``words`` are remembered."""
        young, old = self.young, self.old
        missing = words - young.keys()
        if len(young) + len(missing) > self.most:
            self.old = old = young
            self.young = young = {"": b""}
            missing = words
        letters, ended, rest = set(), [], []
        for w in missing:
            known = old.get(w)
            if known is not None:
                young[w] = known
            elif w.isalpha():
                letters.add(w)
            elif (core := w.rstrip(MARKS)).isalpha() and core.lower().isalpha():
                # Marks behind letters are a unit of their own (not behind an accent that lower-casing splits off).
                ended.append((w, core, w[len(core) :]))
                letters.add(core)
            elif w:
                rest.append(w)
        self._letters([w for w in letters if w not in young])
        if rest:
            young.update(zip(rest, self._encode(rest)))
        if ended:
            tails = list({tail for _, _, tail in ended})
            marks = dict(zip(tails, self._encode(tails)))
            young.update([(w, young[core] + marks[tail]) for w, core, tail in ended])

    def forget(self) -> None:
        self.young, self.old = {"": b""}, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        rows = []
        for text in texts:
            # Lower-casing is the tokenizer's; done here it makes fewer words. Not where letter by letter and word by word could differ.
            if "<|" not in text and "Σ" not in text and "İ" not in text:
                text = text.lower()
            rows.append(text.replace("\n", " ").split(" "))
        self.learn(set().union(*rows))
        get = self.young.__getitem__
        return [b"".join(map(get, row)) for row in rows]


def word_ids(path: str, cache_words: int) -> WordIds:
    """The worker's own ``WordIds``: its tokenizer is kept from task to task, its words only for a task."""
    home = sys.modules.setdefault("_packing_word_ids", types.ModuleType("_packing_word_ids"))
    if path not in home.__dict__:
        home.__dict__[path] = WordIds(path)
    home.__dict__[path].most = cache_words
    return home.__dict__[path]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every item and the number of bins. The tree's inner nodes hold the most room of any bin below them."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        need, node = int(sizes[k]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - tree[node]
        used = max(used, node - leaves + 1)
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets, used


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_rows: int = GROUP_ROWS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece; ``ids`` are little-endian unsigned 32-bit.

    One shuffle, of the texts. Sorting within partitions fixes the order in a group, so a repeated task gives the same sequences.
    """
    groups = max(1, -(-docs.count() // group_rows))
    # A row's place in the scan tells copies apart: they lie in groups of their own.
    place = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    rows = docs.select("doc_id", "text").withColumn("_place", place).withColumn("_group", F.pmod(F.shiftright("_place", 20), F.lit(groups).cast("long")))
    rows = rows.repartition("_group").sortWithinPartitions("_group", "_place", "doc_id")
    id_type = docs.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids, schema = word_ids(tokenizer_path, cache_words), [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        pending: list[tuple] = []
        group, sequence = None, 0

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), schema)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            if pending:
                bins, offsets, used = first_fit_decreasing(np.array([p[2] for p in pending]), length)
                first = (group << 32) + sequence
                sequence += used
                placed = [(*p, first + b, o) for p, b, o in zip(pending, bins.tolist(), offsets.tolist())]
                for i in range(0, len(placed), 512):
                    yield batch_of(placed[i : i + 512])
                pending.clear()

        for batch in batches:
            doc_ids, groups_, texts = batch.column("doc_id").to_pylist(), batch.column("_group").to_pylist(), as_text(batch.column("text"))
            for a, b in slices(texts):
                whole: list[tuple] = []
                for k, data in zip(range(a, b), ids.texts(texts[a:b].to_pylist())):
                    if groups_[k] != group or len(pending) >= GROUP_PIECES:
                        if whole:
                            yield batch_of(whole)
                            whole = []
                        yield from flush()
                        if groups_[k] != group:
                            group, sequence = groups_[k], 0
                    data += end
                    n = len(data) // 4
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        piece = (doc_ids[k], start, size, data[4 * start : 4 * (start + size)], n)
                        if size == length:
                            whole.append((*piece, (group << 32) + sequence, 0))
                            sequence += 1
                        else:
                            pending.append(piece)
                if whole:
                    yield batch_of(whole)
        yield from flush()
        ids.forget()

    return rows.mapInArrow(released(run), f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


@query("op8_packing")
def _query(t: Tables) -> DataFrame:
    import public_tokenizers

    pieces = pack(t.documents, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
