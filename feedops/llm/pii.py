"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a span classifier learns from the result.

1. Every whole text is searched once for candidates: the base spans (e-mail address, IP address, payment card, phone number, each by its own rule) and looser
   shapes of the same kinds: addresses spelt with "at" and "dot", colon-separated IP addresses, numbers of 13 to 19 digits, phone numbers without a plus sign.
2. Six labelers vote yes, no or nothing on each candidate: two on its shape (regex), two from gazetteers and two from the words and characters around it.
3. Expectation-maximisation per kind finds each labeler's rates of votes among true and false spans, and so each vote pattern's probability. Spans of the base
   rules count as true; everything else starts from the majority of its votes.
4. A logistic regression is fitted to these probabilities on features of the span and its neighbourhood, and decides on the looser candidates. Base spans stay.

A candidate's votes and features are a few small numbers, so corpus statistics are counts per combination: at most a few thousand rows reach the driver,
however large the corpus, and they cover every document. Texts are read once; candidates are kept in the shared folder.

Results by case: a null or empty text has no spans; null ids are kept; repeated rows get equal results; an added span never overlaps a base span or an earlier
added one; without any candidate nothing is fitted; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.llm.registry import Tables, query
from feedops.session import pinned

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base rules. The e-mail rule is split at its @, so that a long run of name characters without one is never rescanned.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL_NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP_RULE = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
CARD_RULE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RULE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser shapes: the candidates on which only the votes decide.
SPELT_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{2,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,3}", re.I)
SIX_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
NUMBER = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3} ?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[0-9]")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|62")

# Gazetteers: plain lists, parameters of ``candidates``.
DOMAIN_ENDS = frozenset("com org net edu gov info biz io de fr es it uk us ca nl pl jp cn br".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91".split())
WORDS_FOR = (
    frozenset("mail email contact write reach address correo courriel kontakt".split()),
    frozenset("ip host server login address from client connected".split()),
    frozenset("card credit debit visa mastercard payment pay account karte tarjeta carte".split()),
    frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone".split()),
)
WORDS_AGAINST = frozenset("version isbn issn order invoice part serial hash sha commit token id ref page section chapter".split())
WORD = re.compile(r"[^\W\d_]+")
CONTEXT = 40
LABELERS = 6
# Combinations of kind, votes and features that can occur: 4 kinds, 3^6 votes, 2^6 features.
ROUNDS, STEPS, RIDGE = 50, 60, 1.0
PRIOR = 2.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if k % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of the spans that the base rules find, by kind and begin; ends are exclusive, positions code points."""
    found: list[tuple[int, int, int]] = []
    last = 0
    if "@" in text:
        for m in EMAIL_HOST.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in EMAIL_NAME_CHARACTERS:
                begin -= 1
            if begin < m.start():
                last = m.end()
                found.append((EMAIL, begin, last))
    if not DIGIT.search(text):
        return found
    for m in IP_RULE.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((IP, m.start(), m.end()))
    for m in CARD_RULE.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in PHONE_RULE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found.append((PHONE, m.start(), m.end()))
    return found


def looser_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidates of looser shape, whether or not a base rule also finds them."""
    low = text.lower()
    if "at" in low and ("dot" in low or "." in low) and any(x in low for x in ("[at]", "(at)", "{at}", " dot ", "(dot)", "[dot]")):
        for m in SPELT_EMAIL.finditer(text):
            if not re.search(r" at ", m.group(), re.I) or re.search(r"dot", m.group(), re.I):
                yield EMAIL, m.start(), m.end()
    if text.count(":") >= 7:
        for m in SIX_IP.finditer(text):
            yield IP, m.start(), m.end()
    if not DIGIT.search(text):
        return
    for m in NUMBER.finditer(text):
        yield CARD, m.start(), m.end()
    for m in CARD_RULE.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_digits(m.group())) <= 19:
            yield CARD, m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield PHONE, m.start(), m.end()


def _vote(yes: bool, no: bool) -> int:
    return 2 if yes and not no else 1 if no and not yes else 0


def judged(text: str, kind: int, begin: int, end: int) -> tuple[int, int]:
    """(votes, features) of a candidate: six votes in base 3 (0 none, 1 no, 2 yes) and six yes-or-no features in bits."""
    span, before, after = text[begin:end], text[max(0, begin - CONTEXT) : begin], text[end : end + 1]
    near = {w.lower() for w in WORD.findall(before)[-4:]}
    digits = _digits(span)
    joined = (before[-1:].isalnum() or before[-1:] in ("_", '"', "=")) or (after.isalnum() or after in ("_", '"'))
    separated = any(c in " -.()" for c in span)
    if kind == EMAIL:
        name, _, host = span.partition("@")
        spelt = not host
        ending = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        shape = _vote(len(name) <= 64 and not spelt, name.startswith(".") or ".." in span)
        rule = _vote(spelt and bool(re.search(r"[\[({]at|[\[({]dot", span, re.I)), spelt and span.islower() and len(span.split()) > 5)
        listed, known = _vote(ending in DOMAIN_ENDS, len(ending) < 2 or ending.isdigit()), _vote(bool(re.search(r"mail|post|inbox", span, re.I)), False)
    elif kind == IP:
        parts = span.split(".") if "." in span else span.split(":")
        shape, rule = _vote(len(parts) in (4, 8), False), _vote(len(set(parts)) > 1, len(set(parts)) == 1 or any(len(p) > 1 and p[0] == "0" for p in parts))
        listed, known = _vote("." in span and 0 < int(parts[0][-3:]) < 224, span.startswith(("0.", "127."))), _vote(":" in span and parts[0].lower().startswith(("20", "fe80", "fd")), False)
    elif kind == CARD:
        shape, rule = _vote(len(digits) in (15, 16), len(digits) in (14, 17, 18)), _vote(luhn(digits), not luhn(digits))
        listed, known = _vote(bool(ISSUERS.match(digits)), digits[0] in "0189"), _vote(False, len(set(digits)) <= 2)
    else:
        shape, rule = _vote(span.startswith("+") or "(" in span, not separated), _vote(9 <= len(digits) <= 13, len(set(digits)) <= 2)
        code = any(digits.startswith(c) for c in CALLING_CODES)
        listed, known = _vote(span.startswith("+") and code, span.startswith("+") and not code), _vote(False, bool(re.fullmatch(r"(19|20)[0-9]{2}[ .-].*", span)))
    context = _vote(bool(near & WORDS_FOR[kind]), bool(near & WORDS_AGAINST))
    edges = _vote(False, joined)
    votes = 0
    for v in (shape, rule, listed, known, context, edges):
        votes = votes * 3 + v
    features = 0
    for bit in (luhn(digits) if len(digits) > 1 else False, separated, before[-1:].isspace() or not before, after.isspace() or not after, len(digits) > 12, bool(near & WORDS_FOR[kind])):
        features = features * 2 + int(bit)
    return votes, features


def document(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, begin, end, base, votes, features) of a text's base spans and of the looser candidates beside them."""
    base = base_spans(text)
    taken = sorted((b, e) for _, b, e in base)
    out = [(k, b, e, True, *judged(text, k, b, e)) for k, b, e in base]
    starts = [b for b, _ in taken]
    # The furthest end of any base span up to each, for a look-up by begin.
    ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    last = 0
    for kind, begin, end in sorted(looser_spans(text), key=lambda s: (s[1], s[0], -s[2])):
        i = int(np.searchsorted(starts, end)) if starts else 0
        if begin >= last and not (i and ends[i - 1] > begin):
            out.append((kind, begin, end, False, *judged(text, kind, begin, end)))
            last = end
    return out


_SPAN = "kind int, begin int, end int, base boolean, votes int, features int"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``: all candidates with their votes and features."""
    id_type = docs.schema["doc_id"].dataType
    names = ("kind", "begin", "end", "base", "votes", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(names, s)) for s in document(text.as_py() or "")] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>")


def patterns(found: DataFrame) -> DataFrame:
    """How many candidates show each combination: (kind, base, votes, features, n). Bounded by the number of combinations."""
    return found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.base", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))


def _vote_columns(votes: np.ndarray) -> np.ndarray:
    return np.stack([(votes // 3**k) % 3 for k in reversed(range(LABELERS))], axis=1)


def _feature_columns(kind: np.ndarray, votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Kind, single votes and features as 0 and 1, and a constant."""
    cast = _vote_columns(votes)
    bits = np.stack([(features >> k) & 1 for k in reversed(range(6))], axis=1)
    return np.hstack([kind[:, None] == np.arange(len(KINDS)), cast == 1, cast == 2, bits, np.ones((len(kind), 1))]).astype(float)


def reliabilities(votes: np.ndarray, base: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pattern, rates) for the candidates of one kind by expectation-maximisation.

    ``rates[c, j, v]`` is how often labeler j votes v on spans of class c. Base spans are known to be true; ``PRIOR`` pseudo-counts keep rates off 0 and 1.
    """
    cast = _vote_columns(votes)
    lead = (cast == 2).sum(1) - (cast == 1).sum(1)
    p = np.where(base, 1.0, 1 / (1 + np.exp(-lead.astype(float))))
    rates = np.zeros((2, LABELERS, 3))
    # The rates start from labelers that are right more often than not.
    lean = np.array([[1.0, 2.0, 1.0], [1.0, 1.0, 2.0]])
    for _ in range(rounds):
        for c, weight in enumerate((n * (1 - p), n * p)):
            counts = np.stack([(weight[:, None] * (cast == v)).sum(0) for v in range(3)], axis=1) + PRIOR * lean[c]
            rates[c] = counts / counts.sum(1, keepdims=True)
        loose = ~base
        share = ((n * p)[loose].sum() + 1) / (n[loose].sum() + 2)
        log = np.log(rates[:, np.arange(LABELERS)[None, :], cast]).sum(2)
        odds = log[1] - log[0] + np.log(share / (1 - share))
        new = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, rates


def fit_classifier(x: np.ndarray, target: np.ndarray, n: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a ridge logistic regression to probabilities, by Newton steps."""
    w = np.zeros(x.shape[1])
    scale = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - target)) + RIDGE * w
        step = np.linalg.solve((x * (scale * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepted(rows: list[tuple[int, bool, int, int, int]]) -> list[tuple[int, int, int]]:
    """The (kind, votes, features) combinations that the trained classifier takes for personal data."""
    if not rows:
        return []
    rows = sorted(rows)
    kind, votes, features, n = (np.array([r[i] for r in rows]) for i in (0, 2, 3, 4))
    base = np.array([r[1] for r in rows], bool)
    n = n.astype(float)
    target = np.zeros(len(rows))
    for k in range(len(KINDS)):
        mine = kind == k
        if mine.any():
            target[mine] = reliabilities(votes[mine], base[mine], n[mine])[0]
    x = _feature_columns(kind, votes, features)
    score = x @ fit_classifier(x, target, n)
    return sorted({(int(k), int(v), int(f)) for k, v, f, s in zip(kind, votes, features, score) if s >= 0})


def _code(kind: Column, votes: Column, features: Column) -> Column:
    return (kind * 729 + votes) * 64 + features


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: array of (kind, begin, end, base), by kind and begin."""
    found = pinned(candidates(docs))
    rows = [tuple(r) for r in patterns(found).select("kind", "base", "votes", "features", "n").collect()]
    taken = [(k * 729 + v) * 64 + f for k, v, f in accepted(rows)]
    known = F.array(*[F.lit(c) for c in taken]) if taken else F.array().cast("array<int>")
    kept = F.filter("spans", lambda s: s["base"] | F.array_contains(known, _code(s["kind"], s["votes"], s["features"])))
    spans = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select("doc_id", F.array_sort(spans).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:begin:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"], s["end"])), ",")


def _of_kind(spans: str, kind: int) -> Column:
    """How many of ``spans`` are of one kind. The lambda takes the span alone: Spark fills a second parameter, defaults too, with the place in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op13_pii")
def _query(t: Tables) -> DataFrame:
    found = personal_data(t.documents).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    counts = [_of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
