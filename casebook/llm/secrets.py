"""Secrets in whole texts: fixed patterns, and strings that look drawn at random.

Two character Markov models, one of random strings and one of ordinary identifiers, give the log
likelihood ratio of a run of key characters. Runs that are long enough and clearly likelier under
the random model are reported as ``markov`` spans beside the spans of the patterns. A run that is
not, as a key behind a path or a name, is searched for the stretch with the largest sum of
ratios above half the margin, and what lies before and behind it again.

The ordinary model is trained on runs that the patterns leave alone in a bounded, hash-chosen
sample of the texts, the random one on the values that they find there and on strings drawn with a
fixed seed. Null text is empty and has no spans; spans count code points, ends exclusive, and lie
in order of start, then kind. Spans of the patterns may overlap; of a run that meets one only the parts
beside it are searched. Repeated rows get equal spans; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ["assign", "access", "hex", "markov"]
SAMPLE_ROWS = 2_000  # texts that the fit may read
SAMPLE_CHARS = 4_000  # characters of each of them, from a place chosen by hash
DRAWN = 3_000  # random strings drawn for the random model
RUN = 20  # characters of the shortest run that is scored
MARGIN = 3.0  # mean log likelihood ratio of the characters of a random string
DISTINCT = 8  # different characters that such a string has at least, unlike ruled lines
LEAN = 20.0  # weight of a symbol's own share in each row of a chain

# The patterns and least lengths of the base kinds.
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("passw", "secret", "token", "api")
_LEAST_VALUE, _LEAST_ACCESS = 6, 20

_RUNS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % RUN)
_WORDS = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CODES = np.full(128, len(_LETTERS), np.int64)
_CODES[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
_SYMBOLS = len(_LETTERS) + 2  # all others, and the start


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, leftmost and non-overlapping in each kind."""
    spans = []
    low = text.lower()
    if any(cue in low for cue in _CUES):
        spans += [
            (m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= _LEAST_VALUE
        ]
    if "AKIA" in text:
        spans += [
            (m.start(), m.end(), "access") for m in _ACCESS.finditer(text)
            if m.end() - m.start() >= _LEAST_ACCESS
        ]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _codes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def chain(strings: Iterable[str]) -> np.ndarray:
    """Log probabilities of each symbol after each other.

    Pairs lean on the symbols' own shares, and these on one more of each.
    """
    counts = np.zeros((_SYMBOLS, _SYMBOLS))
    for text in strings:
        codes = np.concatenate([[_SYMBOLS - 1], _codes(text)])
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    share = (counts.sum(axis=0) + 1) / (counts.sum() + _SYMBOLS)
    return np.log((counts + LEAN * share) / (counts.sum(axis=1, keepdims=True) + LEAN))


def drawn(n: int, seed: int = 7) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    random = np.random.default_rng(seed)
    alphabets = [
        "0123456789abcdef", _LETTERS[:62], _LETTERS[:64], "0123456789ABCDEF", _LETTERS[26:62]]
    return [
        "".join(random.choice(list(alphabets[i % len(alphabets)]), int(random.integers(16, 48))))
        for i in range(n)
    ]


def ratios(text: str, model: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each of a string's characters, random over ordinary."""
    codes = np.concatenate([[_SYMBOLS - 1], _codes(text)])
    return model[codes[:-1], codes[1:]]


def score(text: str, model: np.ndarray) -> float:
    """The mean of a string's ratios."""
    return float(ratios(text, model).mean())


def best_stretch(excess: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum, from running sums; the first on ties."""
    ends = np.cumsum(excess)
    before = np.minimum.accumulate(np.concatenate([[0.0], ends[:-1]]))
    end = int(np.argmax(ends - before))
    start = int(np.argmin(np.concatenate([[0.0], ends[:end]])))
    return start, end + 1


def random_stretches(run: str, model: np.ndarray, margin: float) -> list[tuple[int, int]]:
    """Where a run of key characters holds random strings; the run itself if it is one."""
    values = ratios(run, model)
    found, parts = [], [(0, len(run))]
    while parts:
        low, high = parts.pop()
        if high - low < RUN:
            continue
        a, b = low, high
        if values[a:b].mean() < margin:
            a, b = (low + x for x in best_stretch(values[low:high] - margin / 2))
        if b - a < RUN or values[a:b].mean() < margin or len(set(run[a:b])) < DISTINCT:
            continue
        found.append((a, b))
        parts += [(low, a), (b, high)]
    return found


def _beside(start: int, end: int, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a stretch that no span covers; spans in order of start."""
    out = []
    for a, b, _ in spans:
        if a < end and start < b:
            out.append((start, a))
            start = max(start, b)
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= RUN]


def fit(texts: Iterable[str]) -> np.ndarray:
    """The table of log likelihood ratios from a sample of texts."""
    values, words = drawn(DRAWN), []
    for text in texts:
        spans = base_spans(text)
        values += [text[a:b].rsplit("=", 1)[-1].rsplit(":", 1)[-1].strip(" \"'") for a, b, _ in spans]
        at = 0
        for a, b, _ in [*spans, (len(text), len(text), "")]:
            words += _WORDS.findall(text[at:a]) if a > at else []
            at = max(at, b)
    return chain(values) - chain(words)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Pieces of at most about ``rows`` texts, chosen by the hash of text and id."""
    held = docs.where("text is not null and text <> ''")
    total = held.count()
    if not total:
        return []
    bar = int((1 << 30) * min(1.0, rows / total))
    spare = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), spare.cast("long")) + 1
    chosen = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bar).select(
        F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece"))
    # A hash that many rows share could bring more than the bound: the lowest texts then stay.
    return [r["piece"] for r in chosen.orderBy("piece").limit(2 * rows).collect()]


def spans_of(text: str, model: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    spans = base_spans(text)
    found = list(spans)
    for m in _RUNS.finditer(text):
        for start, end in _beside(m.start(), m.end(), spans):
            found += [
                (start + a, start + b, "markov")
                for a, b in random_stretches(text[start:end], model, margin)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans = [
                [dict(zip(("start", "end", "kind"), s)) for s in spans_of(t.as_py() or "", model)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def scan(docs: DataFrame) -> DataFrame:
    """Train on a sample of ``docs`` and scan all of it."""
    return find(docs, fit(sample(docs.select("doc_id", "text"))))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if end > at:
            out += [text[at:max(at, start)], f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
