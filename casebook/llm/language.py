"""Language of whole texts by a byte convolutional network over fixed-length windows.

Filters of several widths slide over the bytes of a window, each keeps its largest response, and
a softmax over these responses gives the languages' probabilities. Weights are fitted in numpy on
a bounded, hash-chosen sample of labelled rows. A text's probabilities are the mean over all its
windows, weighted by their bytes.

Null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled
row is given. Ties go to the language that sorts first. Repeated rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casebook.llm import wordhash
from casebook.llm.memory import tidy

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE_ROWS = 2_000  # labelled rows that the fit may use, over all languages
SAMPLE_BYTES = 1_024  # bytes taken from each of them, at a place chosen by hash
STEPS = 250
BATCH = 96
WINDOWS_AT_ONCE = 64


@dataclass
class Network:
    labels: list[str]
    filters: dict[int, np.ndarray]  # by width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (filters of all widths, labels)
    offset: np.ndarray

    def pairs(self) -> dict[int, list[np.ndarray]]:
        """Response tables for two neighbouring bytes at once."""
        tables = {}
        for width, taps in self.filters.items():
            both = [
                (taps[o][:, None, :] + taps[o + 1][None, :, :]).reshape(65536, -1)
                for o in range(0, width - 1, 2)
            ]
            tables[width] = both + ([taps[width - 1]] if width % 2 else [])
        return tables

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.offset


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows, their row and their number of bytes."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // WINDOW))
    firsts = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    for first, low, high in zip(firsts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        flat[first * WINDOW:first * WINDOW + high - low] = data[low:high]
    row = np.repeat(np.arange(len(sizes)), counts)
    weight = np.full(len(row), WINDOW)
    weight[firsts + counts - 1] = sizes - (counts - 1) * WINDOW
    return flat.reshape(-1, WINDOW), row, np.maximum(weight, 1)


def _pooled(tables: dict[int, list[np.ndarray]], windows: np.ndarray) -> np.ndarray:
    wide = windows.astype(np.int64)
    pair = wide[:, :-1] * 256 + wide[:, 1:]
    parts = []
    for width, steps in tables.items():
        n = WINDOW - width + 1
        total = steps[0][pair[:, :n]]
        for i, table in enumerate(steps[1:], 1):
            source = pair if len(table) > 256 else wide
            total += table[source[:, 2 * i:2 * i + n]]
        parts.append(total.max(axis=1))
    return np.concatenate(parts, axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, bytes]], seed: int = 11) -> Network | None:
    """The network for ``(label, bytes)`` samples; None without any."""
    samples = [(label, data) for label, data in samples if data]
    if not samples:
        return None
    labels = sorted({label for label, _ in samples})
    data = np.frombuffer(b"".join(d for _, d in samples), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d) for _, d in samples])])
    windows, row, _ = windows_of(data, offsets)
    truth = np.array([labels.index(label) for label, _ in samples])[row]
    share = np.bincount(truth, minlength=len(labels)).astype(float)
    random = np.random.default_rng(seed)
    chance = (1 / share)[truth]
    chance /= chance.sum()
    net = Network(
        labels,
        {w: random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        random.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    values = [*net.filters.values(), net.bias, net.dense, net.offset]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    for step in range(1, STEPS + 1):
        chosen = random.choice(len(windows), BATCH, p=chance)
        x, y = windows[chosen].astype(np.int64), truth[chosen]
        pooled, peaks = [], []
        for width, taps in net.filters.items():
            n = WINDOW - width + 1
            response = sum(taps[o][x[:, o:o + n]] for o in range(width))
            peak = response.argmax(axis=1)
            peaks.append(peak)
            pooled.append(np.take_along_axis(response, peak[:, None, :], 1)[:, 0])
        before = np.concatenate(pooled, axis=1) + net.bias
        hidden = np.maximum(before, 0)
        error = _softmax(hidden @ net.dense + net.offset)
        error[np.arange(BATCH), y] -= 1
        error /= BATCH
        back = (error @ net.dense.T) * (before > 0)
        gradients = []
        for i, (width, taps) in enumerate(net.filters.items()):
            gradient = np.zeros_like(taps)
            own = back[:, i * FILTERS:(i + 1) * FILTERS]
            filters = np.broadcast_to(np.arange(FILTERS), own.shape)
            for o in range(width):
                seen = x[np.arange(BATCH)[:, None], peaks[i] + o]
                np.add.at(gradient[o], (seen, filters), own)
            gradients.append(gradient)
        gradients += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
        for value, g, m, v in zip(values, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            fixed = np.sqrt(v / (1 - 0.99**step)) + 1e-8
            value -= 0.02 * (m / (1 - 0.9**step)) / fixed
    return net


def _stable(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30))


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """At most about ``rows`` pieces of labelled texts, as many of each language as there are."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    quota = max(1, rows // len(counts))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        bar = int((1 << 30) * min(1.0, quota / n))
        keep = keep | ((F.col("lang") == lang) & (_stable(F.col("doc_id")) < bar))
    content = F.col("text").cast("binary")
    spare = F.greatest(F.octet_length(content) - SAMPLE_BYTES, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), spare.cast("long")) + 1
    chosen = labelled.where(keep).select(
        "doc_id", "lang", F.substring(content, start.cast("int"), F.lit(SAMPLE_BYTES)).alias("piece")
    )
    found = chosen.limit(2 * rows).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["piece"] or b"")))
    return [(r["lang"], bytes(r["piece"] or b"")) for r in found]


def _predictor(net: Network | None):
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.pairs() if net else {}
        for column in columns:
            langs: list[str] = []
            scores: list[float] = []
            data, offsets = wordhash.texts(column)
            first = 0
            while net and first < len(column):
                end = int(np.searchsorted(offsets, offsets[first] + (1 << 20), "right")) - 1
                end = min(max(end, first + 1), len(column))
                windows, row, weight = windows_of(data, offsets[first:end + 1])
                total = np.zeros((end - first, len(net.labels)))
                for at in range(0, len(windows), WINDOWS_AT_ONCE):
                    stop = at + WINDOWS_AT_ONCE
                    p = _softmax(net.logits(_pooled(tables, windows[at:stop])))
                    np.add.at(total, row[at:stop], p * weight[at:stop, None])
                total /= total.sum(axis=1, keepdims=True)
                langs += [net.labels[i] for i in total.argmax(axis=1)]
                scores += np.minimum(total.max(axis=1), 1.0).tolist()
                first = end
            known = column.is_valid().to_pylist()
            if not net:
                langs, scores = [UNKNOWN] * len(known), [0.0] * len(known)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([g if k else UNKNOWN for g, k in zip(langs, known)], pa.string()),
                    pa.array([s if k else 0.0 for s, k in zip(scores, known)], pa.float64()),
                ],
                ["lang", "score"],
            )

    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(predict)(columns)

    return F.arrow_udf(predicted, "lang string, score double")


def predict(net: Network | None, text: Column) -> Column:
    """``struct<lang, score>`` for a text column; texts without a letter are unknown."""
    return _predictor(net)(F.when(text.rlike(r"\p{L}"), text))


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no fit may see."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame) -> Network | None:
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return fit(sample(usable.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``."""
    net = learn(docs)
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(net, F.col("text")).alias("found")
    )
    return rows.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
