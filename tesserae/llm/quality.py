"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Cyclic boosting goes over the features in turn; each turn fits a tree of at most four leaves on one feature's bins and
adds it, shrunk, to that feature's lookup table. Pairs with the largest gains over the residuals then get tables of
their own by trees that cut each of two features once. A score is the logistic of a sum of looked-up bins.

The model is fitted on the driver on at most SAMPLE labelled rows (a hash chooses them); all whole texts are scored.
Features come from the text alone.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, raw, slices

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bound of the labelled rows that are fitted; bins of a feature and of a paired feature; rounds and shrinkage; pairs.
SAMPLE, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAST_ROWS = 16_384, 32, 8, 150, 60, 0.1, 8, 8
#: Words of the stretches whose worst value is a feature.
STRETCH = 32

_is = np.zeros((8, 256), np.int64)
_is[0, [9, 10, 11, 12, 13, 32]] = 1  # white space
_is[1, 48:58] = 1  # digits
_is[2, 65:91] = 1  # upper case
_is[3, 97:123] = 1  # lower case
_is[4, list(b".,;:?'\"-()")] = 1  # punctuation of prose
_is[5, list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 1  # symbols
_is[6, 128:] = 1  # beyond ASCII
_is[7, 10] = 1
SPACE, SYMBOL = _is[0].astype(bool), _is[5].astype(bool)
NAMES = ["bytes", "words", "word_bytes", "digits", "upper", "lower", "prose_marks", "symbols", "beyond_ascii", "lines", "distinct", "repeats", "symbol_ends", "symbol_words", "sentence_ends", "entropy", "worst_repeats", "worst_symbol_ends", "worst_symbol_words", "worst_upper", "worst_long", "longest_word", "distinct_lines", "worst_digits"]


def _worst(flags: np.ndarray) -> float:
    """Largest share of flagged words in a stretch."""
    if len(flags) <= STRETCH:
        return float(flags.mean())
    total = np.concatenate([[0], np.cumsum(flags)])
    return float((total[STRETCH:] - total[:-STRETCH]).max() / STRETCH)


def features(text: bytes) -> list[float]:
    """NAMES of one whole text; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text, np.uint8)
    histogram = np.bincount(data, minlength=256)
    kinds, n, m = _is @ histogram, len(data), len(words)
    share = histogram[histogram > 0] / n
    space = SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    last, first, size = data[end - 1], data[start], end - start
    again = np.zeros(m, bool)
    again[1:] = np.fromiter(map(operator.eq, words[1:], words), bool, m - 1)
    symbol_end = SYMBOL[last]
    symbol_word = symbol_end & SYMBOL[first] & (size <= 3)
    second = data[np.minimum(start + 1, n - 1)]
    upper = (_is[2, second] > 0) & (size > 1)
    digit = _is[1, first] > 0
    lines = text.split(b"\n")
    ends = np.isin(last, list(b".?!"))
    return [
        np.log1p(n), np.log1p(m), n / m, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / m,
        len(set(words)) / m ** 0.9, again.mean(), symbol_end.mean(), symbol_word.mean(), ends.mean(), float(-(share * np.log2(share)).sum()),
        _worst(again), _worst(symbol_end), _worst(symbol_word), _worst(upper), _worst(size > 20), np.log1p(size.max()), len(set(lines)) / len(lines), _worst(digit),
    ]


class Additive:
    """Bin edges, one table for each feature and for each chosen pair."""

    def __init__(self):
        self.edges, self.tables, self.pairs, self.pair_tables, self.base = [], [], [], [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        rows, width = x.shape
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if rows else np.zeros(0) for c in x.T] if width else []
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        p = (y.sum() + 1) / (rows + 2)
        self.base = float(np.log(p / (1 - p)))
        if rows < 2 * LEAST_ROWS or y.min() == y.max():
            return self
        bins = self._bins(x)
        raw_score = np.full(rows, self.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-raw_score))
                step = RATE * _tree(np.bincount(b, y - p, len(self.tables[j])), np.bincount(b, p * (1 - p), len(self.tables[j])), np.bincount(b, minlength=len(self.tables[j])))
                self.tables[j] += step
                raw_score += step[b]
        coarse = self._coarse(bins)
        p = 1 / (1 + np.exp(-raw_score))
        gains = [(-_quadrants(*_sums(coarse[i], coarse[j], y - p, p * (1 - p)))[1], i, j) for i in range(width) for j in range(i)]
        self.pairs = [(i, j) for _, i, j in sorted(gains)[:PAIRS]]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                p = 1 / (1 + np.exp(-raw_score))
                step = RATE * _quadrants(*_sums(coarse[i], coarse[j], y - p, p * (1 - p)))[0]
                self.pair_tables[k] += step
                raw_score += step[coarse[i], coarse[j]]
        return self

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def _coarse(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        return [b * PAIR_BINS // (len(e) + 1) for b, e in zip(bins, self.edges, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: additions of looked-up bins."""
        bins, total = self._bins(x), np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        if self.pairs:
            coarse = self._coarse(bins)
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Newton values by bin of a tree of depth two over one feature's bins."""

    def cut(a: int, b: int) -> int | None:
        gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
        gain = gl**2 / (hl + 1) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + 1)
        gain[(nl < LEAST_ROWS) | (n[a:b].sum() - nl < LEAST_ROWS)] = -1
        k = int(gain.argmax()) if len(gain) else 0
        return a + k + 1 if len(gain) and gain[k] >= 0 else None

    out, cuts = np.zeros(len(g)), [0, len(g)]
    if (root := cut(0, len(g))) is not None:
        cuts = sorted({0, len(g), root, cut(0, root) or root, cut(root, len(g)) or root})
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = np.clip(g[a:b].sum() / (h[a:b].sum() + 1), -4, 4)
    return out


def _sums(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = a * PAIR_BINS + b
    return tuple(np.bincount(at, v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of the best tree that cuts each of two features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts_ = []
    for c in (cg, ch):
        tl, top, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts_.append((tl, top - tl, left - tl, c[-1, -1] - top - left + tl))
    gain = sum(a**2 / (b + 1) for a, b in zip(*parts_, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    values = [np.clip(a[i, j] / (b[i, j] + 1), -4, 4) for a, b in zip(*parts_, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Additive:
    """Fit on at most SAMPLE rows with a label 0 or 1, outside the held-out fold. Rows of one key with two labels count as both; without two classes the score is constant."""
    spark = docs.sparkSession
    arrow_limits(spark)
    learnable = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col(key).cast("string")) % FOLDS != HELD_OUT))
    chosen = learnable.select(F.col(key).alias("key"), F.col("quality").cast("int").alias("label")).distinct().orderBy(F.xxhash64("key"), "key", "label").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.record_batch([b.column("key"), b.column("label"), pa.array([features(t) for t in raw(b.column("text"))], pa.list_(pa.float64()))], names=["key", "label", "x"])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(chosen), "key").select("key", "label", "text")  # at most SAMPLE small rows
    rows = texts.mapInArrow(run, f"key {kind}, label int, x array<double>").orderBy(F.xxhash64("key"), "key", "label", F.xxhash64("x")).limit(SAMPLE).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return Additive().fit(x, rows.column("label").to_numpy().astype(float))


def classify(docs: DataFrame, model: Additive, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, the columns ``keep``, score, predicted) of each row; a null text is empty. One pass, no shuffle."""
    arrow_limits(docs.sparkSession)
    names = [key, *(c for c in keep if c != key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            score = model.score(np.array([features(t) for t in raw(b.column("_text"))], float).reshape(-1, len(NAMES)))
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, f"{kinds}, score double, predicted int")


def op6_gam(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
