"""Subword lattice likelihood: a text's probability is summed over all segmentations of its words.

The arcs of a word's lattice are the pieces of an existing vocabulary and the word itself:

    P(word) = c / (N + A) + A / (N + A) * sum over segmentations of the product of piece probabilities

c is the word's count in training texts, N their tokens, and A is set so that the pieces get the share of training
tokens that were seen once (Good and Turing's estimate of what is new). Pieces start with weights that fall with their
score's rank in the vocabulary; EM_ROUNDS rounds of forward and backward recursion over all distinct training words,
each once (pieces stand for words not seen yet), give their expected counts, which the starting weights smooth. Words
are recursed together by length in log space, very long ones alone; no segmentation of any word is left out. A
document's probability is the product over its words and the end.

Documents are dealt once into blocks; a block asks for its distinct words only, so a frequent word is at most one row a
block. Texts, words and counts cover all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, parts, raw, save, slices
from .substring import prepared

FOLDS, HELD_OUT = 7, 2
#: Rounds of expectation and maximisation; counts that the starting weights stand for; words recursed at once.
EM_ROUNDS, PRIOR, AT_ONCE = 3, 30.0, 4096
#: A word beyond this many characters is recursed alone.
TOGETHER = 256
END = b""
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The vocabulary's pieces in a two-way hash table by rolling hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces, scores = [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids])
        order = np.argsort(-scores, kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(len(order))
        #: Piece len(pieces) stands for any character without a piece of its own, spelled by bytes.
        weight = np.append(1 / (rank + 10), 1e-4)
        self.prior = weight / weight.sum()
        self.n, self.most = len(pieces), max(map(len, pieces))
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in pieces if len(p) == 1]] = True
        size = 1 << 20
        self.mask = np.uint64(size - 1)
        self.keys, self.ids = np.zeros((2, size), np.uint64), np.full((2, size), -1, np.int32)
        known = {p: i for i, p in enumerate(pieces)}
        for p in pieces:
            for k in range(1, len(p)):
                known.setdefault(p[:k], -2)  # begins a piece
        for p, i in known.items():
            h = 1
            for c in p:
                h = (h * int(_M1) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            for way in (0, 1):
                slot = int(self._slot(np.array([h], np.uint64), way)[0])
                if self.ids[way, slot] == -1:
                    self.keys[way, slot], self.ids[way, slot] = h, i
                    break
            else:
                raise ValueError("no slot for a piece")

    def _slot(self, h: np.ndarray, way: int) -> np.ndarray:
        return ((h * _M2) >> np.uint64(44 if way == 0 else 20)) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids by hash; -2 for what only begins a piece, -1 for what does not."""
        slot = self._slot(h, 0)
        out = np.where(self.keys[0][slot] == h, self.ids[0][slot], -1)
        left = np.flatnonzero(out == -1)
        slot = self._slot(h[left], 1)
        out[left] = np.where(self.keys[1][slot] == h[left], self.ids[1][slot], -1)
        return out


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Equally long words (n, length) of code points with their arcs by start and end."""

    def __init__(self, chars: np.ndarray, pieces: Pieces, log_p: np.ndarray):
        self.n, self.length = chars.shape
        self.arcs: list[dict[int, tuple]] = [{} for _ in range(self.length + 1)]  # by end, then start
        alone, wide = pieces.single[chars], chars.astype(np.uint64)
        for start in range(self.length):
            h, alive = wide[:, start] + _M1, np.arange(self.n)
            for end in range(start + 1, min(self.length, start + pieces.most) + 1):
                if end > start + 1:
                    h = h * _M1 + wide[alive, end - 1]
                found = pieces.find(h)
                at = np.flatnonzero(found >= 0)
                words, ids = alive[at], found[at]
                weight = log_p[ids]
                if end == start + 1 and not alone[:, start].all():
                    other = np.flatnonzero(~alone[:, start])
                    c = chars[other, start]
                    words, ids = np.concatenate([words, other]), np.concatenate([ids, np.full(len(other), pieces.n, np.int32)])
                    weight = np.concatenate([weight, log_p[pieces.n] - np.log(256.0) * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])
                if len(words):
                    self.arcs[end][start] = words, ids, weight
                begins = np.flatnonzero(found != -1)
                if not len(begins):
                    break
                h, alive = h[begins], alive[begins]
        self.alpha = np.empty((self.length + 1, self.n))
        self.alpha[0] = 0
        for end in range(1, self.length + 1):
            self.alpha[end] = self._sum((words, self.alpha[start][words] + weight) for start, (words, _, weight) in self.arcs[end].items())

    def _sum(self, terms: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log of the sum of exponentials by word."""
        rows = []
        for words, value in terms:
            rows.append(np.full(self.n, -np.inf))
            rows[-1][words] = value
        if not rows:
            return np.full(self.n, -np.inf)
        rows = np.array(rows)
        top = rows.max(0)
        base = np.where(np.isfinite(top), top, 0)
        rows -= base
        with np.errstate(divide="ignore"):
            return np.log(np.exp(rows, out=rows).sum(0)) + base

    @property
    def total(self) -> np.ndarray:
        return self.alpha[-1]

    def expected(self, count: np.ndarray, out: np.ndarray) -> None:
        """Add each piece's expected count over words of these counts."""
        beta = np.empty((self.length + 1, self.n))
        beta[-1] = 0
        by_start: list[list] = [[] for _ in range(self.length)]
        for end, starts in enumerate(self.arcs):
            for start, arc in starts.items():
                by_start[start].append((end, arc))
        ids, shares = [], []
        for start in range(self.length - 1, -1, -1):
            through = [(words, found, beta[end][words] + weight) for end, (words, found, weight) in by_start[start]]
            beta[start] = self._sum((words, value) for words, _, value in through)
            left = self.alpha[start] - self.total
            for words, found, value in through:
                ids.append(found)
                shares.append(np.exp(left[words] + value) * count[words])
        out += np.bincount(np.concatenate(ids), np.concatenate(shares), len(out))


class Chain:
    """One long word (n=1): its arcs are found at all positions at once, the recursions go from position to position."""

    def __init__(self, chars: np.ndarray, pieces: Pieces, log_p: np.ndarray):
        self.length, starts, ends, ids, weights = len(chars), [], [], [], []
        wide, at = chars.astype(np.uint64), np.arange(len(chars))
        h = wide + _M1
        for size in range(1, pieces.most + 1):
            if size > 1:
                at = at[at + size <= self.length]
                h = h[: len(at)] * _M1 + wide[at + size - 1]
            found = pieces.find(h)
            hit = found >= 0
            starts.append(at[hit])
            ids.append(found[hit])
            weights.append(log_p[found[hit]])
            if size == 1:
                other = np.flatnonzero(~pieces.single[chars])
                c = chars[other]
                starts.append(other)
                ids.append(np.full(len(other), pieces.n, np.int32))
                weights.append(log_p[pieces.n] - np.log(256.0) * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
                ends.append(at[hit] + 1)
                ends.append(other + 1)
            else:
                ends.append(at[hit] + size)
            begins = found != -1
            at, h = at[begins], h[begins]
            if not len(at):
                break
        self.start, self.end, self.ids, self.weight = (np.concatenate(x) for x in (starts, ends, ids, weights))
        self.alpha = self._recursed(self.end, self.start)
        self.total = self.alpha[-1:]

    def _recursed(self, to: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Log of the sum over paths from position 0 to each position."""
        by = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[by], np.arange(1, self.length + 2)).tolist()
        back, weight, out = back[by].tolist(), self.weight[by].tolist(), [0.0]
        for a, b in zip(cut, cut[1:], strict=False):
            terms = [out[back[i]] + weight[i] for i in range(a, b)]
            top = max(terms, default=-math.inf)
            out.append(top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top)
        return np.array(out)

    def expected(self, count: np.ndarray, out: np.ndarray) -> None:
        """Add each piece's expected count over the word of this count."""
        beta = self._recursed(self.length - self.start, self.length - self.end)[::-1]
        share = np.exp(self.alpha[self.start] + self.weight + beta[self.end] - self.total) * count[0]
        out += np.bincount(self.ids, share, len(out))


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.Table]:
    """Batches of words joined up to about ``limit`` bytes, so that words of a length come in numbers."""
    held, size = [], 0
    for b in slices(batches, "word", limit):
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lattices(words: list[bytes], pieces: Pieces, log_p: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice | Chain]]:
    """(positions in ``words``, their lattice) by length."""
    marked = ["▁" + w.decode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    for n in np.unique(size).tolist():
        group = np.flatnonzero(size == n)
        step = max(1, min(AT_ONCE, 200_000 // n)) if n <= TOGETHER else 1
        for s in range(0, len(group), step):
            at = group[s : s + step]
            chars = np.frombuffer("".join([marked[i] for i in at]).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.int64)
            yield at, Lattice(chars, pieces, log_p) if n <= TOGETHER else Chain(chars[0], pieces, log_p)


def log_marginals(words: list[bytes], path: str, log_p: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all its segmentations into pieces."""
    out = np.zeros(len(words))
    for at, lattice in lattices(words, _pieces(path), log_p):
        out[at] = lattice.total
    return out


def word_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, n: its count in training texts): every distinct token of all texts; the empty word is the end."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        held: set[bytes] = set()

        def out() -> Iterator[pa.RecordBatch]:
            words = [*count, *(w for w in held if w not in count)]
            values = np.zeros(len(words), np.int64)
            values[: len(count)] = np.fromiter(count.values(), np.int64, len(count))
            for i in range(0, len(words), 50_000):
                yield pa.record_batch([pa.array(words[i : i + 50_000], pa.binary()), pa.array(values[i : i + 50_000])], names=["word", "n"])
            count.clear()
            held.clear()

        for b in slices(batches, "text"):
            for text, train in zip(raw(b.column("text")), b.column("train").to_pylist(), strict=True):
                words = text.lower().split()
                if train:
                    count.update(words)
                    count[END] += 1
                else:
                    held.update(words)
            if len(count) + len(held) > 500_000:
                yield from out()
        yield from out()

    train = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS != HELD_OUT, F.lit(True)).alias("train")
    return docs.select("text", train).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(words: DataFrame, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, of the unknown piece, and last of the end, from all distinct training words."""
    spark = words.sparkSession
    pieces = _pieces(path)
    ends = words.where((F.col("word") == F.lit(END)) & (F.col("n") > 0)).count()
    counts = pieces.prior * PRIOR
    for _ in range(rounds):
        log_p = np.log(counts / (counts.sum() + ends + 1))
        shared = spark.sparkContext.broadcast(log_p)  # one number for each piece of the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared, path=path) -> Iterator[pa.RecordBatch]:
            table = _pieces(path)
            out = np.zeros(table.n + 1)
            for b in gathered(batches):
                for at, lattice in lattices(b.column("word").to_pylist(), table, shared.value):
                    lattice.expected(np.ones(len(at)), out)
            used = np.flatnonzero(out)
            yield pa.record_batch([pa.array(used), pa.array(out[used])], names=["piece", "n"])

        found = words.where((F.col("n") > 0) & (F.col("word") != F.lit(END))).mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = pieces.prior * PRIOR
        counts[found.column("piece").to_numpy()] += found.column("n").to_numpy()
    total = counts.sum() + ends + 1
    return np.append(np.log(counts / total), np.log((ends + 1) / total))


def score(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, log10.

    Null texts are empty: one end token. A null key trains. Without training tokens the base is 0 counts over one token.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    words = save(word_counts(docs, key), "words")
    total, distinct, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1)).first()
    learned = spark.sparkContext.broadcast(learn(words, path))
    fresh = max(1.0, once * total / max(1.0, total - once)) if total else 1.0
    log_n = float(np.log10(max(1, total + distinct + 1) if total else 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            w, n = b.column("word").to_pylist(), b.column("n").to_numpy().astype(float)
            end = np.array([x == END for x in w], bool)
            spelled = np.where(end, learned.value[-1], log_marginals(w, path, learned.value[:-1]))
            value = np.logaddexp(np.log(np.maximum(n, 1e-300)), np.log(fresh) + spelled) - np.log(total + fresh)
            yield from pa.table([b.column("word"), b.column("n"), pa.array(value)], names=["word", "n", "value"]).to_batches()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[bytes]] = {}
        for b in slices(batches, "text"):
            for block, text in zip(b.column("_block").to_pylist(), raw(b.column("text")), strict=True):
                seen.setdefault(block, {END}).update(text.lower().split())
        for block in list(seen):
            own = list(seen.pop(block))
            for i in range(0, len(own), 50_000):
                w = own[i : i + 50_000]
                yield pa.record_batch([pa.array(np.full(len(w), block, np.int32)), pa.array(w, pa.binary())], names=["_block", "word"])

    kind = docs.schema[key].dataType.simpleString()

    def apply(block: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        n = found.column("n").to_numpy()
        at = {w: i for i, w in enumerate(found.column("word").to_pylist())}
        base, value, known = np.log10(n + 1.0) - log_n, found.column("value").to_numpy(), n > 0
        rows = []
        keys = texts.column(key)
        for doc_id, text in zip(keys.to_pylist(), raw(texts.column("text").combine_chunks()), strict=True):
            words = text.lower().split()
            words.append(END)
            i = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT
            rows.append((held, len(words), int(known[i].sum()), total, float(base[i].sum()), float(value[i].sum()) / math.log(10)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([keys, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = prepared(docs, key, parts(docs))
    need = rows.mapInArrow(asked, "_block int, word binary")
    values = words.mapInArrow(weigh, "word binary, n long, value double")
    answer = need.join(values, "word")
    return rows.groupBy("_block").cogroup(answer.groupBy("_block")).applyInArrow(apply, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Scores all documents with the 32k pieces of the public vocabulary."""
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
