"""Lexical retrieval packing: in each shard a BM25 inverted index gives a seed's unused neighbours, which fill its window.

Whole windows of a long document are its own; only its rest (under one window) goes to a shard, with the counts of the
terms of its windows, so a row of the shuffle is bounded by the vocabulary. Neighbours are chosen by whole documents, and
document frequencies and the average length are those of all whole documents. Shards are ranges
of the order by the documents' heaviest shared terms, so that documents on the same lie together; what shares all of them
is dealt by a hash of the document, its tokens and its number among equal rows: no term, id, text or source fills a
shard. The last window of a shard is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_limits, save, slices

WINDOW, END = 4096, 2
#: BM25 parameters, heaviest terms that place a document, documents of a shard, words that a worker remembers.
K1, B, PLACED, SHARD, CACHE = 1.2, 0.75, 3, 1024, 500_000


#: Neighbours sorted at once.
FIRST = 32
#: Marks that the tokenizer splits from letters before them (an apostrophe may belong to these), and words of lower-case
#: letters that no step of it changes.
MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
SMALL = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100), *range(0x430, 0x450), 0x451)))
LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff\u0430-\u044f\u0451]+$"


class Merges:
    """The tokenizer's merges, applied to many words of letters at once: in each round every word joins its best pair (the leftmost of equals)."""

    NONE = 1 << 30

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], [tuple(m.split()) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        others = [b for b in range(256) if b not in printed]
        chars = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int32)
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.joined = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys, ranks, self.tables = left << 16 | right, np.arange(len(merges), dtype=np.int32), []
        while len(keys):  # pairs whose slot is taken go to the next table
            slot = self._slot(keys, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << 17, -1, np.int64), np.full(1 << 17, self.NONE, np.int32)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((held, rank))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * table * 0x2545F491)) >> np.uint64(47)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for what does not merge."""
        keys, out = left.astype(np.int64) << 16 | right, np.full(left.shape, self.NONE, np.int32)
        for i, (held, rank) in enumerate(self.tables):
            slot = self._slot(keys, i).astype(np.int64)
            np.copyto(out, rank[slot], where=held[slot] == keys)
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 16 bits) of each word of one to 255 bytes."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 7), (7, 10), (10, 14), (14, 20), (20, 40), (40, 256)):
            at = np.flatnonzero((size >= low) & (size < high))
            if len(at):
                for i, ids in zip(at.tolist(), self._merge([words[i] for i in at], size[at], high - 1), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], size: np.ndarray, wide: int) -> list[bytes]:
        chars = np.array(words, f"S{wide}").view(np.uint8).reshape(-1, wide)
        cols, n = np.arange(wide), len(words)
        ids = self.inner[chars]
        ids[np.arange(n), size - 1] = self.last[chars[np.arange(n), size - 1]]
        rank = np.full((n, wide), self.NONE, np.int32)
        if wide > 1:
            rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        rank[cols >= (size - 1)[:, None]] = self.NONE
        done, length, rows, size = np.zeros((n, wide), "<u2"), size.copy(), np.arange(n), size.copy()
        while True:
            here = np.arange(len(rows))
            at = rank.argmin(1)
            best = rank[here, at]
            more = best < self.NONE
            if not more.all():
                done[rows[~more]], length[rows[~more]] = ids[~more], size[~more]
                rows, ids, rank, size, at, best = rows[more], ids[more], rank[more], size[more], at[more], best[more]
                here = np.arange(len(rows))
            if not len(rows):
                break
            behind = cols[:-1] > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=behind)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=behind)
            size -= 1
            new = ids[here, at] = self.joined[best]
            after = np.flatnonzero(at + 1 < size)
            rank[here, at] = self.NONE
            rank[after, at[after]] = self.rank(new[after], ids[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], new[before])
        flat, step = done.tobytes(), 2 * wide
        return [flat[i : i + n] for i, n in zip(range(0, len(flat), step), (2 * length).tolist(), strict=True)]


class Words:
    """Token ids by white-space word.

    The tokenizer drops white space and never joins across it, so ids of a text are those of its words in turn. It lowers
    case, but finds its special strings first, by case: a text is lowered here only where it can hold none. Of a word of
    letters and marks behind, the two are looked up each. Letters go straight to the merges; all else goes whole through
    the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {b"": b""}, {b"": b""}
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])

    def _ids(self, words: list[bytes], letters: bool) -> list[bytes]:
        """Ids of distinct words, from the known and the older ones where they are there."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            if (ids := self.older.get(words[i])) is None:
                new.append(words[i])
            else:
                self.known[words[i]] = ids
        short = [w for w in new if len(w) < 256] if letters else []
        self.known.update(zip(short, self.merges(short), strict=True))
        rest = [w for w in new if len(w) > 255] if letters else new
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.known[w] = struct.pack(f"<{len(e.ids)}H", *e.ids)
        for i in missing:
            found[i] = self.known[words[i]]
        return found

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text (null: empty) and the end: its words as numbers of the distinct ones, each of which is looked up once."""
        if len(self.known) > CACHE:
            self.known, self.older = {b"": b""}, self.known
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten()
        stems = pc.ascii_rtrim(words, MARKS).dictionary_encode()
        plain = pc.match_substring_regex(stems.dictionary, LETTERS).to_numpy(zero_copy_only=False)
        code = stems.indices.to_numpy()
        good = plain[code]
        marked = good & (pc.binary_length(words).to_numpy() > pc.binary_length(stems.dictionary).to_numpy()[code])
        others = words.filter(pa.array(~good)).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(pa.array(marked)), SMALL).dictionary_encode()
        letters = self._ids(stems.dictionary.filter(pa.array(plain)).cast(pa.binary()).to_pylist(), True)
        rest = self._ids(others.dictionary.cast(pa.binary()).to_pylist() + marks.dictionary.cast(pa.binary()).to_pylist(), False)
        found = [*letters, *rest, b"", struct.pack("<H", END)]  # white space at the ends gives an empty word, which has no ids
        flat, size = np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2
        place = np.cumsum(plain) - 1
        pairs = np.full((len(words), 2), len(found) - 2)  # of each word: the letters or all of it, then the marks or nothing
        pairs[:, 0] = place[code]
        pairs[~good, 0] = len(letters) + others.indices.to_numpy()
        pairs[marked, 1] = len(letters) + len(others.dictionary) + marks.indices.to_numpy()
        ends = 2 * pc.list_value_length(lists).to_numpy().astype(np.int64).cumsum()
        word = np.insert(pairs.ravel(), ends, len(found) - 1)
        n, start = size[word], (np.cumsum(size) - size)[word]
        upto = np.cumsum(n)
        ids = flat[np.repeat(start - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        cut = upto[ends + np.arange(len(ends))]
        return np.split(ids, cut[:-1]) if len(cut) else []


@lru_cache(1)
def _words(path: str) -> Words:
    """A worker's words: they stay known from task to task."""
    return Words(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, doc_tokens, whole: CRCs of the whole windows, body: terms and counts of these, rest: its other ids, place: a hash that tells equal rows apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, seen = _words(vocabulary), Counter()
        for b in slices(batches, "text", 8 << 20):
            total, whole, body, rest, place = [], [], [], [], []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), words(b.column("text")), strict=True):
                cut = len(ids) // WINDOW * WINDOW
                total.append(len(ids))
                whole.append([crc(ids[i : i + WINDOW]) for i in range(0, cut, WINDOW)])
                terms, n = np.unique(ids[:cut], return_counts=True) if cut else (ids[:0], ids[:0])
                body.append(terms.astype("<u2").tobytes() + n.astype("<u4").tobytes())
                rest.append(ids[cut:].tobytes())
                name = f"{doc_id}:{xxhash.xxh64_hexdigest(ids.tobytes())}"
                place.append(xxhash.xxh64_intdigest(f"{name}:{seen[name]}") >> 1)
                seen[name] += 1
            yield pa.record_batch([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(body, pa.binary()), pa.array(rest, pa.binary()), pa.array(place, pa.int64())], names=["doc_id", "doc_tokens", "whole", "body", "rest", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, whole array<long>, body binary, rest binary, place long")


def counted(docs: list[np.ndarray], bodies: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of token lists and of the counts in ``bodies``, by document and term."""
    size = [len(d) for d in docs]
    keys, tf = np.unique(np.repeat(np.arange(len(docs)) << 16, size) | np.concatenate([*docs, np.zeros(0, np.uint16)]).astype(np.int64), return_counts=True)
    more = [(i, b) for i, b in enumerate(bodies or ()) if b]
    if more:
        terms = [i << 16 | np.frombuffer(b, "<u2", len(b) // 6).astype(np.int64) for i, b in more]
        both = np.concatenate([keys, *terms])
        n = np.concatenate([tf, *(np.frombuffer(b, "<u4", len(b) // 6, len(b) // 6 * 2) for _, b in more)])
        order = np.argsort(both, kind="stable")
        both, n = both[order], n[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        keys, tf = both[first], np.add.reduceat(n, first)
    return keys >> 16, keys & 65535, tf


def lengths(docs: list[np.ndarray], bodies: list[bytes] | None = None) -> np.ndarray:
    """Tokens of whole documents."""
    return np.array([len(d) + (int(np.frombuffer(b, "<u4", len(b) // 6, len(b) // 6 * 2).sum()) if b else 0) for d, b in zip(docs, bodies or [b""] * len(docs), strict=True)], np.int64)


class Statistics:
    """Documents, document frequencies and average length, of the whole corpus or of lists."""

    def __init__(self, n: int, df: np.ndarray, mean: float):
        self.df, self.mean = df, max(1.0, mean)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        return cls(len(docs), np.bincount(counted(docs)[1], minlength=65536), sum(map(len, docs)) / max(1, len(docs)))

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def statistics(rows: DataFrame) -> Statistics:
    """Statistics of all whole documents: a task counts its own, the sums by term (at most 65536) come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(65536, np.int64), 0, 0
        for b in slices(batches, "rest"):
            docs, bodies = [np.frombuffer(r, "<u2") for r in b.column("rest").to_pylist()], b.column("body").to_pylist()
            df += np.bincount(counted(docs, bodies)[1], minlength=65536)
            n, size = n + len(docs), size + int(lengths(docs, bodies).sum())
        terms = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[terms, -1, -2]), pa.array(np.r_[df[terms], n, size])], names=["term", "n"])

    found = {r.term: r.n for r in rows.select("rest", "body").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, size, df = found.pop(-1, 0), found.pop(-2, 0), np.zeros(65536, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, df, size / max(1, n))


def heaviest(docs: list[np.ndarray], stats: Statistics, bodies: list[bytes] | None = None) -> np.ndarray:
    """(n, PLACED) heaviest terms that other documents share; none: -1."""
    doc, term, tf = counted(docs, bodies)
    shared = stats.df[term] > 1
    doc, term, tf = doc[shared], term[shared], tf[shared]
    size = lengths(docs, bodies)
    out = np.full((len(docs), PLACED), -1, np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    if len(first):  # the largest of weight, then smallest term, again and again
        left = stats.weights(term, tf, size[doc]).astype(np.float32).view(np.int32).astype(np.int64) << 16 | (65535 - term)
        many = np.diff(np.r_[first, len(doc)])
        for i in range(PLACED):
            top = np.maximum.reduceat(left, first)
            out[doc[first], i] = np.where(top >= 0, 65535 - (top & 65535), -1)
            left[left == np.repeat(top, many)] = -1
    return out


class Index:
    """An inverted BM25 index over a shard's documents, weighted by the statistics given (else by their own)."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics | None = None, bodies: list[bytes] | None = None):
        self.n, stats = len(docs), stats or Statistics.of(docs)
        size = lengths(docs, bodies)
        doc, self.term, tf = counted(docs, bodies)
        df = np.bincount(self.term, minlength=65536)
        weight = stats.weights(self.term, tf, size[doc])
        by_term = np.argsort(self.term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.own = np.searchsorted(doc, np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the seed's terms."""
        terms = self.term[self.own[seed] : self.own[seed + 1]]
        n = self.start[terms + 1] - self.start[terms]
        upto = np.cumsum(n)
        at = np.repeat(self.start[terms] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)
        return np.bincount(self.docs[at], self.weights[at], self.n)

    def nearest(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The unused documents from the nearest on, ties to the first; they are sorted as far as asked for."""
        left = np.flatnonzero(unused)
        score = self.scores(seed)[left]
        while len(left):
            near = score >= np.partition(score, -FIRST)[-FIRST] if len(left) > 2 * FIRST else np.ones(len(left), bool)
            yield from left[near][np.argsort(-score[near], kind="stable")].tolist()
            left, score = left[~near], score[~near]


def fill(docs: list[np.ndarray], stats: Statistics | None = None, bodies: list[bytes] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) that hold each id once; all but the last have WINDOW ids."""
    index, unused = Index(docs, stats, bodies), np.array([len(d) > 0 for d in docs], bool)
    windows: list[list[tuple[int, int, int]]] = []
    seed, start, next_seed = -1, 0, 0
    while True:
        if seed < 0:
            while next_seed < len(docs) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return windows
            seed, start = next_seed, 0
            unused[seed] = False
        pieces, space = [(seed, start, len(docs[seed]) - start)], WINDOW - len(docs[seed]) + start
        windows.append(pieces)
        order = iter(())
        if space and unused.any():
            order = index.nearest(seed, unused)
        seed = -1
        while space and (d := next(order, None)) is not None:
            unused[d] = False
            n = min(space, len(docs[d]))
            pieces.append((d, 0, n))
            space -= n
            if n < len(docs[d]):
                seed, start = d, n


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two of their sum, largest first."""
    left, total, out = list(pieces), sum(p[2] for p in pieces), []
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
        now, space = [], size
        while space:
            d, start, n = left.pop(0)
            now.append((d, start, min(n, space)))
            if n > space:
                left.insert(0, (d, start + space, n - space))
            space -= now[-1][2]
        out.append(now)
    return out


def pack(docs: DataFrame, vocabulary: str, shard: int = SHARD) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most WINDOW ids.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur; other columns are left.
    """
    arrow_limits(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    rows = save(tokenized(docs, vocabulary), "tokens")
    stats = statistics(rows)
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    names = ["doc_id", "doc_tokens", "whole", "rest", "body"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "rest"):
            terms = heaviest([np.frombuffer(r, "<u2") for r in b.column("rest").to_pylist()], shared.value, b.column("body").to_pylist())
            yield pa.record_batch([*b.columns, *(pa.array(t) for t in terms.T)], names=[*b.schema.names, *(f"t{i}" for i in range(PLACED))])

    def packed(rows: list[tuple], first: int) -> list[tuple]:
        rows, out = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1])), []
        for doc_id, total, whole, *_ in rows:
            for k, value in enumerate(whole):
                out.append((doc_id, k * WINDOW, WINDOW, value, total, first, 0))
                first += 1
        ids = [np.frombuffer(r[3], "<u2") for r in rows]
        windows = fill(ids, shared.value, [r[4] for r in rows])
        if windows and sum(p[2] for p in windows[-1]) < WINDOW:
            windows[-1:] = powers(windows[-1])
        for pieces in windows:
            offset = 0
            for d, start, n in pieces:
                out.append((rows[d][0], len(rows[d][2]) * WINDOW + start, n, crc(ids[d][start : start + n]), rows[d][1], first, offset))
                offset += n
            first += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, last = [], TaskContext.get().partitionId() << 32, False
        while not last:
            b = next(batches, None)
            last = b is None
            if b is not None:
                held += zip(*(b.column(c).to_pylist() for c in names), strict=True)
            while len(held) >= 2 * shard or last and held:
                n = shard if len(held) >= 2 * shard else len(held)
                out, held = packed(held[:n], first), held[n:]
                first = max(r[5] for r in out) + 1
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    shards = max(1, -(-rows.count() // shard))
    order = [*(f"t{i}" for i in range(PLACED)), "place"]
    placed = rows.mapInArrow(place, f"doc_id {kind}, doc_tokens long, whole array<long>, body binary, rest binary, place long, " + ", ".join(f"t{i} long" for i in range(PLACED)))
    return placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_bm25_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents by the 49k word vocabulary."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
