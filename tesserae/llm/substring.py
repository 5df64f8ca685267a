"""Substring dedup by seed and extend: documents are joined on winnowed anchors, whose matches are extended both ways.

Anchors are the K-word sequences that winnowing selects: the least hash of each LENGTH - K + 1 neighbouring ones. Every
window of LENGTH words therefore owns one anchor (its own least one), which is selected wherever the window occurs. So:

1. seed: anchors are counted over all documents; those that occur once are dropped;
2. extend: the occurrences of a repeated anchor meet, each with the words beside it; every pair is extended word by word
   to the left and to the right (as far as a window that holds the anchor reaches), and matches of LENGTH words or more
   stay. All matches of an occurrence hold its anchor, so together they are one span;
3. the spans of all anchors of a document are merged into its maximal repeats, and these are cut.

An anchor of more than PAIRS occurrences is not compared pair by pair: its occurrences are extended to every window that
owns it, and equal windows meet, each in a task of its own; what occurs again stays. That is the same result.

Documents are dealt once into blocks by a hash. A frequent window is one row a block, so an anchor of a third of all rows
is spread over its windows and has at most one row a block in each. Words beside an anchor are compared by 32 bits of
their hash, whole windows by 64 bits beside the anchor's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, parts, raw, slices, split_by

LENGTH, K = 35, 8
#: Occurrences of an anchor up to which all its pairs are extended.
PAIRS = 64
#: Kinds of rows that meet: an occurrence of a rare anchor, a window of a frequent one, places known to be repeated; and how many of these a row has.
RARE, FREQUENT, KNOWN, PLACES = 0, 1, 2, 1024
#: Odd multipliers of the rolling hashes (fixed values).
BASE_K, BASE_W = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Distinct words whose hash a worker remembers.
CACHE = 300_000


class Hashes(dict):
    """XXH64 by word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that the least hash is no matter of the last word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolled(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash (mod 2**64, scrambled) of each n consecutive entries, by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, size, left, power, have = None, 1, words, np.array([base]), 0
    while True:
        if n & size:
            if out is None:
                out, have = left, size
            else:  # out covers the words before, left the next `size`
                m = len(words) - have - size + 1
                out, have = out[:m] * power + left[have : have + m], have + size
        if have == n:
            return _mix(out[: len(words) - n + 1])
        left = left[: len(left) - size] * power + left[size:]
        size, power = size * 2, power * power


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Position of the least of each n consecutive entries, the leftmost of equals."""
    size, at = 1, np.arange(len(x))
    while size * 2 <= n:
        a, b = at[:-size], at[size:]
        at, size = np.where(x[b] < x[a], b, a), size * 2
    if size < n:
        a, b = at[: len(x) - n + 1], at[n - size : len(x) - size + 1]
        at = np.where(x[b] < x[a], b, a)
    return at


class Text:
    """Hashes of one text's words, and where its anchors stand: ``owner`` of each window, ``at`` without repeats."""

    def __init__(self, text: bytes, known: Hashes, length: int, k: int):
        words = text.split()
        self.at = np.zeros(0, np.int64)
        if len(words) >= length:
            self.words = _mix(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) | np.uint64(1))
            self.grams = rolled(self.words, k, BASE_K).view(np.int64)
            self.owner = least(self.grams.view(np.uint64), length - k + 1)
            self.at = self.owner[np.r_[True, self.owner[1:] != self.owner[:-1]]]


def ordered(texts: list[bytes]) -> np.ndarray:
    """An order of a block's texts that hangs on the texts alone: a place in it names a text in every stage."""
    return np.argsort(np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts)), kind="stable")


def prepared(docs: DataFrame, key: str, blocks: int) -> DataFrame:
    """All columns and the block, dealt once: later uses in the same job reuse the exchange."""
    return docs.withColumn("_block", split_by(F.col("text"), F.col(key), blocks)).repartition(blocks, "_block")


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Hashes = Hashes()
        seen: dict[int, dict[int, int]] = {}
        for b in slices(batches, "text"):
            if len(known) > CACHE:
                known.clear()
            for block, text in zip(b.column("_block").to_pylist(), raw(b.column("text")), strict=True):
                t = Text(text, known, length, k)
                if len(t.at):
                    own = seen.setdefault(block, {})
                    for a in t.grams[t.at].tolist():
                        own[a] = own.get(a, 0) + 1
        for block, own in seen.items():
            items = np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own))
            for i in range(0, len(own), 50_000):
                a = items[0][i : i + 50_000]
                yield pa.record_batch([pa.array(np.full(len(a), block, np.int32)), pa.array(a), pa.array(items[1][i : i + 50_000])], names=["_block", "anchor", "n"])

    return run


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def _occurrences(length: int, k: int, pairs: int):
    """Per block: its repeated anchors in; out for a rare one each occurrence with the words beside it (hashes, zero beyond
    the text), for a frequent one its windows. ``at`` is the text's place in the block and the word where it starts. What
    occurs again within the block is known without the others, which are told of it: its places go on in rows of PLACES."""
    reach, wide = length - k, 2 * length - k

    def run(key: tuple, docs: pa.Table, repeated: pa.Table) -> pa.Table:
        known, near, far = Hashes(), [], []
        wanted, total = repeated.column("anchor").to_numpy(), repeated.column("total").to_numpy()
        by = np.argsort(wanted)
        wanted, rare = wanted[by], total[by] <= pairs
        texts = raw(docs.column("text").combine_chunks())
        for place, i in enumerate(ordered(texts).tolist() if len(wanted) else ()):
            t = Text(texts[i], known, length, k)
            if not len(t.at):
                continue
            a = t.grams[t.at]
            found = np.minimum(np.searchsorted(wanted, a), len(wanted) - 1)
            again = wanted[found] == a
            at = t.at[again & rare[found]]
            if len(at):
                words = np.zeros(len(t.words) + 2 * reach, np.uint32)
                words[reach : reach + len(t.words)] = t.words.astype(np.uint32) | np.uint32(1)
                near.append((t.grams[at], place << 32 | at, words[at[:, None] + np.arange(wide)]))
            if (again & ~rare[found]).any():
                frequent = np.zeros(len(t.grams), bool)
                frequent[t.at[again & ~rare[found]]] = True
                start = np.flatnonzero(frequent[t.owner])
                far.append(np.stack([t.grams[t.owner[start]], rolled(t.words, length, BASE_W)[start].view(np.int64), place << 32 | start]))
        anchor, at = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in near)]) for c in (0, 1))
        words = np.concatenate([np.zeros((0, wide), np.uint32), *(x[2] for x in near)])
        rows = np.concatenate([np.zeros((3, 0), np.int64), *far], 1)
        rows = rows[:, np.lexsort(rows[::-1])]
        first = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)][: rows.shape[1]])
        count = np.diff(np.r_[first, rows.shape[1]])
        once = count == 1
        known_at = rows[2, np.repeat(~once, count)]
        o = np.argsort(~once, kind="stable")  # windows found once, with their place, then those found again, without
        first, count = first[o], np.minimum(count[o], 2)
        n, m, p, single = len(anchor), len(first), -(-len(known_at) // PLACES), int(once.sum())
        ends = np.r_[np.arange(n + 1) * 4 * wide, np.full(m + p, 4 * n * wide)].astype(np.int32)
        lists = np.r_[np.arange(n + single), np.full(m - single, n + single), n + single + np.arange(p) * PLACES]
        block = key[0].as_py()
        beside = pa.Array.from_buffers(pa.binary(), n + m + p, [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())])
        cols = [
            pa.array(np.full(n + m + p, block, np.int32)),
            pa.array(np.repeat([RARE, FREQUENT, KNOWN], [n, m, p]).astype(np.int8)),
            pa.array(np.r_[anchor, rows[0, first], np.full(p, block)]),
            pa.array(np.r_[np.zeros(n, np.int64), rows[1, first], np.arange(p)]),
            pa.array(np.r_[np.ones(n, np.int64), count, np.ones(p, np.int64)].astype(np.int8)),
            _lists(np.r_[at, rows[2, first[:single]], known_at], lists),
            beside,
        ]
        return pa.table(cols, names=["_block", "kind", "anchor", "window", "n", "at", "beside"])

    return run


def extended(words: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched, left, right) of each row of ``words``: how far its longest matches of at least ``length`` with other rows of its group go."""
    reach, m = length - k, len(words)
    matched, left, right = np.zeros(m, bool), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for n in np.unique(size[size > 1]).tolist():
        group = start[size == n]
        step = max(1, 1_000_000 // (n * n))
        for s in range(0, len(group), step):
            rows = group[s : s + step, None] + np.arange(n)
            c = words[rows]

            def same(d: int, c=c) -> np.ndarray:
                return (c[:, :, None, d] == c[:, None, :, d]) & (c[:, :, None, d] != 0)

            seed = ~np.eye(n, dtype=bool) & np.logical_and.reduce([same(d) for d in range(reach, reach + k)])
            spans = []
            for steps in (range(reach - 1, -1, -1), range(reach + k, 2 * reach + k)):
                alive, far = seed.copy(), np.zeros(seed.shape, np.int8)
                for d in steps:
                    alive &= same(d)
                    if not alive.any():
                        break
                    far += alive
                spans.append(far)
            ok = seed & (spans[0] + spans[1] + k >= length)
            matched[rows] = ok.any(2)
            left[rows], right[rows] = (np.where(ok, far, 0).max(2) for far in spans)
    return matched, left, right


def _meet(length: int, k: int):
    """Rows sorted by anchor and window: (block, at, length of the match) of what occurs again."""
    wide = 2 * length - k

    def found(t: pa.Table, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Matches within a table of whole groups; ``whole`` tells rows whose window is known to occur elsewhere."""
        kind, n = t.column("kind").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        key = np.stack([kind.astype(np.int64), t.column("anchor").to_numpy(), t.column("window").to_numpy()])
        first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        size = np.diff(np.r_[first, len(kind)])
        at, block = t.column("at").combine_chunks(), t.column("_block").to_numpy()
        places = pc.list_value_length(at).to_numpy()
        again = (kind == FREQUENT) & ((np.repeat(np.add.reduceat(n, first), size) > 1) | whole) & (places > 0) | (kind == KNOWN)
        if again.any():
            yield pa.record_batch([pa.array(block[again]), at.filter(pa.array(again)), pa.array(np.full(again.sum(), length, np.int32))], names=["_block", "at", "length"])
        near = np.flatnonzero(kind == RARE)
        if len(near):
            rare = kind[first] == RARE
            words = np.frombuffer(b"".join(t.column("beside").take(near).to_pylist()), np.uint32).reshape(-1, wide)
            matched, left, right = extended(words, np.searchsorted(near, first[rare]), size[rare], length, k)
            if matched.any():
                start = at.flatten().to_numpy()[np.cumsum(places)[near] - 1] - left
                yield pa.record_batch([pa.array(block[near][matched]), _lists(start[matched], np.arange(matched.sum())), pa.array((left + right + k)[matched].astype(np.int32))], names=["_block", "at", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, open_ = 0, None  # open_: a frequent window that occurs again and whose rows may go on
        for b in _then(batches):
            if b is not None:
                held.append(b)
                rows += b.num_rows
            if not rows or (b is not None and rows < 20_000):
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = [t.column(c).to_numpy() for c in ("kind", "anchor", "window")]
            last = np.logical_and.reduce([x == x[-1] for x in key])
            cut = rows if b is None else int(last.argmax())
            name = tuple(x[-1] for x in key)
            if cut == 0 and name[0] == FREQUENT:  # one frequent window fills the table: what is there goes on
                if name == open_ or pc.sum(t.column("n")).as_py() > 1:
                    open_ = name
                    yield from found(t, np.ones(rows, bool))
                    held, rows = [], 0
                continue
            part = t.slice(0, cut)
            whole = np.zeros(cut, bool)
            if open_ is not None:
                whole = np.logical_and.reduce([x[:cut] == v for x, v in zip(key, open_, strict=True)])
            yield from found(part, whole)
            held, rows = t.slice(cut).to_batches(), rows - cut

    return run


def _then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _cut(names: list[str], schema: pa.Schema):
    """Per block: its matches in, its rows with the kept text out."""

    def run(key: tuple, docs: pa.Table, matches: pa.Table) -> pa.Table:
        at = matches.column("at").combine_chunks()
        length = np.repeat(matches.column("length").to_numpy(), pc.list_value_length(at).to_numpy().astype(np.int64))
        at = at.flatten().to_numpy()
        by = np.argsort(at, kind="stable")
        at, length = at[by], length[by]
        texts = raw(docs.column("text").combine_chunks())
        place = np.empty(len(texts), np.int64)
        place[ordered(texts) if len(at) else np.arange(len(texts))] = np.arange(len(texts))
        low, high = np.searchsorted(at, place << 32), np.searchsorted(at, place + 1 << 32)
        rows = []
        for text, a, b in zip(texts, low.tolist(), high.tolist(), strict=True):
            words, spans, gone = text.split(), [], 0
            kept = words
            if a < b:
                edge = np.zeros(len(words) + 1, np.int64)
                start = at[a:b] & 0xFFFFFFFF
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length[a:b], -1)
                drop = np.cumsum(edge)[:-1] > 0
                step = np.diff(np.r_[0, drop.astype(np.int8), 0])
                spans = [{"start": int(x), "length": int(y - x)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                gone, kept = int(drop.sum()), [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            joined = b" ".join(kept)
            rows.append((len(words), gone, (joined if gone else text).decode("utf-8", "replace"), hashlib.sha256(joined).hexdigest(), spans))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([*(docs.column(c) for c in names), *(pa.array(c, schema.field(n).type) for c, n in zip(cols, schema.names[len(names) :], strict=True))], names=schema.names)

    return run


def dedup_substrings(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, k: int = K, keep: tuple[str, ...] = (), pairs: int = PAIRS) -> DataFrame:
    """(key, the columns ``keep``, n_words, n_removed, kept_text, kept_sha256, repeats: spans (start, length) in words).

    A word goes if a window of ``length`` words over it also starts elsewhere, in the same document or another; kept
    words are joined by one space for the digest, and in the text if any word goes (else it stays as it was). A null text
    has no words. Repeated rows repeat each other's windows. Texts under ``length`` words stay whole. Columns to keep may
    have any name but those of the result, ``text`` and ``_block``.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    names = [key, *keep]
    blocks = parts(docs)
    rows = prepared(docs.select(*dict.fromkeys(names), F.coalesce("text", F.lit("")).alias("text")), key, blocks)
    anchors = rows.mapInArrow(_anchors(length, k), "_block int, anchor long, n long")
    repeated = anchors.withColumn("total", F.sum("n").over(Window.partitionBy("anchor"))).where("total > 1").select("_block", "anchor", "total")
    met = rows.groupBy("_block").cogroup(repeated.groupBy("_block")).applyInArrow(_occurrences(length, k, pairs), "_block int, kind byte, anchor long, window long, n byte, at array<long>, beside binary")
    met = met.repartition(blocks, "anchor", "window").sortWithinPartitions("kind", "anchor", "window")
    matches = met.mapInArrow(_meet(length, k), "_block int, at array<long>, length int")
    added = "n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<struct<start: long, length: long>>"
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    schema = pa.schema([*((c, pa.null()) for c in names), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("repeats", span)])
    return rows.groupBy("_block").cogroup(matches.groupBy("_block")).applyInArrow(_cut(names, schema), f"{kinds}, {added}")


def op10_seed_extend(spark, sf_dir: str) -> DataFrame:
    """Passages of LENGTH words that occur again anywhere, cut from all documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
 windows AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER w) AS h, COUNT(*) OVER w AS n FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
 again AS (SELECT doc_id, i, CASE WHEN n = 35 AND COUNT(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS dup FROM windows),
 covered AS (SELECT doc_id, i, MAX(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM again),
 kept AS (
  SELECT w.doc_id, COUNT(*) AS n_words, SUM(gone) AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE gone = 0), '') AS rest
  FROM words w JOIN covered c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY 1)
SELECT d.doc_id, CAST(COALESCE(n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
