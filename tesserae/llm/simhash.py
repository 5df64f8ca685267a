"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits, each seen as a word of the perfect (23, 12) Golay code.
``keys`` of a segment: the indices of the codewords nearest to the segment and to its neighbours at one bit (1 or about
6 of 4096). Two segments at up to two differing bits share a key; at up to one, the nearest codeword of either is a key
of the other. Fingerprints at up to four differing bits therefore meet in one of two kinds of key:

- no segment differs in over two bits: all three segments share a key each (36 bits), or
- one segment differs in three or four bits: of the others, one is equal and the other differs in at most one bit, so
  its nearest codeword is a key of the other fingerprint's (23 + 12 bits).

Rows that meet are verified on the whole fingerprint. Equal fingerprints are one class beforehand, and of the links
that a task verifies only a spanning forest leaves it, so a group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_limits, components, raw, save, slices

SHINGLE, SEED, BITS = 4, 42, 4
#: First bit and bits of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code (fixed value), x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Rows of a key compared with each other at once.
BLOCK = 2048


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


def _errors() -> np.ndarray:
    """Error pattern of at most three bits by syndrome: the code is perfect, each of the 2048 syndromes has one."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | one).ravel())
    patterns = np.concatenate([[0], one, two, three[np.bitwise_count(three) == 3]])
    table = np.full(2048, -1)
    table[syndrome(patterns)] = patterns
    assert len(patterns) == 2048 and (table >= 0).all()
    return table


ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[syndrome(words)]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits + 1): the nearest codeword's index, then those of the words at one bit; repeats in a row are -1."""
    near = np.stack([decode(words), *(decode(words ^ (1 << b)) for b in range(bits))], 1)
    order = np.sort(near[:, 1:], axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == near[:, :1]] = -1
    return np.concatenate([near[:, :1], order], 1)


def _compact(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys without the -1 in rows: values and start of each row."""
    valid = keys >= 0
    return keys[valid], np.concatenate([[0], np.cumsum(valid.sum(1))])


def fingerprint_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of fingerprints: side 0 meets itself, 1 meets 2 of the same key. The key's top bits name its kind."""
    seg = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys = [segment_keys(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    rows, out, side = [], [], []
    flat = [_compact(k) for k in keys]
    count = [np.diff(start) for _, start in flat]
    many = count[0] * count[1] * count[2]
    row = np.repeat(np.arange(len(fp)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    c2, c12 = count[2][row], (count[1] * count[2])[row]
    rows.append(row)
    out.append(flat[0][0][flat[0][1][row] + at // c12] << 24 | flat[1][0][flat[1][1][row] + at % c12 // c2] << 12 | flat[2][0][flat[2][1][row] + at % c2])
    side.append(np.zeros(len(row), np.int8))
    for kind, (equal, near) in enumerate(((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)), 1):
        top = np.int64(kind) << 40 | seg[equal] << 12
        rows.append(np.arange(len(fp)))
        out.append(top | keys[near][:, 0])
        side.append(np.ones(len(fp), np.int8))
        value, start = flat[near]
        row = np.repeat(np.arange(len(fp)), np.diff(start))
        rows.append(row)
        out.append(top[row] | value)
        side.append(np.full(len(row), 2, np.int8))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(side)


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((i, j))

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (nxt := self.up[r]).tolist() != r.tolist():
            r = nxt
        return r


def _linked(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]) <= BITS


def link(fp: np.ndarray, row: np.ndarray, key: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the verified links between positions of ``fp`` whose rows share a key."""
    forest = Forest(len(fp))
    order = np.lexsort((fp[row], key))
    row, key, side = row[order], key[order], side[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    start, size = start[size > 1], size[size > 1]
    for n in np.unique(size[size <= 64]).tolist():  # small groups, all of one size at once
        i, j = np.triu_indices(n, 1)
        group = start[size == n]
        for s in range(0, len(group), max(1, 1_000_000 // len(i))):
            at = group[s : s + max(1, 1_000_000 // len(i))]
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = ((side[x] == 0) | (side[x] != side[y])) & (row[x] != row[y])
            x, y = row[x[ok]], row[y[ok]]
            ok = _linked(fp, x, y)
            forest.add(x[ok], y[ok])
    for s, n in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        _large(fp, np.unique(row[s : s + n]), forest)
    return forest.links


def _large(fp: np.ndarray, at: np.ndarray, forest: Forest) -> None:
    """Links within one key's many fingerprints. Neighbours in sorted orders join most; then only members of different trees are compared, in blocks."""
    for turn in (0, 13, 29, 47):
        turned = fp[at] << np.uint64(turn) | fp[at] >> np.uint64((64 - turn) % 64) if turn else fp[at]
        by = at[np.argsort(turned, kind="stable")]
        ok = _linked(fp, by[:-1], by[1:])
        forest.add(by[:-1][ok], by[1:][ok])
    tree, size = np.unique(forest.roots(at), return_inverse=True, return_counts=True)[1:]
    at = at[np.lexsort((at, tree, -size[tree]))]  # the largest tree first: only the others are compared with it
    for j in range(0, len(at), BLOCK):
        for i in range(0, j + 1, BLOCK):
            a, b = at[i : i + BLOCK], at[j : j + BLOCK]
            ra, rb = forest.roots(a), forest.roots(b)
            if (ra[0] == ra).all() and (rb == ra[0]).all():
                continue
            rare = rb != np.bincount(ra).argmax()
            for b, r in ((b[rare], rb[rare]), (b[~rare], rb[~rare])):
                if not len(b):
                    continue
                other = ra != r[0] if (r == r[0]).all() else np.ones(len(a), bool)
                near = np.bitwise_count(fp[a[other]][:, None] ^ fp[b]) <= BITS
                near &= ra[other][:, None] != r
                x, y = np.nonzero(near)
                forest.add(a[other][x], b[y])


def fingerprint(text: bytes) -> int:
    """SimHash of a text's shingles, repeats included: a bit is 1 if set in over half of their XXH64; none: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -SHINGLE]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 65536):
        block = np.array(hashes[i : i + 65536], "<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, digest: XXH64 of the text, fp long: the fingerprint's 64 bits) of each row; a null text is empty."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t) for t in raw(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("key"), b.column("digest"), pa.array(fp)], names=["key", "digest", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"key {kind}, digest long, fp long").withColumnRenamed("key", key)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is connected among distinct fingerprints ``fp``: every pair that shares a key is verified."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                fp = b.column("fp")[i : i + 1000].to_numpy()
                row, key, side = fingerprint_keys(fp.view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(fp[row]), pa.array(side)], names=["key", "fp", "side"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(), b.column("fp").to_numpy(), b.column("side").to_numpy()) for b in batches]
        if got:
            key, fp, side = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            own, row = np.unique(fp, return_inverse=True)
            found = np.array(link(own.view(np.uint64), row, key, side), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(own[found[:, 0]]), pa.array(own[found[:, 1]])], names=["a", "b"])

    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // 5000))
    # a fingerprint becomes some 180 keys, so few bytes need many tasks; by fp itself the exchange would fall away as redundant
    dealt = fps.repartition(n, F.xxhash64("fp"))
    return dealt.mapInArrow(spread, "key long, fp long, side byte").repartition(n, "key").mapInArrow(meet, "a long, b long")


def _classes(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with fingerprints, (fp, least: smallest key with it, root: the least linked fingerprint))."""
    rows = save(fingerprints(docs, key), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(key).alias("least"))
    root = components(save(links(classes.select("fp")), "links"), "a", "b")
    named = classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, save(named, "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp long, component_id): the smallest key that links of at most BITS differing bits reach, itself included.

    Repeated rows and equal texts share a fingerprint and so a component; null keys count only where a component has no
    other. An empty table gives no row.
    """
    rows, named = _classes(docs, key)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """One row of each component: that of the smallest key (null last), of the smallest text digest among equals.

    With a ``similarity``, components are linked by that Jaccard similarity of five-word shingles: ``links`` of fingerprints are
    the first candidates, MinHash keys find those beyond BITS.
    Columns may have any names and types.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_key", F.col(f"c{names.index(key)}")).withColumn("text", F.col(f"c{names.index('text')}"))
    keyed = plain.select("_key", "text")
    rows, named = _classes(keyed, "_key") if similarity is None else shingles.classes(keyed, "_key", similarity, fingerprint, links)
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), "digest")).alias("w"))
    won = least.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("w").alias("w"))
    won = won.select(F.col("w.key").alias("_won"), F.col("w.digest").alias("_digest"))
    found = plain.withColumn("_own", F.xxhash64("text"))
    found = found.join(won, F.col("_key").eqNullSafe(F.col("_won")) & (F.col("_own") == F.col("_digest")), "left_semi")
    # rows of one key and text: the least as JSON, which orders columns of any type
    once = Window.partitionBy("_key", "_own").orderBy(F.to_json(F.struct(*(f"c{i}" for i in range(len(names))))))
    return found.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by whole texts."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
