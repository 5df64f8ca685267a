"""Near-duplicates by Jaccard similarity of five-word shingles: Golay keys of SimHash fingerprints and MinHash bands find candidates, which are verified exactly.

Classes whose fingerprints Golay keys link, or that share a fingerprint, are candidates first. Pairs at a similarity of 0.8 share one of the BANDS keys (ROWS least hashes each) with probability 1 - (1 - 0.8**5)**28,
over 0.9999; Golay keys reach four of 64 bits, and such pairs differ in about 10. Texts of equal shingles are one class
beforehand. Of a key's many classes, neighbours in a hashed order are verified first; then all pairs of a key that are not
yet in one component, so a group of near copies never becomes all its pairs and no candidate is left out. The order is the
same in all keys: classes that share several are mostly neighbours in each, and their pair is made once, not a pair a key.

A passage that many documents share gives them keys in common though they are unlike. Among the classes of crowded keys,
two that are alike therefore either share a rare shingle (of at most RARE of these classes) among the rarest of both, and
are found by it; or they share frequent shingles only, of which both must then have enough. Classes of the second kind
first meet the one of their key with the fewest others, which links most of them, then each other where still apart. No
other pair is made, and none that would be verified is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, components, raw, save, slices, stars

SHINGLE, BANDS, ROWS = 5, 28, 5
#: Classes of a key above which it is crowded; classes of a shingle up to which it is rare.
CROWD, RARE = 16, 64
#: Shingles hashed at once.
AT_ONCE = 1024
#: Fixed masks and odd multipliers of the hashes whose least values are taken.
MASKS, ODD = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
ODD |= np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of a text's SHINGLE-word sequences, lower-cased; of fewer words: of all; of none: empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(n, BANDS) keys of sets that are not empty."""
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for x, low in zip(sets, least, strict=True):
        for i in range(0, len(x), AT_ONCE):
            np.minimum(low, ((x[i : i + AT_ONCE] ^ MASKS) * ODD).min(1), out=low)
    least, out = least.reshape(-1, BANDS, ROWS), np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), 1))
    for i in range(ROWS):
        out = (out ^ least[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _named(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes())


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32), pa.array(flat))


def sketches(docs: DataFrame, key: str, fingerprint: Callable[[bytes], int]) -> DataFrame:
    """(key, digest: XXH64 of the text, fp: XXH64 of its shingles, n: their number, bands, sim: ``fingerprint``) of each row; a null text is empty."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = raw(b.column("text"))
            sets = [shingles(t) for t in texts]
            sim = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            full = [x for x in sets if len(x)]
            keys = iter(bands(full))
            yield pa.record_batch([b.column("key"), b.column("digest"), pa.array(np.array([_named(x) for x in sets], np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), _lists([next(keys) if len(x) else x for x in sets]), pa.array(sim)], names=["key", "digest", "fp", "n", "bands", "sim"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"key {kind}, digest long, fp long, n long, bands array<long>, sim long").withColumnRenamed("key", key)


def _sets(docs: DataFrame, key: str, rows: DataFrame, met: DataFrame) -> DataFrame:
    """(fp, n, set) of the classes in ``met``, by one of the texts of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t) for t in raw(b.column("text"))]
            yield pa.record_batch([pa.array(np.array([_named(x) for x in sets], np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["fp", "n", "set"])

    one = rows.groupBy("fp").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "digest")).alias("w")).join(met.select("fp").distinct(), "fp", "left_semi")
    one = one.select(F.col("w.key").alias("_key"), F.col("w.digest").alias("_digest"))
    own = docs.select(key, "text", F.xxhash64("text").alias("_own"))
    texts = own.join(one, own[key].eqNullSafe(one["_key"]) & (own["_own"] == one["_digest"]), "left_semi").select("text")
    return texts.mapInArrow(run, "fp long, n long, set array<long>").dropDuplicates(["fp"])


def _chained(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that follow each other, in one order for all keys, among those of a key; a crowded key is dealt to many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            band, fp = (b.column(c).to_numpy() for c in ("band", "fp"))
            if last is not None:
                band, fp = np.r_[last[0], band], np.r_[last[1], fp]
            if len(band):
                last = band[-1], fp[-1]
                same = band[1:] == band[:-1]
                x, y = fp[:-1][same], fp[1:][same]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = met.select("band", "fp", F.xxhash64("fp").alias("place")).repartitionByRange(n, "band", "place")
    return placed.sortWithinPartitions("band", "place").select("band", "fp").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingles have a Jaccard similarity of at least ``similarity``."""
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    # the quotient is the double nearest to the fraction, as the bound is
    return pairs.join(a, "a").join(b, "b").where(both / (F.col("n_a") + F.col("n_b") - both) >= similarity).select("a", "b")


class Crowds:
    """Unlinked classes (band, fp, n, root) of a key, and counts of the shingles of those whose key is crowded."""

    def __init__(self, placed: DataFrame, sets: DataFrame, similarity: float):
        self.similarity = similarity
        crowds = placed.groupBy("band").agg((F.count("*") > CROWD).alias("crowd"))
        self.rows = save(placed.join(crowds, "band"), "crowds")
        crowd = self.rows.where("crowd")
        grams = crowd.select("fp").distinct().join(sets, "fp").select("fp", "n", F.explode("set").alias("shingle"))
        shared = grams.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")
        own = Window.partitionBy("fp")
        ranked = grams.join(shared, "shingle").withColumn("m", F.count("*").over(own)).withColumn("frequent", F.count_if(F.col("classes") > RARE).over(own)).withColumn("rank", F.row_number().over(own.orderBy("classes", "shingle")))
        # of n shingles, n - m are in no other class; like classes share one of the n - ceil(similarity * n) + 1 rarest of either
        first = ranked.where(F.col("rank") <= F.col("m") + 1 - F.ceil(F.col("n") * similarity - 1e-9))
        self.first = save(first.select("fp", "n", "shingle", "classes", "frequent"), "rarest")
        full = self.first.select("fp", "frequent").distinct().where(F.col("frequent") / F.col("n") >= similarity)
        self.full = save(crowd.select("band", "fp", "n").join(full, "fp"), "full")

    def centres(self) -> DataFrame:
        """Pairs of each class that can be like another by frequent shingles alone and, of a key, the one with the fewest others."""
        best = self.full.groupBy("band").agg(F.min(F.struct((F.col("n") - F.col("frequent")).alias("others"), (-F.col("n")).alias("size"), F.col("fp"))).alias("best"))
        # a crowded key is dealt to CROWD parts; its centre, one of more than CROWD classes, goes to each
        parts = best.select("band", F.col("best.fp").alias("centre"), F.explode(F.sequence(F.lit(0), F.lit(CROWD - 1))).alias("part"))
        placed = self.full.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(CROWD)).cast("int"))
        pairs = placed.join(parts, ["band", "part"]).where("fp <> centre")
        return pairs.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()

    def candidates(self, root: DataFrame) -> DataFrame:
        """Pairs (a, b) that can be alike, of different roots (node, root): all but those that counts rule out."""
        alike = f"least(x.n, y.n) / greatest(x.n, y.n) >= {self.similarity}D"

        def paired(rows: DataFrame, on: str) -> DataFrame:
            named = rows.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            x, y = named.alias("x"), named.alias("y")
            return x.join(y, F.expr(f"{on} and x.root < y.root")).select(F.expr("least(x.fp, y.fp)").alias("a"), F.expr("greatest(x.fp, y.fp)").alias("b"))

        sparse = paired(self.rows.where("not crowd").drop("root"), f"x.band = y.band and {alike}")
        rare = paired(self.first.where(F.col("classes") <= RARE), f"x.shingle = y.shingle and {alike}")
        both = "least(x.frequent, y.frequent)"
        dense = paired(self.full, f"x.band = y.band and {both} / (x.n + y.n - {both}) >= {self.similarity}D")
        return sparse.unionByName(rare).unionByName(dense).distinct()


def near(rows: DataFrame, links: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Pairs (a, b) of classes by their fingerprints (rows: fp, n, sim): those of ``links`` between fingerprints, by one class of each, and classes that follow each other in one fingerprint."""
    named = save(rows.where("n > 0").select("sim", "fp", "n").distinct(), "named")
    one = named.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("c"))
    a, b = (one.select(F.col("sim").alias(s), F.col("c").alias(f"c_{s}")) for s in "ab")
    linked = links(one.select(F.col("sim").alias("fp"))).join(a, "a").join(b, "b").select("c_a", "c_b")
    linked = linked.where(F.least("c_a.n", "c_b.n") / F.greatest("c_a.n", "c_b.n") >= similarity)
    linked = linked.select(F.least("c_a.fp", "c_b.fp").alias("a"), F.greatest("c_a.fp", "c_b.fp").alias("b")).where("a < b")
    return linked.unionByName(_chained(named.select(F.col("sim").alias("band"), "fp"))).distinct()


def classes(docs: DataFrame, key: str, similarity: float, fingerprint: Callable[[bytes], int], links_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with digest and fp, (fp, root: the least fp that links of at least ``similarity`` reach)).

    ``links_of``: the links between fingerprints, which are the first candidates.
    """
    rows = save(sketches(docs, key, fingerprint), "sketches")
    close = save(near(rows, links_of, similarity), "near")
    keys = rows.select("fp", "n", "bands").dropDuplicates(["fp"]).select("fp", "n", F.explode("bands").alias("band"))
    met = save(keys.join(keys.groupBy("band").count().where("count > 1").select("band"), "band", "left_semi").select("band", "fp", "n"), "met")
    wanted = met.select("fp").unionByName(close.select(F.explode(F.array("a", "b")).alias("fp")))
    sets = save(_sets(docs, key, rows, wanted), "sets")
    tested = save(_chained(met).unionByName(close).distinct(), "pairs")
    root = components(stars(save(_verified(tested, sets, similarity), "links")), "a", "b")
    held = root.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")  # links so far, one a class
    placed = save(met.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("band", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
    split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    crowds = Crowds(save(placed.join(split, "band", "left_semi"), "open"), sets, similarity)
    if not crowds.full.isEmpty():
        centred = save(crowds.centres().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(centred)
        root = components(stars(save(held.unionByName(_verified(centred, sets, similarity)), "links")), "a", "b")
        held = root.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    rest = crowds.candidates(root).join(tested, ["a", "b"], "left_anti")
    root = components(stars(save(held.unionByName(_verified(rest, sets, similarity)), "links")), "a", "b")
    named = rows.select("fp").distinct().join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows.select(key, "digest", "fp"), save(named, "classes")
