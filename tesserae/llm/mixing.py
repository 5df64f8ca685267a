"""Mixing sources to target weights by a low-discrepancy schedule.

Sources get targets by weight, capped at twice their size (water-filling). Slot i of the schedule goes to the source
whose stretch of cumulative target shares holds the golden-ratio point frac((i + 1/2) * phi): every stretch of slots
holds each source close to its share. A source's documents, shuffled by a hash, form a stream (up to twice), which is
cut into as many equal-token blocks as the source has slots; the slot of rank r in its source takes block r. A mixed
table is written in the order of its slots, so any stretch of it holds the sources close to their shares.

Positions in the streams are two-level prefix sums over (source, hash bucket), so a source of a third of all rows is
many buckets; the hash is of id and text, so an id (or null) of many rows is many buckets too. Slots are dealt and
ranked in chunks. Up to SOURCES sources are a list on the driver; more are a table: their targets by aggregations,
their order and edges by prefix sums over ranges, their slots by a join of points and stretches on cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, arrow_limits, parts, raw, save, slices

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: Words of a slot, rows of a bucket, slots of a chunk, sources held as a list, parts of a source where it meets their table.
SLOT, BUCKET, CHUNK, SOURCES, SALT = 4096, 1024, 1 << 16, 100_000, 32
PHI = (5**0.5 - 1) / 2


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of ``share`` times all sizes by the repeating weights; none above ``cap`` times its size, the excess reshared by weight."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def sized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All columns, _size: the words of the whole text, 0 for null, and _md5: the place of id and text in a stream."""
    mark = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.md5("text"), F.lit("null")))
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_md5", F.md5(mark))


def _meet(rows: DataFrame, few: DataFrame, on: Column, listed: bool, by: str) -> DataFrame:
    """``rows`` joined with the rows of sources ``few``: sent to all tasks if ``listed`` (at most SOURCES rows), else by (source, part of ``by``)."""
    if listed:
        return rows.join(F.broadcast(few), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    spread = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(spread, on & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")


def streams(docs: DataFrame, plan: DataFrame, rows: int, listed: bool = True) -> DataFrame:
    """``sized`` rows with _s (number of the source), source_size, target and _at: words of their source's stream before them.

    ``plan``: (_s, _source, source_size, target). Rows of equal id and text have equal sizes, so their order among
    themselves changes nothing.
    """
    buckets = max(1, -(-rows // BUCKET))
    order = F.shiftright(F.conv(F.substring("_md5", 1, 7), 16, 10).cast("long") * buckets, 28).cast("int")
    named = _meet(docs, plan, F.col("source").eqNullSafe(F.col("_source")), listed, "_md5").drop("_source")
    dealt = named.withColumn("_bucket", order)
    before = dealt.groupBy("_s", "_bucket").agg(F.sum("_size").alias("n"))
    before = before.select("_s", "_bucket", (F.sum("n").over(Window.partitionBy("_s").orderBy("_bucket")) - F.col("n")).alias("_before"))
    w = Window.partitionBy("_s", "_bucket").orderBy("_md5").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    return placed.join(before, ["_s", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_before", "_in", "_md5", "_bucket")


def schedule(spark, wanted: list[float], slot: int = SLOT) -> DataFrame:
    """(slot, _s, rank): golden-ratio points through the cumulative shares; ranks count a source's slots."""
    total = sum(wanted)
    slots, edges = (int(-(-total // slot)), np.cumsum(wanted) / total) if total else (0, np.zeros(0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("id").to_pylist():
                i = np.arange(c * CHUNK, min(slots, (c + 1) * CHUNK))
                s = np.searchsorted(edges[:-1], ((i + 0.5) * PHI) % 1.0, side="right")
                by = np.argsort(s, kind="stable")
                first = np.searchsorted(s[by], s[by])
                rank = np.empty(len(i), np.int64)
                rank[by] = np.arange(len(i)) - first
                yield pa.record_batch([pa.array(np.full(len(i), c)), pa.array(i), pa.array(s.astype(np.int32)), pa.array(rank)], names=["chunk", "slot", "_s", "rank"])

    chunks = -(-slots // CHUNK)
    return _ranked(spark.range(0, chunks, 1, max(1, min(chunks, 10_000))).mapInArrow(deal, "chunk long, slot long, _s int, rank long"))


def _ranked(dealt: DataFrame) -> DataFrame:
    """(slot, _s, rank) of (chunk, slot, _s, rank within chunk and source)."""
    counts = dealt.groupBy("chunk", "_s").agg(F.count("*").alias("n"))
    counts = counts.select("chunk", "_s", (F.sum("n").over(Window.partitionBy("_s").orderBy("chunk")) - F.col("n")).alias("before"))
    return dealt.join(counts, ["chunk", "_s"]).select("slot", "_s", (F.col("rank") + F.col("before")).alias("rank"))


def running(rows: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over all rows before them in ``order``, which has no ties.

    Rows are sorted into ranges; a range starts from the sum of those before it, which are as many as partitions.
    """
    held = rows.withColumn("_value", value).repartitionByRange(parts(rows), order)
    held = save(held.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = held.groupBy("_range").agg(F.sum("_value").alias("n"))
    sums = sums.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy("_range").orderBy(order)) - F.col("_value")
    return held.withColumn("_in", within).join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_value", "_before", "_in")


def many_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``targets`` of a table (source, n): adds _s, the source's number, and target.

    Each round raises the words a unit of weight gets by what the sources above their cap leave; it ends when no further one is above.
    """
    placed = running(sources, F.col("source").asc_nulls_last(), F.lit(1).cast("long"), "_s")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_s") % len(weights) + 1).cast("int"))
    placed = save(placed.withColumn("_s", F.col("_s").cast("int")).withColumn("_w", weight), "sources")
    unit, above = 0.0, -1
    while True:
        over = cap * F.col("n") < F.lit(unit) * F.col("_w")
        r = placed.agg(F.count_if(over).alias("k"), (share * F.sum("n") - F.coalesce(F.sum(F.when(over, cap * F.col("n"))), F.lit(0.0))).alias("left"), F.sum(F.when(~over, F.col("_w"))).alias("w")).first()
        if r.k == above or not r.w:
            break
        unit, above = r.left / r.w, r.k
    return placed.withColumn("target", F.least(cap * F.col("n"), F.lit(unit) * F.col("_w"))).drop("_w")


def many_scheduled(aims: DataFrame, slot: int = SLOT) -> DataFrame:
    """``schedule`` of a table (_s, target). Edges are whole thousandths of words, so every point has exactly one source.

    There are as many cells as sources with a share; the points are spread evenly, so the pairs that meet are some two a slot.
    """
    some = save(running(aims.select("_s", "target", F.floor(F.col("target") * 1000).cast("long").alias("t")).where("t > 0"), F.col("_s"), F.col("t"), "low"), "edges")
    sources, whole, total = some.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    slots, wide = int(-(-total // slot)), max(1, -(-whole // max(1, sources)))
    low, high = F.col("low"), F.col("low") + F.col("t")
    cells = some.select("_s", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / wide), F.floor((high - 1) / wide))).alias("cell"))
    y = F.least(F.floor(((F.col("id") + 0.5) * PHI) % 1.0 * float(whole)), F.lit(whole - 1)).cast("long")
    points = aims.sparkSession.range(0, slots, 1, max(1, min(10_000, -(-slots // CHUNK)))).select(F.col("id").alias("slot"), y.alias("y")).withColumn("cell", F.floor(F.col("y") / wide))
    dealt = points.join(cells, "cell").where("low <= y and y < high").select(F.floor(F.col("slot") / CHUNK).alias("chunk"), "slot", "_s")
    return _ranked(save(dealt.withColumn("rank", (F.row_number().over(Window.partitionBy("chunk", "_s").orderBy("slot")) - 1).cast("long")), "dealt"))


def _listed(spark, found: list) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(plan for ``streams``, slots, blocks (_s, n, words), number of slots) of collected sources."""
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.n for r in found])
    plan = spark.createDataFrame([(i, r.source, r.n, t) for i, (r, t) in enumerate(zip(found, wanted, strict=True))], "_s int, _source string, source_size long, target double")
    slots = save(schedule(spark, wanted), "schedule")
    counted = {r._s: r.n for r in slots.groupBy("_s").agg(F.count("*").alias("n")).collect()}
    last = sum(counted.values())
    extra = [(last + i, s, 0) for i, s in enumerate(s for s, t in enumerate(wanted) if t >= 1 and s not in counted)]  # a source under a slot gets one at the end
    if extra:
        slots = slots.unionByName(spark.createDataFrame(extra, "slot long, _s int, rank long"))
    blocks = spark.createDataFrame([(s, max(1, counted.get(s, 1)), int(t)) for s, t in enumerate(wanted)], "_s int, n long, words long")
    return plan, slots, blocks, last + len(extra)


def _many(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """As ``_listed``, of a table of sources (source, n)."""
    aims = save(many_targets(sources), "targets")
    slots = save(many_scheduled(aims), "schedule")
    counted = save(slots.groupBy("_s").agg(F.count("*").alias("slots")), "counted")
    last = slots.count()
    extra = running(aims.where("target >= 1").join(counted, "_s", "left_anti").select("_s"), F.col("_s"), F.lit(1).cast("long"), "k")
    extra = save(extra.select((F.col("k") + last).alias("slot"), "_s", F.lit(0).cast("long").alias("rank")), "extra")
    blocks = aims.join(counted, "_s", "left").select("_s", F.coalesce("slots", F.lit(1)).cast("long").alias("n"), F.floor("target").cast("long").alias("words"))
    plan = aims.select("_s", F.col("source").alias("_source"), F.col("n").alias("source_size"), "target")
    return plan, slots.unionByName(extra), blocks, last + extra.count()


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(streams of the rows, pieces, slots): pieces (slot, _s, _at, epoch, start, length) are what each slot takes of a row.

    ``docs`` are ``sized`` rows. Pieces of a row are found by (_s, _at) where _size > 0. Empty texts have no piece; a
    null source is a source, the last; repeated rows each have their place. An empty table mixes nothing. Targets are
    taken to the whole word.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    sources = docs.groupBy("source").agg(F.sum("_size").alias("n"), F.count("*").alias("rows"))
    found = sources.limit(SOURCES + 1).collect()
    listed = len(found) <= SOURCES
    plan, slots, blocks, count = _listed(spark, found) if listed else _many(save(sources.select("source", "n"), "sources"))
    placed = streams(docs, plan, sum(r.rows for r in found) if listed else docs.count(), listed)
    epoch = F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch")
    at = placed.where("_size > 0").select("_s", "_at", "_size", "source_size", epoch)
    at = _meet(at, blocks.withColumnRenamed("_s", "_b"), F.col("_s") == F.col("_b"), listed, "_at").drop("_b")
    a = F.col("_at") + F.col("epoch") * F.col("source_size")
    at = at.withColumn("a", a).withColumn("b", F.least(a + F.col("_size"), F.col("words"))).where("a < b")
    # block r has the words [r * words div n, (r + 1) * words div n) of the stream: word x is in block ((x + 1) * n - 1) div words
    at = at.withColumn("rank", F.explode(F.expr("sequence(((a + 1) * n - 1) div words, (b * n - 1) div words)")))
    low, high = F.greatest(F.col("a"), F.expr("rank * words div n")), F.least(F.col("b"), F.expr("(rank + 1) * words div n"))
    cut = at.select("_s", "_at", "epoch", "rank", (low - F.col("a")).alias("start"), (high - low).alias("length"))
    return placed, cut.join(slots.hint("merge"), ["_s", "rank"]).select("slot", "_s", "_at", "epoch", "start", "length"), count


def mixed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents as the mix takes them, in the order of their first slots: each row up to twice, cut after the last word taken.

    Partitions are equal ranges of slots, each sorted by slot. Columns of any name are kept.
    """
    names, place, schema = docs.columns, docs.columns.index("text"), docs.schema
    columns = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, columns, strict=True)), F.col(key).alias("_key"), F.col("source"), F.col("text"))
    rows = sized(plain, "_key").drop("text", "_key").withColumn("_row", F.monotonically_increasing_id())
    rows = save(rows, "sized")  # written, so the numbers stay
    placed, pieces, slots = mix(rows.select("source", "_size", "_md5", "_row"))
    taken = pieces.groupBy("_s", "_at", "epoch").agg(F.sum("length").alias("_take"), F.min("slot").alias("_slot"))
    takes = placed.where("_size > 0").join(taken, ["_s", "_at"]).select("_row", "_take", "_slot", "_s", "_at", "epoch")
    n = parts(rows)
    found = rows.join(takes, "_row").repartitionById(n, (F.col("_slot") * n / max(1, slots)).cast("int")).sortWithinPartitions("_slot", "_s", "epoch", "_at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, columns[place]):
            out = []
            for text, n, m in zip(raw(b.column(columns[place])), b.column("_take").to_pylist(), b.column("_size").to_pylist(), strict=True):
                if n < m:
                    space = np.isin(np.frombuffer(text, np.uint8), [9, 10, 11, 12, 13, 32])
                    ends = np.flatnonzero(np.diff(np.r_[space, True].astype(np.int8)) == 1) + 1
                    text = text[: ends[n - 1]]
                out.append(text)
            cols = [b.column(c) for c in columns]
            cols[place] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.record_batch(cols, names=names)

    return found.select(*columns, "_take", "_size").mapInArrow(cut, schema)


def op8_golden_mix(spark, sf_dir: str) -> DataFrame:
    """Words of each document that the mix of all sources takes, the first slot that takes some (null: none), and its pieces in slots."""
    docs = save(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "_size", "_md5"), "sizes")
    placed, pieces, _ = mix(docs)
    taken = pieces.groupBy("_s", "_at").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"))
    whole = F.when(F.col("_size") > 0, F.col("_at"))
    out = placed.withColumn("_own", whole).join(taken.withColumnRenamed("_at", "_own"), ["_s", "_own"], "left")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 3).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).alias("slots"))


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, COALESCE(md5(text), 'null') AS mark FROM documents),
 src AS (
  SELECT source, SUM(size)::BIGINT AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sized GROUP BY source),
 ranked AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS k FROM src),
 level AS (
  SELECT *, (1.5 * (SELECT SUM(n) FROM src) - COALESCE(2.0 * SUM(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM ranked),
 first_free AS (SELECT MIN(k) AS k FROM level WHERE unit * w <= 2.0 * n),
 goal AS (
  SELECT l.source, l.n, CASE WHEN l.k < f.k THEN 2.0 * l.n ELSE l.w * (SELECT unit FROM level WHERE k = f.k) END AS target FROM level l, first_free f),
 shares AS (
  SELECT *, row_number() OVER o - 1 AS s, CAST(floor(target) AS BIGINT) AS words, SUM(target) OVER o / SUM(target) OVER () AS upto
  FROM goal WINDOW o AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 points AS (
  SELECT i AS slot, ((i + 0.5) * CAST('0.6180339887498949' AS DOUBLE)) % 1.0 AS x
  FROM range((SELECT CAST(ceil(SUM(target) / 4096.0) AS BIGINT) FROM goal)) t(i)),
 dealt AS (
  SELECT slot, (SELECT COUNT(*) FROM shares WHERE upto <= x AND s < (SELECT MAX(s) FROM shares)) AS s FROM points),
 slots AS (
  SELECT slot, s, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank FROM dealt
  UNION ALL
  SELECT (SELECT COUNT(*) FROM points) + row_number() OVER (ORDER BY s) - 1, s, 0 FROM shares WHERE target >= 1 AND s NOT IN (SELECT s FROM dealt)),
 blocks AS (SELECT s, COUNT(*) AS n FROM slots GROUP BY s),
 placed AS (
  SELECT z.doc_id, z.size, g.n AS source_size, g.target, g.words, g.s, COALESCE(b.n, 1) AS n,
         COALESCE(SUM(z.size) OVER (PARTITION BY z.source ORDER BY md5('mix:' || COALESCE(CAST(z.doc_id AS VARCHAR), 'null') || ':' || z.mark)
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM sized z JOIN shares g ON z.source IS NOT DISTINCT FROM g.source LEFT JOIN blocks b ON b.s = g.s),
 ends AS (
  SELECT *, LEAST(pos + size, words) AS b, source_size + pos AS a2, LEAST(source_size + pos + size, words) AS b2 FROM placed),
 cut AS (
  SELECT *, CASE WHEN pos < b THEN ((pos + 1) * n - 1) // words END AS r, CASE WHEN pos < b THEN (b * n - 1) // words - ((pos + 1) * n - 1) // words + 1 ELSE 0 END
         + CASE WHEN a2 < b2 THEN (b2 * n - 1) // words - ((a2 + 1) * n - 1) // words + 1 ELSE 0 END AS pieces FROM ends)
SELECT c.doc_id, size, source_size, round(target, 3) AS target, CAST(GREATEST(0, b - pos) + GREATEST(0, b2 - a2) AS BIGINT) AS taken,
       CAST(slot AS BIGINT) AS first_slot, CAST(pieces AS BIGINT) AS slots
FROM cut c LEFT JOIN slots t ON t.s = c.s AND t.rank = c.r
"""
