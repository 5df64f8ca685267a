"""Approximate nearest neighbours: NN-descent builds the graph by Spark joins, queries walk it greedily.

Building and walking measure the vectors themselves, in double precision, so near copies are told apart as all others.
Equal vectors are one node, expanded at the end, so a vector of a third of all rows is no hot node.

- Start: random hyperplanes deal nodes into cells (split by a hash where crowded); TREES times, each node takes the
  nearest K of its cell.
- Descent: each node's neighbours, and up to K of the nodes that have it as theirs, meet at the node by a join; pairs
  with a new edge are measured there and offered to each other where nearer than the present K-th. Up to ROUNDS times.
- Search: all queries go on at once. A round joins each query's best unexpanded nodes with their edges, measures what
  comes, and keeps the BEAM nearest; it ends when no query has anything to expand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, save

#: Neighbours of a node, starting cells and their rows, rounds, offers of a node at a meeting, and least updates a node.
K, TREES, CELL, ROUNDS, OFFERS, STILL = 32, 5, 256, 6, 4, 0.02
#: Tasks that the rows of a crowded cell are dealt to; with CELL rows in a cell, its sizes are less than the rows.
SPREAD = 64
#: Nodes kept and expanded for a query, entries for a query that is no node, members kept of a class.
BEAM, EXPAND, ENTRIES = 192, 64, 256
EDGE = "u long, v long, d double, fresh boolean"


def coded(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, code: bytes of a component, then the components) of arrays of float or double."""
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
            packed = np.concatenate([np.full((len(x), 1), x.itemsize, np.uint8), x.view(np.uint8)], 1)
            yield pa.record_batch([b.column("id"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "code"])

    return vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, "id long, code binary")


def opened(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Components and squared length of codes."""
    data = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    x = np.ascontiguousarray(data[:, 1:]).view(f"<f{data[0, 0] if len(data) else 4}").astype(np.float64)
    return x, np.einsum("ij,ij->i", x, x)


def squared(a: tuple, b: tuple, dot: np.ndarray) -> np.ndarray:
    """Squared distances from lengths and dot products."""
    return np.maximum(0, (a[1][..., :, None] + b[1][..., None, :]) - 2 * dot)


def _cells(nodes: DataFrame, n: int, dims: int, tree: int) -> DataFrame:
    """Edges (u, v, d, fresh) to each node's nearest K of its cell."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / (CELL / 2))))))
    planes = np.random.default_rng(tree).standard_normal((dims, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = (opened(b.column("code").to_pylist())[0] @ planes > 0) @ (1 << np.arange(bits)) if bits else np.zeros(b.num_rows, np.int64)
            yield pa.record_batch([b.column("id"), b.column("code"), pa.array(cell.astype(np.int64))], names=["id", "code", "cell"])

    def measure(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), opened(t.column("code").to_pylist())
        out = []
        for i in range(0, len(ids), 512):
            a = tuple(v[i : i + 512] for v in x)
            d = squared(a, x, a[0] @ x[0].T)
            d[np.arange(len(a[0])), np.arange(i, i + len(a[0]))] = np.inf
            best = np.argpartition(d, min(K, len(ids) - 1) - 1, axis=1)[:, : min(K, len(ids) - 1)] if len(ids) > 1 else np.zeros((len(a[0]), 0), np.int64)
            out.append((np.repeat(ids[i : i + 512], best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()))
        u, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(u), pa.array(v), pa.array(d), pa.array(np.ones(len(u), bool))], names=["u", "v", "d", "fresh"])

    dealt = nodes.mapInArrow(deal, "id long, code binary, cell long")
    crowd = dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    crowd = crowd.select("cell", F.ceil(F.col("n") / CELL).alias("into"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("at"))
    # rows of a crowded cell meet its size in SPREAD tasks, then each part of it is a group of its own
    spread = dealt.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).join(crowd, ["cell", "at"], "left")
    split = spread.withColumn("part", F.pmod(F.xxhash64("id", F.lit(tree)), F.coalesce("into", F.lit(1))))
    return split.select("cell", "part", "id", "code").groupBy("cell", "part").applyInArrow(measure, EDGE)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The nearest k distinct of each u; an edge known before stays known."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.bool_and("fresh").alias("fresh"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).where(F.col("rank") <= k).drop("rank")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``at``: the members of a node's meeting. Offers (u, v, d, fresh) between members."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def offers(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at = t.column("at").to_numpy()
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[start, len(at)])
        ids, kth, fresh = t.column("member").to_numpy(), t.column("kth").to_numpy(), t.column("fresh").to_numpy(zero_copy_only=False)
        x = opened(t.column("code").to_pylist())
        out = []
        for n in np.unique(size[size > 1]).tolist():
            group = start[size == n]
            step = max(1, 1_000_000 // (n * n))
            for s in range(0, len(group), step):
                rows_ = group[s : s + step, None] + np.arange(n)
                a = tuple(v[rows_] for v in x)
                d = squared(a, a, a[0] @ a[0].transpose(0, 2, 1))
                i, f = ids[rows_], fresh[rows_]
                d[(d >= kth[rows_][:, :, None]) | (i[:, :, None] == i[:, None, :]) | ~(f[:, :, None] | f[:, None, :])] = np.inf
                m = min(OFFERS, n)
                best = np.argpartition(d, m - 1, axis=2)[:, :, :m]
                value = np.take_along_axis(d, best, 2)
                g, p, q = np.nonzero(np.isfinite(value))
                out.append((i[g, p], i[g, best[g, p, q]], value[g, p, q]))
        if out:
            u, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
            order = np.lexsort((v, d, u))
            u, v, d = u[order], v[order], d[order]
            keep = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
            u, v, d = u[keep], v[keep], d[keep]
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(d), pa.array(np.ones(len(u), bool))], names=["u", "v", "d", "fresh"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows > 30_000:
            t = pa.Table.from_batches(held).combine_chunks()
            at = t.column("at").to_numpy()
            cut = int(np.searchsorted(at, at[-1]))  # the last node's rows may go on
            yield from offers(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(at) - cut
    if rows:
        yield from offers(pa.Table.from_batches(held).combine_chunks())


def build(nodes: DataFrame, dims: int, rounds: int | None = None) -> DataFrame:
    """The neighbour graph (u, v, d, fresh): about the K nearest v of each node u of (id, code).

    Ends when a round brings few new edges (STILL) or after ``rounds`` (ROUNDS): the graph is an approximation, and what a search
    finds in it is measured by recall.
    """
    rounds = ROUNDS if rounds is None else rounds
    arrow_limits(nodes.sparkSession)
    n = nodes.count()
    found = [_cells(nodes, n, dims, t) for t in range(TREES)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    graph = save(_nearest(found[0], K), "graph")
    for _ in range(rounds):
        kth = graph.groupBy("u").agg(F.when(F.count("*") >= K, F.max("d")).otherwise(float("inf")).alias("kth"))
        known = save(nodes.join(kth.withColumnRenamed("u", "id"), "id", "left").select("id", "code", F.coalesce("kth", F.lit(float("inf"))).alias("kth")), "known")
        ahead = graph.join(known.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("at"), F.col("v").alias("member"), "code", "kth", "fresh", F.lit(0).alias("back"))
        back = graph.join(known.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("at"), F.col("u").alias("member"), "code", "kth", "fresh", F.lit(1).alias("back"))
        place = Window.partitionBy("at").orderBy("back", F.xxhash64("member", "at"))
        both = ahead.unionByName(back).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= 2 * K)
        offers = both.select("at", "member", "code", "kth", "fresh").mapInArrow(_meet, EDGE)
        graph = save(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(offers), K), "graph")
        if graph.where("fresh").count() <= STILL * K * n:
            break
    return graph


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, v, d): the ``beam`` nearest nodes found for each query of (query, node: where it enters or null, code)."""
    spark = graph.sparkSession
    edges = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rank = Window.partitionBy("u").orderBy(F.xxhash64("u", "v"))
    edges = save(edges.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= 3 * K).groupBy("u").agg(F.collect_list("v").alias("to")), "steps")
    entries = nodes.orderBy(F.xxhash64("id")).limit(ENTRIES).select("id")
    queries = save(queries, "queries")
    lost = queries.where("node is null").select("query", "code").crossJoin(F.broadcast(entries.withColumnRenamed("id", "v")))  # ENTRIES nodes for a query that is none
    first = queries.where("node is not null").select("query", "code", F.col("node").alias("v")).unionByName(lost)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = opened(b.column("code").to_pylist()), opened(b.column("other").to_pylist())
            d = ((a[0] - c[0]) ** 2).sum(1)
            yield pa.record_batch([b.column("query"), b.column("v"), pa.array(d)], names=["query", "v", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes.select(F.col("id").alias("v"), F.col("code").alias("other")), "v").select("query", "v", "code", "other").mapInArrow(measure, "query long, v long, d double").withColumn("done", F.lit(False))

    best = Window.partitionBy("query").orderBy("d", "v")
    held = save(measured(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam).drop("rank"), "beam")
    while True:  # a step expands something of each query that has anything left, and what leaves a beam never comes back
        ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("done", "d", "v")))
        marked = save(ranked.withColumn("now", ~F.col("done") & (F.col("rank") <= EXPAND)).drop("rank"), "beam")
        if marked.where("now").isEmpty():
            break
        came = marked.where("now").join(edges, F.col("v") == edges["u"]).select("query", F.explode("to").alias("v")).distinct()
        came = came.join(marked.select("query", "v"), ["query", "v"], "left_anti").join(queries.select("query", "code"), "query")
        held = marked.select("query", "v", "d", (F.col("done") | F.col("now")).alias("done")).unionByName(measured(came))
        held = save(held.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam).drop("rank"), "beam")
    return held.select("query", "v", "d")


def nearest(vectors: DataFrame, every: int, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose key is divisible by ``every``, the k nearest other rows found.

    Null, zero and non-finite vectors, vectors with null components, null keys, and vectors of another than the most
    common dimension take no part. Nearest first, ties to the smaller key. A key that repeats is a row each time, but a
    query only once, by its least vector. Empty tables give no row.
    """
    spark = vectors.sparkSession
    x = F.col(vector)
    good = F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: v + 0).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = save(rows.where(F.size("x") == sizes.dims), "vectors")
    # the k + 1 smallest members of each distinct vector (limited before the shuffle), and its node: the smallest
    member = rows.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("rank") <= k + 1)
    classes = save(member.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumn("node", F.xxhash64("x")), "classes")
    nodes = save(coded(classes, "node", "x", sizes.dims), "nodes")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")).select(F.col("id").alias("query"), F.xxhash64("x").alias("node"), F.col("x").alias("qx"))
    asked = save(asked, "asked")
    graph = build(nodes, sizes.dims)
    found = search(graph, nodes, asked.join(nodes, asked["node"] == nodes["id"]).select("query", "node", "code"))
    exact = found.join(classes, F.col("v") == classes["node"]).select("query", "x", F.explode("members").alias("vec_id")).join(asked.select("query", "qx"), "query").where("vec_id <> query")
    apart = F.sqrt(F.aggregate(F.zip_with(F.col("x"), F.col("qx"), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    exact = exact.select(F.col("query").alias("query_id"), "vec_id", apart.alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nn_descent(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of each hundredth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 100)
