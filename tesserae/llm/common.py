"""What the operators of this subpackage share: shared storage, partition sizes, bounded Arrow slices, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (0x20, 0x09-0x0D) separates words, as ``bytes.split()`` does.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or (unset, all in one process) one made once."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
            spark.sparkContext.setCheckpointDir(base)
    return base


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = path
    return out


def discard(saved: DataFrame) -> None:
    """Delete a table of ``save`` that nothing reads any more."""
    path = saved.sparkSession._jvm.org.apache.hadoop.fs.Path(saved._saved)
    path.getFileSystem(saved.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_limits(spark: SparkSession) -> None:
    """Keep batches for Python small whatever the length of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def parts(df: DataFrame, bytes_each: int = 4 << 20, least: int = 16) -> int:
    """Partitions (or blocks) for ``df`` so that each holds about ``bytes_each`` of its estimated size; grows with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 56:  # no estimate
        size = df.count() * 2048
    return max(least, -(-size // bytes_each))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has at most ``limit`` bytes in each (or one row)."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j


def raw(array: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null is empty."""
    return [x if x is not None else b"" for x in array.cast(pa.binary()).to_pylist()]


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 of x below 2**32, within 64 bits."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor), F.shiftright(x, 16) * F.lit(factor)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(x: Column, bits: int) -> Column:
    """x rotated right by ``bits`` of 32."""
    return F.shiftright(x, bits).bitwiseOR(F.shiftleft(x, 32 - bits).bitwiseAND(F.lit(0xFFFFFFFF)))


def named_block(i: Column) -> Column:
    """The int whose hash in a hash exchange is i: blocks so named go to a partition each, where plain numbers collide.

    Exchanges place an int by Murmur3 (32 bits, seed 42), each step of which can be undone.
    """
    inverse = {c: pow(c, -1, 1 << 32) for c in (0xC2B2AE35, 0x85EBCA6B, 5, 0x1B873593, 0xCC9E2D51)}
    steps = (
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)),
        lambda x: _times(x, inverse[0xC2B2AE35]),
        lambda x: x.bitwiseXOR(F.shiftright(x, 13)).bitwiseXOR(F.shiftright(x, 26)),
        lambda x: _times(x, inverse[0x85EBCA6B]),
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)).bitwiseXOR(F.lit(4)),
        lambda x: _times((x + F.lit((1 << 32) - 0xE6546B64)).bitwiseAND(F.lit(0xFFFFFFFF)), inverse[5]),
        lambda x: _turned(x, 13).bitwiseXOR(F.lit(42)),
        lambda x: _times(x, inverse[0x1B873593]),
        lambda x: _turned(x, 15),
        lambda x: _times(x, inverse[0xCC9E2D51]),
        lambda x: F.when(x >= F.lit(1 << 31), x - F.lit(1 << 32)).otherwise(x),
    )
    one = F.array(i.cast("long"))
    for step in steps:  # a step uses its value several times: as an element it is worked out once
        one = F.transform(one, step)
    return one[0].cast("int")


def split_by(text: Column, doc_id: Column, n: int) -> Column:
    """Block of a document, of n: by id and text, so that neither a repeated id nor a repeated text fills a block alone."""
    return named_block(F.pmod(F.xxhash64(doc_id, text), F.lit(n)))


#: Edges that a task of ``stars`` takes.
EDGES = 1 << 18


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (a, b) of integers that connect what ``edges`` (a saved table) connects: of those that a task gets, one from each node to its least.

    A group of n nodes with many edges leaves a task as n - 1 of them, and paths become short, which saves ``components`` rows and rounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if got:
            own, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*got, strict=True)]), return_inverse=True)
            x, y = at.reshape(2, -1)
            up = np.arange(len(own))
            while not (up[x] == up[y]).all():
                low = np.minimum(up[x], up[y])
                for side in (up[x], up[y]):
                    np.minimum.at(up, side, low)
                while not np.array_equal(up, nxt := up[up]):
                    up = nxt
            far = np.flatnonzero(up != np.arange(len(own)))
            yield pa.record_batch([pa.array(own[far]), pa.array(own[up[far]])], names=["a", "b"])

    n = max(2, -(-edges.count() // EDGES))
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).repartition(n).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """Connected components of an edge table: (node, root), root the smallest node of the component.

    Each round takes the least label among a node's neighbours (a join and an aggregation that combines before the
    shuffle, so a hub is no single task's group) and then jumps along labels; it ends when no label changes. A round's
    labels are written to the shared folder.
    """
    both = save(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct(), "edges")
    labels = save(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    table = labels
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("lower"))
        before, new = table, save(hooked.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("root"), F.col("root").alias("old")), "labels")
        discard(before)
        table, labels = new, new.select("node", "root")
        if new.where("root <> old").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {most} rounds")
