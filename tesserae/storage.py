"""Tables of documents on shared storage: hash partitions by key, versions, one commit for any number of tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made a version since the one that a change was made from."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; in a local session without one, one made once."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: worked out once, whatever reads it, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one folder. A row lies in a bucket by the hash of its key; a version is a small file that names each bucket's folder.

    A commit writes the buckets that its rows and deleted keys fall into, aside from all others, and then publishes one
    version file for all tables: by a hard link where the folder is local, by a rename that never replaces elsewhere (the file
    system must have one, as HDFS has). A version shows whole or not at all; the second of two writers who started from
    one version gets ``Conflict`` and leaves nothing behind. The version before stays readable; older ones are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        """``schemas``: name of a table to its columns (DDL) and key. ``buckets`` holds for a new folder only."""
        self.spark, self.path, self.schemas, self._buckets = spark, path.rstrip("/"), schemas, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The newest version; 0 where nothing was committed."""
        return max((int(n[:-5]) for n in self._names("versions") if re.fullmatch(r"\d+\.json", n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": how many, "tables": {name: {bucket: folder}}} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"buckets": self._buckets, "tables": {}}
        stream = self._fs.open(self._at(f"versions/{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _bucket(self, key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        schema = self.schemas[name][0]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def read(self, name: str, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """The table; with ``keys`` (its key column) only their rows, from the buckets that they fall into."""
        manifest = self.manifest(version)
        at = manifest["tables"].get(name, {})
        if keys is None:
            return self._read(name, list(at.values()))
        key = self.schemas[name][1]
        wanted = keys.select(key).distinct()
        near = self._read(name, [at[b] for b in self._touched(wanted, key, manifest["buckets"]) if b in at])
        return near.join(wanted, key, "left_semi")

    def _touched(self, keys: DataFrame, key: str, n: int) -> list[str]:
        return [str(r.b) for r in keys.select(self._bucket(F.col(key), n).alias("b")).distinct().collect()]  # at most n

    def deal(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with the rows of a key in one task, and those of few buckets: rows that a task makes of them can be written there (``dealt``)."""
        n = self.manifest()["buckets"]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = F.col(key).cast("string")
        return df.repartition(self._bucket(name, n), F.pmod(F.xxhash64(F.lit("deal"), name), F.lit(max(1, -(-4 * parts // n)))))

    def commit(self, rows: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, at: int | None = None, dealt: tuple[str, ...] = ()) -> int:
        """A new version of all named tables: ``rows`` replace all rows of their keys, rows of the keys in ``gone`` go.

        ``at`` is the version that the change was made from (else the newest now). Each of ``rows`` is worked out once; a null
        key is a key like others. Rows of the tables ``dealt`` are written by the tasks that make them (of rows from ``deal``). Returns the version made; any failure leaves the old version and no files.
        """
        rows, gone, version = rows or {}, gone or {}, self.version() if at is None else at
        manifest, made = self.manifest(version), []
        try:
            for name in sorted({*rows, *gone}):
                manifest["tables"][name] = self._changed(name, manifest, rows.get(name), gone.get(name), made, name in dealt)
            self._publish(version + 1, manifest)
        except BaseException:
            for folder in made:
                self._fs.delete(self._at(folder), True)
            raise
        self._forget(version, manifest)
        return version + 1

    def _changed(self, name: str, manifest: dict, rows: DataFrame | None, gone: DataFrame | None, made: list[str], dealt: bool = False) -> dict:
        schema, key = self.schemas[name]
        n, old = manifest["buckets"], manifest["tables"].get(name, {})
        out, touched, keys, fresh = dict(old), set(), None, {}
        if rows is not None:
            folder = self._write(name, rows.select(*self._read(name, []).columns), key, n, made, dealt)
            fresh = {f.removeprefix("bucket="): f"{folder}/{f}" for f in self._names(folder) if f.startswith("bucket=")}
            keys = self._read(name, list(fresh.values())).select(key).distinct()
            touched |= fresh.keys()
            out |= fresh
        if gone is not None:
            lost = gone.select(F.col(key)).distinct()
            touched |= set(self._touched(lost, key, n))
            keys = lost if keys is None else keys.unionByName(lost).distinct()
        again = sorted(touched & old.keys())
        if again:
            was = self._read(name, [old[b] for b in again])
            kept = was.join(keys.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
            beside = [fresh[b] for b in again if b in fresh]
            if beside:
                kept = kept.unionByName(self._read(name, beside))
            folder = self._write(name, kept, key, n, made)
            merged = {f.removeprefix("bucket="): f"{folder}/{f}" for f in self._names(folder) if f.startswith("bucket=")}
            for b in again:
                out.pop(b, None)
            out |= merged
            for f in beside:
                self._fs.delete(self._at(f), True)
        return out

    def _write(self, name: str, rows: DataFrame, key: str, n: int, made: list[str], dealt: bool = False) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        made.append(folder)
        placed = rows.withColumn("bucket", self._bucket(F.col(key), n))
        if not dealt:
            placed = placed.hint("rebalance", "bucket")
        writers, was = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        try:
            if dealt:  # a task has few buckets: a file of each is open, and rows are not sorted by bucket
                self.spark.conf.set(writers, n)
            placed.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        finally:
            self.spark.conf.set(writers, was)
        return folder

    def _publish(self, version: int, manifest: dict) -> None:
        aside, target = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:09d}.json")
        stream = self._fs.create(aside)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: self._jvm.java.nio.file.Paths.get(self._jvm.java.net.URI.create("file://" + p.toUri().getRawPath()))
                self._jvm.java.nio.file.Files.createLink(local(target), local(aside))
            else:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, target, self._spark_none())
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"version {version} of {self.path} is there already: another writer came first") from e
            raise
        finally:
            if self._fs.exists(aside):
                self._fs.delete(aside, False)

    def _spark_none(self):
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        return options

    def _forget(self, before: int, manifest: dict) -> None:
        """Delete what neither the new version nor the one before it names, and the files of older versions."""
        folders = lambda m: {f for t in m["tables"].values() for f in t.values()}
        kept = folders(manifest) | folders(self.manifest(before))
        for v in range(before - 1, 0, -1):
            if not self._fs.exists(self._at(f"versions/{v:09d}.json")):
                break
            for f in folders(self.manifest(v)) - kept:
                self._fs.delete(self._at(f), True)
            self._fs.delete(self._at(f"versions/{v:09d}.json"), False)
