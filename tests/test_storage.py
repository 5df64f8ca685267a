import os

import pytest
from pyspark.sql import functions as F

from tesserae.operators.catalog import Catalog, latest, upsert
from tesserae.storage import Conflict, Tables

SCHEMAS = {"a": ("doc_id string, n int", "doc_id"), "b": ("doc_id string, part int, t string", "doc_id")}


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, n int")


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def content(tables, name="a"):
    return sorted(map(tuple, tables.read(name).collect()), key=repr)


def test_rows_replace_their_keys(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", SCHEMAS, 8)
    assert tables.version() == 0 and tables.read("a").isEmpty()
    tables.commit({"a": made(spark, [("x", 1), ("x", 2), ("y", 1), (None, 5)])})
    tables.commit({"a": made(spark, [("x", 3), (None, 6)])}, {"a": made(spark, [("y", 0), ("nobody", 0)])})
    assert content(tables) == sorted([("x", 3), (None, 6)], key=repr)
    assert [tuple(r) for r in tables.read("a", made(spark, [("x", 0), ("z", 0)])).collect()] == [("x", 3)]
    assert tables.read("a", version=1).count() == 4  # readers of the version before go on
    tables.commit(gone={"a": tables.read("a")})
    assert tables.read("a").isEmpty()
    tables.commit({"a": made(spark, [])})
    assert tables.read("a").isEmpty() and tables.version() == 4


def test_bytes_written_follow_the_change(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", SCHEMAS, 64)
    tables.commit({"a": spark.range(60_000).select(F.col("id").cast("string").alias("doc_id"), (F.xxhash64("id") % 1_000_000).cast("int").alias("n"))})
    before, files = size(tmp_path), tables.manifest()["tables"]["a"]
    tables.commit({"a": made(spark, [("17", -1)])})
    now = tables.manifest()["tables"]["a"]
    assert size(tmp_path) - before < before / 16
    assert sum(files[b] != now[b] for b in files) == 1
    assert tables.read("a").count() == 60_000 and tables.read("a").where("doc_id = '17'").first().n == -1
    plan = tables.read("a", made(spark, [("17", 0)]))._jdf.queryExecution().toString()
    assert "InMemoryFileIndex(1 paths)" in plan


def test_of_two_writers_one_raises(spark, tmp_path):
    one, two = (Tables(spark, f"file://{tmp_path}/t", SCHEMAS, 4) for _ in range(2))
    one.commit({"a": made(spark, [("x", 1)])})
    at = two.version()
    one.commit({"a": made(spark, [("y", 2)])})  # between the other's read and its commit
    with pytest.raises(Conflict):
        two.commit({"a": made(spark, [("z", 3)])}, at=at)
    assert content(one) == [("x", 1), ("y", 2)] == content(two)
    publish, between = two._publish, []

    def late(version, manifest):  # and between its check and its publication
        between.append(one.commit({"a": made(spark, [("w", 4)])}))
        publish(version, manifest)

    two._publish = late
    with pytest.raises(Conflict):
        two.commit({"a": made(spark, [("z", 3)])})
    assert between and content(one) == [("w", 4), ("x", 1), ("y", 2)]
    two._publish = publish
    two.commit({"a": made(spark, [("z", 3)])})
    assert content(one) == [("w", 4), ("x", 1), ("y", 2), ("z", 3)]
    named = {f"{tmp_path}/t/{f}" for v in (two.version() - 1, two.version()) for t in two.manifest(v)["tables"].values() for f in t.values()}
    there = {f"{d}/{x}" for d, names, _ in os.walk(tmp_path) for x in names if x.startswith("bucket=")}
    assert there == named  # what lost or is old has gone


def test_one_commit_for_all_tables(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t", SCHEMAS, 4)
    good = spark.createDataFrame([("x", 1, "t")], SCHEMAS["b"][0])
    tables.commit({"a": made(spark, [("x", 1)]), "b": good})
    with pytest.raises(Exception):
        tables.commit({"a": made(spark, [("x", 2)]), "b": good.withColumn("t", F.raise_error(F.lit("no")).cast("string"))})
    assert content(tables) == [("x", 1)] and content(tables, "b") == [("x", 1, "t")] and tables.version() == 1
    assert len(os.listdir(tmp_path / "t" / "a")) == 1  # the failed commit's folder has gone


def test_latest_row_whatever_the_order(spark):
    rows = [("d", None, "a"), ("d", None, "b"), ("e", "2024-01-01", "x"), ("e", "2024-01-02", "w"), ("e", "2024-01-02", "v"), ("e", None, "z")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id string, at string, raw_text string").select("doc_id", F.col("at").cast("timestamp").alias("updated_at"), "raw_text")
        assert sorted((r.doc_id, r.raw_text) for r in latest(df).collect()) == [("d", "b"), ("e", "w")]
        assert upsert(df.where("doc_id = 'e'"), df.where("doc_id = 'd'")).count() == 5


def test_catalogue_of_one_bucket_rewritten(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.upsert(spark.range(100).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("r").alias("raw_text")))
    before = catalog.tables.manifest()["tables"]["rows"]
    catalog.upsert(spark.createDataFrame([("d7", "new")], "doc_id string, raw_text string"))
    after = catalog.tables.manifest()["tables"]["rows"]
    assert sum(before[b] != after[b] for b in before) == 1 and catalog.get("d7")["raw_text"] == "new" and catalog.read().count() == 100
    catalog.delete(["d7", "nobody"])
    assert catalog.get("d7") is None and catalog.read().count() == 99
