"""A catalogue of documents on Parquet: upsert, delete, look up, list, back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import normalized_filename
from ..storage import Tables

SCHEMA = "doc_id string, source string, document_name string, version string, document_folder string, source_type string, original_filename string, stored_source_path string, text_source_path string, layout_source_path string, raw_text string, updated_at timestamp"


def latest(rows: DataFrame) -> DataFrame:
    """One row a document: the latest ``updated_at``; of equal or missing ones the largest by all other columns."""
    others = [F.desc_nulls_last(c) for c in sorted(rows.columns) if c not in ("doc_id", "updated_at")]
    order = ([F.desc_nulls_last("updated_at")] if "updated_at" in rows.columns else []) + others
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order or [F.lit(0)]))).where("_n = 1").drop("_n")


def upsert(current: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` over ``current``: a document's new row replaces its old one, of several new ones the latest.

    Only the new rows are grouped; the current ones are only joined with the new ids. Columns that rows lack become null.
    """
    ids = rows.select(F.col("doc_id").alias("_id")).distinct()
    return current.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").unionByName(latest(rows), allowMissingColumns=True)


def delete(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows of ``ids``; ids that are not there are of no account. Null ids stay."""
    return current.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def listing(catalog: DataFrame) -> DataFrame:
    shown = catalog.select("doc_id", "source", "document_name", "version", F.coalesce(F.nullif("document_folder", F.lit("")), F.lit(DEFAULT.default_folder)).alias("document_folder"), F.coalesce("source_type", F.lit("")).alias("source_type"), "original_filename", "stored_source_path", "updated_at")
    return shown.orderBy("document_name", "version", "source", "doc_id")


def matches(query: str, folder: str) -> Column:
    """Whether a listed row is in the folder and holds the query in a field, whatever the case."""
    in_folder = F.lit(folder == DEFAULT.all_folders) | (F.col("document_folder") == folder)
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("document_folder", "document_name", "version", "source_type", "source", "doc_id"))))
    return in_folder & (F.lit(query == "") | F.contains(hay, F.lit(query.lower())))


def duplicate_uploads(catalog: DataFrame, uploads: DataFrame) -> DataFrame:
    """(filename, doc_id): uploads whose file name a catalogued file has, whatever the case and folder."""
    names = catalog.select("doc_id", F.explode(F.array("original_filename", "source", "stored_source_path")).alias("path")).where("path <> ''")
    names = names.select("doc_id", normalized_filename(F.col("path")).alias("_name"))
    return uploads.withColumn("_name", normalized_filename(F.col("filename"))).where("_name <> ''").join(names, "_name").select("filename", "doc_id").distinct()


def accepted(files: DataFrame, types: tuple[str, ...] = DEFAULT.upload_types, most: int = DEFAULT.upload_bytes) -> DataFrame:
    """Rows of ``binaryFile`` with an allowed extension and size."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(kind.isin(*types) & (F.col("length") <= most)).withColumn("source_type", kind)


class Versioned:
    """A table of its own under one folder (``storage.Tables``): a change rewrites the buckets that it falls into."""

    SCHEMA, KEY = SCHEMA, "doc_id"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, Tables(spark, path, {"rows": (self.SCHEMA, self.KEY)})

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        return self.tables.read("rows", keys)

    def replace(self, rows: DataFrame, at: int | None = None) -> None:
        """All rows of the keys in ``rows`` replaced by them. Raises ``Conflict`` if another writer came first."""
        self.tables.commit(rows={"rows": rows}, at=at)

    def remove(self, keys: DataFrame, at: int | None = None) -> None:
        """Without the rows of these keys; unknown and null ones are of no account."""
        self.tables.commit(gone={"rows": keys.where(F.col(self.KEY).isNotNull())}, at=at)


class Catalog(Versioned):
    """The catalogue's rows by SCHEMA."""

    def upsert(self, rows: DataFrame) -> None:
        self.replace(latest(rows).unionByName(self.spark.createDataFrame([], SCHEMA), allowMissingColumns=True))

    def delete(self, ids: list[str]) -> None:
        self.remove(self.spark.createDataFrame([(i,) for i in ids], "doc_id string"))

    def get(self, doc_id: str) -> dict | None:
        row = self.read(self.spark.createDataFrame([(doc_id,)], "doc_id string")).first()
        return row.asDict() if row else None

    def list(self) -> DataFrame:
        return listing(self.read())

    def backfill(self, folder: str) -> int:
        """Upsert every JSON bundle of a folder that has a doc_id; malformed files are skipped."""
        found = self.spark.read.schema(SCHEMA + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*.json")
        cached = found.cache()  # Spark reads a corrupt record's column only beside others or from a cache
        try:
            good = cached.where("_bad is null and coalesce(doc_id, '') <> ''").drop("_bad")
            n = good.count()
            if n:
                self.upsert(good)
            return n
        finally:
            cached.unpersist()
