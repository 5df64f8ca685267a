"""Incremental ingest, an extension: new files of a folder go into the catalogue as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import document_id, safe_document_name
from ..operators.catalog import Catalog
from ..sources.files import documents_of


def catalog_rows(read: DataFrame, folder: str = "", version: str = "1") -> DataFrame:
    name = safe_document_name(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    return read.where("error is null").select(document_id(F.lit(folder), name, F.lit(version)).alias("doc_id"), F.col("path").alias("source"), name.alias("document_name"), F.lit(version).alias("version"), F.lit(folder).alias("document_folder"), "source_type", F.regexp_extract("path", r"([^/]+)$", 1).alias("original_filename"), "raw_text", F.col("modificationTime").alias("updated_at"))


def watch(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Upserts each batch of new files. A batch that is run again after a failure upserts the same rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        rows = catalog_rows(documents_of(df))
        if not rows.isEmpty():
            catalog.upsert(rows)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
