"""Stores beside the catalogue: bundles, vectors, summaries, uploads; what belongs to a document goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_document_name
from .catalog import Catalog, Versioned, accepted
from .sections import split_into_sections

SECTION = "array<struct<page_content:string,metadata:struct<section_id:int,section_title:string,doc_id:string,source:string,document_name:string,version:string,document_folder:string>>>"
META = ("source", "document_name", "version", "document_folder")


def serialised(sections: DataFrame) -> DataFrame:
    """(doc_id, sections: JSON) of rows (doc_id, section_id, section_title, page_content, META), in order of section_id."""
    own = [F.col(c).cast("string").alias(c) for c in ("doc_id", *META)]
    item = F.struct("section_id", F.struct("page_content", F.struct("section_id", "section_title", *own).alias("metadata")).alias("item"))
    whole = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return whole.select("doc_id", F.to_json("s.item").alias("sections"))


def deserialised(bundles: DataFrame) -> DataFrame:
    """Section rows of (doc_id, sections: JSON); malformed JSON and items without text give none."""
    item = bundles.select("doc_id", F.explode(F.from_json("sections", SECTION)).alias("i")).where("i.page_content is not null")
    meta = F.col("i.metadata")
    return item.select("doc_id", F.coalesce(meta["section_id"], F.lit(0)).alias("section_id"), F.trim(F.coalesce(meta["section_title"], F.lit("Документ"))).alias("section_title"), F.col("i.page_content").alias("page_content"), *(meta[c].alias(c) for c in META))


def load_sections(wanted: DataFrame, bundles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sections of the documents in ``wanted``: of their bundle, or where that has none, of the catalogue's raw text."""
    ids = wanted.select("doc_id").distinct()
    stored = deserialised(bundles.join(ids, "doc_id", "left_semi"))
    bare = catalog.join(ids, "doc_id", "left_semi").join(stored.select("doc_id").distinct(), "doc_id", "left_anti").where("raw_text is not null")
    made = split_into_sections(bare, text="raw_text").join(bare.select("doc_id", *META), "doc_id")
    return stored.unionByName(made)


def list_or_backfill(catalog: Catalog, folder: str) -> DataFrame:
    """The listing; an empty catalogue is filled from the folder's bundles first."""
    if catalog.read().isEmpty():
        catalog.backfill(folder)
    return catalog.list()


def upsert_vectors(current: DataFrame, rows: DataFrame) -> DataFrame:
    """All vectors of the documents in ``rows`` replaced: a document that has fewer chunks now keeps none of the old."""
    return current.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows.select(*current.columns))


def vector_documents(vectors: DataFrame) -> DataFrame:
    """(doc_id, chunks): the documents of a vector table."""
    return vectors.groupBy("doc_id").agg(F.count("*").alias("chunks"))


class VectorTable(Versioned):
    """Vectors (doc_id, chunk_id, text, embedding) by document."""

    SCHEMA = "doc_id string, chunk_id int, text string, embedding array<float>"

    def upsert(self, rows: DataFrame) -> None:
        self.replace(rows)

    def delete(self, ids: DataFrame) -> None:
        self.remove(ids)

    def scan(self, doc_id: str | None = None) -> DataFrame:
        return self.read() if doc_id is None else self.read(self.spark.createDataFrame([(doc_id,)], "doc_id string"))


class Bundles(Versioned):
    """Sections of documents as JSON (doc_id, sections)."""

    SCHEMA = "doc_id string, sections string"

    def upsert(self, rows: DataFrame) -> None:
        self.replace(rows)

    def delete(self, ids: DataFrame) -> None:
        self.remove(ids)


class SummaryCache(Versioned):
    """Summaries by content key (key, summary)."""

    SCHEMA, KEY = "key string, summary string", "key"

    def add(self, summarised: DataFrame) -> None:
        """Keep what sections.summaries has made: one summary a key, the present one where there is one."""
        new = summarised.select(F.col("summary_key").alias("key"), "summary").where("summary is not null").groupBy("key").agg(F.min("summary").alias("summary"))
        at = self.tables.version()
        self.replace(new.join(self.tables.read("rows", new, at).select("key"), "key", "left_anti"), at)


def inside(path: Column, root: str) -> Column:
    """Whether a path, its dots resolved, lies below ``root`` (not the root itself)."""
    steps = F.aggregate(
        F.split(path, "/+"), F.array().cast("array<string>"),
        lambda out, s: F.when(s.isin("", "."), out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))),
    )
    return F.coalesce(F.startswith(F.concat(F.lit("/"), F.array_join(steps, "/")), F.lit(root.rstrip("/") + "/")) & F.startswith(path, F.lit("/")), F.lit(False))


def owned_files(catalog: DataFrame, ids: DataFrame, root: str) -> DataFrame:
    """(doc_id, path): the files of documents to delete that lie below ``root`` and belong to no other document."""
    files = catalog.select("doc_id", F.explode(F.array_distinct(F.array("source", "stored_source_path", "text_source_path", "layout_source_path"))).alias("path")).where(inside(F.col("path"), root))
    gone = files.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = files.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select("path").distinct()
    return gone.join(kept, "path", "left_anti").select("doc_id", "path")


def cascade_delete(spark: SparkSession, catalog: Catalog, bundles: Bundles, vectors: VectorTable, ids: list[str], root: str) -> list[str]:
    """Delete documents with their vectors, bundles and own files below ``root``; the files that went."""
    gone = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    paths = [r.path for r in owned_files(catalog.read(), gone, root).select("path").distinct().collect()]  # of the stated ids
    vectors.delete(gone)
    bundles.delete(gone)
    catalog.delete(ids)
    done = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False):
            done.append(p)
    return done


def landing_names(files: DataFrame, folder: str) -> DataFrame:
    """(path, source_type, target): where accepted uploads of ``binaryFile`` rows go: safe names, numbered where several are alike."""
    name = safe_document_name(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    rows = accepted(files).select("path", "source_type", name.alias("name"))
    n = F.row_number().over(Window.partitionBy(F.lower("name"), "source_type").orderBy("path"))
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")
    return rows.withColumn("n", n).select("path", "source_type", F.concat(F.lit(folder.rstrip("/") + "/"), "name", suffix, F.lit("."), "source_type").alias("target"))


def write_texts(rows: DataFrame, path: str) -> None:
    """Rows (name, text) as text files below ``path``, one folder a name: reports as JSON or HTML, Markdown of documents."""
    rows.select("name", "text").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)
