"""A library of documents: catalogue, sections, chunks, index and vectors in one folder, changed by one commit, asked where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import document_id, preprocess_text, safe_document_name
from ..operators import catalog as c
from ..operators import index as ix
from ..operators import models as m
from ..operators.compare import compare_questions
from ..operators.sections import chunk_sections
from ..operators.stages import Answers
from ..sources.files import documents_of
from ..sources.landing import store_originals, write_files
from ..storage import Tables, save
from .ask import Corpus, across_corpus, ask_corpus, index_documents

TABLES = {
    "catalog": (c.SCHEMA, "doc_id"),
    "sections": ("doc_id string, section_id int, section_title string, page_content string, summary string, source string, document_name string, version string, document_folder string", "doc_id"),
    "chunks": ("doc_id string, section_id int, section_title string, chunk_id int, start_index int, text string, source string", "doc_id"),
    "postings": (ix.POSTINGS, "doc_id"),
    "sizes": (ix.SIZES, "doc_id"),
    "vectors": ("doc_id string, chunk_id int, embedding array<float>", "doc_id"),
    "summary_vectors": ("doc_id string, section_id int, embedding array<float>", "doc_id"),
    "errors": ("doc_id string, source string, stage string, error string", "doc_id"),
}


class Library:
    """Documents with all that is derived from them. Readers see the state of one commit; what a failed one wrote is gone."""

    def __init__(self, spark: SparkSession, path: str, models: m.Models = m.Models(), config: Config = DEFAULT, buckets: int = 64):
        self.spark, self.models, self.config = spark, models, config
        self.tables = Tables(spark, f"{path.rstrip('/')}/tables", TABLES, buckets)
        self.answers = Answers(spark, f"{path.rstrip('/')}/answers")

    def read(self, name: str, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        return self.tables.read(name, keys, version)

    def ingest(self, rows: DataFrame) -> int:
        """Put documents (catalogue columns; error: why one could not be read) into all tables by one commit; its version.

        A document that is there already is replaced whole. One without text, or whose row has an error, gets a row in ``errors``
        and keeps what it had; a later success takes that row away. Of several rows of a document the latest counts.
        Summaries and vectors are asked of the models before the commit, each once (``stages``). Null ids are no documents.
        """
        at = self.tables.version()
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        whole = rows.withColumn("error", error).unionByName(self.spark.createDataFrame([], c.SCHEMA), allowMissingColumns=True).where("doc_id is not null")
        whole = save(c.latest(whole).withColumn("error", F.coalesce("error", F.when(F.col("raw_text").isNull(), "no text"))), "ingest")
        good, bad = whole.where("error is null").drop("error"), whole.where("error is not null")
        text = good.select("doc_id", preprocess_text(F.col("raw_text")).alias("text"))
        sections, _ = index_documents(text, self.config, self.models, None, self.answers)
        meta = good.select("doc_id", F.coalesce("source", "doc_id").alias("source"), "document_name", "version", "document_folder")
        sections = save(sections.drop("summary_key").join(meta, "doc_id"), "sections")
        chunks = save(chunk_sections(sections, config=self.config).withColumnRenamed("page_content", "text").join(meta.select("doc_id", "source"), "doc_id"), "chunks")
        summed = sections.select("doc_id", F.col("section_id").alias("chunk_id"), F.col("summary").alias("text"))
        levels = chunks.select("doc_id", "chunk_id", "text", F.lit("chunk").alias("level")).unionByName(summed.withColumn("level", F.lit("summary")))
        both = ("doc_id", "level")
        made = {"catalog": good, "sections": sections, "chunks": chunks, "postings": ix.postings(self.tables.deal(levels, "doc_id"), both, dealt=True), "sizes": ix.sizes(levels, both), "errors": bad.select("doc_id", "source", F.lit("read").alias("stage"), "error")}
        if self.models.embed:
            made["vectors"] = self._embedded(chunks, "chunk_id", F.col("text"))
            made["summary_vectors"] = self._embedded(sections, "section_id", F.col("summary"))
        return self.tables.commit(made, {"errors": good.select("doc_id"), **({} if self.models.embed else {"vectors": good.select("doc_id"), "summary_vectors": good.select("doc_id")})}, at, ("postings",))

    def ingest_folder(self, path: str, folder: str = "", version: str = "1", originals: str | None = None) -> int:
        """``ingest`` of all accepted files below ``path``; with ``originals`` each is copied there and named in the catalogue."""
        return self._ingest_files(self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), folder, version, originals)

    def _ingest_files(self, files: DataFrame, folder: str, version: str, originals: str | None = None) -> int:
        rows = document_rows(documents_of(files), folder, version)
        if originals:
            kept = save(store_originals(files.join(rows.select("doc_id", F.col("source").alias("path")), "path"), originals), "originals")
            rows = rows.drop("stored_source_path").join(kept.where("error is null").select(F.col("path").alias("source"), F.col("target").alias("stored_source_path")), "source", "left")
        return self.ingest(rows)

    def watch(self, path: str, checkpoint: str, folder: str = "", version: str = "1"):
        """A stream that ingests new files of a folder, a commit a batch; a batch that is run again puts the same rows."""
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).load(path)
        return files.writeStream.foreachBatch(lambda df, _: None if df.isEmpty() else self._ingest_files(df, folder, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def bundles(self, ids: DataFrame | None = None) -> DataFrame:
        """(doc_id, bundle): each document with its sections, summaries and chunks as one JSON object."""
        at = self.tables.version()
        whole = self.read("catalog", ids, at)
        for name, order, text in (("sections", "section_id", "page_content"), ("summaries", "section_id", "summary"), ("chunks", "chunk_id", "text")):
            rows = self.read("sections" if name == "summaries" else name, ids, at)
            own = [F.col(x) for x in ("section_id", "section_title", "source", *(("chunk_id", "start_index") if name == "chunks" else ()))]
            item = F.struct(F.col(order).alias("_o"), F.struct(F.col(text).alias("page_content"), F.struct("doc_id", *own).alias("metadata")).alias("i"))
            whole = whole.join(rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item))["i"].alias(name)), "doc_id", "left")
        return whole.select("doc_id", F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("bundle"))

    def export_bundles(self, folder: str, ids: DataFrame | None = None) -> DataFrame:
        """(path, target, bytes, sha256, error): the bundles as files ``<doc_id>.json`` below ``folder``, written by the tasks."""
        rows = self.bundles(ids).select(F.col("doc_id").alias("path"), F.concat(F.lit(folder.rstrip("/") + "/"), "doc_id", F.lit(".json")).alias("target"), F.col("bundle").cast("binary").alias("content"))
        return save(write_files(rows), "bundles")

    def compare(self, questions: DataFrame) -> DataFrame:
        """``compare_questions`` (query_id, left_doc_id, right_doc_id, text) on stored documents."""
        ids = save(questions.select(F.explode(F.array("left_doc_id", "right_doc_id")).alias("doc_id")).distinct(), "asked")
        at = self.tables.version()
        return compare_questions(self.read("sections", ids, at), self.read("catalog", ids, at), questions, self.models, self.answers)

    def _embedded(self, rows: DataFrame, key: str, text: Column) -> DataFrame:
        return self.answers.once(rows.select("doc_id", key, text.alias("_t")), "embedding", {"text": F.col("_t")}, self.models.embed, "array<float>").where("embedding is not null").drop("_t")

    def delete(self, ids: DataFrame) -> int:
        """Without the documents of ``ids`` in any table, by one commit."""
        gone = ids.select("doc_id").where("doc_id is not null").distinct()
        return self.tables.commit(gone={name: gone for name in TABLES})

    def corpus(self, ids: DataFrame) -> Corpus:
        """What is stored of the documents in ``ids``: only the buckets that these fall into are read, all of one version."""
        at = self.tables.version()
        ids = save(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "asked")
        read = lambda name: self.read(name, ids, at)
        vectors = (read("vectors"), read("summary_vectors")) if self.models.embed else (None, None)
        return Corpus(read("sections"), read("chunks"), *vectors, read("postings"), read("sizes"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text): the documents' raw text; of one without, its chunks in order, a blank line between."""
        known = self.read("catalog", ids.select(F.col("doc_id").cast("string").alias("doc_id"))).where("raw_text is not null").select("doc_id", preprocess_text(F.col("raw_text")).alias("text"))
        chunks = self.read("chunks", ids.select(F.col("doc_id").cast("string").alias("doc_id"))).join(known.select("doc_id"), "doc_id", "left_anti")
        return known.unionByName(joined_chunks(chunks))

    def ask(self, questions: DataFrame) -> DataFrame:
        """``ask_corpus`` of questions (query_id, doc_id, text[, mode]) on stored documents; those on unknown ones find nothing."""
        ids = questions.select("doc_id")
        return ask_corpus(self.corpus(ids), questions, self.models, self.config, self.texts(ids), self.answers)

    def ask_across(self, questions: DataFrame) -> DataFrame:
        """``across_corpus`` of questions (query_id, doc_ids, text[, mode])."""
        ids = questions.select(F.explode("doc_ids").alias("doc_id"))
        return across_corpus(self.corpus(ids), questions, self.models, self.config, self.texts(ids), self.answers)


def document_rows(read: DataFrame, folder: str = "", version: str = "1") -> DataFrame:
    """Catalogue columns and error of files read (``sources.files``): the id is that of folder, name and version."""
    name = safe_document_name(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    return read.select(document_id(F.lit(folder), name, F.lit(version)).alias("doc_id"), F.col("path").alias("source"), name.alias("document_name"), F.lit(version).alias("version"), F.lit(folder).alias("document_folder"), "source_type", F.regexp_extract("path", r"([^/]+)$", 1).alias("original_filename"), F.lit(None).cast("string").alias("stored_source_path"), "raw_text", F.col("modificationTime").alias("updated_at"), "error")


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, text) of chunks (doc_id, chunk_id, text): each document's in order, a blank line between."""
    whole = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))
    return whole.select("doc_id", F.array_join("c.text", "\n\n").alias("text"))
