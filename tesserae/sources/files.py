"""Files as rows: text, DOCX (read from its XML) and PDF (by an optional library)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import preprocess_text
from ..operators.catalog import accepted
from ..operators.layout import lines_to_markdown

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node: ElementTree.Element) -> str:
    return " ".join("".join({"t": e.text or "", "tab": " ", "br": " "}.get(e.tag.removeprefix(WORD_XML), "") for e in node.iter()).replace("\u00a0", " ").split())


def _level(style: str) -> int | None:
    name = style.strip().lower()
    number = name.removeprefix("heading").strip()
    return {"title": 1, "subtitle": 2}.get(name) or (max(1, min(6, int(number))) if name.startswith("heading") and number.isdigit() else None)


def docx_markdown(content: bytes) -> str:
    """Paragraphs and tables of a DOCX in the body's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_XML}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD_XML}style"):
                label = s.find(f"{WORD_XML}name")
                names[s.get(f"{WORD_XML}styleId")] = label.get(f"{WORD_XML}val", "") if label is not None else ""
    blocks = []
    for child in body if body is not None else ():
        if child.tag == f"{WORD_XML}p" and (text := _text(child)):
            style = child.find(f"{WORD_XML}pPr/{WORD_XML}pStyle")
            label = style.get(f"{WORD_XML}val", "") if style is not None else ""
            level = _level(names.get(label, label))
            blocks.append("#" * level + " " + text if level else text)
        elif child.tag == f"{WORD_XML}tbl":
            rows = [[_text(c) for c in r.findall(f"{WORD_XML}tc")] for r in child.findall(f"{WORD_XML}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                rows.insert(1, ["---"] * width)
                blocks.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
    return "\n\n".join(blocks) + "\n"


def pdf_markdown(content: bytes) -> str:
    """Lines of a PDF's text by pypdf; a RuntimeError names the library where it is not installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_markdown, "pdf": pdf_markdown, "md": lambda b: b.decode("utf-8", "replace"), "txt": lambda b: b.decode("utf-8", "replace")}


@F.pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())]))
def _read(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for c, k in zip(content, kind, strict=True):
        try:
            rows.append((READERS[k](c), None))
        except Exception as e:  # a file that can't be read is a row with its error
            rows.append((None, f"{type(e).__name__}: {e}"[:300]))
    return pd.DataFrame(rows, columns=["markdown", "error"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, source_type, raw_text, error) of the accepted files below ``path``."""
    return documents_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def documents_of(files: DataFrame) -> DataFrame:
    """The same from rows of ``binaryFile``, batch or stream."""
    read = accepted(files).withColumn("_r", _read("content", "source_type"))
    text = F.when(F.col("source_type") == "pdf", lines_to_markdown(F.split("_r.markdown", r"\r\n|[\r\n]"))).otherwise(F.col("_r.markdown"))
    return read.select("path", "modificationTime", "length", "source_type", preprocess_text(text).alias("raw_text"), F.col("_r.error").alias("error"))


def read_vectors(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """A vector table on Parquet; a doc_id filter reaches the scan."""
    df = spark.read.parquet(path)
    return df.where(F.col("doc_id") == doc_id) if doc_id is not None else df
