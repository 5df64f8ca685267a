"""Files written by the tasks: uploads into a landing folder, originals beside the library; a row for each with its outcome."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators.stores import landing_names

MEGABYTE = 1 << 20


def put(content: bytes, target: str) -> str:
    """Write one file aside and move it into place, so that a target is never seen in part; the SHA-256 of what was written.

    Written again by a task that is run again, it is the same file: a retry leaves one copy.
    """
    from pyarrow import fs

    scheme, place = target.split("://", 1) if "://" in target else ("file", target)
    files, path = fs.FileSystem.from_uri(f"{scheme}://{quote(place)}")
    folder, name = path.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(aside) as out:
            out.write(content)
        files.move(aside, path)
    except BaseException:
        if files.get_file_info(aside).type != fs.FileType.NotFound:
            files.delete_file(aside)
        raise
    return hashlib.sha256(content).hexdigest()


def write_files(rows: DataFrame) -> DataFrame:
    """(path, target, bytes, sha256, error) of rows (path, target, content): each file is written when its row is evaluated.

    Evaluate once (``storage.save``); a file that cannot be written is a row with its error. Rows hold whole files, as those of
    ``binaryFile`` do; batches are of few rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, target, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    out.append((path, target, len(content), put(content, target), None))
                except Exception as e:
                    out.append((path, target, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "target", "bytes", "sha256", "error"]) if out else pa.RecordBatch.from_pylist([])

    return rows.select("path", "target", "content").mapInArrow(run, "path string, target string, bytes long, sha256 string, error string")


def land(files: DataFrame, folder: str) -> DataFrame:
    """(path, target, bytes, sha256, error) of uploads (rows of ``binaryFile``): accepted ones are copied under safe, distinct names; the
    others say why not. Empty files have no row: Spark's reader leaves them out."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known, fits = kind.isin(*DEFAULT.upload_types), F.col("length") <= DEFAULT.upload_bytes
    why = F.when(~known, F.concat(F.lit("type not accepted: "), kind)).when(~fits, F.concat(F.lit("too large: "), F.round(F.col("length") / MEGABYTE, 1).cast("string"), F.lit(" MB")))
    refused = files.where(why.isNotNull()).select("path", F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"), why.alias("error"))
    named = landing_names(files.select("path", "length"), folder).select("path", "target")  # names without the contents
    return write_files(named.join(files.select("path", "content"), "path")).unionByName(refused)


def store_originals(docs: DataFrame, folder: str) -> DataFrame:
    """(path, target, bytes, sha256, error) of documents (doc_id, path, content): each original is kept as its id with its extension."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    target = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce(F.nullif(kind, F.lit("")), F.lit("bin")))
    return write_files(docs.where("doc_id is not null").select("path", target.alias("target"), "content"))
