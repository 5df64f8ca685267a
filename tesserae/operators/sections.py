"""Text to structure: sections, numbered points, chunks, summaries, outlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import collapse, let, strip

HEADING = r"^#{1,3}\s+(.+?)\s*$"
LINE_END = "\r\n|[\n\x0b\f\r\x1c-\x1e\u0085\u2028\u2029]"


def split_into_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", preamble: str = "Документ") -> DataFrame:
    """(key, section_id, section_title, page_content): a section starts at a heading line of level 1 to 3 and holds it.

    Empty sections go and the rest are numbered from 0; a text without a section is one, stripped. All within the row: no
    shuffle, and rows of one key are documents of their own.
    """
    rows = docs.select(F.col(key), F.split(F.coalesce(text, F.lit("")), LINE_END).alias("_lines"))

    def cut(lines):
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull())

        def section(starts, start, k):
            end = F.coalesce(F.get(starts, k + 1), F.size(lines))
            title = F.nullif(F.regexp_extract(F.get(lines, start), HEADING, 1), F.lit(""))
            return F.struct(F.coalesce(title, F.lit(preamble)).alias("section_title"), strip(F.array_join(F.slice(lines, start + 1, end - start), "\n")).alias("page_content"))

        all_ = let(F.array_distinct(F.concat(F.array(F.lit(0)), heads)), lambda starts: F.transform(starts, lambda start, k: section(starts, start, k)))
        return F.filter(all_, lambda s: s["page_content"] != "")

    none = F.array(F.struct(F.lit(preamble).alias("section_title"), F.lit("").alias("page_content")))
    whole = let(let(F.col("_lines"), cut), lambda full: F.when(F.size(full) > 0, full).otherwise(none))
    found = rows.select(key, F.posexplode(whole).alias("section_id", "_s"))
    return found.select(key, "section_id", "_s.section_title", "_s.page_content")


def numbered_points(rows: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, pos, point_no, point_text): parts that start with ``12. `` at a line's start, if there are at least two."""
    marked = F.regexp_replace(text, r"(?m)^\s*(\d+)\.\s", "\u0001$0")
    parts = F.transform(F.slice(F.split(marked, "\u0001"), 2, 1 << 30), strip)
    found = rows.select(*keys, parts.alias("parts")).where(F.size("parts") >= 2)
    return found.select(*keys, F.posexplode("parts").alias("pos", "point_text")).withColumn("point_no", F.regexp_extract("point_text", r"^(\d+)\.", 1))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Chunks of at most ``size`` characters where separators allow; a separator stays at the start of its piece."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    pieces = [p for i, x in enumerate(text.split(separator)) if (p := x if i == 0 else separator + x)]
    chunks: list[str] = []
    run: list[str] = []
    total = 0

    def flush() -> None:
        if joined := "".join(run).strip():
            chunks.append(joined)

    for piece in pieces:
        if len(piece) >= size:
            if run:
                flush()
                run, total = [], 0
            chunks.extend(split_recursively(piece, size, overlap, finer) if finer else [piece])
            continue
        if run and total + len(piece) > size:
            flush()
            while run and (total > overlap or total + len(piece) > size):
                total -= len(run.pop(0))
        run.append(piece)
        total += len(piece)
    if run:
        flush()
    return chunks


def chunk_sections(sections: DataFrame, key: str = "doc_id", config: Config = DEFAULT) -> DataFrame:
    """(key, section_id, section_title, chunk_id, start_index, page_content): chunk_id counts over the document.

    The recursive split has no JVM expression; it runs on Arrow batches, one row at a time, and never groups rows.
    """
    size, overlap, separators = config.chunk_size, config.chunk_overlap, config.separators

    def cut(text: pd.Series) -> pd.Series:
        rows = []
        for t in text:
            out, start, last = [], 0, 0
            for chunk in split_recursively(t or "", size, overlap, separators):
                start = (t or "").find(chunk, max(0, start + last - overlap) if out else 0)
                out.append({"start_index": start, "page_content": chunk})
                last = len(chunk)
            rows.append(out)
        return pd.Series(rows)

    udf = F.pandas_udf(cut, "array<struct<start_index:int,page_content:string>>")
    parts = sections.select(key, "section_id", "section_title", F.posexplode(udf("page_content")).alias("part", "c"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("section_id", "part")) - 1
    return parts.select(key, "section_id", "section_title", number.alias("chunk_id"), "c.start_index", "c.page_content")


def summaries(sections: DataFrame, cache: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Section summaries: from a cache (key, summary) by content hash where it has them, else the section's start."""
    key = F.sha1(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("section_id").cast("string"), F.sha1("page_content")))
    rows = sections.withColumn("summary_key", key)
    start = F.substring("page_content", 1, config.summary_chars)
    if cache is None:
        return rows.withColumn("summary", start)
    return rows.join(cache.select(F.col("key").alias("summary_key"), F.col("summary").alias("_cached")), "summary_key", "left").withColumn("summary", F.coalesce("_cached", start)).drop("_cached")


def outline(summarised: DataFrame, key: str = "doc_id", sections: int = 18, chars: int = 220) -> DataFrame:
    """(key, outline): one line for each of a document's first sections."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("section_id"))
    line = F.concat(F.col("section_id").cast("string"), F.lit(". "), F.col("section_title"), F.lit(": "), F.substring(collapse(F.col("summary")), 1, chars))
    first = summarised.withColumn("_r", rank).where(F.col("_r") <= sections).select(key, F.struct("_r", line.alias("line")).alias("l"))
    return first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias("outline"))
