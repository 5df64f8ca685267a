"""Fill-in-middle transformation: DuckDB SQL inside the tasks, from Arrow batch to Arrow batch.

Texts are cut into units (white space and the word after it). A hash of seed and id chooses where prefix and middle end
and the form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Texts that hold a marker stay plain, so
that a transformed text can be taken apart at its markers: a marker cannot lie across a seam, as each begins with ``<``
and has no other ``<``.

Nulls: a null text is empty and plain; a null id hashes as an empty one. Equal ids with equal texts give equal rows. Every
task has a DuckDB of its own with one thread and bounded memory that writes no files; it gets slices of bounded size (or
one row), so a very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, slices

SEED, RATE, SPM_SHARE = 42, 50, 80
MEMORY = "1GB"
#: Units of a text; the markers.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
P, S, M = "<P>", "<S>", "<M>"


def cut_sql(seed: int = SEED, rate: int = RATE, spm: int = SPM_SHARE) -> str:
    """Query over ``batch`` (id, text): all its columns and n, form, prefix, middle, suffix, output."""
    number = lambda i: f"('0x' || substr(h, {8 * i - 7}, 8))::ubigint"
    piece = lambda a, b: f"coalesce(array_to_string(list_slice(units, {a}, {b}), ''), '')"
    return f"""
    with hashed as (
      select * replace (coalesce(text, '') as text), sha256('{seed}:' || coalesce(id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '{UNIT}') as units from batch),
    drawn as (select *, len(units)::bigint as n, {number(1)} as h1, {number(2)} as h2, {number(3)} as h3, {number(4)} as h4 from hashed),
    placed as (
      select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
        case when text = '' or contains(text, '{P}') or contains(text, '{S}') or contains(text, '{M}') or h3 % 100 >= {rate} then 'plain'
          when h4 % 100 < {spm} then 'spm' else 'psm' end as form
      from drawn),
    pieces as (
      select *, case when form <> 'plain' then {piece('1', 'a')} end as prefix, case when form <> 'plain' then {piece('a + 1', 'b')} end as middle,
        case when form <> 'plain' then {piece('b + 1', 'n')} end as suffix from placed)
    select * exclude (units, h, h1, h2, h3, h4, a, b), case form when 'plain' then text
      when 'psm' then '{P}' || prefix || '{S}' || suffix || '{M}' || middle
      else '{S}' || suffix || '{P}' || prefix || '{M}' || middle end as output
    from pieces"""


def restore_sql(table: str) -> str:
    """Query over ``table`` (output, form): all its columns and restored, the text taken apart at the markers and put together."""
    between = lambda a, b: f"substr(output, strpos(output, '{a}') + 3, strpos(output, '{b}') - strpos(output, '{a}') - 3)"
    end = f"substr(output, strpos(output, '{M}') + 3)"
    return f"""
    select *, case form when 'plain' then output when 'psm' then {between(P, S)} || {end} || {between(S, M)}
      when 'spm' then {between(P, M)} || {end} || {between(S, P)} end as restored
    from {table}"""


def in_duckdb(df: DataFrame, sql: str, schema: str, column: str) -> DataFrame:
    """The rows of ``sql`` over each slice of ``df`` (as ``batch``), slices by the bytes of ``column``."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "autoinstall_known_extensions": False}) as con:
            for piece in slices(batches, column):
                con.register("batch", pa.Table.from_batches([piece]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, key: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM_SHARE) -> DataFrame:
    """(key, n, form, output) of each row: units, the form chosen, and the transformed text."""
    rows = docs.select(F.col(key).alias("id"), "text")
    kind = docs.schema[key].dataType.simpleString()
    return in_duckdb(rows, f"select id, n, form, output from ({cut_sql(seed, rate, spm)})", f"id {kind}, n long, form string, output string", "text").withColumnRenamed("id", key)


def restore(transformed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, form, output): the exact text; a null form gives null."""
    rows = transformed.select(F.col(key).alias("id"), "form", "output")
    kind = transformed.schema[key].dataType.simpleString()
    return in_duckdb(rows, f"select id, restored as text from ({restore_sql('batch')})", f"id {kind}, text string", "output").withColumnRenamed("id", key)


DIGEST = f"""
  with made as ({cut_sql()}), back as ({restore_sql('made')})
  select id as doc_id, n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars,
    sha256(output) as output_sha256, sha256(restored) as restored_sha256 from back"""


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of all transformed and restored texts; one pass, no shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return in_duckdb(docs, DIGEST, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", "text")


#: The same statement over the table in one piece; tests also hold the rows against plain Python.
ORACLE = f"with batch as (select doc_id as id, text from documents) select * from ({DIGEST})"
