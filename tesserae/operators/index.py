"""An inverted index by document, to be written once and asked often: the rows of BM25 from the postings of the words asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from . import indexed
from .retrieval import K1, B, small, words

POSTINGS = "doc_id string, level string, word string, idf double, avgdl double, hits array<struct<chunk_id: int, tf: int, dl: int>>"
SIZES = "doc_id string, level string, ids array<int>"


def postings(chunks: DataFrame, index: tuple[str, ...] = ("doc_id",), chunk: str = "chunk_id", dealt: bool = False) -> DataFrame:
    """(index, word, idf, avgdl, hits): for each word of each index its weight and the chunks that have it.

    A word's hits are an array: an index is a document's, so an array has at most its chunks. Texts are dealt by index, unless they
    are ``dealt`` so that each index lies in one task; its words are counted there, and the rows stay there.
    """
    rows = chunks.dropna(subset=list(index)).select(*index, F.col(chunk).cast("int").alias("_chunk"), "text")
    hits = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("chunk_id", "tf", "dl")]))
    kind = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in index), T.StructField("word", T.StringType()), T.StructField("idf", T.DoubleType()), T.StructField("avgdl", T.DoubleType()), T.StructField("hits", hits)])
    return indexed.postings(rows if dealt else rows.repartition(*index), list(index), kind)


def sizes(chunks: DataFrame, index: tuple[str, ...] = ("doc_id",), chunk: str = "chunk_id") -> DataFrame:
    """(index, ids): the chunks of each index, the largest id first."""
    return chunks.groupBy(*index).agg(F.sort_array(F.collect_list(F.col(chunk).cast("int")), asc=False).alias("ids"))


def search(posted: DataFrame, sized: DataFrame, queries: DataFrame, k: int = DEFAULT.bm25_k, index: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(query_id, index, rank, chunk_id, score): as ``bm25(..., index)`` over the same chunks, of ``queries`` (query_id[, index], text).

    A query that names no document asks all (a stated query set). Only postings of the words asked are read into the join; lists with fewer than k
    positive scores are filled from the chunk ids of ``sized`` alone.
    """
    index = list(index)
    on = [c for c in index if c in queries.columns]
    wanted = queries.select("query_id", *on, F.explode(words(F.col("text"))).alias("word")).groupBy("query_id", *on, "word").agg(F.count("*").alias("q"))
    told = small(wanted.select("word").distinct())  # before the join, which moves what is left of the postings
    found = posted.join(told, "word", "left_semi").join(wanted, [*on, "word"]).select("query_id", *index, "q", "idf", "avgdl", F.explode("hits").alias("h"))
    tf, dl = F.col("h.tf"), F.col("h.dl")
    part = F.col("q") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scored = found.groupBy("query_id", *index, F.col("h.chunk_id").alias("c")).agg(F.round(F.sum(part), 9).alias("s"))
    best = F.struct((-F.col("s")).alias("s"), (-F.col("c")).alias("c"))
    hits = scored.groupBy("query_id", *index).agg(F.array_sort(F.collect_list(best)).alias("hits"))
    asked = queries.select("query_id", *on).distinct()
    every = sized.join(asked, on) if on else sized.crossJoin(small(asked))
    every = every.join(hits, ["query_id", *index], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<s: double, c: int>>")))
    near = F.array_except(F.slice("ids", F.lit(1), F.size("hits") + k), F.transform("hits", lambda h: -h["c"]))  # enough without a hit
    zeros = F.transform(F.slice(near, 1, k), lambda c: F.struct(F.lit(0.0).alias("s"), (-c).alias("c")))
    top = F.slice(F.array_sort(F.concat(F.slice("hits", 1, k), zeros)), 1, k)
    rows = every.select("query_id", *index, F.posexplode(top).alias("r", "t"))
    return rows.select("query_id", *index, (F.col("r") + 1).alias("rank"), (-F.col("t.c")).alias("chunk_id"), (F.lit(0.0) - F.col("t.s")).alias("score"))
