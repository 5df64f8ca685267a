"""BM25 of indexes that each lie in one task, their rows beside one another: counted from the texts, no row a word is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieval as r


def sortable(kind: T.DataType) -> bool:
    """Whether equal values of a type are beside one another once sorted (not those of floats: NaN)."""
    return isinstance(kind, T.AtomicType) and not isinstance(kind, (T.FloatType, T.DoubleType))


def codable(kind: T.DataType) -> bool:
    return all(codable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.AtomicType)


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones; null is a value, a struct its fields."""
    if not pa.types.is_struct(values.type):
        return values.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    out = values.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    for field in values.flatten():
        code = _codes(field)
        out = np.unique(out * (code.max(initial=0) + 1) + code, return_inverse=True)[1].astype(np.int64)
    return out


def _chunked(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.concat_arrays([a, b.cast(a.type)]) if len(a) else b


@dataclass
class Counts:
    """What is counted of some indexes: rows by index (``doc``), words by index (``key``: index times words, plus word) and by row."""

    names: pa.Table  # a row an index
    q_doc: np.ndarray  # questions that name an index, in its order
    q_id: pa.Array
    q_text: pa.Array
    doc: np.ndarray  # rows
    chunk: pa.Array
    dl: np.ndarray
    vocabulary: pa.Array
    key: np.ndarray  # ascending, each once
    df: np.ndarray
    row: np.ndarray  # pairs of a row and a word, ascending by row
    word: np.ndarray
    tf: np.ndarray

    def part(self, start: int, end: int) -> Counts:
        """Those of the indexes from ``start`` to before ``end``, numbered from 0; the words are those that they have."""
        size = max(1, len(self.vocabulary))
        q, n, k = (slice(*np.searchsorted(a, b)) for a, b in ((self.q_doc, (start, end)), (self.doc, (start, end)), (self.key, (start * size, end * size))))
        p = slice(*np.searchsorted(self.row, (n.start, n.stop)))
        doc, word = np.divmod(self.key[k], size)
        used = np.unique(word)
        return Counts(
            self.names.slice(start, end - start), self.q_doc[q] - start, self.q_id[q], self.q_text[q], self.doc[n] - start, self.chunk[n], self.dl[n],
            self.vocabulary.take(pa.array(used, pa.int64())), (doc - start) * max(1, len(used)) + np.searchsorted(used, word), self.df[k],
            self.row[p] - n.start, np.searchsorted(used, self.word[p]), self.tf[p],
        )


def _counted(batch: pa.Table, index: list[str], held: Counts | None, asks: bool, keep: Callable[[pa.Array], pa.Array] | None) -> Counts:
    """Counts of a batch (index, _kind (0: a question, before the rows), _query, _chunk, text), which goes on with the index ``held``.

    ``asks``: only indexes with questions count. ``keep`` (vocabulary): which words' pairs are kept; else those the index is asked.
    """
    names = batch.select(index) if held is None else pa.concat_tables([held.names, batch.select(index)])
    new = np.zeros(names.num_rows, bool)
    for c in index:
        new[np.r_[0, pc.run_end_encode(_chunked(names.column(c))).run_ends.to_numpy()[:-1]]] = True
    doc = (np.cumsum(new) - 1)[0 if held is None else 1 :]
    names = names.take(pa.array(np.flatnonzero(new)))
    text, question = _chunked(batch.column("text")), batch.column("_kind").to_numpy() == 0 if asks else np.zeros(batch.num_rows, bool)
    q_doc, q_text, rows = doc[question], text.filter(pa.array(question)), ~question
    q_id = _chunked(batch.column("_query")).filter(pa.array(question)) if asks else pa.nulls(0)
    if held is not None:
        q_doc, q_id, q_text = np.r_[held.q_doc, q_doc], _joined(held.q_id, q_id), _joined(held.q_text, q_text)
    if asks:
        rows &= np.bincount(q_doc, minlength=names.num_rows)[doc] > 0
    doc, text, chunk = doc[rows], text.filter(pa.array(rows)), _chunked(batch.column("_chunk")).filter(pa.array(rows))
    at, found, dl = r._cut_words(text)
    before = held.vocabulary if held is not None else pa.array([], pa.string())
    coded = pa.concat_arrays([before, found]).dictionary_encode()  # words held keep their numbers
    vocabulary, size = coded.dictionary, max(1, len(coded.dictionary))
    word = coded.indices.to_numpy().astype(np.int64)[len(before) :]
    pair, tf = np.unique(at * size + word, return_counts=True)
    row, word = np.divmod(pair, size)
    key, df = np.unique(doc[row] * size + word, return_counts=True)
    if held is not None:
        key, into = np.unique(np.r_[held.key, key], return_inverse=True)
        df = np.bincount(into, np.r_[held.df, df], len(key)).astype(np.int64)
        doc, chunk, dl = np.r_[held.doc, doc], _joined(held.chunk, chunk), np.r_[held.dl, dl]
        row, word, tf = np.r_[held.row, row + len(held.doc)], np.r_[held.word, word], np.r_[held.tf, tf]
    if keep is not None:
        wanted = keep(vocabulary).to_numpy(zero_copy_only=False)[word] if len(word) else np.zeros(0, bool)
    else:
        at, said, _ = r._cut_words(q_text)
        code = pc.fill_null(pc.index_in(said, value_set=vocabulary), -1).to_numpy().astype(np.int64)
        wanted = np.isin(doc[row] * size + word, (q_doc[at] * size + code)[code >= 0])
    return Counts(names, q_doc, q_id, q_text, doc, chunk, dl, vocabulary, key, df, row[wanted], word[wanted], tf[wanted])


def _streamed(index: list[str], asks: bool, keep: Callable[[pa.Array], pa.Array] | None, made: Callable[[Counts], Iterator[pa.Table]]):
    """Arrow batches in order of index (and _kind) to ``made`` of the indexes that are over; only counts of the last one are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for cut in r._cuts(b, "text", max(1, b.num_rows)):
                counts = _counted(pa.table(cut), index, held, asks, keep)
                last = counts.names.num_rows - 1
                for t in made(counts.part(0, last)) if last else ():
                    yield from t.combine_chunks().to_batches(1 << 16)
                held = counts.part(last, last + 1)
        for t in made(held) if held is not None else ():
            yield from t.combine_chunks().to_batches(1 << 16)

    return run


def _weights(c: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows and mean words of each index, word number and weight of each key)."""
    n = np.bincount(c.doc, minlength=c.names.num_rows)
    avgdl = np.bincount(c.doc, c.dl, len(n)) / np.maximum(n, 1)
    doc, word = np.divmod(c.key, max(1, len(c.vocabulary)))
    raw = np.log(n[doc] - c.df + 0.5) - np.log(c.df + 0.5)
    mean = np.bincount(doc, raw, len(n)) / np.maximum(np.bincount(doc, minlength=len(n)), 1)
    return n, avgdl, word, np.where(raw < 0, r.EPSILON * mean[doc], raw)


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + 0 .. many[i] - 1) for each i."""
    i = np.repeat(np.arange(len(many)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _best(c: Counts, q_doc: np.ndarray, q_id: pa.Array, at: np.ndarray, said: pa.Array, k: int, fill: bool, cells: int) -> Iterator[pa.Table]:
    """The k best rows for each question (its index ``q_doc``, ascending, its words ``said`` by question ``at``), each once in an index."""
    size, total = max(1, len(c.vocabulary)), len(c.doc)
    n, avgdl, _, idf = _weights(c)
    begin = np.cumsum(n) - n
    place = np.empty(total, np.int64)
    place[pc.sort_indices(c.chunk, null_placement="at_start").to_numpy()] = np.arange(total)
    code = _codes(c.chunk)
    _, alike, unit = np.unique(c.doc * (code.max(initial=0) + 1) + code, return_index=True, return_inverse=True)
    unit = alike[unit]  # rows of one chunk are summed at the first of them
    part = c.tf * (r.K1 + 1) / (c.tf + r.K1 * (1 - r.B + r.B * c.dl[c.row] / np.maximum(avgdl[c.doc[c.row]], 1e-300)))
    pair = c.doc[c.row] * size + c.word
    by = np.argsort(pair, kind="stable")
    pair, row, part = pair[by], unit[c.row[by]], part[by]
    code = pc.fill_null(pc.index_in(said, value_set=c.vocabulary), -1).to_numpy().astype(np.int64)
    asked, q = np.unique(at[code >= 0] * size + code[code >= 0], return_counts=True)
    at, code = np.divmod(asked, size)
    key = q_doc[at] * size + code
    spot = np.minimum(np.searchsorted(c.key, key), max(0, len(c.key) - 1))
    there = c.key[spot] == key if len(c.key) else np.zeros(len(key), bool)
    at, key, weight = at[there], key[there], (q * idf[spot] if len(c.key) else q)[there]
    low, high = np.searchsorted(pair, key), np.searchsorted(pair, key, side="right")
    ends = np.cumsum(n[q_doc])
    i = 0
    while i < len(q_doc):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + cells, side="right")))
        own = slice(*np.searchsorted(at, (i, j)))
        first = ends[i:j] - n[q_doc[i:j]] - (ends[i - 1] if i else 0)
        hit, pairs = _spread(low[own], (high - low)[own])
        question = at[own][hit] - i
        cell = first[question] + row[pairs] - begin[q_doc[i:j][question]]
        count = int(n[q_doc[i:j]].sum())
        score = np.round(np.bincount(cell, part[pairs] * weight[own][hit], count), 9) + 0.0
        found = np.bincount(cell, minlength=count) > 0
        question, rows = _spread(begin[q_doc[i:j]], n[q_doc[i:j]])
        listed = found | (fill & ~found[first[question] + unit[rows] - begin[q_doc[i:j]][question]])
        question, rows, score = question[listed], rows[listed], score[listed]
        order = np.lexsort((-place[rows], -score, question))
        question, rows, score = question[order], rows[order], score[order]
        start = np.flatnonzero(np.r_[True, question[1:] != question[:-1]]) if len(question) else np.zeros(0, np.int64)
        rank = np.arange(len(question)) - np.repeat(start, np.diff(np.r_[start, len(question)])) + 1
        top = rank <= k
        taken, rows = pa.array(question[top] + i), rows[top]
        names = c.names.take(pa.array(c.doc[rows]))
        yield pa.table([q_id.take(taken), *names.columns, pa.array(rank[top], pa.int32()), c.chunk.take(pa.array(rows)), pa.array(score[top])], names=["_query", *names.column_names, "rank", "_chunk", "score"])
        i = j


def _ranked(k: int, fill: bool, cells: int) -> Callable[[Counts], Iterator[pa.Table]]:
    """The best rows for questions that name their index; rows of one question are one."""
    def made(c: Counts) -> Iterator[pa.Table]:
        if len(c.q_doc) and len(c.doc):
            code = _codes(c.q_id)
            _, alike, into = np.unique(c.q_doc * (code.max() + 1) + code, return_index=True, return_inverse=True)
            at, said, _ = r._cut_words(c.q_text)
            yield from _best(c, c.q_doc[alike], c.q_id.take(pa.array(alike)), into[at], said, k, fill, cells)

    return made


def _ranked_all(queries: pa.Table, k: int, fill: bool, cells: int) -> tuple[Callable[[pa.Array], pa.Array], Callable[[Counts], Iterator[pa.Table]]]:
    """(which words are asked, the best rows of every index for all of a small query set)."""
    ids = _chunked(queries.column("query_id"))
    _, alike, into = np.unique(_codes(ids), return_index=True, return_inverse=True)
    ids, (at, said, _) = ids.take(pa.array(alike)), r._cut_words(_chunked(queries.column("text")))
    at, words = into[at], pc.unique(said)

    def made(c: Counts) -> Iterator[pa.Table]:
        n, start = np.bincount(c.doc, minlength=c.names.num_rows), 0
        ends = np.cumsum(np.maximum(n, len(said) + 1) * max(1, len(ids)))
        while start < len(n) and len(ids):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + cells, side="right")))
            own, docs = c.part(start, end), end - start
            every = np.repeat(np.arange(docs), len(at)) * len(ids) + np.tile(at, docs)
            yield from _best(own, np.repeat(np.arange(docs), len(ids)), ids.take(pa.array(np.tile(np.arange(len(ids)), docs))), every, said.take(pa.array(np.tile(np.arange(len(said)), docs))), k, fill, cells)
            start = end

    return lambda vocabulary: pc.is_in(vocabulary, value_set=words), made


def bm25(chunks: DataFrame, queries: DataFrame, k: int, index: list[str], chunk: str, fill: bool) -> DataFrame | None:
    """``retrieval.bm25`` in each index, or None where types or a large query set for all indexes need its joins.

    Texts are dealt by index once, questions that name an index beside them; a small query set for all goes to all tasks.
    """
    on = [c for c in index if c in queries.columns]
    kinds = [chunks.schema[c].dataType for c in index]
    plain = all(map(sortable, kinds)) and isinstance(chunks.schema[chunk].dataType, T.AtomicType) and codable(queries.schema["query_id"].dataType)
    if not plain or "text" in index or (on != index if on else not r.is_small(queries)):
        return None
    differ = {c for c, kind in zip(on, kinds, strict=False) if queries.schema[c].dataType != kind}
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for c in differ for df in (chunks, queries)):
        return None
    wide = lambda c: (F.col(c).cast("long") if c in differ else F.col(c)).alias(c)
    asked, held = queries.schema["query_id"].dataType, chunks.schema[chunk].dataType
    rows = chunks.dropna(subset=index).select(*map(wide, index), F.col(chunk).alias("_chunk"), "text")
    if on:
        rows = rows.withColumn("_kind", F.lit(1)).withColumn("_query", F.lit(None).cast(asked))
        named = queries.dropna(subset=index).select(*map(wide, index), F.lit(None).cast(held).alias("_chunk"), "text", F.lit(0).alias("_kind"), F.col("query_id").alias("_query"))
        rows, run = rows.unionByName(named), _streamed(index, True, None, _ranked(k, fill, r.CELLS))
    else:
        run = _streamed(index, False, *_ranked_all(queries.select("query_id", "text").toArrow(), k, fill, r.CELLS))
    out = [T.StructField("_query", asked), *(T.StructField(c, rows.schema[c].dataType) for c in index), T.StructField("rank", T.IntegerType()), T.StructField("_chunk", held), T.StructField("score", T.DoubleType())]
    found = rows.repartition(*index).sortWithinPartitions(*index, *(["_kind"] if on else [])).mapInArrow(run, T.StructType(out))
    return found.select(F.col("_query").alias("query_id"), *(F.col(c).cast(t).alias(c) for c, t in zip(index, kinds, strict=True)), "rank", F.col("_chunk").alias(chunk), "score")


def _posted(c: Counts) -> Iterator[pa.Table]:
    """(index, word, idf, avgdl, hits): the words of indexes, each with the rows that have it in order."""
    _, avgdl, word, idf = _weights(c)
    size = max(1, len(c.vocabulary))
    place = np.empty(len(c.doc), np.int64)
    place[pc.sort_indices(c.chunk, null_placement="at_start").to_numpy()] = np.arange(len(c.doc))
    by = np.lexsort((place[c.row], c.doc[c.row] * size + c.word))
    row, tf = c.row[by], c.tf[by]
    hit = pa.StructArray.from_arrays([c.chunk.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(c.dl[row], pa.int32())], names=["chunk_id", "tf", "dl"])
    hits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(c.df)], pa.int32()), hit)
    doc = c.key // size
    names = c.names.take(pa.array(doc))
    yield pa.table([*names.columns, c.vocabulary.take(pa.array(word)), pa.array(idf), pa.array(avgdl[doc]), hits], names=[*names.column_names, "word", "idf", "avgdl", "hits"])


def postings(dealt: DataFrame, index: list[str], kind: T.StructType) -> DataFrame:
    """Postings of rows (index, _chunk, text) of which each index lies in one task."""
    run = _streamed(index, False, lambda vocabulary: pa.array(np.ones(len(vocabulary), bool)), _posted)
    return dealt.sortWithinPartitions(*index).mapInArrow(run, kind)
