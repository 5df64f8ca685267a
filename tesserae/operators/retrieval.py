"""Ranking: BM25, dense nearest neighbours, reciprocal rank fusion, section scan, filters, neighbours, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..functions.text import collapse, let, strip
from ..storage import save

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of questions that name no topic (fixed values).
STOPWORDS = ("что", "какие", "какой", "какая", "какое", "каких", "все", "всё", "в", "на", "по", "из", "для", "и", "или", "о", "об", "про", "как", "перечисли", "найди", "документе", "документ", "есть")
#: Rows and bytes of a query side up to which it is sent to all tasks; beyond that it is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 16 << 20
#: Scores of chunks by queries that a task holds at once.
CELLS = 1 << 19


def is_small(df: DataFrame) -> bool:
    """Whether rows and bytes (as JSON) are within the bounds, measured on at most BROADCAST_ROWS + 1 rows."""
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df) else df


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def counted_words(words_: Column) -> Column:
    """(word, n) of the distinct words of an array, in the row: sorted, then cut into runs."""
    def runs(by: Column) -> Column:
        starts = F.filter(F.transform(by, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.get(by, s["i"] - 1) != s["word"]))
        return let(starts, lambda first: F.transform(first, lambda s, k: F.struct(s["word"], (F.coalesce(F.get(first, k + 1)["i"], F.size(by)) - s["i"]).alias("n"))))

    return let(F.array_sort(words_), runs)


#: Bytes of text that a task cuts into words at once.
TEXT = 4 << 20


def _cuts(batch: pa.RecordBatch, column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and TEXT bytes of ``column`` (or one row)."""
    ends, i = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while i < batch.num_rows:
        j = min(i + rows, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TEXT, side="right"))))
        yield batch.slice(i, j - i)
        i = j


def _cut_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each word, the words, words of each row) of texts, cut as ``words`` does: at ASCII white space; null is empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.string()), ""))
    flat, at = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    at = at[full.to_numpy(zero_copy_only=False)]
    return at, flat.filter(full), np.bincount(at, minlength=len(text))


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, df, words): how many of the rows of a cut hold each word; under null the number of rows and of their words."""
    for b in batches:
        for cut in _cuts(b, "text", b.num_rows):
            at, found, _ = _cut_words(cut.column("text"))
            coded = found.dictionary_encode()
            held = pc.unique(pa.array(at * len(coded.dictionary) + coded.indices.to_numpy())).to_numpy() % max(1, len(coded.dictionary))
            df = np.bincount(held.astype(np.int64), minlength=len(coded.dictionary))
            names = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())])
            yield pa.record_batch([names, pa.array(np.r_[df, cut.num_rows].astype(np.int64)), pa.array(np.r_[np.zeros(len(df), np.int64), len(at)])], names=["word", "df", "words"])


def _top_scores(vocabulary: pa.Array, starts: np.ndarray, query: np.ndarray, weight: np.ndarray, names: pa.Array, avgdl: float, k: int, fill: bool, chunk: str):
    """Arrow batches (chunk, text) to the k best (query_id, chunk, score) of each query among the batches of a task.

    ``query`` and ``weight`` from ``starts[i]`` are the queries that ask word i of ``vocabulary``. A batch's scores are summed in blocks
    of bounded size; what is kept between batches is k rows a query.
    """
    def best(t: pa.Table) -> pa.Table:
        by = t.append_column("_at", pa.array(np.arange(t.num_rows))).sort_by([("_q", "ascending"), ("score", "descending"), (chunk, "descending")])
        q = by.column("_q").to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return by.take(pa.array(np.flatnonzero(place < k))).drop_columns(["_at"])

    def scored(ids: pa.Array, text: pa.Array) -> pa.Table:
        n, nq = len(ids), len(names)
        at, found, dl = _cut_words(text)
        word = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy()
        pair, tf = np.unique(at[word >= 0] * len(vocabulary) + word[word >= 0], return_counts=True)
        row, word = np.divmod(pair, max(1, len(vocabulary)))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
        many = starts[word + 1] - starts[word]
        hit = np.repeat(np.arange(len(word)), many)  # a hit for each query that asks the word
        into = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + starts[word[hit]]
        cell = row[hit] * nq + query[into]
        score = np.round(np.bincount(cell, part[hit] * weight[into], n * nq).astype(np.float64), 9).reshape(n, nq)
        if not fill:
            score[np.bincount(cell, minlength=n * nq).reshape(n, nq) == 0] = -np.inf
        last = np.partition(score, n - min(k, n), axis=0)[n - min(k, n)]
        r, q = np.nonzero((score >= last) & (score > -np.inf))  # ties of the last one too
        return best(pa.table({"_q": q, chunk: ids.take(pa.array(r)), "score": score[r, q]}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, step = None, max(1, CELLS // max(1, len(names)))
        for b in batches if len(names) else ():
            for cut in _cuts(b, "text", step):
                made = scored(cut.column(0), cut.column(1))
                kept = made if kept is None else best(pa.concat_tables([kept, made]))
        if kept is not None:
            yield from pa.table({"query_id": names.take(kept.column("_q").combine_chunks()), chunk: kept.column(chunk), "score": kept.column("score")}).combine_chunks().to_batches()

    return run


def _bm25_whole(chunks: DataFrame, queries: DataFrame, k: int, chunk: str, fill: bool) -> DataFrame:
    """``bm25`` of a small query set in one index of distinct chunks: words of queries go to all tasks, each keeps its k best chunks a query.

    Two passes over the chunks, which cut texts into words within the tasks: document frequencies, rows and words (a word of
    many chunks is a row for each cut of text, and only the mean idf of all words and those of query words leave the tasks that
    sum them), and scores.
    """
    wanted = queries.select("query_id", F.explode(words(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("q"))
    asked = small(wanted.select("word").distinct().withColumn("asked", F.lit(True)))
    counts = chunks.select("text").mapInArrow(_chunk_counts, "word string, df long, words long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).join(asked, "word", "left")
    # all words by how many chunks have them (one row a frequency), the words asked, and the row of totals
    told = save(counts.groupBy("df", "words", F.col("word").isNull().alias("total"), F.when(F.col("asked"), F.col("word")).alias("word")).agg(F.count("*").alias("times")), "frequencies")
    n, total = told.where("total").select("df", "words").first() or (0, 0)
    avgdl = total / n if n else None
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    told = told.where("not total").withColumn("idf", raw)
    mean = told.agg(F.sum(F.col("idf") * F.col("times")) / F.sum("times")).first()[0]
    idf = told.where("word is not null").select("word", F.when(F.col("idf") < 0, EPSILON * F.lit(mean)).otherwise(F.col("idf")).alias("idf"))
    rows = wanted.join(idf, "word").select("word", "query_id", (F.col("q") * F.col("idf")).alias("weight")).toArrow()
    said = rows.column("word").to_numpy()
    order = np.argsort(said, kind="stable")
    vocabulary, first = np.unique(said[order], return_index=True)
    names = queries.select("query_id").distinct().toArrow().column("query_id").combine_chunks()
    query = pc.index_in(rows.column("query_id"), value_set=names).to_numpy()[order]
    run = _top_scores(pa.array(vocabulary, pa.string()), np.r_[first, rows.num_rows], query, rows.column("weight").to_numpy()[order], names, avgdl or 1.0, k, fill, chunk)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{chunk}` {chunks.schema[chunk].dataType.simpleString()}, score double"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(chunk))
    return chunks.select(chunk, "text").mapInArrow(run, kinds).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", chunk, "score")


def bm25(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT.bm25_k, index: tuple[str, ...] = (), chunk: str = "chunk_id", fill: bool = True) -> DataFrame:
    """(query_id, index, rank, chunk, score): Okapi BM25 of ``queries`` (query_id, text) in each index of ``chunks``.

    Case-sensitive words; statistics are those of the index (all rows if ``index`` is empty). A negative idf becomes
    EPSILON times the mean idf; query words count as often as they occur; ties go to the larger chunk id; chunks without
    a query word score 0. Queries that name an index (columns of ``index``) ask only that one. A row is a chunk: its words
    are counted in the row. With ``index`` the chunks are dealt by index once, and nothing but they and the queries is shuffled;
    they are counted and ranked within the tasks (``indexed``) but for a large query set that asks all indexes, or types that need joins.
    """
    index = list(index)
    if not index and isinstance(queries.schema["query_id"].dataType, T.AtomicType) and is_small(queries) and chunks.groupBy(chunk).count().where("count > 1").isEmpty():
        return _bm25_whole(chunks, queries, k, chunk, fill)
    if index:
        from . import indexed

        if (found := indexed.bm25(chunks, queries, k, index, chunk, fill)) is not None:
            return found
    on = [c for c in index if c in queries.columns]
    wanted = queries.select("query_id", *on, F.explode(words(F.col("text"))).alias("word")).groupBy("query_id", *on, "word").agg(F.count("*").alias("q"))
    wanted = small(wanted) if on != index or not index else wanted.repartition(*on)
    sized = chunks.select(*index, chunk, words(F.col("text")).alias("w"))
    if index:  # an index lies in one part from here on: its words are counted, joined and summed where they lie
        sized = sized.repartition(*index)
    tf = sized.select(*index, chunk, F.size("w").alias("dl"), F.explode(counted_words(F.col("w"))).alias("_w")).select(*index, chunk, "dl", "_w.word", F.col("_w.n").alias("tf"))
    total = sized.groupBy(*index).agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))

    def with_total(df: DataFrame) -> DataFrame:
        return df.join(total, index) if index else df.crossJoin(F.broadcast(total))  # one row

    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df_ = with_total(tf.groupBy(*index, "word").agg(F.count("*").alias("df"))).withColumn("idf", raw)
    mean = df_.groupBy(*index).agg(F.avg("idf").alias("mean"))
    floor = df_.join(mean, index) if index else df_.crossJoin(F.broadcast(mean))  # one row
    idf = floor.select(*index, "word", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("q") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = tf.join(wanted, ["word", *on]).join(idf, [*index, "word"]).groupBy("query_id", *index, chunk).agg(F.round(F.sum(part), 9).alias("score"))
    best = Window.partitionBy("query_id", *index).orderBy(F.desc("score"), F.desc(chunk))
    top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if fill:  # lists with fewer than k positive scores: chunks without a query word come before negative ones
        have = top.where("score > 0").groupBy("query_id", *index).agg(F.count("*").alias("have"))
        asked, sizes = small(queries.select("query_id", *on).distinct()), total.select(*index, "n")
        every = sizes.join(asked, on) if on else asked.crossJoin(sizes if index else F.broadcast(sizes))
        lacking = every.join(have, ["query_id", *index], "left").where(F.coalesce("have", F.lit(0)) < F.least("n", F.lit(k))).select("query_id", *index)
        rest = lacking.join(chunks.select(*index, chunk), index) if index else lacking.crossJoin(chunks.select(chunk))
        rest = rest.join(hits.select("query_id", *index, chunk), ["query_id", *index, chunk], "left_anti").withColumn("score", F.lit(0.0))
        rest = rest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        top = top.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", *index, "rank", chunk, "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Vectors and queries of a block, queries of a matrix product.
VECTOR_BLOCK, QUERY_BLOCK, AT_ONCE = 1 << 16, 1 << 13, 256
#: Parts that the groups of a search within groups are dealt to.
GROUPS = 256


def _block_best(k: int, key: str, within: tuple[str, ...] = ()):
    """Arrow tables of a block of vectors (key, embedding) and one of queries (query_id, _q) to the k best pairs of each query."""
    def widths(column: pa.ChunkedArray) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy()

    def matrix(column: pa.ChunkedArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``at``, of one width, as unit vectors, and which they are: zero and non-finite ones take no part."""
        flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64()).to_numpy().reshape(len(at), -1)
        norm = np.sqrt((flat * flat).sum(1))
        fine = np.isfinite(norm) & (norm > 0)
        return flat[fine] / norm[fine, None], at[fine]

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows, cols, scores = [], [], []
        v_width, q_width = widths(vectors.column("embedding")), widths(queries.column("_q"))
        for width in np.intersect1d(v_width[v_width > 0], q_width):
            v, v_at = matrix(vectors.column("embedding"), np.flatnonzero(v_width == width))
            q, q_at = matrix(queries.column("_q"), np.flatnonzero(q_width == width))
            names = np.array(vectors.column(key).take(pa.array(v_at)).to_pylist())
            for start in range(0, len(q) if len(v) else 0, AT_ONCE):
                score = np.round(q[start : start + AT_ONCE] @ v.T, 9)
                last = np.partition(score, len(v) - min(k, len(v)), axis=1)[:, len(v) - min(k, len(v))]
                for i, (s, least) in enumerate(zip(score, last, strict=True)):
                    at = np.flatnonzero(s >= least)  # ties of the last one too
                    at = at[np.lexsort((names[at], -s[at]))][:k]
                    rows += [q_at[start + i]] * len(at)
                    cols += v_at[at].tolist()
                    scores += s[at].tolist()
        return pa.table({"query_id": queries.column("query_id").take(pa.array(rows, pa.int64())), key: vectors.column(key).take(pa.array(cols, pa.int64())), "score": pa.array(scores, pa.float64())})

    def each(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """The groups of a block one after another: rows of each by its number among those of the queries."""
        def numbered(t: pa.Table) -> np.ndarray:
            return t.select(list(within)).append_column("_i", pa.array(np.arange(t.num_rows)))

        names = queries.select(list(within)).group_by(list(within)).aggregate([])
        names = names.append_column("_n", pa.array(np.arange(names.num_rows)))
        at = [numbered(t).join(names, list(within), join_type="inner").select(["_i", "_n"]).sort_by([("_n", "ascending"), ("_i", "ascending")]) for t in (vectors, queries)]
        cuts = [np.searchsorted(t.column("_n").to_numpy(), np.arange(names.num_rows + 1)) for t in at]
        out = [best(vectors.slice(0, 0), queries.slice(0, 0))]
        for g in range(names.num_rows):
            v, q = (side.take(t.column("_i").slice(c[g], c[g + 1] - c[g])) for side, t, c in zip((vectors, queries), at, cuts, strict=True))
            if v.num_rows:
                out.append(best(v, q))
        return pa.concat_tables(out)

    return each if within else best


def knn(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT.dense_k, key: str = "vec_id", within: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, key, score): the k most similar vectors (cosine) of a stated query set (query_id, embedding[, within]).

    Exact. Every block of vectors meets every block of queries as a matrix product in a task of bounded memory, which keeps k
    rows a query; those are merged. So vectors are dealt once for each QUERY_BLOCK queries. With ``within`` vectors meet the
    queries of their group only (a document's chunks, a label's vectors); null groups meet none. Null, zero and non-finite vectors take no part.
    """
    asked = queries.select("query_id", F.col("embedding").alias("_q"), *within)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    blocks = lambda df, each: max(1, -(-df.count() // each))
    n, m = blocks(vectors, VECTOR_BLOCK), blocks(asked, QUERY_BLOCK)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    left = vectors.select(key, "embedding", *within, part(key, n).alias("_b"), every(m).alias("_c"))
    right = asked.select("query_id", "_q", *within, every(n).alias("_b"), part("query_id", m).alias("_c"))
    if within:  # a group's rows of a block; small groups share a task, and groups are told apart by number
        for c in within:
            left, right = left.where(F.col(c).isNotNull()), right.where(F.col(c).isNotNull())
        held = F.xxhash64(*within)
        left, right = left.withColumn("_g", F.pmod(held, F.lit(GROUPS)).cast("int")), right.withColumn("_g", F.pmod(held, F.lit(GROUPS)).cast("int"))
    kinds = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    by = ["_b", "_c", *(["_g"] if within else [])]
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_block_best(k, key, within), kinds)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def rrf(lists: DataFrame, keys: tuple[str, ...], k: int = DEFAULT.rrf_k, top: int | None = None, query: str = "query_id") -> DataFrame:
    """(query, rank, keys, score): sums of 1 / (k + rank) over ranked lists (query, list_no, rank, keys); ties as first seen."""
    fused = lists.groupBy(query, *keys).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "seen", *keys)
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return (ranked.where(F.col("rank") <= top) if top else ranked).select(query, "rank", *keys, "score")


def _scanned(terms: list[str], starts: np.ndarray, query: np.ndarray, times: np.ndarray, names: pa.Array, top: int, key: str):
    """Arrow batches of rows (key, section_id, title, hay), in order of key and section, to the ``top`` sections of each query in each key.

    ``query`` and ``times`` from ``starts[i]`` are the queries that ask term i. Rows are scored in blocks of bounded size; of a key
    that goes on in the next block, its best sections so far and the last section (whose rows may go on) are held.
    """
    def runs(t: pa.Table, columns: list[str]) -> np.ndarray:
        """Number of the run of rows equal in ``columns`` that each row is in."""
        new = np.zeros(t.num_rows, bool)
        for c in columns:
            ends = pc.run_end_encode(t.column(c).combine_chunks()).run_ends.to_numpy()
            new[ends[:-1]] = True
        return np.cumsum(new)

    def best(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
        """(the ranked rows of the keys that are over, what is held of the last one)."""
        doc, unit, q = runs(t, [key]), runs(t, [key, "section_id"]), t.column("_q").to_numpy()
        cell, at, into = np.unique(unit.astype(np.int64) * len(names) + q, return_index=True, return_inverse=True)
        score = np.bincount(into, t.column("score").to_numpy(), len(cell))
        doc, unit, q = doc[at], unit[at], q[at]
        order = np.lexsort((unit, -score, q, doc))
        d, u, q, score, at = doc[order], unit[order], q[order], score[order], at[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (q[1:] != q[:-1])])
        rank = np.arange(len(d)) - np.repeat(first, np.diff(np.r_[first, len(d)])) + 1
        made = t.take(pa.array(at)).set_column(t.schema.get_field_index("score"), "score", pa.array(score)).append_column("rank", pa.array(rank, pa.int32()))
        over = (d < d.max()) | last
        out = made.filter(pa.array(over & (rank <= top)))
        keep = np.flatnonzero(~over & ((rank <= top) | (u == u.max())))
        held = made.take(pa.array(keep[np.argsort(u[keep], kind="stable")])).drop_columns(["rank"])
        return out, held if held.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        find, held, step = ahocorasick.Automaton(), None, max(1, CELLS // max(1, len(names)))
        for i, t in enumerate(terms):
            find.add_word(t, (i, t, len(t)))
        if terms:
            find.make_automaton()

        def named(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from pa.table({"query_id": names.take(t.column("_q").combine_chunks()), key: t.column(key), "rank": t.column("rank"), "section_id": t.column("section_id"), "score": t.column("score")}).combine_chunks().to_batches()

        for b in batches if terms else ():
            for cut in _cuts(b, "hay", step):
                at, found, points = [], [], []
                for i, (title, hay) in enumerate(zip(cut.column("title").to_pylist(), cut.column("hay").to_pylist(), strict=True)):
                    count: dict[int, int] = {}
                    free: dict[int, int] = {}  # where a term may start again: its occurrences don't overlap
                    for end, (k, _, size) in find.iter(hay or ""):
                        if end - size + 1 >= free.get(k, 0):
                            count[k] = count.get(k, 0) + 1
                            free[k] = end + 1
                    titled = {k for _, (k, _, _) in find.iter(title)} if title else ()
                    at += [i] * len(count)
                    found += count
                    points += [min(n, 4) + (1.5 if k in titled else 0.0) for k, n in count.items()]
                if not at:
                    continue
                row, term = np.array(at), np.array(found)
                many = starts[term + 1] - starts[term]
                hit = np.repeat(np.arange(len(term)), many)  # a hit for each query that asks the term
                into = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + starts[term[hit]]
                score = np.bincount(row[hit] * len(names) + query[into], np.array(points)[hit] * times[into], cut.num_rows * len(names))
                cell = np.flatnonzero(score)  # every hit has points
                r, q = np.divmod(cell, len(names))
                t = pa.table({key: cut.column(key).take(pa.array(r)), "section_id": cut.column("section_id").take(pa.array(r)), "_q": q, "score": score[cell]})
                out, held = best(t if held is None else pa.concat_tables([held, t]), False)
                yield from named(out)
        if held is not None:
            yield from named(best(held, True)[0])

    return run


def scan_sections(sections: DataFrame, queries: DataFrame, top: int = 5, key: str = "doc_id") -> DataFrame:
    """(query_id, key, rank, section_id, score): sections by how often they hold the query's words (each up to 4) and whether their title does (1.5). Queries with a ``key`` ask only that document.

    The terms of a small query set that asks all documents go to all tasks: sections are dealt by ``key`` once, and scored, summed
    and ranked where they lie.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-zА-Яа-яЁё0-9-]{3,}"), F.lit(0))
    on = [c for c in (key,) if c in queries.columns]
    terms = queries.select("query_id", *on, F.explode(found).alias("term")).where(~F.col("term").isin(*STOPWORDS)).groupBy("query_id", *on, "term").agg(F.count("*").alias("times"))
    hay = F.lower(F.concat_ws(" ", "section_title", "page_content"))
    rows = sections.select(key, "section_id", F.lower("section_title").alias("title"), hay.alias("hay"))
    each = terms.select(*on, "term").distinct()  # a term of several queries is looked for once
    plain = all(isinstance(df.schema[c].dataType, T.AtomicType) for df, c in ((queries, "query_id"), (sections, key), (sections, "section_id")))
    if not on and plain and is_small(terms):
        asked = terms.toArrow().sort_by("term")
        names = pc.unique(asked.column("query_id"))
        said, first = np.unique(asked.column("term").to_numpy(), return_index=True)
        query = pc.index_in(asked.column("query_id"), value_set=names).to_numpy()
        run = _scanned(said.tolist(), np.r_[first, asked.num_rows], query, asked.column("times").to_numpy(), names, top, key)
        kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
        return rows.repartition(key).sortWithinPartitions(key, "section_id").mapInArrow(run, f"{kind(queries, 'query_id')}, {kind(sections, key)}, rank int, {kind(sections, 'section_id')}, score double")
    pairs = (rows.join(each, on) if on else rows.crossJoin(each)).where(F.contains("hay", F.col("term")))  # a stated query set
    hits = F.expr("(length(hay) - length(replace(hay, term, ''))) div length(term)")
    points = F.least(hits, F.lit(4)) + F.when(F.contains("title", F.col("term")), 1.5).otherwise(0.0)
    found_terms = pairs.select(key, "section_id", "term", points.alias("points"))
    scored = found_terms.join(small(terms), [*on, "term"]).groupBy("query_id", key, "section_id").agg(F.sum(F.col("points") * F.col("times")).alias("score"))
    order = Window.partitionBy("query_id", key).orderBy(F.desc("score"), "section_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", key, "rank", "section_id", "score")


def title_hints(sections: DataFrame, hints: DataFrame) -> DataFrame:
    """(query_id, section_id): sections whose title holds a hint or is held by one; ``hints`` is a stated, small set."""
    title, hint = F.lower(strip(F.col("section_title"))), F.lower(strip(F.col("hint")))
    pairs = sections.crossJoin(small(hints)).where((hint != "") & (F.contains(title, hint) | F.contains(hint, title)))
    return pairs.select("query_id", "section_id").distinct()


def informative(text: Column) -> Column:
    return (F.length(collapse(text)) >= 80) | (F.length(F.regexp_replace(text, "[^A-Za-zА-Яа-яЁё0-9]+", "")) >= 50)


def drop_low_information(rows: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """Rows with enough text; a query of which none has keeps all."""
    any_good = F.max(F.col("_good").cast("int")).over(Window.partitionBy(query))
    return rows.withColumn("_good", informative(F.col(text))).withColumn("_any", any_good).where("_good or _any = 0").drop("_good", "_any")


def add_neighbours(ranked: DataFrame, chunks: DataFrame, window: int = DEFAULT.neighbours, keys: tuple[str, ...] = ("doc_id",), chunk: str = "chunk_id") -> DataFrame:
    """(query_id, pos, keys, chunk, ...): each ranked chunk with those beside it, in first-seen order; absent ones are skipped."""
    around = ranked.select("query_id", "rank", *keys, F.col(chunk).alias("_c"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("d"))
    around = around.select("query_id", "rank", *keys, (F.col("_c") + F.col("d")).alias(chunk), "d")
    once = around.groupBy("query_id", *keys, chunk).agg(F.min(F.struct("rank", "d")).alias("seen"))
    found = small(save(once, "around")).join(chunks, [*keys, chunk])  # worked out once: few rows beside the chunks
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("seen"))).drop("seen")


def inject_hints(docs: DataFrame, hints: DataFrame, chunks: DataFrame, per_section: int = 2, most: int = 5) -> DataFrame:
    """(query_id, pos, doc_id, chunk_id): ``docs`` (query_id, pos, ...) and then up to two unseen informative chunks of each of the first hinted sections (query_id, hint_no, doc_id, section_id)."""
    extra = hints.where(F.col("hint_no") <= most).join(chunks.where(informative(F.col("text"))), ["doc_id", "section_id"])
    extra = extra.join(docs.select("query_id", "doc_id", "chunk_id"), ["query_id", "doc_id", "chunk_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id", "hint_no").orderBy("chunk_id"))
    extra = extra.withColumn("_r", rank).where(F.col("_r") <= per_section)
    both = docs.select("query_id", F.lit(0).alias("g"), F.col("pos").alias("a"), F.lit(0).alias("b"), "doc_id", "chunk_id").unionByName(extra.select("query_id", F.lit(1).alias("g"), F.col("hint_no").alias("a"), F.col("_r").alias("b"), "doc_id", "chunk_id"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("g", "a", "b"))).select("query_id", "pos", "doc_id", "chunk_id")


def build_context(rows: DataFrame, most: int = DEFAULT.context_chars, kind: str | None = None) -> DataFrame:
    """(query_id, context, blocks): cited blocks in order until the next would pass the budget (each counts two more characters).

    Rows: query_id, pos, source, section_title, chunk_id, start_index, text. A query whose first block does not fit has none.
    """
    where = F.lit(f" section={kind}") if kind else F.concat(F.lit(" section="), F.coalesce("section_title", F.lit("")))
    head = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] source="), F.coalesce(F.col("source").cast("string"), F.lit("")), where, F.lit(" chunk_id="), F.col("chunk_id").cast("string"), F.lit(" start="), F.col("start_index").cast("string"), F.lit("\n"))
    block = F.concat(head, strip(F.col("text")))
    before = F.coalesce(F.sum(F.length("block") + 2).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("block", block).withColumn("_b", before).withColumn("fits", F.when(F.col("_b") + F.length("block") <= most, F.struct("pos", "block")))
    joined = kept.groupBy("query_id").agg(F.array_sort(F.collect_list("fits")).alias("b"))
    return joined.select("query_id", F.array_join("b.block", "\n\n---\n\n").alias("context"), F.size("b").alias("blocks"))


def cite(rows: DataFrame) -> DataFrame:
    """Citations numbered from 1 in order of pos."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def top_sources(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The first rows distinct in (source, section_title, chunk_id)."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source", "section_title", "chunk_id").orderBy("pos"))).where("_n = 1")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("_r") <= limit).drop("_n", "_r")
