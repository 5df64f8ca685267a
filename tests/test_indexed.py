"""BM25 of indexes that lie in one task each, against the joins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import index as ix
from tesserae.operators import indexed, retrieval
from tesserae.plans import ask
from tesserae.storage import Tables


def row(r):
    return (str(r.query_id), r.doc_id, r.h, r["rank"], r.chunk_id, round(r.score, 8) + 0.0)


@pytest.mark.parametrize(("cells", "batch"), [(1, 1), (1 << 19, 40)])
def test_indexes_are_counted_and_ranked_within_the_tasks(spark, monkeypatch, cells, batch):
    """An index may go on over many batches, questions and chunks come twice, types of ids differ: the rows of the joins, texts shuffled once."""
    rng = random.Random(8)
    say = lambda: rng.choice([None, "", " \t", " ".join(rng.choices(["a", "b", "c", "dä", "e\xa0f", "A"], [9, 5, 2, 1, 1, 1], k=rng.randint(0, 12)))])
    chunks = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice("xy"), rng.choice([str(i), "same"]), say()) for i in range(220)], "doc_id int, h string, chunk_id string, text string").repartition(4)
    every = [(i % 9, rng.choice([None, 1, 1, 2, 9]), rng.choice("xy"), rng.choice(["a a c", "zz", "", None, "dä b zz", "e\xa0f A a"])) for i in range(30)]
    named = spark.createDataFrame(every, "q int, doc_id long, h string, text string").withColumn("query_id", F.struct(F.struct(F.nullif("q", F.lit(3)).alias("a"), F.lit("s").alias("b")).alias("q"), F.col("q").alias("v"))).drop("q")
    monkeypatch.setattr(retrieval, "CELLS", cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for queries in (named, named.drop("doc_id", "h")):
            for k, fill in ((6, False), (50, True)):
                got = retrieval.bm25(chunks, queries, k, ("doc_id", "h"), fill=fill)
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
                with monkeypatch.context() as m:
                    m.setattr(indexed, "bm25", lambda *a: None)
                    wanted = retrieval.bm25(chunks, queries, k, ("doc_id", "h"), fill=fill)
                assert got.dtypes == wanted.dtypes
                wanted = sorted(map(row, wanted.collect()), key=repr)
                assert sorted(map(row, got.collect()), key=repr) == wanted and len(wanted) > 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_types_that_need_joins_keep_them(spark):
    chunks = spark.createDataFrame([(1.0, 1, "a b"), (float("nan"), 2, "b"), (float("nan"), 3, "a")], "doc_id double, chunk_id int, text string")
    queries = spark.createDataFrame([([7], "a")], "query_id array<int>, text string")
    assert sorted((str(r.doc_id), r["rank"], r.chunk_id) for r in retrieval.bm25(chunks, queries, 2, ("doc_id",)).collect()) == [("1.0", 1, 1), ("nan", 1, 3), ("nan", 2, 2)]


def test_only_counts_are_held_of_an_index(monkeypatch):
    """Of an index of many batches a task holds words, rows and the pairs asked, not its texts."""
    held, real = [], indexed._counted
    monkeypatch.setattr(indexed, "_counted", lambda *a: held.append(real(*a)) or held[-1])
    keep, made = indexed._ranked_all(pa.table({"query_id": [5], "text": ["w3 nowhere"]}), 2, True, 1 << 10)
    batches = [pa.record_batch([pa.array([1] * 50), pa.array(range(i, i + 50)), pa.array([" ".join(f"w{x % 7}" for x in range(i, i + 40))] * 50)], names=["doc_id", "_chunk", "text"]) for i in range(0, 1000, 50)]
    out = pa.Table.from_batches(indexed._streamed(["doc_id"], False, keep, made)(iter(batches)))
    assert out.select(["_query", "doc_id", "rank"]).to_pylist() == [{"_query": 5, "doc_id": 1, "rank": 1}, {"_query": 5, "doc_id": 1, "rank": 2}]
    last = held[-1]
    assert len(last.doc) == 1000 == len(last.row) and len(last.vocabulary) == 7 == len(last.key) and np.all(last.tf >= 5)


def test_postings_are_made_and_written_where_their_texts_lie(spark, tmp_path):
    """Texts are shuffled once, postings neither aggregated nor shuffled nor sorted; a search moves only those of its words."""
    chunks = spark.createDataFrame([(str(d), i, ["a b a", "b c", None, "x\u2003y a", ""][(d + i) % 5]) for d in range(40) for i in range(4)], "doc_id string, chunk_id long, text string").withColumn("level", F.lit("chunk"))
    tables = Tables(spark, f"file://{tmp_path}/t", {"postings": (ix.POSTINGS, "doc_id")}, 4)
    plans, write = [], tables._write
    tables._write = lambda name, rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(name, rows, *a)
    dealt, levels = tables.deal(chunks, "doc_id"), ("doc_id", "level")
    tables.commit({"postings": ix.postings(dealt, levels, dealt=True)}, dealt=("postings",))
    assert plans[0].count("Exchange") == 1 and "Aggregate" not in plans[0] and "Generate" not in plans[0]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    posted = tables.read("postings")
    assert sorted(map(str, posted.collect())) == sorted(map(str, ix.postings(chunks, levels).select(*posted.columns).collect()))
    words = {(str(d), w): [i for i in range(4) if w in (["a b a", "b c", "", "x\u2003y a", ""][(d + i) % 5]).split(" ")] for d in range(40) for w in ("a", "b", "c", "x\u2003y")}
    assert {(r.doc_id, r.word): [h.chunk_id for h in r.hits] for r in posted.collect()} == {key: at for key, at in words.items() if at}
    one = posted.where("doc_id = '0' and word = 'a'").first()
    assert [tuple(h) for h in one.hits] == [(0, 2, 3), (3, 1, 2)] and one.avgdl == 7 / 4 and one.idf == 0  # in two of four chunks
    tables.commit({"postings": posted.where("doc_id = '1'").limit(1)}, {"postings": chunks.where("doc_id = '2'")})  # as other rows
    assert tables.read("postings").where("doc_id = '1'").count() == 1 and tables.read("postings").where("doc_id = '2'").isEmpty()
    queries = spark.createDataFrame([(i, str(i), "a c") for i in range(40)], "query_id int, doc_id string, text string")
    plan = ix.search(posted, ix.sizes(chunks, levels), queries)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan


def test_only_documents_asked_are_cut(spark, monkeypatch):
    """Documents that no question asks are left out before texts are cut into chunks and dealt, with the same answers."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("# Price\nThe price of lot "), F.col("id").cast("string"), F.lit(" is "), F.expr("repeat('high and ', 30)"), F.lit("fair.\n# Place\n"), F.expr("repeat('In the harbour. ', 40)")).alias("text"))
    questions = spark.createDataFrame([(1, [3, 7, 3], "what is the price of lot"), (2, [7, 99, None], "harbour"), (3, [], "price")], "query_id int, doc_ids array<int>, text string")
    seen, cut = [], ask.chunk_sections
    monkeypatch.setattr(ask, "chunk_sections", lambda sections, **k: seen.append(sections) or cut(sections, **k))
    got = ask.across_documents(docs, questions)
    assert seen[-1].select("doc_id").distinct().count() == 2 and "ArrowEvalPython" not in seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, ask.ask_across(*ask.index_documents(docs), questions).collect())) and got.where("blocks > 0").count() == 2
    plan = ask.documents_asked(docs, questions.select(F.explode("doc_ids").alias("doc_id")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
