import json
import re

import pytest
from pyspark.sql import functions as F

from tesserae.config import Config
from tesserae.operators import index, models, retrieval
from tesserae.operators.dates import date_replies
from tesserae.operators.stages import Answers
from tesserae.plans import ask
from tesserae.plans.library import Library

MONEY = "The price of the contract is one hundred thousand and it is paid within ten days of the invoice by the buyer."
OTHER = "Nothing of note is said here about anything at all, though the section is long enough to be kept by filters."
PLACE = "The goods are handed over in the harbour of the northern town before the end of the working day by the seller."
DOCS = [(1, f"# Money\n{MONEY}\n# Other\n{OTHER}"), (2, f"# Place\n{PLACE}")]


def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def counted(spark, say, kind="string"):
    """A hook that counts its calls, and its counter."""
    n = spark.sparkContext.accumulator(0)

    def call(*values):
        n.add(1)
        return say(*values)

    return F.udf(call, kind), n


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, text string")


def test_models_are_called_once(spark, tmp_path):
    answers = Answers(spark, f"file://{tmp_path}/a")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "fails")], "i int, t string")
    said = []
    hook, n = counted(spark, lambda t: None if t == "fails" else t + "!")
    for _ in range(3):
        said.append({r.i: r.s for r in answers.once(rows, "s", {"t": F.col("t")}, hook).collect()})
    assert said == [{1: "x!", 2: "y!", 3: "x!", 4: None, 5: None}] * 3
    assert n.value == 5  # x and y once, the one that fails each time, null never
    other = {r.i: r.z for r in answers.once(rows, "z", {"t": F.col("t")}, hook).collect()}
    assert other[1] == "x!" and n.value == 8  # another stage has answers of its own
    listed, m = counted(spark, lambda t: [len(t), 2], "array<int>")
    assert [r.l for r in answers.once(rows.where("i < 3"), "l", {"t": F.col("t")}, listed, "array<int>").orderBy("i").collect()] == [[1, 2], [1, 2]] and m.value == 2


def test_cached_sections_cost_no_call(spark, tmp_path):
    hook, n = counted(spark, lambda title, text: f"{title} in short")
    answers, made = Answers(spark, f"file://{tmp_path}/a"), models.Models(summarise=hook)
    first = {r.section_title: r.summary for r in ask.index_documents(documents(spark), models=made, answers=answers)[0].collect()}
    assert first == {t: f"{t} in short" for t in ("Money", "Other", "Place")} and n.value == 3
    again = ask.index_documents(documents(spark), models=made, answers=answers)[0]
    assert again.count() == 3 and n.value == 3
    cache = again.select(F.col("summary_key").alias("key"), F.substring("page_content", 1, 800).alias("summary"))
    own = ask.index_documents(documents(spark), models=made, cache=cache, answers=Answers(spark, f"file://{tmp_path}/b"))[0]
    assert {r.summary for r in own.collect()} == {r.summary for r in cache.collect()} and n.value == 3  # a cached summary that equals the start counts


def test_a_question_costs_one_call_a_stage(spark, tmp_path):
    correct, typos = counted(spark, lambda q: q.replace("prise", "price"))
    variants, phrasings = counted(spark, lambda q: json.dumps({"dense": [], "bm25": [q + " payment"]}))
    plan, plans = counted(spark, lambda outline, q: "Here: " + json.dumps({"dense_queries": ["a"], "bm25_queries": ["harbour"], "section_titles": ["OTHER", "no such"]}))
    order, orders = counted(spark, lambda q, listed: "2, 99, 2, 1")
    answer, given = counted(spark, lambda context, q, mode: f"{mode}: {q}" if "price" in context else None)
    made = models.Models(correct=correct, variants=variants, plan=plan, order=order, answer=answer)
    answers = Answers(spark, f"file://{tmp_path}/a")
    sections, chunks = ask.index_documents(documents(spark))
    questions = spark.createDataFrame([(1, 1, "What is the prise", "Кратко"), (2, 2, "Where are the goods handed over", None)], "query_id long, doc_id long, text string, mode string")
    got = {r.query_id: r for r in ask.ask(sections, chunks, questions, made, answers=answers).collect()}
    assert [c.value for c in (typos, phrasings, plans, orders, given)] == [2, 2, 2, 2, 2]
    assert got[1].answer == "Кратко: What is the prise" and got[1].answer_source == "llm"
    assert got[2].answer_source == "fallback" and got[2].answer == models.CONTEXT_FOUND
    assert [(s["index"], s.source, s.section_title, s.chunk_id) for s in got[1].sources] == [(1, "1", "Money", 0), (2, "1", "Other", 1)]
    assert got[1].sources[0].text.startswith("# Money") and got[1].blocks == 2 and got[2].blocks == 1
    ask.ask(sections, chunks, questions, made, answers=answers).collect()
    assert [c.value for c in (typos, phrasings, plans, orders, given)] == [2, 2, 2, 2, 3]  # only the failed answer again


@pytest.mark.parametrize("said, wanted", [("2, 1", [2, 1]), ("3;3;0;9", [3]), ("", [1, 2]), (None, [1, 2]), ("none of them", [1, 2]), ("99999999999999999999 1", [1]), ("1 2 3", [1, 2])])
def test_order_of_a_model(spark, said, wanted):
    df = spark.createDataFrame([(said,)], "s string")
    assert df.select(models.chosen_numbers(F.col("s"), F.lit(3), 2).alias("n")).first().n == wanted
    assert df.select(models.chosen_numbers(F.col("s"), F.lit(0), 2).alias("n")).first().n == []


def test_lists_that_a_model_says(spark):
    texts = ['x {"a": ["1", 2, null], "c": 1} y', '{"a": "no list"}', "no object", None, "{broken", '{"a": ["1"]', '{"a": ["q"]} and {"a": ["r"]}', "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", models.said_lists(F.col("t"), ("a", "b")).alias("s")).collect()}
    assert got == {0: [["1", "2"], []], **{i: [[], []] for i in (1, 2, 3, 4, 5, 7)}, 6: [["q"], []]}


def test_planner_phrasings_and_titles(spark):
    sections, chunks = ask.index_documents(documents(spark))
    corpus = ask.Corpus(sections, chunks)
    answers = Answers(spark)
    said = json.dumps({"dense_queries": ["d1", "D1", "d2", "d3", "d4", "d5"], "bm25_queries": ["b1"], "section_titles": ["some other matter", "money", "x", "y", "z", "place"]})
    made = models.Models(plan=lambda o, q: F.when(F.contains(q, F.lit("fail")), "sorry").otherwise(said))
    rows = ask.phrase(asked(spark, [(1, 1, "One"), (2, 2, "Two fail")]), made, Config(), answers)
    got = {r.query_id: r for r in ask._planned(corpus, rows, made, Config(), answers).collect()}
    assert got[1].dense == ["One", "d1", "d2", "d3"] and got[1].bm25 == ["One", "b1"] and got[1].titled == [0, 1]
    assert got[2].dense == ["Two fail"] and got[2].titled == []


def test_complex_questions_search_their_parts(spark):
    sections, chunks = ask.index_documents(spark.createDataFrame([(1, "\n".join(f"# S{i}\nword{i} " + f"{OTHER} " * 30 for i in range(12)))], "doc_id long, text string"))
    question = asked(spark, [(1, 1, "Перечисли условия word3 и word7?")])
    made = models.Models(decompose=lambda q: F.lit("- word3\n• word7\n\nword9\nword11"))
    with_parts = ask.ask(sections, chunks, question, made).first()
    assert with_parts.route == "complex"
    named = {s.section_title for s in with_parts.sources}
    assert {"S3", "S7", "S9"} <= named


def test_scored_order_reads_the_first_1500_characters(spark):
    answers = Answers(spark)
    kept = spark.createDataFrame([(1, i, 1, i, "x" * 1500 + "y" * i) for i in range(1, 4)] + [(1, 4, 1, 4, "good")], "query_id long, rank int, doc_id long, chunk_id int, text string")
    rows = asked(spark, [(1, 1, "q")]).withColumn("corrected", F.col("text"))
    made = models.Models(rerank=lambda q, t: F.when(t == "good", 1.0).otherwise(F.length(t) / 10_000))
    got = ask.rerank(kept, rows, made, Config(reranked=3), answers).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [4, 1, 2]
    failing = models.Models(rerank=lambda q, t: F.lit(None).cast("double"))
    assert [r.chunk_id for r in ask.rerank(kept, rows, failing, Config(reranked=2), Answers(spark)).orderBy("rank").collect()] == [1, 2]


def test_quotes(spark):
    sections, chunks = ask.index_documents(documents(spark))
    quote = asked(spark, [(3, 1, "The PRICE of the  contract is one hundred thousand and it:"), (4, 1, "The PRISE of the contract is one hundred thousand and it is:"), (5, 2, "This is nowhere in the text of the second document at all:")])
    got = {r.query_id: r for r in ask.ask(sections, chunks, quote, models.Models(correct=lambda q: F.replace(F.replace(q, F.lit("PRISE"), F.lit("price")), F.lit(":"), F.lit(""))), texts=documents(spark)).collect()}
    assert got[3].context.startswith("[1] source=1 (direct extract)\nThe price of the contract") and got[3].route == "quote"
    assert got[4].context == got[3].context and [s.section_title for s in got[4].sources] == ["direct extract"]
    assert got[3].answer == models.CONTEXT_FOUND and got[5].sources[0].section_title == "Place"
    assert ask.ask(sections, chunks, asked(spark, [(9, 1, "  \n")])).isEmpty()


def test_dense_lists_and_several_documents(spark):
    words = ["price", "goods", "said"]
    made = models.Models(embed=lambda t: F.array(*(F.contains(t, F.lit(w)).cast("float") + F.lit(0.01) for w in words)))
    sections, chunks = ask.index_documents(documents(spark))
    vectors = ask.embed_chunks(chunks, made)
    got = ask.ask(sections, chunks, asked(spark, [(1, 1, "said")]), made, Config(neighbours=0), vectors).first()
    assert got.sources[0].section_title == "Other"
    with pytest.raises(RuntimeError):
        ask.embed_chunks(chunks, models.Models())
    scope = spark.createDataFrame([(7, [1, 2], "price of the goods"), (8, [2], "price of the goods")], "query_id long, doc_ids array<long>, text string")
    both = {r.query_id: r for r in ask.ask_across(sections, chunks, scope).collect()}
    assert both[7].documents == 2 and "source=1" in both[7].context and "source=2" in both[7].context
    assert both[8].documents == 1 and "source=1" not in both[8].context


def test_dates_over_documents(spark):
    many = "\n\n".join(f"Событие номер {i} случилось 01.02.{1950 + i} в городе." for i in range(25))
    docs = spark.createDataFrame([(1, "Договор подписан 05.03.2020 обеими сторонами."), (2, "Здесь нет ничего такого, о чём спрашивают."), (3, many), (4, "Договор подписан 05.03.2020 и ещё 06.03.2021 сторонами.")], "doc_id long, text string")
    alone = {r.doc_id: r for r in date_replies(docs).collect()}
    assert alone[1].answer == "Найдённые даты в документе:\n- 05.03.2020" and alone[1].context == "[1] source=1 section=date-scan\nДоговор подписан 05.03.2020 обеими сторонами."
    assert alone[2].answer == "В документе не удалось уверенно найти даты." and alone[2].context == "" and alone[2].found == 0
    assert alone[3].found == 12 and alone[3].context.count("section=date-scan") == 6
    sections, chunks = ask.index_documents(docs)
    scope = spark.createDataFrame([(1, [4, 2, 1], "Какие даты?"), (2, [2], "Когда это было"), (3, [3, 1, 4], "сроки"), (4, [1], "Кто подписал")], "query_id long, doc_ids array<long>, text string")
    got = {r.query_id: r for r in ask.ask_across(sections, chunks, scope, texts=docs).collect()}
    assert got[1].answer == "Найдённые даты в выбранных документах:\n- 05.03.2020\n- 06.03.2021" and got[1].answer_source == "deterministic" and got[1].route == "date"
    assert [s.source for s in got[1].sources] == ["4", "1"] and got[1].blocks == 2
    assert got[2].answer == "Найдённые даты в выбранных документах:\n" and got[2].sources == [] and got[2].context == ""
    assert len(got[3].sources) == 12 and got[3].documents == 3 and got[4].route == "simple" and got[4].answer_source == "fallback"


def test_stored_index_gives_the_rows_of_bm25(spark):
    texts = ["a b a", "b c", "a", "", None, "c c c d", "x y", "a a a a b"]
    chunks = spark.createDataFrame([(d, i, t) for d in (1, 2, 3) for i, t in enumerate(texts[d - 1 :])] + [(4, 0, "only one")], "doc_id long, chunk_id int, text string")
    queries = spark.createDataFrame([(1, 1, "a b a"), (2, 2, "zzz"), (3, 3, "c d"), (4, 4, "one"), (5, 1, ""), (6, 9, "a")], "query_id long, doc_id long, text string")
    posted, sized = index.postings(chunks), index.sizes(chunks)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "chunk_id", F.round("score", 9)).collect()))
    for k in (1, 2, 5, 50):
        assert rows(index.search(posted, sized, queries, k)) == rows(retrieval.bm25(chunks, queries, k, ("doc_id",))), k
        every = queries.select("query_id", "text")
        assert rows(index.search(posted, sized, every, k)) == rows(retrieval.bm25(chunks, every, k, ("doc_id",))), k


def test_library(spark, tmp_path):
    summarise, summed = counted(spark, lambda title, text: f"{title}: {text[:40]}")
    embed, embedded = counted(spark, lambda t: [float(len(t)), 1.0], "array<float>")
    library = Library(spark, f"file://{tmp_path}/l", models.Models(summarise=summarise, embed=embed), buckets=8)
    rows = spark.createDataFrame([("d1", "a.md", "a", DOCS[0][1], None), ("d2", "b.md", "b", DOCS[1][1], None), ("d3", "c.md", "c", None, "cannot read"), ("d4", "d.md", "d", None, None), (None, "e.md", "e", "x", None)], "doc_id string, source string, document_name string, raw_text string, error string")
    assert library.ingest(rows) == 1
    assert {r.doc_id: r.error for r in library.read("errors").collect()} == {"d3": "cannot read", "d4": "no text"}
    assert sorted(r.doc_id for r in library.read("catalog").collect()) == ["d1", "d2"] and summed.value == 3 and embedded.value == 6
    state = lambda: {n: sorted(map(str, library.read(n).collect())) for n in ("catalog", "sections", "chunks", "postings", "sizes", "vectors", "summary_vectors", "errors")}
    before = state()
    library.ingest(rows)
    assert state() == before and summed.value == 3 and embedded.value == 6  # a rerun gives equal rows and costs no call
    broken = Library(spark, f"file://{tmp_path}/l", models.Models(embed=lambda t: F.raise_error(F.lit("no model")).cast("array<float>")), buckets=8)
    with pytest.raises(Exception):
        broken.ingest(spark.createDataFrame([("d1", "a.md", "a", "# New\nall is new", None)], rows.schema))
    assert state() == before
    publish = library.tables._publish
    library.tables._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the commit"))
    with pytest.raises(RuntimeError):
        library.ingest(spark.createDataFrame([("d1", "a.md", "a", "# New\nall is new", None)], rows.schema))
    library.tables._publish = publish
    assert state() == before
    questions = spark.createDataFrame([(1, "d1", "What is the price"), (2, "d9", "unknown document")], "query_id long, doc_id string, text string")
    got = {r.query_id: r for r in library.ask(questions).collect()}
    assert got[1].sources[0].source == "a.md" and MONEY in got[1].context and got[2].blocks == 0 and got[2].answer == models.NOTHING_FOUND
    fresh = ask.index_documents(spark.createDataFrame([("d1", DOCS[0][1])], "doc_id string, text string"), models=library.models, answers=library.answers)
    made = ask.ask(*fresh, questions.where("query_id = 1"), library.models, vectors=library.read("vectors").where("doc_id = 'd1'")).first()
    assert [s.chunk_id for s in made.sources] == [s.chunk_id for s in got[1].sources]
    library.ingest(spark.createDataFrame([("d3", "c.md", "c", "# Now\nit can be read", None), ("d1", "a.md", "a", None, "gone bad")], rows.schema))
    assert {r.doc_id for r in library.read("errors").collect()} == {"d1", "d4"} and library.read("sections").where("doc_id = 'd1'").count() == 2
    both = library.ask_across(spark.createDataFrame([(1, ["d2", "d3"], "goods")], "query_id long, doc_ids array<string>, text string")).first()
    assert both.documents == 2 and "source=b.md" in both.context
    library.delete(spark.createDataFrame([("d1",), ("d4",)], "doc_id string"))
    assert all(r.doc_id not in ("d1", "d4") for n in before for r in library.read(n).select("doc_id").distinct().collect())
    assert library.read("postings").where("doc_id = 'd2'").count() > 0


def test_text_from_chunks(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/l", buckets=2)
    library.ingest(spark.createDataFrame([("d1", DOCS[0][1])], "doc_id string, raw_text string"))
    library.tables.commit({"catalog": library.read("catalog").withColumn("raw_text", F.lit(None).cast("string"))})
    assert library.texts(spark.createDataFrame([("d1",)], "doc_id string")).first().text == f"# Money\n{MONEY}\n\n# Other\n{OTHER}"


def test_files_into_the_library(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(DOCS[0][1])
    (tmp_path / "in" / "bad.docx").write_text("no archive")
    (tmp_path / "in" / "no.exe").write_text("x")
    library = Library(spark, f"file://{tmp_path}/l", buckets=4)
    library.ingest_folder(f"file://{tmp_path}/in", "F", originals=f"file://{tmp_path}/kept")
    row = library.read("catalog").first()
    assert (row.document_name, row.document_folder, row.source_type, row.original_filename) == ("a", "F", "md", "a.md")
    assert row.stored_source_path == f"file://{tmp_path}/kept/{row.doc_id}.md" and (tmp_path / "kept" / f"{row.doc_id}.md").read_text() == DOCS[0][1]
    assert "BadZipFile" in library.read("errors").first().error
    (tmp_path / "in" / "b.md").write_text(DOCS[1][1])
    library.watch(f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint", "F").awaitTermination()
    assert sorted(r.document_name for r in library.read("catalog").collect()) == ["a", "b"] and library.read("sections").count() == 3
    ids = {r.document_name: r.doc_id for r in library.read("catalog").collect()}
    library.export_bundles(f"file://{tmp_path}/bundles")
    bundle = json.loads((tmp_path / "bundles" / f"{ids['a']}.json").read_text())
    assert bundle["raw_text"] == DOCS[0][1] and [x["metadata"]["section_title"] for x in bundle["sections"]] == ["Money", "Other"] == [x["metadata"]["section_title"] for x in bundle["chunks"]]
    assert bundle["summaries"][0]["page_content"].startswith("# Money") and bundle["chunks"][1]["metadata"]["chunk_id"] == 1
    asked = spark.createDataFrame([(1, ids["a"], ids["b"], "что изменилось"), (2, ids["a"], "none", "x")], "query_id int, left_doc_id string, right_doc_id string, text string")
    got = {r.query_id: r for r in library.compare(asked).collect()}
    assert got[1].answer == "Измененных разделов: 0." and got[1].context.startswith("META:\nleft_document_name=a") and got[2].error


def test_questions_read_a_written_corpus(spark, monkeypatch):
    """Searches read written sections and chunks of the documents asked: no plan cuts documents again, or those not asked."""
    seen = []
    for name in ("ask_corpus", "across_corpus"):
        monkeypatch.setattr(ask, name, lambda corpus, *a: seen.append(corpus))
    sections, chunks = ask.index_documents(documents(spark))
    ask.ask(sections, chunks, asked(spark, [(1, 2, "price")]))
    ask.ask_across(sections, chunks, spark.createDataFrame([(1, [2, 9, 2], "price")], "query_id int, doc_ids array<int>, text string"))
    for corpus in seen:
        for df in (corpus.sections, corpus.chunks):
            assert df.select("doc_id").distinct().collect() == [(2,)] and "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 2


def test_bm25_deals_an_index_once(spark):
    df = spark.range(50).selectExpr("id % 5 as doc_id", "id as chunk_id", "'a b' as text")
    plan = retrieval.bm25(df, df.selectExpr("chunk_id as query_id", "doc_id", "'a' as text"), 3, ("doc_id",), fill=False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\((doc_id#\d+L?, word|word)", plan)
