"""Question answering over many documents at once, without or with models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.dates import asks_for_dates
from ..functions.routing import route
from ..functions.text import collapse, normalize_query, strip, strip_bullets, unique_keep_order
from ..operators import models as m
from ..operators.dates import date_evidence, date_reply, date_snippets, merged_dates
from ..operators.index import search
from ..operators.retrieval import BROADCAST_BYTES, add_neighbours, bm25, build_context, cite, drop_low_information, inject_hints, knn, rrf, scan_sections
from ..operators.sections import chunk_sections, outline, split_into_sections, summaries
from ..operators.stages import Answers
from ..storage import save

PLAN = ("dense_queries", "bm25_queries", "section_titles")
SOURCE = "array<struct<index: int, source: string, section_title: string, section_id: int, chunk_id: int, start_index: int, text: string>>"
NONE = "array<string>"


@dataclass(frozen=True)
class Corpus:
    """What is asked: sections (doc_id, section_id, section_title, page_content, summary), chunks (doc_id, section_id,
    section_title, chunk_id, start_index, text), and where there are any: vectors (doc_id, chunk_id, embedding) of chunks and (doc_id,
    section_id, embedding) of summaries, and a written index of both (``postings``, ``sizes`` with a level)."""

    sections: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    summary_vectors: DataFrame | None = None
    postings: DataFrame | None = None
    sizes: DataFrame | None = None

    def words(self, level: str, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, rank, id): the best chunks (level chunk) or sections by their summaries (level summary) of each query's document."""
        if self.postings is not None:
            found = search(self.postings.where(F.col("level") == level), self.sizes.where(F.col("level") == level), queries, k)
            return found.select("query_id", "doc_id", "rank", F.col("chunk_id").alias("id"))
        if level == "chunk":
            return bm25(self.chunks, queries, k, ("doc_id",)).select("query_id", "doc_id", "rank", F.col("chunk_id").alias("id"))
        rows = self.sections.select("doc_id", "section_id", F.col("summary").alias("text"))
        return bm25(rows, queries, k, ("doc_id",), "section_id").select("query_id", "doc_id", "rank", F.col("section_id").alias("id"))

    def nearest(self, level: str, queries: DataFrame, k: int) -> DataFrame | None:
        vectors, key = (self.vectors, "chunk_id") if level == "chunk" else (self.summary_vectors, "section_id")
        if vectors is None:
            return None
        found = knn(vectors, queries, k, key, ("doc_id",))
        return found.join(queries.select("query_id", "doc_id"), "query_id").select("query_id", "doc_id", "rank", F.col(key).alias("id"))


def index_documents(docs: DataFrame, config: Config = DEFAULT, models: m.Models = m.Models(), cache: DataFrame | None = None, answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections with summaries, chunks) of (doc_id, text).

    Summaries are those of ``cache`` (key, summary), else the model's for sections that have none there, else the section's start.
    """
    split = split_into_sections(docs)
    if models.summarise is None:
        sections = summaries(split, cache, config)
    else:
        keyed = summaries(split, None, config)
        known = keyed if cache is None else keyed.join(cache.select(F.col("key").alias("summary_key"), F.col("summary").alias("_cached")), "summary_key", "left")
        text = strip(F.col("page_content"))
        asked = text if cache is None else F.when(F.col("_cached").isNull(), text)
        made = (answers or Answers(docs.sparkSession)).once(known, "made_summary", {"text": F.substring(asked, 1, 6000), "title": F.col("section_title"), "key": F.col("summary_key")}, lambda text, title, _: models.summarise(title, text))
        own = [F.col("_cached")] if cache is not None else []
        sections = made.withColumn("summary", F.coalesce(*own, strip(F.col("made_summary")), F.substring(text, 1, config.summary_chars))).drop("_cached", "made_summary")
    return sections, chunk_sections(sections, config=config).withColumnRenamed("page_content", "text")


def embed_chunks(chunks: DataFrame, models: m.Models) -> DataFrame:
    """(doc_id, chunk_id, text, embedding) of chunks."""
    return chunks.select("doc_id", "chunk_id", "text", m.embedded(models, F.col("text")).alias("embedding"))


def _first(items: list[Column], most: int) -> Column:
    return F.slice(unique_keep_order(F.concat(*items)), 1, most)


def phrase(questions: DataFrame, models: m.Models, config: Config, answers: Answers) -> DataFrame:
    """``questions`` (.., text[, mode]) with text, mode, route, working, corrected, dense, bm25 (phrasings) and parts (of a complex one), written.

    Each model stage is asked once for each distinct input.
    """
    mode = F.coalesce("mode", F.lit(config.answer_mode)) if "mode" in questions.columns else F.lit(config.answer_mode)
    rows = questions.withColumn("text", strip(F.col("text"))).withColumn("mode", mode).withColumn("route", route(F.col("text")))
    rows = rows.withColumn("working", F.when(F.col("route") == "quote", F.col("text")).otherwise(normalize_query(F.col("text"))))
    rows = answers.once(rows, "correct", {"query": F.col("working")}, models.correct)
    rows = rows.withColumn("corrected", F.coalesce(F.nullif(collapse(F.col("correct")), F.lit("")), F.col("working")))
    rows = answers.once(rows, "variants", {"query": normalize_query(F.col("corrected"))}, models.variants)
    rows = answers.once(rows, "decompose", {"query": F.when(F.col("route") == "complex", F.col("corrected"))}, models.decompose)
    said = m.said_lists(F.col("variants"), ("dense", "bm25"))
    own = F.array("working", "corrected", normalize_query(F.col("corrected")))
    rows = rows.withColumn("dense", _first([own, said["dense"]], config.variants)).withColumn("bm25", _first([own, F.slice(said["bm25"], 1, 2)], config.variants))
    rows = rows.withColumn("parts", F.slice(unique_keep_order(strip_bullets(F.coalesce("decompose", F.lit("")))), 1, config.subquestions))
    return save(rows.drop("correct", "variants", "decompose"), "questions")


def _groups(asked: DataFrame, models: m.Models, answers: Answers, keys: tuple[str, ...]) -> DataFrame:
    """(keys, g, doc_id, dense, bm25, forced): the question itself (g 0, with the sections ``forced`` on it if there are any) and its parts."""
    whole = asked.select(*keys, F.lit(0).alias("g"), "doc_id", "dense", "bm25", "forced")
    if models.decompose is None:
        return whole
    parts = asked.select(*keys, "doc_id", F.posexplode("parts").alias("i", "part"))
    said = m.said_lists(F.col("variants"), ("dense", "bm25"))
    parts = answers.once(parts, "variants", {"query": normalize_query(F.col("part"))}, models.variants)
    own = F.array("part", normalize_query(F.col("part")))
    return whole.unionByName(parts.select(*keys, (F.col("i") + 1).alias("g"), "doc_id", _first([own, said["dense"]], 3).alias("dense"), _first([own, said["bm25"]], 2).alias("bm25"), F.array().cast("array<int>").alias("forced")))


def _planned(corpus: Corpus, asked: DataFrame, models: m.Models, config: Config, answers: Answers) -> DataFrame:
    """``asked`` with the planner's phrasings among its own, and ``titled``: sections whose titles the planner names, in document order."""
    if models.plan is None:
        return asked.withColumn("titled", F.array().cast("array<int>"))
    rows = answers.once(asked.join(outline(corpus.sections), "doc_id", "left"), "plan", {"outline": F.nullif(strip(F.col("outline")), F.lit("")), "query": F.col("text")}, models.plan)
    said = m.said_lists(F.col("plan"), PLAN)
    rows = rows.withColumn("dense", _first([F.col("dense"), F.slice(unique_keep_order(said["dense_queries"]), 1, 4)], config.variants)).withColumn("bm25", _first([F.col("bm25"), F.slice(unique_keep_order(said["bm25_queries"]), 1, 4)], config.variants))
    rows = rows.withColumn("_titles", F.transform(F.slice(unique_keep_order(said["section_titles"]), 1, 5), F.lower)).drop("plan", "outline")
    title = F.lower(strip(F.col("section_title")))
    held = F.exists("_titles", lambda t: F.contains(title, t) | F.contains(t, title))
    named = rows.select("query_id", "doc_id", "_titles").join(corpus.sections.select("doc_id", "section_id", "section_title"), "doc_id").where((title != "") & held)
    found = named.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set(F.col("section_id").cast("int"))).alias("titled"))
    return save(rows.drop("_titles").join(found, ["query_id", "doc_id"], "left").withColumn("titled", F.coalesce("titled", F.array().cast("array<int>"))), "planned")


def _lists(groups: DataFrame, kind: str) -> DataFrame:
    """Queries (query_id: group and number, doc_id, text) of a kind of phrasing."""
    rows = groups.select(F.col("query_id").alias("q"), "doc_id", F.posexplode(kind).alias("v", "text"))
    return rows.select(F.struct("q", "v").alias("query_id"), "doc_id", "text")


def _searched(corpus: Corpus, level: str, groups: DataFrame, models: m.Models, dense_k: int, bm25_k: int) -> DataFrame:
    """(query_id, list_no, rank, doc_id, id): dense lists of all phrasings, then those by words."""
    by_words = corpus.words(level, _lists(groups, "bm25"), bm25_k)
    out = by_words.select(F.col("query_id.q").alias("query_id"), (F.col("query_id.v") + 100).alias("list_no"), "rank", "doc_id", "id")
    if (corpus.vectors if level == "chunk" else corpus.summary_vectors) is not None:
        near = corpus.nearest(level, _lists(groups, "dense").withColumn("embedding", m.embedded(models, F.col("text"))), dense_k)
        out = out.unionByName(near.select(F.col("query_id.q").alias("query_id"), F.col("query_id.v").alias("list_no"), "rank", "doc_id", "id"))
    return out


def retrieve(corpus: Corpus, groups: DataFrame, models: m.Models, config: Config) -> tuple[DataFrame, DataFrame]:
    """Of groups (query_id, doc_id, dense, bm25, forced): (query_id, rank, doc_id, chunk_id) fused, and (query_id, hint_no, doc_id, section_id).

    Sections that summaries point to follow the ``forced`` ones; the chunks of each are a list like those of the searches.
    """
    by_summary = _searched(corpus, "summary", groups, models, config.summary_dense_k, config.summary_bm25_k)
    hints = rrf(by_summary.withColumnRenamed("id", "section_id"), ("doc_id", "section_id"), config.hint_rrf_k, config.boosted_sections)
    pointed = hints.select("query_id", "doc_id", F.col("section_id").cast("int").alias("section_id"), F.lit(1).alias("o"), F.col("rank").cast("int").alias("rank"))
    pointed = pointed.unionByName(groups.select("query_id", "doc_id", F.posexplode("forced").alias("rank", "section_id")).withColumn("o", F.lit(0)))
    once = pointed.groupBy("query_id", "doc_id", "section_id").agg(F.min(F.struct("o", "rank")).alias("at"))
    hinted = save(once.select("query_id", "doc_id", "section_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "section_id")).alias("hint_no")), "hints")
    of_hints = hinted.join(corpus.chunks.select("doc_id", "section_id", "chunk_id"), ["doc_id", "section_id"])
    of_hints = of_hints.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "hint_no").orderBy("chunk_id")))
    lists = _searched(corpus, "chunk", groups, models, config.dense_k, config.bm25_k).withColumnRenamed("id", "chunk_id")
    lists = lists.unionByName(of_hints.select("query_id", (F.col("hint_no") + 1000).alias("list_no"), "rank", "doc_id", "chunk_id"))
    return rrf(lists, ("doc_id", "chunk_id"), config.rrf_k, config.fused).drop("score"), hinted


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rerank(kept: DataFrame, asked: DataFrame, models: m.Models, config: Config, answers: Answers) -> DataFrame:
    """The first ``reranked`` rows of each question (query_id, rank, .., text) by the scoring model, else by the order that a model
    names in one call a question, else by rank; where a model fails its rows keep their rank."""
    if models.rerank:
        rows = answers.once(kept.join(asked.select("query_id", F.col("corrected").alias("_q")), "query_id"), "relevance", {"query": F.col("_q"), "text": F.substring("text", 1, 1500)}, models.rerank, "double").drop("_q")
        order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), "rank")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.reranked).drop("relevance")
    if models.order is None:
        return kept.where(F.col("rank") <= config.reranked)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.translate(F.substring("text", 1, 700), "\n", " "))
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))  # at most ``fused``
    listed = listed.join(asked.select("query_id", "corrected"), "query_id").select("query_id", "corrected", F.array_join("l.line", "\n").alias("listed"), F.size("l").alias("n"))
    said = answers.once(listed, "named", {"query": F.col("corrected"), "listed": F.col("listed")}, models.order)
    picked = said.select("query_id", F.posexplode(m.chosen_numbers(F.col("named"), F.col("n"), config.reranked)).alias("_r", "rank"))
    return kept.join(picked, ["query_id", "rank"]).withColumn("rank", F.col("_r") + 1).drop("_r")


def sources(rows: DataFrame) -> DataFrame:
    """(query_id, sources): the rows (query_id, pos, source, section_title, section_id, chunk_id, start_index, text) as citations from 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    whole = lambda c: F.col(c).cast("int").alias(c)
    item = F.struct(whole("index"), text("source"), text("section_title"), whole("section_id"), whole("chunk_id"), whole("start_index"), strip(F.col("text")).alias("text"))
    return cite(rows).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("sources"))


def _answered(rows: DataFrame, models: m.Models, answers: Answers) -> DataFrame:
    """``rows`` (text, context, mode) with answer and answer_source: the model's, else the one that needs none."""
    made = answers.once(rows, "made", {"context": F.col("context"), "query": F.col("text"), "mode": F.col("mode")}, models.answer)
    return made.withColumn("answer", F.coalesce("made", m.fallback_answer(F.col("context"), F.col("text")))).withColumn("answer_source", F.when(F.col("made").isNotNull(), "llm").otherwise("fallback")).drop("made")


def _with_context(asked: DataFrame, placed: DataFrame, config: Config) -> DataFrame:
    """Questions with context, blocks and sources of the chunks placed for them."""
    out = asked.join(build_context(placed, config.context_chars), "query_id", "left").join(sources(placed), "query_id", "left")
    return out.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("blocks", F.coalesce("blocks", F.lit(0))).withColumn("sources", F.coalesce("sources", F.array().cast(SOURCE)))


def _chunks(corpus: Corpus) -> DataFrame:
    return corpus.chunks if "source" in corpus.chunks.columns else corpus.chunks.withColumn("source", F.col("doc_id").cast("string"))


def ask_corpus(corpus: Corpus, questions: DataFrame, models: m.Models = m.Models(), config: Config = DEFAULT, texts: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """(query_id, doc_id, route, context, blocks, sources, answer, answer_source) of each question (query_id, doc_id, text[, mode]) on its document.

    A quote that ``texts`` (doc_id, text) holds, as asked or corrected, has the passage as its context. All others: the phrasings
    of question, model and planner are searched, sections that the planner, the section scan and the summaries point to
    add their chunks, parts of a complex question are searched alike and fused; then informative chunks, the
    model's order, neighbours, hinted chunks, context. Empty questions have no row.
    """
    answers = answers or Answers(questions.sparkSession)
    asked = phrase(questions.where(strip(F.col("text")) != ""), models, config, answers)
    direct = None
    if texts is not None:
        raw = asked.where("route = 'quote'").join(texts.select("doc_id", F.col("text").alias("_raw")), "doc_id")
        passage = F.coalesce(m.quoted(F.col("_raw"), F.col("working")), m.quoted(F.col("_raw"), F.col("corrected")))
        direct = save(raw.withColumn("passage", passage).where("passage is not null").drop("_raw"), "quotes")
        asked = asked.join(direct.select("query_id"), "query_id", "left_anti")
    asked = _planned(corpus, asked, models, config, answers)
    scanned = scan_sections(corpus.sections, asked.select("query_id", "doc_id", F.array_join(F.concat("dense", "bm25"), " ").alias("text")))
    scanned = scanned.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section_id"))), lambda x: x["section_id"].cast("int")).alias("scanned"))
    forced = asked.join(scanned, "query_id", "left").withColumn("forced", F.array_distinct(F.concat("titled", F.coalesce("scanned", F.array().cast("array<int>")))))
    groups = _groups(forced, models, answers, ("query_id",)).withColumn("query_id", F.struct(F.col("query_id").alias("q"), "g"))
    fused, hinted = retrieve(corpus, save(groups, "groups"), models, config)
    fused = save(rrf(fused.select(F.col("query_id.q").alias("query_id"), F.col("query_id.g").alias("list_no"), "rank", "doc_id", "chunk_id"), ("doc_id", "chunk_id"), config.rrf_k, config.fused), "fused")
    chunks = _chunks(corpus)
    kept = _numbered(drop_low_information(fused.join(chunks, ["doc_id", "chunk_id"])))
    first = drop_low_information(rerank(kept, asked, models, config, answers))
    near = drop_low_information(add_neighbours(first.select("query_id", "rank", "doc_id", "chunk_id"), chunks, config.neighbours))
    hints = hinted.where("query_id.g = 0").select(F.col("query_id.q").alias("query_id"), "hint_no", "doc_id", "section_id")
    placed = save(inject_hints(near, hints, chunks).join(chunks, ["doc_id", "chunk_id"]), "placed")
    keep = ["query_id", "doc_id", "text", "mode", "route", "context", "blocks", "sources"]
    found = _with_context(asked, placed, config).select(*keep)
    if direct is not None:
        cited = F.struct(F.lit(1).alias("index"), F.col("doc_id").cast("string").alias("source"), F.lit("direct extract").alias("section_title"), *(F.lit(None).cast("int").alias(c) for c in ("section_id", "chunk_id", "start_index")), F.col("passage").alias("text"))
        head = F.concat(F.lit("[1] source="), F.col("doc_id").cast("string"), F.lit(" (direct extract)\n"), "passage")
        found = found.unionByName(direct.withColumn("context", head).withColumn("blocks", F.lit(1)).withColumn("sources", F.array(cited).cast(SOURCE)).select(*keep))
    return _answered(found, models, answers).select("query_id", "doc_id", "route", "context", "blocks", "sources", "answer", "answer_source")


def _corpus(sections: DataFrame, chunks: DataFrame, vectors: DataFrame | None, asked: DataFrame) -> Corpus:
    """The documents asked (doc_id), written once: every search reads them, and no plan holds how they were made."""
    wanted = save(asked.distinct(), "asked")
    return Corpus(*(save(df.join(wanted, "doc_id", "left_semi"), name) for df, name in ((sections, "sections"), (chunks, "chunks"))), vectors)


def ask(sections: DataFrame, chunks: DataFrame, questions: DataFrame, models: m.Models = m.Models(), config: Config = DEFAULT, vectors: DataFrame | None = None, texts: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """``ask_corpus`` over sections and chunks that no index is written for."""
    return ask_corpus(_corpus(sections, chunks, vectors, questions.select("doc_id")), questions, models, config, texts, answers)


def ask_across(sections: DataFrame, chunks: DataFrame, questions: DataFrame, models: m.Models = m.Models(), config: Config = DEFAULT, vectors: DataFrame | None = None, texts: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """``across_corpus`` over sections and chunks that no index is written for."""
    return across_corpus(_corpus(sections, chunks, vectors, questions.select(F.explode("doc_ids").alias("doc_id"))), questions, models, config, texts, answers)


def documents_asked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is in ``ids``: found where they are read, by ids that go to all tasks if they are few bytes, so texts are not shuffled for it."""
    wanted = save(ids.select("doc_id").where("doc_id is not null").distinct(), "asked")
    size = wanted.agg(F.sum(16 + F.length(F.col("doc_id").cast("string")))).first()[0] or 0
    return docs.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "doc_id", "left_semi")


def across_documents(docs: DataFrame, questions: DataFrame, models: m.Models = m.Models(), config: Config = DEFAULT, texts: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """``across_corpus`` over documents (doc_id, text) that are not cut yet: those asked are, and written once."""
    answers = answers or Answers(questions.sparkSession)
    sections, _ = index_documents(documents_asked(docs, questions.select(F.explode("doc_ids").alias("doc_id"))), config, models, None, answers)
    sections = save(sections, "sections")
    chunks = save(chunk_sections(sections, config=config).withColumnRenamed("page_content", "text"), "chunks")
    return across_corpus(Corpus(sections, chunks), questions, models, config, texts, answers)


def across_corpus(corpus: Corpus, questions: DataFrame, models: m.Models = m.Models(), config: Config = DEFAULT, texts: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """(query_id, route, context, blocks, sources, documents, answer, answer_source) of each question (query_id, doc_ids, text[, mode]) over several documents.

    A question for dates is answered from the dates of all its documents where ``texts`` are given. All others: the lists of each
    document of the scope, in the order given, and of each part of a complex question are fused over the documents; then
    the model's order, neighbours and context.
    """
    answers = answers or Answers(questions.sparkSession)
    rows = questions.where(strip(F.col("text")) != "").withColumn("doc_ids", F.array_distinct("doc_ids"))
    dated = None
    if texts is not None:
        dated = ask_for_dates(texts, rows.where(asks_for_dates(F.col("text"))))
        rows = rows.where(~asks_for_dates(F.col("text")))
    asked = phrase(rows, models, config, answers)
    scoped = asked.select("query_id", F.posexplode("doc_ids").alias("o", "doc_id"), "dense", "bm25", "parts").withColumn("forced", F.array().cast("array<int>"))
    groups = _groups(scoped, models, answers, ("query_id", "o")).withColumn("query_id", F.struct(F.col("query_id").alias("q"), "o", "g")).drop("o")
    fused, _ = retrieve(corpus, save(groups, "groups"), models, config)
    number = F.col("query_id.o") * (config.subquestions + 1) + F.col("query_id.g")
    fused = save(rrf(fused.select(F.col("query_id.q").alias("query_id"), number.alias("list_no"), "rank", "doc_id", "chunk_id"), ("doc_id", "chunk_id"), config.rrf_k, config.fused), "fused")
    chunks = _chunks(corpus)
    first = rerank(fused.drop("score").join(chunks, ["doc_id", "chunk_id"]), asked, models, config, answers)
    placed = save(add_neighbours(first.select("query_id", "rank", "doc_id", "chunk_id"), chunks, config.neighbours), "placed")
    out = _answered(_with_context(asked.withColumn("documents", F.size("doc_ids")), placed, config), models, answers).select("query_id", "route", "context", "blocks", "sources", "documents", "answer", "answer_source")
    return out if dated is None else out.unionByName(dated)


def ask_for_dates(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """As ``across_corpus`` for questions (query_id, doc_ids, text[, mode]) whose answer is the dates of ``texts`` (doc_id, text)."""
    scope = questions.select("query_id", F.posexplode(F.array_distinct("doc_ids")).alias("o", "doc_id"))
    wanted = texts.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    return merged_dates(date_reply(date_evidence(date_snippets(wanted))), scope)
