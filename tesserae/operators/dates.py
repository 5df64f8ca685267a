"""Date evidence and date answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import find_dates, normalized_dates
from ..functions.text import collapse, unique_keep_order


def date_snippets(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 24) -> DataFrame:
    """(key, pos, snippet): a document's paragraphs with a date, at least 20 characters, distinct but for case, cut to 700."""
    parts = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n{2,}")).alias("at", "part")).withColumn("snippet", collapse(F.col("part")))
    dated = parts.where((F.length("snippet") >= 20) & (F.size(find_dates(F.col("snippet"))) > 0))
    once = dated.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.lower("snippet")).orderBy("at"))).where("_n = 1")
    ranked = once.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("pos") <= most)
    return ranked.select(key, "pos", F.substring("snippet", 1, 700).alias("snippet"))


def date_evidence(snippets: DataFrame, key: str = "doc_id", most: int = 12) -> DataFrame:
    """(key, pos, snippet, dates): the first snippets, of three times as many, that keep a valid date."""
    dated = snippets.where(F.col("pos") <= 3 * most).withColumn("dates", normalized_dates(F.col("snippet"))).where(F.size("dates") > 0)
    return dated.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("pos") <= most)


def date_answer(evidence: DataFrame, key: str = "doc_id", limit: int = 20) -> DataFrame:
    """(key, dates, found): all dates of a document's evidence in order, the first ``limit``, and how many there are."""
    whole = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "dates"))).alias("e"))
    dates = unique_keep_order(F.flatten("e.dates"))
    return whole.select(key, F.slice(dates, 1, limit).alias("dates"), F.size(dates).alias("found"))


#: Answers with dates (fixed values).
IN_DOCUMENT, IN_DOCUMENTS, NO_DATES = "Найдённые даты в документе:\n", "Найдённые даты в выбранных документах:\n", "В документе не удалось уверенно найти даты."
JOINT = "\n\n---\n\n"


def _listed(head: str, dates: Column, limit: int) -> Column:
    """An answer: the first dates line by line, and a notice if there are more."""
    shown = F.slice(dates, 1, limit)
    more = F.concat(F.lit("\n\nПоказаны первые "), F.size(shown).cast("string"), F.lit(" дат из "), F.size(dates).cast("string"), F.lit(" найденных."))
    return F.concat(F.lit(head), F.array_join(F.transform(shown, lambda d: F.concat(F.lit("- "), d)), "\n"), F.when(F.size(dates) > limit, more).otherwise(""))


def date_reply(evidence: DataFrame, key: str = "doc_id", limit: int = 20, cited: int = 6) -> DataFrame:
    """(key, answer, context, evidence, found) of each document with evidence: the answer in words, its first snippets as context, all as citations."""
    whole = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("index"), F.col("snippet").alias("text"), "dates"))).alias("e"))  # at most 12
    dates = unique_keep_order(F.flatten("e.dates"))
    block = lambda e: F.concat(F.lit("["), e["index"].cast("string"), F.lit("] source="), F.col(key).cast("string"), F.lit(" section=date-scan\n"), e["text"])
    context = F.array_join(F.transform(F.slice("e", 1, cited), block), JOINT)
    return whole.select(key, _listed(IN_DOCUMENT, dates, limit).alias("answer"), context.alias("context"), F.col("e").alias("evidence"), F.size(dates).alias("found"))


def date_replies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``date_reply`` of all documents (key, text); without dates the answer says so and there is no context."""
    found = date_reply(date_evidence(date_snippets(docs, key), key), key)
    return docs.select(key).join(found, key, "left").select(key, F.coalesce("answer", F.lit(NO_DATES)).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), "evidence", F.coalesce("found", F.lit(0)).alias("found"))


def merged_dates(replies: DataFrame, scope: DataFrame, limit: int = 20, most: int = 12) -> DataFrame:
    """(query_id, route, context, blocks, sources, documents, answer, answer_source) of questions over documents (``scope``: query_id, o, doc_id).

    The dates shown for each document, in the order of the scope, each once; contexts joined; the first ``most`` snippets as sources.
    """
    cited = F.transform(F.coalesce("evidence", F.array().cast("array<struct<index: int, text: string, dates: array<string>>>")), lambda e: F.struct(e["index"].alias("index"), F.col("doc_id").cast("string").alias("source"), F.lit("date-scan").alias("section_title"), *(F.lit(None).cast("int").alias(c) for c in ("section_id", "chunk_id", "start_index")), e["text"].alias("text")))
    one = F.struct("o", find_dates(F.coalesce("answer", F.lit(""))).alias("dates"), F.nullif("context", F.lit("")).alias("context"), cited.alias("cited"))
    each = scope.join(replies, "doc_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("d"))  # the documents of one question
    dates = unique_keep_order(F.flatten("d.dates"))
    contexts = F.filter("d.context", lambda c: c.isNotNull())
    return each.select("query_id", F.lit("date").alias("route"), F.array_join(contexts, JOINT).alias("context"), F.size(contexts).alias("blocks"), F.slice(F.flatten("d.cited"), 1, most).alias("sources"), F.size("d").alias("documents"), _listed(IN_DOCUMENTS, dates, limit).alias("answer"), F.lit("deterministic").alias("answer_source"))
