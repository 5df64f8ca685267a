"""Model-backed stages as injected functions; without one each takes its deterministic way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import asks_for_dates, find_dates
from ..functions.text import collapse, json_fragment, let, strip, unique_keep_order

#: Answers without a model (fixed values).
DATES_FOUND = "LLM недоступен, поэтому показываю даты, найденные в контексте:\n"
CONTEXT_FOUND = "LLM недоступен. Поиск нашёл релевантные фрагменты, но автоматически сформировать надёжный ответ без модели не удалось."
NOTHING_FOUND = "LLM недоступен, и поиск не собрал достаточный контекст для ответа."


@dataclass(frozen=True)
class Models:
    """Each field maps columns to a column (a pandas UDF, say) that is null where the model fails.

    What models say is their raw text, taken apart here: ``variants`` (query) and ``plan`` (outline, query) answer with a
    JSON object, ``decompose`` (query) with a line for each part, ``order`` (query, numbered texts) with the numbers of the best.
    ``rerank`` (query, text) is a score, ``embed`` (text) a vector, ``answer`` is of
    (context, query, mode), ``compare`` of (context, question).
    """

    summarise: Callable[[Column, Column], Column] | None = None
    correct: Callable[[Column], Column] | None = None
    variants: Callable[[Column], Column] | None = None
    answer: Callable[[Column, Column, Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    order: Callable[[Column, Column], Column] | None = None
    embed: Callable[[Column], Column] | None = None
    decompose: Callable[[Column], Column] | None = None
    plan: Callable[[Column, Column], Column] | None = None
    compare: Callable[[Column, Column], Column] | None = None


def said_lists(raw: Column, names: tuple[str, ...]) -> Column:
    """The named lists of strings of the first JSON object in a model's text; empty where there is none or it is malformed."""
    none = F.array().cast("array<string>")
    given = F.from_json(json_fragment(raw), ", ".join(f"{n} array<string>" for n in names) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return let(given, lambda g: F.struct(*(F.when(g["_bad"].isNull(), F.filter(F.coalesce(g[n], none), lambda x: x.isNotNull())).otherwise(none).alias(n) for n in names)))


def chosen_numbers(raw: Column, n: Column, top: int) -> Column:
    """The numbers in a model's text that are 1 to ``n``, each once, the first ``top``; without any, 1 to ``top``."""
    found = F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    fine = F.slice(F.array_distinct(F.filter(found, lambda x: x.between(1, n))), 1, top)
    return let(fine, lambda f: F.when(F.size(f) > 0, f).when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(top)))).otherwise(F.array().cast("array<int>")))


def fallback_answer(context: Column, query: Column, most: int = 20) -> Column:
    dates = unique_keep_order(find_dates(context))
    more = F.when(F.size(dates) > most, F.concat(F.lit(f"\n\nПоказаны первые {most} дат из "), F.size(dates).cast("string"), F.lit(" найденных в контексте."))).otherwise("")
    listed = F.concat(F.lit(DATES_FOUND), F.array_join(F.transform(F.slice(dates, 1, most), lambda d: F.concat(F.lit("- "), d)), "\n"), more)
    return F.when(asks_for_dates(query) & (F.size(dates) > 0), listed).when(strip(context) != "", CONTEXT_FOUND).otherwise(NOTHING_FOUND)


def embedded(models: Models, text: Column) -> Column:
    """Vectors of texts; there is no stand-in for an embedding model."""
    if models.embed is None:
        raise RuntimeError("vectors need an embedding model")
    return models.embed(text)


def quoted(raw_text: Column, query: Column, most: int = 4500, loose: bool = True) -> Column:
    """The numbered point (or up to ``most`` characters) of a text that starts with the query's first 140 characters; else null.

    White space and case are of no account; a query under 40 characters is no quote. If not ``loose``, the start must stand in the
    text as asked but for case, and white space is that of ASCII. Texts are cut by patterns: positions of matches count
    UTF-16 units, those of substrings characters.
    """
    space, digit = (r"\s", r"\d") if loose else (r"[\t\n\f\r ]", "[0-9]")
    anchor = strip(F.substring(collapse(query), 1, 140)) if loose else F.substring(query, 1, 140)
    literal = F.transform(F.split(anchor, " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    number = F.nullif(F.regexp_extract(query, r"^\s*(\d{1,9})\.\s", 1), F.lit("")).cast("int")
    after = F.concat(F.lit(rf"\n{space}*"), F.coalesce((number + 1).cast("string"), F.lit(f"{digit}+")), F.lit(rf"\.{space}"))
    start = F.concat(F.lit("(?iuU)"), F.array_join(literal, r"\s+" if loose else " "), F.lit("(?s:.*)"))

    def cut(rest: Column) -> Column:
        tail = F.substring(rest, 2, 1 << 30)
        stopped = F.concat(F.substring(rest, 1, 1), F.split(tail, after, 2)[0])
        part = F.when(F.regexp_like(tail, after), stopped).otherwise(F.substring(rest, 1, most))
        return strip(part) if loose else F.regexp_replace(part, rf"^{space}+|{space}+\z", "")

    at = let(F.regexp_substr(raw_text, start), lambda rest: F.when(rest.isNotNull(), cut(rest)))
    return F.when(F.length(anchor) >= 40, at)
