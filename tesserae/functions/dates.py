"""Dates in running text: expressions and their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, unique_keep_order

#: Month names in the genitive (fixed values).
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
#: After "г" only the full word or a backslash and a character are taken, so "2020 г." gives "2020 г".
YEAR = r"г(?:ода|\\.)?"
PATTERN = r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}\s+(?:" + "|".join(MONTHS) + r")\s+\d{4}\s+" + YEAR + r"|\b\d{4}\s+" + YEAR + r"|\b\d{4}-\d{4}\b"
#: Words of a question for dates (fixed values).
QUESTION = ("дата", "даты", "срок", "сроки", "когда", "период", "году", "год", "дедлайн", "deadline", "до какого", "с какого", "по какое")


def find_dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iuU)" + PATTERN), F.lit(0))


def normalize_date(value: Column) -> Column:
    """One-line form, or null where a year is missing or not in 1900..2100."""
    item = F.regexp_replace(collapse(value), r"^[ .,;:()\[\]]+|[ .,;:()\[\]]+$", "")
    years = F.transform(F.regexp_extract_all(item, F.lit(r"\d{4}"), F.lit(0)), lambda y: y.cast("int"))
    first, second = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    fine = first.between(1900, 2100) & (~item.rlike(r"^\d{4}-\d{4}$") | second.between(1900, 2100))
    return F.when(fine, item)


def normalized_dates(text: Column) -> Column:
    found = F.filter(F.transform(find_dates(text), normalize_date), lambda d: d.isNotNull())
    return unique_keep_order(found)


def asks_for_dates(query: Column) -> Column:
    return F.exists(F.array(*map(F.lit, QUESTION)), lambda m: F.contains(F.lower(query), m))
