"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's white space and word classes are ASCII unless (?U) asks for Unicode's.
SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: inside a lambda an expression from outside is worked out for each element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends (trim takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def preprocess_text(text: Column) -> Column:
    """Unix line ends; dashes that start items become list lines."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(F.replace(out, F.lit(" – "), F.lit("\n- ")), F.lit("– "), F.lit("\n- "))


def normalize_query(text: Column) -> Column:
    return F.regexp_replace(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))), r"[ \t]+", " ")


def _punctuation(text: Column) -> Column:
    out = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "–—", "--")
    return out


def _brackets(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?U)\[\s*(\d+)\s*\]", "[$1]")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\(\s*", "("), r"(?U)\s*\)", ")")


def _spacing(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _unless_plain(text: Column, body) -> Column:
    """``body`` of a text, or the text itself where it has nothing that normalising changes: found by plain search, far cheaper than the patterns."""
    def plain(x: Column) -> Column:
        marks = [F.contains(x, F.lit(mark)) for mark in ("\n", "-", "–", "—", "(", ")", "[", "  ", "\t", "\r")]
        return ~reduce(or_, [*marks, *(F.substring(x, at, 1).rlike(SPACE) for at in (1, -1))])

    return let(text, lambda x: F.when(plain(x), x).otherwise(body(x)))


def normalize_text(text: Column) -> Column:
    """For comparison: single line ends joined, brackets tightened, hyphens spaced (blank lines beside them go too)."""
    def changed(x: Column) -> Column:
        out = F.regexp_replace(_punctuation(x), r"(?<!\n)\n(?!\n)", " ")
        return _spacing(F.regexp_replace(_brackets(out), r"(?U)\s*-\s*", " - "))

    return _unless_plain(text, changed)


def normalize_display_text(text: Column) -> Column:
    """As normalize_text, but lines and hyphens stay."""
    return _unless_plain(text, lambda x: _spacing(_brackets(_punctuation(x))))


def tokenize_with_separators(text: Column) -> Column:
    """Words, single marks and runs of white space: joined, they give the text back."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]|\s+"), F.lit(0))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def paragraphs_html(text: Column) -> Column:
    blocks = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda b: b != "")
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<div class='paragraph'>"), html_escape(b), F.lit("</div>"))), "")


def compact(text: Column, most: int) -> Column:
    """At most ``most`` characters and an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("...")))


def safe_document_name(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w_. -]+", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("document"))


def normalized_filename(path: Column) -> Column:
    return F.lower(strip(F.element_at(F.split(path, "/"), -1)))


def document_id(folder: Column, name: Column, version: Column) -> Column:
    parts = (F.coalesce(c, F.lit("")) for c in (folder, name, version))
    return F.substring(F.sha1(F.concat_ws("::", *parts).cast("binary")), 1, 16)


def document_label(folder: Column, name: Column, version: Column, kind: Column, default_folder: str) -> Column:
    def or_else(c: Column, value: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))

    return F.concat(or_else(folder, default_folder), F.lit(" / "), or_else(name, "document"), F.lit(" | "), or_else(version, "version"), F.lit(" | "), or_else(kind, "file"))


def clean_line(text: Column) -> Column:
    out = F.translate(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\t\u00a0", "  ")
    return strip(F.regexp_replace(out, " {2,}", " "))


def first_letter(text: Column) -> Column:
    return F.regexp_extract(text, "[A-Za-zА-Яа-яЁё]", 0)


def starts_with_lowercase(text: Column) -> Column:
    letter = first_letter(text)
    return (letter != "") & (letter == F.lower(letter))


def continues_sentence(before: Column, text: Column) -> Column:
    """Whether ``text`` goes on with the sentence of ``before``; empty sides never do."""
    a, b = F.regexp_replace(before, r"(?U)\s+$", ""), F.regexp_replace(text, r"(?U)^\s+", "")
    goes_on = starts_with_lowercase(b) | b.rlike(r"^[)\],;:.!?\-–—]") | a.rlike(r"[(\[«\-–—/№]$") | ~a.rlike(r"[.!?:;]$")
    return F.coalesce((before != "") & (text != "") & goes_on, F.lit(False))


def heading_level_of_style(style: Column) -> Column:
    """Level of a word processor's style: title 1, subtitle 2, ``heading N`` clamped to 1..6, else null."""
    name = F.lower(strip(style))
    n = F.nullif(F.regexp_extract(name, r"^heading\s+(\d{1,9})$", 1), F.lit("")).cast("int")
    return F.when(name == "title", 1).when(name == "subtitle", 2).when(n.isNotNull(), F.greatest(F.lit(1), F.least(n, F.lit(6))))


def is_heading(text: Column, size: Column, body_size: Column, bold: Column, delta: float = 1.5) -> Column:
    bad = (F.length(text) < 3) | text.rlike(r"^\d+\.\s") | text.rlike(r"^\d+\s+[A-ZА-ЯЁ]") | starts_with_lowercase(text) | text.rlike(r"[;,:(\-–—]$")
    return ~bad & ((size >= body_size + delta) | (bold & (F.length(text) <= 140)))


def heading_level_of_size(size: Column, body_size: Column) -> Column:
    return F.when(size >= body_size + 6, 1).when(size >= body_size + 3, 2).otherwise(3)


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table: empty rows go, short ones are padded, the first is the header."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: collapse(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" ")))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    def table(kept: Column, width: Column) -> Column:
        lines = F.transform(kept, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        whole = let(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))), "\n"))
        return F.when(F.size(kept) > 0, whole).otherwise(F.lit(""))

    return let(kept, lambda k: let(F.array_max(F.transform(k, F.size)), lambda w: table(k, w)))


def unique_keep_order(items: Column) -> Column:
    """Stripped, without blanks, the first of those equal but for case."""
    clean = F.filter(F.transform(items, strip), lambda x: x != "")
    ordered = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(ordered, lambda o: F.filter(o, lambda x, j: (j == 0) | (F.get(o, j - 1)["k"] != x["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"], x["x"]))), lambda x: x["x"])


def json_fragment(text: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def strip_bullets(text: Column) -> Column:
    """The lines of a list without marks around them; empty ones go."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\-•]+|[ \t\-•]+$", ""))
    return F.filter(lines, lambda x: x != "")
