"""Comparison of two versions of a document: pairing, changes, token differences, reports."""

from __future__ import annotations

import difflib
import html
import re
from bisect import bisect_left, bisect_right
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.routing import compare_mode
from ..functions.text import html_escape, let, normalize_display_text, normalize_text, paragraphs_html, strip
from ..storage import save
from .models import Models
from .sections import numbered_points
from .stages import Answers


#: The question that stands for none, and the error of a document without a bundle (fixed values).
OPEN_QUESTION, NO_BUNDLE = "Сравни документы и кратко перечисли, что было добавлено, удалено и изменено.", "Не удалось загрузить bundle для doc_id="


def section_blocks(sections: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sections with text normalised for comparison and for display; null ids and titles get defaults."""
    body = F.coalesce("page_content", F.lit(""))
    return sections.select(*keys, F.coalesce("section_id", F.lit(0)).alias("section_id"), F.coalesce("section_title", F.lit("")).alias("section_title"), normalize_text(body).alias("text"), normalize_display_text(body).alias("display_text"))


def pair_sections(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The n-th section of a title on the left with the n-th of that title on the right; either may lack. Columns left_*, right_*, position.

    Both sides are dealt by ``by`` once; all else, up to the position, goes on where they lie. Null keys meet none.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        same = F.col("display_text").eqNullSafe(F.col("text"))  # most texts are shown as they are compared, and are dealt once
        return df.select(*by, "section_title", "section_id", "text", F.when(~same, F.col("display_text")).alias("display_text"), same.alias("same"), F.lit(name).alias("side"))

    rows = side(left, "left").unionByName(side(right, "right"))
    rows = rows.repartition(*by) if by else rows
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "section_title", "side").orderBy("section_id")))
    apart = F.when(reduce(or_, (F.col(c).isNull() for c in by), F.lit(False)), F.col("side")).alias("_apart")

    def of(name: str, c: str):
        return F.max(F.when(F.col("side") == name, F.col(c)))

    shown = [F.when(of(s, "same"), of(s, "text")).otherwise(of(s, "display_text")).alias(f"{s}_display_text") for s in ("left", "right")]
    each = [of(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("section_id", "text")]
    both = rows.groupBy(*by, "section_title", "nth", apart).agg(*each, *shown)
    both = both.select(*by, "section_title", *(f"{s}_{c}" for s in ("left", "right") for c in ("section_id", "text", "display_text")))
    order = Window.partitionBy(*(by or (F.lit(0),))).orderBy(F.col("left_section_id").asc_nulls_last(), "right_section_id")
    return both.withColumn("position", F.row_number().over(order))


def _numbered(text: Column) -> Column:
    """Array (no, i, text) of a text's numbered parts in their order; empty with fewer than two, as in one line."""
    marked = F.regexp_replace(text, r"(?md)^\s*(\d+)\.\s", "\u0001$0")
    parts = F.transform(F.slice(F.split(marked, "\u0001"), 2, 1 << 30), lambda p, i: F.struct(F.regexp_extract(p, r"(\d+)\.", 1).alias("no"), i.alias("i"), strip(p).alias("text")))
    none = F.array().cast("array<struct<no:string,i:int,text:string>>")
    return F.when(F.contains(text, F.lit("\n")), let(parts, lambda found: F.when(F.size(found) > 1, found).otherwise(F.slice(found, 1, 0)))).otherwise(none)


def points(text: Column) -> Column:
    """Numbered points of a text as an array (number, text) by number, the last of equal ones; empty with fewer than two."""
    last = let(F.array_sort(_numbered(text)), lambda by: F.filter(by, lambda p, i: F.coalesce(F.get(by, i + 1)["no"] != p["no"], F.lit(True))))
    return F.transform(last, lambda p: F.struct(p["no"], p["text"]))


def change_types(pairs: DataFrame) -> DataFrame:
    """Adds change_type (same, changed, added, removed) and changed: an added or removed empty section counts as unchanged.

    If a side has numbered points, the points decide: what stands before the first one, and a side without points, count
    as nothing.
    """
    left, right = F.coalesce("left_text", F.lit("")), F.coalesce("right_text", F.lit(""))
    rows = pairs.withColumn("_l", points(left)).withColumn("_r", points(right))
    changed = F.when((F.size("_l") == 0) & (F.size("_r") == 0), left != right).otherwise(F.col("_l") != F.col("_r"))
    kind = F.when(F.col("left_section_id").isNull(), "added").when(F.col("right_section_id").isNull(), "removed").when(F.col("changed"), "changed").otherwise("same")
    return rows.withColumn("changed", changed).drop("_l", "_r").withColumn("change_type", kind)


def compare_counts(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("left_section_id").alias("left_sections"), F.count("right_section_id").alias("right_sections"), F.count("*").alias("paired_sections"), F.count_if("changed").alias("changed_sections"))


def pair_points(pairs: DataFrame, keys: tuple[str, ...] = ("position",)) -> DataFrame:
    """(keys, point_no, left_point, right_point, changed, ord): points of the sides by number, the last of equal numbers; left order first."""
    def side(name: str) -> DataFrame:
        p = numbered_points(pairs, f"{name}_text", keys)
        return p.groupBy(*keys, "point_no").agg(F.max_by("point_text", "pos").alias(f"{name}_point"), F.min("pos").alias(f"{name}_pos"))

    both = side("left").join(side("right"), [*keys, "point_no"], "full")
    order = Window.partitionBy(*keys).orderBy(F.col("left_pos").asc_nulls_last(), "right_pos")
    changed = F.coalesce("left_point", F.lit("")) != F.coalesce("right_point", F.lit(""))
    return both.withColumn("changed", changed).withColumn("ord", F.row_number().over(order)).drop("left_pos", "right_pos")


def matching_blocks(a: list[str], b: list[str], at: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """The blocks of ``difflib.SequenceMatcher`` without junk, ``at`` being its b2j: (i, j, size) by i, adjacent ones joined, then an empty one.

    A longest block of two or more tokens is found by the pairs of tokens that follow each other, which are far rarer than
    the blanks between words. Where no such pair is common, the blocks are single tokens, the first of each in turn.
    """
    pairs: dict[tuple[str, str], list[int]] = {}
    for j in range(1, len(b)):
        pairs.setdefault((b[j - 1], b[j]), []).append(j)
    ends = [(i, pairs[a[i - 1], a[i]]) for i in range(1, len(a)) if (a[i - 1], a[i]) in pairs]
    rows = [i for i, _ in ends]
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        besti = bestj = size = 0
        before, last = {}, -1
        for i, list_ in ends[bisect_right(rows, alo) : bisect_left(rows, ahi)]:
            here = {}
            if i != last + 1:
                before = {}
            for j in list_[bisect_right(list_, blo) : bisect_left(list_, bhi)]:
                here[j] = k = before.get(j - 1, 1) + 1
                if k > size:
                    besti, bestj, size = i - k + 1, j - k + 1, k
            before, last = here, i
        if size:
            found.append((besti, bestj, size))
            open_.append((alo, besti, blo, bestj))
            open_.append((besti + size, ahi, bestj + size, bhi))
            continue
        for i in range(alo, ahi):
            list_ = at.get(a[i], ())
            n = bisect_left(list_, blo)
            if n < len(list_) and list_[n] < bhi:
                found.append((i, list_[n], 1))
                blo = list_[n] + 1
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return [*out, (len(a), len(b), 0)]


def diff_html(left: str, right: str) -> tuple[str, str, bool]:
    """Both texts as HTML, by tokens: what only the left has is marked removed, what only the right has added."""
    if left == right:
        return html.escape(left), html.escape(right), False
    a, b = (re.findall(r"\w+|[^\w\s]|\s+", t) for t in (left, right))
    sides: tuple[list[str], list[str]] = ([], [])
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    matcher.matching_blocks = matching_blocks(a, b, matcher.b2j)
    for kind, *cut in matcher.get_opcodes():
        for side, mark, tokens in zip(sides, ("diff-removed", "diff-added"), (a[cut[0] : cut[1]], b[cut[2] : cut[3]]), strict=True):
            if tokens:
                text = html.escape("".join(tokens))
                side.append(text if kind == "equal" else f"<span class='{mark}'>{text}</span>")
    return "".join(sides[0]), "".join(sides[1]), True


@F.pandas_udf(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
def diff_udf(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """``diff_html`` of each pair; null where a side is null."""
    return pd.DataFrame([(None, None) if a is None or b is None else diff_html(a, b)[:2] for a, b in zip(left, right, strict=True)], columns=["left", "right"])


def _diffed(rows: DataFrame) -> DataFrame:
    """Rows of left, right, left_shown and right_shown with their HTML as ``h``: differences by token, equal texts as displayed."""
    differ = F.col("left") != F.col("right")
    marked = rows.withColumn("h", diff_udf(F.when(differ, F.col("left")), F.when(differ, F.col("right"))))
    same = F.struct(*(paragraphs_html(F.col(f"{s}_shown")).alias(s) for s in ("left", "right")))
    return marked.withColumn("h", F.when(differ, F.col("h")).otherwise(same)).drop("left", "right", "left_shown", "right_shown")


def section_html(compared: DataFrame, keys: tuple[str, ...] = ("doc_id", "position"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, keep, left_html, right_html) of each row of ``compared_sections``, with the columns ``keep`` of it.

    A section with numbered points on a side is taken apart first: a row a point, met with the point of its number (the
    last of equal ones) on the other side and in the displayed texts; left order, then what only the right has. So only
    changed points are compared by token, each on its own, and a long section is many rows for the tasks. All other
    sections are compared where they lie.
    """
    sides = {"left": "_left", "right": "_right", "left_shown": "left_text", "right_shown": "right_text"}
    texts = compared.select(*keys, F.struct(F.lit(0).alias("_"), *keep).alias("_c"), *(F.coalesce(F.col(c), F.lit("")).alias(s) for s, c in sides.items()))
    texts = texts.withColumn("_parts", F.struct(*(_numbered(F.col(s)).alias(s) for s in sides)))
    in_points = (F.size("_parts.left") > 0) | (F.size("_parts.right") > 0)
    kept = [F.col(f"_c.{c}").alias(c) for c in keep]

    def of(side: str):
        return lambda p: F.struct(F.lit(side).alias("side"), p["no"].alias("no"), p["i"].alias("i"), p["text"].alias("text"), F.lit(False).alias("row"))

    # a row a point, and one of no point that holds the section's other columns
    row = F.array(F.struct(F.lit("").alias("side"), F.lit(None).cast("string").alias("no"), F.lit(0).alias("i"), F.lit("").alias("text"), F.lit(True).alias("row")))
    each = F.concat(row, F.flatten(F.array(*(F.transform(f"_parts.{s}", of(s)) for s in sides))))
    parts = texts.where(in_points).select(*keys, "_c", F.explode(each).alias("p")).select(*keys, F.when(F.col("p.row"), F.col("_c")).alias("_c"), "p.*")
    met = parts.repartition(*keys, "no").groupBy(*keys, "no").agg(
        F.first("_c", ignorenulls=True).alias("_c"),
        *(F.max_by(F.when(F.col("side") == s, F.col("text")), F.when(F.col("side") == s, F.col("i"))).alias(s) for s in sides),
        *(F.min(F.when(F.col("side") == s, F.col("i"))).alias(f"{s}_i") for s in ("left", "right")),
    ).where("left_i is not null or right_i is not null or _c is not null")
    met = met.select(*keys, "_c", "no", "left_i", "right_i", *(F.coalesce(s, F.lit("")).alias(s) for s in ("left", "right")), *(F.coalesce(f"{s}_shown", s, F.lit("")).alias(f"{s}_shown") for s in ("left", "right")))
    order = [F.col("left_i").isNull().alias("later"), F.coalesce("left_i", "right_i").alias("i")]
    boxed = [F.concat(F.lit("<div class='point'><div class='point-label'>Пункт "), "no", F.lit("</div><div class='point-body'>"), F.col(f"h.{s}"), F.lit("</div></div>")).alias(s) for s in ("left", "right")]
    point = F.when(F.col("no").isNotNull(), F.struct(*order, *boxed))
    found = _diffed(met).groupBy(*keys).agg(F.first("_c", ignorenulls=True).alias("_c"), F.array_sort(F.collect_list(point)).alias("p"))
    by_points = found.select(*keys, *kept, F.array_join("p.left", "").alias("left_html"), F.array_join("p.right", "").alias("right_html"))
    whole = _diffed(texts.where(~in_points).drop("_parts")).select(*keys, *kept, F.col("h.left").alias("left_html"), F.col("h.right").alias("right_html"))
    return whole.unionByName(by_points)


def compared_sections(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All paired sections of two sides (by, section_id, section_title, page_content) with change_type and display texts, without their HTML."""
    pairs = change_types(pair_sections(section_blocks(left, by), section_blocks(right, by), by))
    title = F.coalesce(F.nullif("section_title", F.lit("")), F.concat(F.lit("Section "), F.col("position").cast("string")))
    sides = [F.coalesce(f"{s}_display_text", F.lit("")).alias(f"{s}_text") for s in ("left", "right")]
    return pairs.select(*by, "position", title.alias("section_title"), "left_section_id", "right_section_id", "changed", "change_type", *sides, F.col("left_text").alias("_left"), F.col("right_text").alias("_right"))


def compare_documents(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``compared_sections`` with the HTML of both sides. The token diff has no JVM expression; it runs on Arrow batches."""
    compared = compared_sections(left, right, by)
    keep = tuple(c for c in compared.columns if c not in (*by, "position", "_left", "_right"))
    return section_html(compared, (*by, "position"), keep)


def _moded(pairs: DataFrame, mode: str | DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(comparisons with each of their modes, their changed sections of that mode, numbered). ``mode``: one for all, or rows (by, mode)."""
    every = pairs.select(*by).distinct()
    modes = every.withColumn("mode", F.lit(mode)) if isinstance(mode, str) else every.join(mode.select(*by, "mode").distinct(), list(by))
    chosen = pairs.where("changed").join(modes, list(by)).where((F.col("mode") == "all") | (F.col("change_type") == F.col("mode")))
    return modes, chosen.withColumn("n", F.row_number().over(Window.partitionBy(*by, "mode").orderBy("position")))


def compare_context(pairs: DataFrame, meta: DataFrame, mode: str | DataFrame = "all", sections: int = 12, chars: int = 2200, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, mode, context) of each comparison and mode: counts, its first changed sections of the mode with both sides cut, what was trimmed.

    ``pairs``: rows of ``compared_sections``. ``meta``: by, left_document_name, left_version, right_document_name, right_version.
    """
    def side(c: str):
        return F.coalesce(F.nullif(strip(F.substring(F.coalesce(c, F.lit("")), 1, chars)), F.lit("")), F.lit("[absent]"))

    modes, chosen = _moded(pairs, mode, by)
    key = [*by, "mode"]
    block = F.concat_ws("\n", F.concat(F.lit("SECTION "), F.col("n").cast("string"), F.lit(": "), F.col("section_title")), F.lit("LEFT:"), side("left_text"), F.lit("RIGHT:"), side("right_text"), F.lit(""))
    body = chosen.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("n") <= sections, F.struct("n", block.alias("b"))))).alias("b"), F.count("*").alias("m"))
    names = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in ("left_document_name", "left_version", "right_document_name", "right_version")]
    counts = [F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("left_sections", "right_sections", "changed_sections")]
    more = F.when(F.col("m") > sections, F.concat(F.lit("... trimmed "), (F.col("m") - sections).cast("string"), F.lit(" more changed sections ...")))
    text = F.concat_ws("\n", F.lit("META:"), *names, *counts, F.concat(F.lit("compare_mode="), F.col("mode")), F.lit(""), F.lit("CHANGED_SECTIONS:"), F.nullif(F.array_join("b.b", "\n"), F.lit("")), more)
    whole = compare_counts(pairs, by).join(meta, list(by)).join(modes, list(by)).join(body, key, "left")
    return whole.select(*key, F.regexp_replace(text, r"\s+$", "").alias("context"))


#: Headings of a change list (fixed values).
LABELS = {"all": "Измененных разделов", "added": "Добавленных разделов", "removed": "Удаленных разделов", "changed": "Измененных разделов"}


def change_list(pairs: DataFrame, mode: str | DataFrame = "all", most: int = 8, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, mode, answer) of each comparison and mode: how many sections changed, and the first of them by title."""
    modes, chosen = _moded(pairs, mode, by)
    kind = F.when(F.col("change_type") == "added", "Добавлено").when(F.col("change_type") == "removed", "Удалено").otherwise("Изменено")
    line = F.concat(F.lit("- "), kind, F.lit(": "), F.col("section_title"))
    got = chosen.groupBy(*by, "mode").agg(F.count("*").alias("m"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", line.alias("l"))))).alias("l"))
    label = F.coalesce(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("mode")], F.lit("Разделов"))
    head = F.concat(label, F.lit(": "), F.coalesce("m", F.lit(0)).cast("string"), F.lit("."))
    return modes.join(got, [*by, "mode"], "left").select(*by, "mode", F.concat_ws("\n", head, F.nullif(F.array_join("l.l", "\n"), F.lit(""))).alias("answer"))


def compare_json(compared: DataFrame, meta: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, json): each comparison with its documents (``meta``), counts and all sections in order, as one JSON object."""
    section = F.struct("position", *(c for c in compared.columns if c not in (*by, "position")))
    whole = compared.groupBy(*by).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    summary = compare_counts(compared, by).select(*by, F.struct("left_sections", "right_sections", F.col("paired_sections").alias("compared_sections"), "changed_sections").alias("summary"))
    named = meta.select(*by, F.struct(*(c for c in meta.columns if c not in by)).alias("documents"))
    return whole.join(summary, list(by)).join(named, list(by), "left").select(*by, F.to_json(F.struct("documents", "summary", "sections"), {"ignoreNullFields": "false"}).alias("json"))


def report_html(compared: DataFrame, title: str = "Document Compare", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, html): a two-pane report of each comparison (position, section_title, changed, left_html, right_html)."""
    mark = F.when(F.col("changed"), "changed").otherwise("same")
    row = F.concat(F.lit("<tr class='"), mark, F.lit("'><th colspan='2'>"), html_escape(F.coalesce("section_title", F.lit(""))), F.lit(" <span class='badge'>"), mark, F.lit("</span></th></tr><tr><td>"), F.coalesce("left_html", F.lit("")), F.lit("</td><td>"), F.coalesce("right_html", F.lit("")), F.lit("</td></tr>"))
    got = compared.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", row.alias("r")))).alias("r"))
    head = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><table><tr><th>Левый документ</th><th>Правый документ</th></tr>"
    return got.select(*by, F.concat(F.lit(head), F.array_join("r.r", ""), F.lit("</table></body></html>")).alias("html"))


def compare_questions(sections: DataFrame, documents: DataFrame, asked: DataFrame, models: Models = Models(), answers: Answers | None = None) -> DataFrame:
    """(query_id, left_doc_id, right_doc_id, mode, context, answer, answer_source, error) of questions (query_id, left_doc_id, right_doc_id, text).

    ``sections``: doc_id, section_id, section_title, page_content of stored bundles; ``documents``: doc_id, document_name, version.
    Each pair of documents is compared once, whatever asks for it; the mode is what a question's words ask for. The
    model's answer, asked once for each context and question, else the list of changes. A document without a bundle makes ``error``.
    """
    by = ("left_doc_id", "right_doc_id")
    rows = asked.select("query_id", *by, strip(F.coalesce("text", F.lit(""))).alias("text")).withColumn("mode", compare_mode(F.col("text")))
    rows = rows.withColumn("question", F.coalesce(F.nullif("text", F.lit("")), F.lit(OPEN_QUESTION)))
    have = sections.select(F.col("doc_id").alias("_d")).distinct()
    for side in by:
        rows = rows.join(have.withColumn(f"_{side}", F.lit(True)), F.col(side) == F.col("_d"), "left").drop("_d")
    absent = [F.when(F.col(f"_{side}").isNull(), F.concat(F.lit(NO_BUNDLE), F.coalesce(F.col(side).cast("string"), F.lit("None")))) for side in by]
    rows = save(rows.withColumn("error", F.coalesce(*absent)).drop(*(f"_{side}" for side in by)), "compare-asked")
    pairs, named = rows.where("error is null").select(*by).distinct(), documents.dropDuplicates(["doc_id"])
    sides = [pairs.join(sections.withColumnRenamed("doc_id", side), side).select(*by, "section_id", "section_title", "page_content") for side in by]
    compared = save(compared_sections(*sides, by).drop("_left", "_right"), "compared")
    meta = pairs
    for side, name in zip(by, ("left", "right"), strict=True):
        meta = meta.join(named.select(F.col("doc_id").alias(side), F.col("document_name").alias(f"{name}_document_name"), F.col("version").alias(f"{name}_version")), side, "left")
    modes = rows.select(*by, "mode").distinct()
    told = rows.join(compare_context(compared, meta, modes, by=by), [*by, "mode"], "left").join(change_list(compared, modes, by=by).withColumnRenamed("answer", "listed"), [*by, "mode"], "left")
    made = (answers or Answers(asked.sparkSession)).once(told, "compare", {"context": F.col("context"), "question": F.col("question")}, models.compare)
    source = F.when(F.col("error").isNotNull(), None).when(F.col("compare").isNotNull(), "llm").otherwise("fallback")
    return made.select("query_id", *by, "mode", "context", F.coalesce(strip(F.col("compare")), "listed").alias("answer"), source.alias("answer_source"), "error")
