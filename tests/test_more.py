import difflib
import html
import re

import pytest
from pyspark.sql import functions as F

from tesserae.functions.text import strip_bullets, unique_keep_order
from tesserae.operators import compare, layout, stores
from tesserae.operators.catalog import Catalog
from tesserae.operators.sections import split_into_sections, summaries


def test_diff_marks_by_opcodes():
    left, right = "one two <three> four", "one 2 <three> four five"
    a, b = (re.findall(r"\w+|[^\w\s]|\s+", t) for t in (left, right))
    wanted = ["", ""]
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        x, y = html.escape("".join(a[i:j])), html.escape("".join(b[k:m]))
        wanted[0] += x if kind == "equal" else f"<span class='diff-removed'>{x}</span>" if x else ""
        wanted[1] += y if kind == "equal" else f"<span class='diff-added'>{y}</span>" if y else ""
    assert compare.diff_html(left, right) == (*wanted, True)
    assert compare.diff_html("a & b", "a & b") == ("a &amp; b", "a &amp; b", False)


def test_points_decide(spark):
    sides = [("pre\n1. a\n2. b", "other\n1. a\n2. b"), ("1. a\n2. b\n1. c", "1. c\n2. b"), ("1. a\n2. b\n1. c", "2. b\n1. c"), ("plain", "plain x"), ("1. a\n2. b", "text"), ("1. only", "1. only"), (None, "new"), ("1. a\n2. b", "1. a\n3. b")]
    rows = [(i, "t", i, i, l, r) for i, (l, r) in enumerate(sides)]
    df = spark.createDataFrame(rows, "position int, section_title string, left_section_id int, right_section_id int, left_text string, right_text string")
    got = {r.position: r.changed for r in compare.change_types(df).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_lines(spark):
    lines = ["", "Hello", "world.", "Next (", "", "here)", "", "Stop.", "", "", "New", "- item", "• two", "1. x", "", "tail:", "after", ""]
    df = spark.createDataFrame([(lines,), (None,), ([],)], "l array<string>")
    got = [r.m for r in df.select(layout.lines_to_markdown(F.col("l")).alias("m")).collect()]
    assert got == ["Hello world.\nNext ( here) Stop.\n\nNew\n- item\n- two\n1. x tail:\nafter\n", None, "\n"]
    many = spark.range(1).select(layout.lines_to_markdown(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: F.concat(F.lit("w"), x.cast("string")))).alias("m")).first().m
    assert many == " ".join(f"w{i}" for i in range(1, 20_001)) + "\n"


def test_small_functions(spark):
    df = spark.createDataFrame([(["b", " a", "B ", "", "a"], "- x\n• y\n\n z ")], "w array<string>, t string")
    r = df.select(unique_keep_order(F.col("w")).alias("u"), strip_bullets(F.col("t")).alias("b")).first()
    assert r.u == ["b", "a"] and r.b == ["x", "y", "z"]


def test_sections_within_the_row(spark):
    texts = [None, "", " \n", "a\n# H\nb\n## G\n", "# H", "#### four\nx", "a\r\n# T \r\nc d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in split_into_sections(df).collect():
        got.setdefault(r.doc_id, []).append((r.section_id, r.section_title, r.page_content))
    assert got == {0: [(0, "Документ", "")], 1: [(0, "Документ", "")], 2: [(0, "Документ", "")], 3: [(0, "Документ", "a"), (1, "H", "# H\nb"), (2, "G", "## G")], 4: [(0, "H", "# H")], 5: [(0, "Документ", "#### four\nx")], 6: [(0, "Документ", "a"), (1, "T", "# T \nc\nd")]}


def test_stores(spark, tmp_path):
    base = f"file://{tmp_path}"
    catalog, bundles, vectors, cache = (kind(spark, f"{base}/{kind.__name__}") for kind in (Catalog, stores.Bundles, stores.VectorTable, stores.SummaryCache))
    kept = tmp_path / "in" / "a.md"
    kept.parent.mkdir()
    kept.write_text("# A\nx")
    rows = spark.createDataFrame([("d1", str(kept), "a", "1", "", "# A\nx"), ("d2", "/etc/b.md", "b", "1", "", "# B\ny")], "doc_id string, source string, document_name string, version string, document_folder string, raw_text string")
    catalog.upsert(rows)
    sections = split_into_sections(rows, text="raw_text").join(rows.select("doc_id", *stores.META), "doc_id")
    bundles.upsert(stores.serialised(sections.where("doc_id = 'd1'")))
    loaded = {(r.doc_id, r.section_title, r.page_content, r.document_name) for r in stores.load_sections(rows, bundles.read(), catalog.read()).collect()}
    assert loaded == {("d1", "A", "# A\nx", "a"), ("d2", "B", "# B\ny", "b")}
    assert stores.deserialised(spark.createDataFrame([("x", "not json")], "doc_id string, sections string")).count() == 0
    vectors.upsert(spark.createDataFrame([("d1", 0, "t", [1.0]), ("d1", 1, "t", [1.0]), ("d2", 0, "t", [1.0])], vectors.SCHEMA))
    vectors.upsert(spark.createDataFrame([("d1", 0, "new", [2.0])], vectors.SCHEMA))
    assert {(r.doc_id, r.chunks) for r in stores.vector_documents(vectors.scan()).collect()} == {("d1", 1), ("d2", 1)}
    cache.add(summaries(sections))
    cache.add(summaries(sections))
    assert cache.read().count() == 2
    assert stores.cascade_delete(spark, catalog, bundles, vectors, ["d1", "d2"], str(tmp_path / "in")) == [str(kept)]
    assert not kept.exists() and catalog.read().isEmpty() and vectors.scan().isEmpty() and bundles.read().isEmpty()


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    good = spark.createDataFrame([("d", "r")], "doc_id string, raw_text string")
    catalog.upsert(good)
    for _ in range(2):
        with pytest.raises(Exception):
            catalog.upsert(good.withColumn("raw_text", F.raise_error(F.lit("no"))))
    catalog.upsert(good.withColumn("doc_id", F.lit("e")))
    assert catalog.read().count() == 2
