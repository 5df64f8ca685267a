import datetime  # noqa: F401

import pytest
from pyspark.sql import functions as F

from tesserae.functions import dates, routing, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.normalize_text, "a\nb\n\nc [ 1 ] ( x ) 2019-2021 — д", "a b\n\nc [1] (x) 2019 - 2021 - д"),
        (text.normalize_display_text, "a\r\nb [ 1 ]  ( x )\n\n\n\nc–d", "a\nb [1] (x)\n\nc-d"),
        (text.preprocess_text, "a\r\nb – c", "a\nb\n- c"),
        (text.normalize_query, "  a \t b\n", "a b"),
        (text.html_escape, "<a href='x'>&\"", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"),
        (text.paragraphs_html, "a\n\n \n\n<b>", "<div class='paragraph'>a</div><div class='paragraph'>&lt;b&gt;</div>"),
        (text.safe_document_name, " Отчёт/2024 #1. ", "Отчёт_2024 _1"),
        (text.safe_document_name, "...", "document"),
        (text.normalized_filename, "/a/b/Файл.PDF ", "файл.pdf"),
        (text.clean_line, "a\t\tb  c\r", "a b c"),
        (text.starts_with_lowercase, "12 привет", True),
        (text.starts_with_lowercase, "12", False),
        (text.heading_level_of_style, "Heading 9", 6),
        (text.heading_level_of_style, "Normal", None),
        (text.json_fragment, 'x {"a": {1}} y', '{"a": {1}}'),
        (text.tokenize_with_separators, "Привет, мир!", ["Привет", ",", " ", "мир", "!"]),
        (dates.normalize_date, " 5 марта\n2020 года. ", "5 марта 2020 года"),
        (dates.normalize_date, "01.02.99", None),
        (dates.normalize_date, "1899-2000", None),
        (dates.normalize_date, "1900-2100", "1900-2100"),
        (dates.find_dates, "с 01.02.2020 до 5 МАРТА 2021 года, 2020 г. и 2024 город, 2019-2021", ["01.02.2020", "5 МАРТА 2021 года", "2020 г", "2024 г", "2019-2021"]),
        (routing.route, "x" * 220, "quote"),
        (routing.route, "x" * 219, "simple"),
        (routing.route, "1. пункт", "quote"),
        (routing.route, "Перечисли условия и сроки?", "complex"),
        (routing.compare_mode, "Что добавлено?", "added"),
        (routing.compare_mode, "что убрали", "removed"),
        (routing.compare_mode, "", "all"),
    ],
)
def test_scalars(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_unique_keep_order(spark):
    df = spark.createDataFrame([([" A", "a", "", "b", "B "],)], "x array<string>")
    assert df.select(text.unique_keep_order(F.col("x")).alias("y")).first().y == ["A", "b"]


def test_table_markdown(spark):
    df = spark.createDataFrame([([["a", "b"], [None, " "], ["c"]],)], "x array<array<string>>")
    assert df.select(text.table_markdown(F.col("x")).alias("y")).first().y == "| a | b |\n| --- | --- |\n| c |  |"
