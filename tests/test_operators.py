import io
import random
import zipfile
from collections import Counter
from math import log

import duckdb
from pyspark.sql import functions as F

from tesserae.config import Config
from tesserae.functions.dates import normalized_dates  # noqa: F401
from tesserae.operators import catalog, compare, layout, models, retrieval, sections
from tesserae.plans import ask as plan
from tesserae.plans import queries as core
from tesserae.sources import files
from tesserae.streaming import ingest


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n#### no\n## A\n\n# B"), (2, "  plain \n"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.section_id): (r.section_title, r.page_content) for r in sections.split_into_sections(docs).collect()}
    assert got == {(1, 0): ("Документ", "intro"), (1, 1): ("A", "# A\nx\n#### no"), (1, 2): ("A", "## A"), (1, 3): ("B", "# B"), (2, 0): ("Документ", "plain"), (3, 0): ("Документ", ""), (4, 0): ("Документ", "")}


def test_numbered_points(spark):
    rows = spark.createDataFrame([(1, "head\n1. a\n b\n 2. c\n10. d "), (2, "1. only")], "k long, x string")
    got = [(r.k, r.point_no, r.point_text) for r in sections.numbered_points(rows, "x", ("k",)).orderBy("pos").collect()]
    assert got == [(1, "1", "1. a\n b"), (1, "2", "2. c"), (1, "10", "10. d")]


def test_chunks(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "long. ", "x\n", "\n\n", "\n- item "]) for _ in range(3000)) + "y" * 2500
    docs = spark.createDataFrame([(1, 0, "t", text), (1, 1, "t", "short"), (2, 0, "t", "")], "doc_id long, section_id int, section_title string, page_content string")
    got = sections.chunk_sections(docs).orderBy("doc_id", "chunk_id").collect()
    first = [r for r in got if r.doc_id == 1]
    assert [r.chunk_id for r in first] == list(range(len(first)))
    covered = set()
    for r in first:
        body = text if r.section_id == 0 else "short"
        assert body[r.start_index : r.start_index + len(r.page_content)] == r.page_content
        assert len(r.page_content) <= 1800 or " " not in r.page_content.strip()
        if r.section_id == 0:
            covered |= set(range(r.start_index, r.start_index + len(r.page_content)))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def brute_bm25(chunks, query, k):
    split = {i: t.split() for i, t in chunks.items()}
    n, avg = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    idf = {w: log(n - f + 0.5) - log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = {i: sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for q in query.split()) for i, ws in split.items()}
    return sorted(((round(s, 6), i) for i, s in score.items()), reverse=True)[:k]


def test_bm25(spark):
    rng = random.Random(2)
    for n in (1, 3, 30):
        chunks = {i: " ".join(rng.choices("a b c d e f B".split(), [9, 3, 2, 1, 1, 1, 1], k=rng.randint(1, 20))) for i in range(n)}
        df = spark.createDataFrame(list(chunks.items()), "chunk_id long, text string")
        queries = {0: "a a b zz", 1: "zz", 2: "e f"}
        got = retrieval.bm25(df, spark.createDataFrame(list(queries.items()), "query_id long, text string"), k=8).orderBy("query_id", "rank").collect()
        for q, text in queries.items():
            assert [(round(r.score, 6) + 0.0, r.chunk_id) for r in got if r.query_id == q] == [(s + 0.0, i) for s, i in brute_bm25(chunks, text, 8)]


def test_fusion_neighbours_context(spark):
    lists = spark.createDataFrame([(0, 1, 1, 5), (0, 1, 2, 6), (0, 2, 1, 6), (0, 2, 2, 7)], "query_id long, list_no int, rank int, chunk_id long")
    fused = retrieval.rrf(lists.withColumn("doc_id", F.lit(1)), ("doc_id", "chunk_id"))
    assert [r.chunk_id for r in fused.orderBy("rank").collect()] == [6, 5, 7]
    chunks = spark.createDataFrame([(1, i, f"text {i}") for i in (4, 5, 6, 7)], "doc_id int, chunk_id long, text string")
    near = retrieval.add_neighbours(fused, chunks)
    assert [r.chunk_id for r in near.orderBy("pos").collect()] == [5, 6, 7, 4]
    rows = near.selectExpr("query_id", "pos", "'s' source", "'t' section_title", "chunk_id", "0 start_index", "text")
    whole = retrieval.build_context(rows).first()
    block = "[1] source=s section=t chunk_id=5 start=0\ntext 5"
    assert whole.blocks == 4 and whole.context.startswith(block + "\n\n---\n\n[2]")
    assert retrieval.build_context(rows, len(block)).first().blocks == 1
    none = retrieval.build_context(rows, len(block) - 1).first()
    assert (none.blocks, none.context) == (0, "")


def test_low_information(spark):
    rows = spark.createDataFrame([(0, "x" * 80), (0, "-" * 79), (0, "a" * 50 + "-"), (0, "a" * 49), (1, "short")], "query_id long, text string")
    assert sorted(r.text for r in retrieval.drop_low_information(rows).collect()) == sorted(["x" * 80, "a" * 50 + "-", "short"])


def test_pairs_and_changes(spark):
    schema = "section_id int, section_title string, text string, display_text string"
    left = spark.createDataFrame([(0, "A", "x", "x"), (1, "A", "y", "y"), (2, "B", "z", "z"), (3, "E", "", "")], schema)
    right = spark.createDataFrame([(0, "C", "n", "n"), (1, "A", "x2", "x2"), (2, "B", "z", "z")], schema)
    pairs = compare.change_types(compare.pair_sections(left, right))
    got = [(r.section_title, r.left_section_id, r.right_section_id, r.change_type, r.changed) for r in pairs.orderBy("position").collect()]
    assert got == [("A", 0, 1, "changed", True), ("A", 1, None, "removed", True), ("B", 2, 2, "same", False), ("E", 3, None, "removed", False), ("C", None, 0, "added", True)]


def test_diff_keeps_both_texts():
    import html
    import re

    for a, b in (("Срок 5 дней.", "Срок 10 дней!"), ("", "new"), ("same", "same"), ("<a> & b", "<a> | b")):
        got = compare.diff_html(a, b)
        assert html.unescape(re.sub("</?span[^>]*>", "", got[0])) == a
        assert html.unescape(re.sub("</?span[^>]*>", "", got[1])) == b
        assert got[2] == (a != b)


def test_points(spark):
    rows = spark.createDataFrame([(1, "1. a\n2. b\n2. last", "2. last\n3. new")], "position int, left_text string, right_text string")
    got = [(r.point_no, r.left_point, r.right_point, r.changed) for r in compare.pair_points(rows).orderBy("ord").collect()]
    assert got == [("1", "1. a", None, True), ("2", "2. last", "2. last", False), ("3", None, "3. new", True)]


def test_wrapped_lines(spark):
    lines = ["One two", "three", "", "four.", "", "Next", "- item", "a |"]
    df = spark.createDataFrame([(lines, ["", "• a.", "", "", "B"])], "a array<string>, b array<string>")
    got = df.select(layout.merge_wrapped(F.col("a")).alias("a"), layout.lines_to_markdown(F.col("b")).alias("b")).first()
    assert got.a == ["One two three four.", "", "Next", "- item a |"] and got.b == "- a.\n\nB\n"


def test_quote(spark):
    body = "1. " + "первый пункт " * 5 + "\n 2. второй"
    df = spark.createDataFrame([(0, "1. " + "ПЕРВЫЙ  пункт " * 5), (1, "x" * 39), (2, "x" * 60)], "i int, q string")
    got = [r.p for r in df.select("i", models.quoted(F.lit(body), F.col("q")).alias("p")).orderBy("i").collect()]
    assert got == [body.split("\n")[0].strip(), None, None]


def test_quote_behind_wide_characters(spark):
    """A match's place counts UTF-16 units, a substring's characters: each wide one before the quote moved the passage."""
    body = "\U0001f600\U0001f600 start\n" + "the quoted words of a line " * 3 + "\U0001f600 more\n2. next"
    df = spark.createDataFrame([("THE quoted  words of a line the quoted words",)], "q string")
    got = df.select(models.quoted(F.lit(body), F.col("q")).alias("a"), models.quoted(F.lit(body), F.col("q"), loose=False).alias("b"), models.quoted(F.lit(body), F.replace("q", F.lit("  "), F.lit(" ")), loose=False).alias("c")).first()
    assert got.a == got.c == ("the quoted words of a line " * 3 + "\U0001f600 more") and got.b is None


def test_quote_passages_against_sql_on_odd_texts(spark, tmp_path):
    line = "some words of a line that is long enough to be a quote here:"
    texts = [f"\U0001f600 first\n{line} on\n3. x", f"head {line[:59]} early\n{line[:59]} and more words\n3. x", f"{line.replace(' ', '  ')}\n{line} b", f"x\n{line[:30]}\u00a0{line} c\n\u00a0 2. d", f"x\n{line} \u0130 e\n\x0b4. f", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(core.ORACLES["quote_passage"]).fetchall()
    got = core.QUERIES["quote_passage"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len(wanted) == 5


def docx(parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD_XML[1:-1]}"><w:body>{parts}</w:body></w:document>')
    return out.getvalue()


def test_docx_and_catalog(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx(body))
    (folder / "b.md").write_text("# T\nтекст")
    (folder / "bad.docx").write_bytes(b"no zip")
    (folder / "skip.exe").write_bytes(b"x")
    read = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(folder)).collect()}
    assert set(read) == {"a.docx", "b.md", "bad.docx"} and read["bad.docx"].error
    assert read["a.docx"].raw_text == "## Title\n\n| a | b |\n| --- | --- |\n| c |  |\n"
    store = catalog.Catalog(spark, str(tmp_path / "cat"))
    ingest.watch(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination(60)
    rows = store.list().collect()
    assert sorted(r.document_name for r in rows) == ["a", "b"]
    assert store.get(rows[0].doc_id)["original_filename"] == rows[0].original_filename
    store.delete([rows[0].doc_id, "absent"])
    assert [r.doc_id for r in store.list().collect()] == [rows[1].doc_id] and store.get("absent") is None
    bundles = tmp_path / "bundles"
    bundles.mkdir()
    (bundles / "x.json").write_text('{"doc_id": "x", "source": "s", "document_name": "n", "version": "1"}')
    (bundles / "y.json").write_text("{broken")
    assert store.backfill(str(bundles)) == 1 and store.get("x")["document_name"] == "n"


def test_ask(spark):
    docs = spark.createDataFrame([(1, "# Сроки\nПоставка товара до 01.02.2024 по договору с покупателем, как указано в приложении к нему и в заявке.\n# Цена\n" + "Цена товара в рублях. " * 20), (2, "x")], "doc_id long, text string")
    secs, chunks = plan.index_documents(docs, Config())
    asked = spark.createDataFrame([(0, 1, "Когда поставка товара?"), (1, 2, "что?")], "query_id long, doc_id long, text string")
    got = {r.query_id: r for r in plan.ask(secs, chunks, asked).collect()}
    assert "01.02.2024" in got[0].answer and got[0].blocks >= 1 and got[0].answer_source == "fallback"
    assert got[1].route == "simple"
