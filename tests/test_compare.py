import difflib
import html
import json
import random
import re

from pyspark.sql import functions as F

from tesserae.operators import compare, stores
from tesserae.operators.models import Models
from tesserae.plans import queries

SF = "/root/testdata/sf0.001"
SECTION = "doc_id string, section_id int, section_title string, page_content string"


def marked(left, right):
    """Both sides by the opcodes of their tokens."""
    a, b = (re.findall(r"\w+|[^\w\s]|\s+", t) for t in (left, right))
    out = ["", ""]
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for side, text, name in ((0, "".join(a[i:j]), "removed"), (1, "".join(b[k:m]), "added")):
            text = html.escape(text)
            out[side] += text if kind == "equal" or not text else f"<span class='diff-{name}'>{text}</span>"
    return out


def test_html_of_all_sections_against_opcodes(spark):
    left, right = queries._sides(spark, SF)
    keys = ["doc_id", "position"]
    rows = compare.compare_documents(left, right).join(compare.compared_sections(left, right).select(*keys, "_left", "_right"), keys).collect()
    changed = 0
    for r in rows:
        a, b = r._left or "", r._right or ""
        assert [r.left_html, r.right_html] == by_hand(a, b, r.left_text, r.right_text)
        changed += r.changed
    assert changed > 100


def by_hand(left, right, left_shown, right_shown):
    """Both sides of a section, as plain loops: by points where a side has two or more, else whole."""
    def cut(text):
        at = [m.start() for m in re.finditer(r"(?m)^\s*\d+\.\s", text)]
        return [(re.match(r"\s*(\d+)", text[i:])[1], text[i:j].strip()) for i, j in zip(at, [*at[1:], len(text)], strict=True)] if len(at) > 1 else []

    def pair(a, b, shown):
        if a != b:
            return marked(a, b)
        return ["".join(f"<div class='paragraph'>{html.escape(p.strip())}</div>" for p in t.split("\n\n") if p.strip()) for t in shown]

    lists = [cut(t) for t in (left, right, left_shown, right_shown)]
    if not lists[0] and not lists[1]:
        return pair(left, right, (left_shown, right_shown))
    numbers = []
    for no, _ in lists[0] + lists[1]:
        if no not in numbers:
            numbers.append(no)
    out = ["", ""]
    for no in numbers:
        a, b, c, d = (next((t for n, t in reversed(found) if n == no), None) for found in lists)
        a, b = a or "", b or ""
        bodies = pair(a, b, (a if c is None else c, b if d is None else d))
        for side in (0, 1):
            out[side] += f"<div class='point'><div class='point-label'>Пункт {no}</div><div class='point-body'>{bodies[side]}</div></div>"
    return out


def test_html_by_points_against_loops(spark):
    sides = [
        ("pre\n1. a - b\n2. b", "other\n1. a - b\n2. b c", "pre\n1. a-b\n2. b", "other\n1. a-b\n2. b c"), ("1. a\n2. b\n1. c", "1. c\n2. b", None, None),
        ("1. a\n2. b\n1. c", "2. b\n1. c", "x", ""), ("plain <b>", "plain & x", None, None), ("1. a\n2. b", "text", None, None), ("1. only", "1. only", "1. only\n\n more ", ""),
        (None, "new", None, "new"), ("1. a\n2. b", "1. a\n3. b\n0. z", "1. a", "7. q\n8. r"), ("", "", "", ""), (None, None, None, None),
        ("10. x\n2. y\n 3. z \n", "3. z\n10. x\n2. y", "", ""), ("1. a\n\n2. b", "1. a\n\n2. b", "1. a\n\n2. b", "1. a\n\n2. b"),
    ]
    rows = [(None if i % 3 == 0 else "d", i, *s) for i, s in enumerate(sides)]
    df = spark.createDataFrame(rows, "doc_id string, position int, _left string, _right string, left_text string, right_text string")
    got = {r.position: [r.left_html, r.right_html] for r in compare.section_html(df).collect()}
    assert got == {i: by_hand(*(t or "" for t in s)) for i, s in enumerate(sides)}
    assert compare.section_html(df.limit(0)).count() == 0


def test_one_long_section_is_many_rows(spark):
    """A section of 4,000 points, of which three differ, is compared point by point."""
    a = [f"{i}. word{i} tail" for i in range(4000)]
    b = [x + (" new" if i in (0, 17, 3999) else "") for i, x in enumerate(a)]
    df = spark.createDataFrame([("d", 1, "\n".join(a), "\n".join(b), "\n".join(a), "\n".join(b))], "doc_id string, position int, _left string, _right string, left_text string, right_text string")
    r = compare.section_html(df).first()
    assert r.left_html.count("<div class='point'>") == r.right_html.count("<div class='point'>") == 4000
    assert r.right_html.count("diff-added") == 3 and "diff-removed" not in r.left_html and "17. word17 tail<span class='diff-added'> new</span>" in r.right_html


def stored(spark):
    rows = [("a", 0, "One", "same text"), ("a", 1, "Two", "old words here"), ("a", 2, "Gone", "left only"), ("b", 0, "One", "same text"), ("b", 1, "Two", "new words here"), ("b", 2, "New <x>", "right only"), ("b", 3, "", "untitled – text")]
    return spark.createDataFrame(rows, SECTION), spark.createDataFrame([("a", "doc", "1"), ("b", "doc", "2")], "doc_id string, document_name string, version string")


def test_questions_on_comparisons(spark):
    sections, documents = stored(spark)
    asked = [(1, "a", "b", ""), (2, "a", "b", "Что добавлено?"), (3, "a", "b", "only removed"), (4, "a", "b", "что изменилось"), (5, "a", "zzz", "x"), (6, "b", "a", None), (7, None, "b", "x"), (8, "a", "a", "all")]
    df = spark.createDataFrame(asked, "query_id int, left_doc_id string, right_doc_id string, text string")
    got = {r.query_id: r for r in compare.compare_questions(sections, documents, df).collect()}
    assert {k: r.mode for k, r in got.items()} == {1: "all", 2: "added", 3: "removed", 4: "changed", 5: "all", 6: "all", 7: "all", 8: "all"}
    assert got[1].answer == "Измененных разделов: 4.\n- Изменено: Two\n- Удалено: Gone\n- Добавлено: New <x>\n- Добавлено: Section 5"
    assert got[2].answer == "Добавленных разделов: 2.\n- Добавлено: New <x>\n- Добавлено: Section 5" and got[3].answer == "Удаленных разделов: 1.\n- Удалено: Gone"
    assert got[4].answer == "Измененных разделов: 1.\n- Изменено: Two" and got[8].answer == "Измененных разделов: 0."
    assert got[5].error.endswith("doc_id=zzz") and got[5].answer is None and got[7].error.endswith("None") and got[1].error is None
    assert got[6].answer.startswith("Измененных разделов: 4.")
    lines = got[2].context.split("\n")
    assert lines[:10] == ["META:", "left_document_name=doc", "left_version=1", "right_document_name=doc", "right_version=2", "left_sections=3", "right_sections=4", "changed_sections=4", "compare_mode=added", ""]
    assert "RIGHT:\nuntitled - text" in got[2].context and "SECTION 1: New <x>\nLEFT:\n[absent]\nRIGHT:\nright only" in got[2].context
    n = spark.sparkContext.accumulator(0)

    def say(context, question):
        n.add(1)
        return None if "added" in context else f" {question} "

    told = {r.query_id: r for r in compare.compare_questions(sections, documents, df, Models(compare=F.udf(say))).collect()}
    assert told[1].answer == compare.OPEN_QUESTION and told[1].answer_source == "llm" and told[2].answer == got[2].answer and told[2].answer_source == "fallback"
    assert n.value == 6 and told[5].answer_source is None  # of eight questions two are on absent bundles


def test_written_reports(spark, tmp_path):
    sections, documents = stored(spark)
    left, right = sections.where("doc_id = 'a'").withColumn("doc_id", F.lit("a__b")), sections.where("doc_id = 'b'").withColumn("doc_id", F.lit("a__b"))
    done = compare.compare_documents(left, right)
    meta = spark.createDataFrame([("a__b", "doc", "doc")], "doc_id string, left_document_name string, right_document_name string")
    made = compare.compare_json(done, meta).select("doc_id", F.col("json").alias("text")).withColumn("name", F.concat("doc_id", F.lit(".json")))
    made = made.select("name", "text").unionByName(compare.report_html(done, "A & B").select(F.concat("doc_id", F.lit(".html")).alias("name"), F.col("html").alias("text")))
    stores.write_texts(made, f"file://{tmp_path}/out")
    read = {p.name: "".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert set(read) == {"name=a__b.json", "name=a__b.html"}
    whole = json.loads(read["name=a__b.json"])
    assert whole["summary"] == {"left_sections": 3, "right_sections": 4, "compared_sections": 5, "changed_sections": 4}
    assert [s["section_title"] for s in whole["sections"]] == ["One", "Two", "Gone", "New <x>", "Section 5"] and whole["documents"]["left_document_name"] == "doc"
    page = read["name=a__b.html"]
    assert "<title>A &amp; B</title>" in page and "New &lt;x&gt; <span class='badge'>changed</span>" in page and page.count("<tr class=") == 5 and "<span class='diff-removed'>old</span>" in page


def test_sides_are_dealt_once(spark):
    """Sections are paired, numbered and compared where they lie: one exchange, no join; null documents meet none."""
    rows = [(d, i, f"t{i % 2}", f"text ({i} )") for d in ("a", "b", None) for i in range(5)]
    left = spark.createDataFrame(rows, SECTION)
    right = left.where("section_id <> 1").withColumn("page_content", F.when(F.col("section_id") == 2, "1. x\n\n2. y").otherwise(F.col("page_content")))
    done = compare.compare_documents(left, right)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    pairs = compare.pair_sections(compare.section_blocks(left), compare.section_blocks(right), ("doc_id",))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    got = sorted((str(r.doc_id), r.position, r.left_section_id, r.right_section_id, r.left_text, r.right_display_text) for r in pairs.collect())
    one = [(1, 0, 0, "text (0)", "text (0)"), (2, 1, 3, "text (1)", "text (3)"), (3, 2, 2, "text (2)", "1. x\n\n2. y"), (4, 3, None, "text (3)", None), (5, 4, 4, "text (4)", "text (4)")]
    null = [(i + 1, i, None, f"text ({i})", None) for i in range(5)] + [(6 + n, None, i, None, t) for n, (i, t) in enumerate([(0, "text (0)"), (2, "1. x\n\n2. y"), (3, "text (3)"), (4, "text (4)")])]
    assert got == sorted([("None", *r) for r in null] + [(d, *r) for d in "ab" for r in one], key=lambda r: (r[0], r[1]))
    html_ = {(r.doc_id, r.position): r for r in done.collect()}
    assert len(html_) == 19 and html_["a", 3].right_html.count("class='point'") == 2 and html_["a", 3].section_title == "t0" and html_["a", 3].right_text == "1. x\n\n2. y"


def test_plain_texts_are_not_searched_by_patterns(spark):
    odd = ["", " ", "a", "a b", " a", "a ", " a", "a ", "a  b", "a\tb", "a\nb", "a\r\nb", "a\n\n\nb", "a-b", "a – b", "( a )", "[ 1 ]", "a]", "x )", "\u0085", None]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    t, x = compare.normalize_text.__globals__, F.col("x")
    whole = t["_spacing"](F.regexp_replace(t["_brackets"](F.regexp_replace(t["_punctuation"](x), r"(?<!\n)\n(?!\n)", " ")), r"(?U)\s*-\s*", " - "))
    shown = t["_spacing"](t["_brackets"](t["_punctuation"](x)))
    got = df.select("x", compare.normalize_text(x).alias("a"), whole.alias("b"), compare.normalize_display_text(x).alias("c"), shown.alias("d"))
    assert got.where("not (a <=> b) or not (c <=> d)").isEmpty()
    assert "contains" in df.select(compare.normalize_text(x))._jdf.queryExecution().analyzed().toString()


def test_blocks_are_those_of_difflib():
    rng = random.Random(3)
    for n in range(3000):
        words = "abcdefghij"[: rng.randint(1, 10)]
        a, b = ([w for _ in range(rng.randint(0, 25)) for w in (rng.choice(words), " ")[: rng.randint(1, 2)]] for _ in range(2))
        if n % 3 == 0:
            b = a[: rng.randint(0, len(a))] + b + a[rng.randint(0, len(a)) :]
        whole = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert compare.matching_blocks(a, b, whole.b2j) == [tuple(x) for x in whole.get_matching_blocks()]
