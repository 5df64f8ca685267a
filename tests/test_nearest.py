import random

import pytest

from tesserae.operators import retrieval


def brute(vectors, queries, k):
    norm = lambda v: sum(x * x for x in v) ** 0.5
    fine = lambda v: bool(v) and all(x is not None and abs(x) < 1e300 for x in v) and norm(v) > 0
    out = set()
    for q, a in queries:
        if fine(a):
            scored = sorted((-round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 9), i) for i, b in vectors if fine(b) and len(b) == len(a))
            out |= {(q, r, i, round(-s, 6)) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("v_block, q_block, at_once", [(1 << 16, 1 << 13, 256), (30, 7, 3), (1, 1, 1)])
def test_blocks_against_brute_force(spark, monkeypatch, v_block, q_block, at_once):
    rng = random.Random(1)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)]  # many ties, some zero
    vectors += [(100, None), (101, []), (102, [float("nan"), 1.0, 0.0, 0.0]), (103, [float("inf"), 1.0, 0.0, 0.0]), (104, [0.0] * 4), (105, [1.0] * 5), (106, [2.0, 1.0, 0.0, 0.0, 1.0])]
    queries = [(i, v) for i, v in vectors if i % 3 == 0 or i >= 100]
    for name, value in (("VECTOR_BLOCK", v_block), ("QUERY_BLOCK", q_block), ("AT_ONCE", at_once)):
        monkeypatch.setattr(retrieval, name, value)
    if v_block == 1:
        vectors, queries = vectors[:8], queries[:3]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    for k in (1, 5, 100) if v_block == 30 else (5,):
        got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in retrieval.knn(df, asked, k).collect()}
        assert got == brute([v for v in vectors if v[0] not in (102, 103)], [q for q in queries if q[0] not in (102, 103)], k)
    assert retrieval.knn(df.limit(0), asked).count() == 0 and retrieval.knn(df, asked.limit(0)).count() == 0


def test_no_pairs_of_all_rows_in_the_plan(spark):
    df = spark.range(100).selectExpr("id as vec_id", "array(float(id), float(1)) as embedding")
    plan = retrieval.knn(df, df.withColumnRenamed("vec_id", "query_id"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    inside = retrieval.knn(df.selectExpr("*", "vec_id % 3 as g"), df.selectExpr("vec_id as query_id", "embedding", "vec_id % 3 as g"), 2, within=("g",))
    assert inside.count() == 200 and inside.where("abs(query_id - vec_id) % 3 <> 0").isEmpty()


def test_bm25_of_one_index_by_tasks_and_by_joins(spark, monkeypatch):
    """A small query set is scored within the rows: the rows of the join, no row for each chunk of each query in a shuffle."""
    rng = random.Random(4)
    chunks = spark.createDataFrame([(i, " ".join(rng.choices("a b c d e f g".split(), [9, 5, 2, 1, 1, 1, 1], k=rng.randint(0, 12))) if i % 9 else None) for i in range(300)], "chunk_id long, text string").repartition(5)
    queries = spark.createDataFrame([(0, "a a c"), (1, "zz"), (2, ""), (3, "d e f zz"), (4, "b")], "query_id long, text string")
    monkeypatch.setattr(retrieval, "CELLS", 40)
    for fill in (True, False):
        got = retrieval.bm25(chunks, queries, 8, fill=fill)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        with monkeypatch.context() as m:
            m.setattr(retrieval, "is_small", lambda df: False)
            wanted = retrieval.bm25(chunks, queries, 8, fill=fill).collect()
        row = lambda r: (r.query_id, r["rank"], r.chunk_id, round(r.score, 8) + 0.0)
        assert sorted(map(row, got.collect())) == sorted(map(row, wanted)) and len(wanted) >= 24
    assert retrieval.bm25(chunks.limit(0), queries).count() == 0 == retrieval.bm25(chunks, queries.limit(0)).count()


@pytest.mark.parametrize("parts", [1, 256])
def test_within_groups_by_blocks(spark, monkeypatch, parts):
    """Vectors meet the queries of their group in matrix products: no joined row a pair, and the rows of brute force."""
    rng = random.Random(5)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(4)], None if i % 13 == 0 else i % 3, "ab"[i % 2]) for i in range(80)] + [(100, None, 1, "a"), (101, [0.0] * 4, 1, "a")]
    for name, value in (("VECTOR_BLOCK", 30), ("QUERY_BLOCK", 9), ("GROUPS", parts)):
        monkeypatch.setattr(retrieval, name, value)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, g int, h string")
    found = retrieval.knn(df, df.where("vec_id % 4 = 0 and h = 'a'").withColumnRenamed("vec_id", "query_id"), 5, within=("g", "h"))
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    wanted = set()
    for g in range(3):
        own = [(i, v) for i, v, a, b in vectors if a == g and b == "a"]
        wanted |= brute(own, [x for x in own if x[0] % 4 == 0], 5)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in found.collect()} == wanted


def test_bm25_cuts_words_within_the_tasks(spark, monkeypatch):
    """Frequencies and scores come from the texts, cut in the tasks as Spark's split does; no row a word of a chunk is made."""
    blank = ["", " ", "\n\t", None, "a\x0bb", "a\xa0b", " a  b ", "\x1ca b", "a\u2003b", "\x85b", "ä a\r\nb\fa", "a a a"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(blank * 3)], "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(0, "a b"), (1, "a\xa0b \x1ca"), (2, "ä"), (3, "\x85b a\u2003b")], "query_id long, text string")
    monkeypatch.setattr(retrieval, "TEXT", 8)
    plans, real = [], retrieval.save
    monkeypatch.setattr(retrieval, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    got = retrieval.bm25(chunks, queries, 5)
    assert len(plans) == 1 and "MapInArrow" in plans[0] and plans[0].count("Generate") == 1  # that of the questions
    row = lambda r: (r.query_id, r["rank"], r.chunk_id, round(r.score, 8) + 0.0)
    monkeypatch.setattr(retrieval, "is_small", lambda df: False)
    assert sorted(map(row, got.collect())) == sorted(map(row, retrieval.bm25(chunks, queries, 5).collect()))


def test_sections_are_summed_and_ranked_within_the_tasks(spark, monkeypatch):
    """Sections of a document and a section's several rows may lie in different blocks: the rows of the join, nothing but sections shuffled."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices("alpha beta gamma alphabet nananana delta".split(), k=n))
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(7)]), rng.choice([None, say(2)]), say(rng.randint(0, 6))) for _ in range(150)]
    sections = spark.createDataFrame(rows, "doc_id long, section_id int, section_title string, page_content string").repartition(4)
    queries = spark.createDataFrame([(7, "alpha beta"), (8, "nana alpha alpha"), (9, "omega"), (None, "bet gamma"), (8, "delta")], "query_id long, text string")
    for cells in (1, 40, 1 << 19):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = retrieval.scan_sections(sections, queries, 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
        with monkeypatch.context() as m:
            m.setattr(retrieval, "is_small", lambda df: False)
            wanted = retrieval.scan_sections(sections, queries, 3).collect()
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted)) and len(wanted) > 40
    assert retrieval.scan_sections(sections.limit(0), queries).count() == 0 == retrieval.scan_sections(sections, queries.limit(0)).count()
