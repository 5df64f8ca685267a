import pytest
from pyspark.sql import functions as F

from tesserae.llm import common, mixing

DOCS = "doc_id long, text string, source string"


def made(spark, kind):
    if kind == "empty":
        return spark.createDataFrame([], DOCS)
    if kind == "blank":
        return spark.createDataFrame([(1, "", "a"), (2, None, None), (3, " ", "b")], DOCS)
    # one source holds a third of the rows, some hold few words, one none, one is null; ids and texts repeat
    rows = [(i, "w " * (i * 37 % 400), "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i * i % 251:03d}") for i in range(1500)]
    rows += [(7, "again and again", "hot")] * 5 + [(9, "", "none"), (None, "x y z", "tiny"), (11, None, "none")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("kind", ["skewed", "blank", "empty"])
def test_sources_as_a_table_give_the_rows_of_the_list(spark, monkeypatch, kind):
    """Beyond SOURCES the sources are a table; targets, slots, ranks and pieces stay what they are."""
    docs = common.save(mixing.sized(made(spark, kind)).select("doc_id", "source", "_size", "_md5"), "t")

    def rows():
        placed, pieces, count = mixing.mix(docs)
        at = sorted((r.source or "", r.doc_id or -1, r._s, r.source_size, round(r.target, 6), r._at) for r in placed.collect() if r._size)
        return at, sorted(tuple(r) for r in pieces.select("slot", "_s", "_at", "epoch", "start", "length").collect()), count

    listed = rows()
    monkeypatch.setattr(mixing, "SOURCES", {"skewed": 10, "blank": 0, "empty": -1}[kind])
    assert rows() == listed
    assert (len(listed[1]) > 1000) == (kind == "skewed")


def test_targets_and_schedule_of_a_table(spark):
    sizes = [10, 120, 100, 0, 3, 3, 5000, 1, 77, 40_000, 2]
    df = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, n long")
    aims = mixing.many_targets(df).orderBy("_s").collect()
    assert [r._s for r in aims] == list(range(len(sizes)))
    assert [r.target for r in aims] == pytest.approx(mixing.targets(sizes))
    wanted = [5e4, 0.0, 2e4, 1e4, 0.25]
    table = spark.createDataFrame(list(enumerate(wanted)), "_s int, target double")
    key = [F.col(c) for c in ("slot", "_s", "rank")]
    got = [tuple(r) for r in mixing.many_scheduled(table, 1).select(*key).orderBy("slot").collect()]
    assert got == [tuple(r) for r in mixing.schedule(spark, wanted, 1).select(*key).orderBy("slot").collect()]
