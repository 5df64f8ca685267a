import duckdb
import pytest

import __spark_entry__ as entry
from tesserae.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(core.ORACLES[name])
    columns = [c[0] for c in cur.description]

    def rows(names, values):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(tuple(f"{r[i]:.7g}" if isinstance(r[i], float) else repr(r[i]) for i in order) for r in values)

    wanted = rows(columns, cur.fetchall())
    df = core.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
