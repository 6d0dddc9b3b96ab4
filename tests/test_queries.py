"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from pagelens import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose work other tests do in less time.
ELSEWHERE = ("undo_identity", "page_report", "page_scorecard", "stream_ingest", "many_packs")
FAST = [k for k in plans.QUERIES if k not in ELSEWHERE]


def rows(df):
    def plain(x):
        return None if x is None or x != x else round(x, 6) if isinstance(x, float) else str(x)

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [k for k in FAST if k in plans.ORACLE_SQL])
def test_query(spark, data, name):
    d = f"{data}/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, d).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_without_training_data():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
