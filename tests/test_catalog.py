"""Every registered corpus-lexicon query against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corpusloom import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    expected = canon([d[0] for d in cur.description], cur.fetchall())
    found = canon(df.columns, [tuple(r) for r in df.collect()])
    assert found[0] == expected[0]
    assert found[1] == expected[1]
    assert found[1] or name in ("sentences_of_word", "compare_texts")
