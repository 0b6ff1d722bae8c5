"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from stemma.plans import engine_queries, file_queries  # noqa: F401
from stemma.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    mine = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    cursor = con.execute(SQL[name])
    columns = [x[0] for x in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert mine == sorted(repr([norm(r[i]) for i in order]) for r in cursor.fetchall())


@pytest.mark.parametrize(("name", "rows"), [("date_normalize", "individuals"), ("date_standard", "individuals"), ("ocr_normalize", "documents")])
def test_one_row_each(spark, con, name, rows):
    df = QUERIES[name](spark, D)
    assert df.count() == con.execute(f"select count(*) from {rows}").fetchone()[0] == df.select(df.columns[0]).distinct().count()


def test_wrapped_lines(spark, con):
    rows = QUERIES["utf8_wrap"](spark, D).collect()
    assert all(len(r["line"].encode()) <= 255 for r in rows) and {r["doc_id"] for r in rows} == {r[0] for r in con.execute("select doc_id from documents").fetchall()}


def test_profile_keys_of_everyone(spark, con):
    rows = {r["key"]: r["n"] for r in QUERIES["profile_key_freq"](spark, D).collect()}
    name = "regexp_replace(lower(full_name), '[^a-z0-9]', '', 'g')"
    want = dict(con.execute(f"select 'name-exact|' || {name}, count(*) from individuals where {name} <> '' group by 1").fetchall())
    assert {k: n for k, n in rows.items() if k.startswith("name-exact|")} == want


def test_capped_pairs_are_some_of_all(spark):
    every = {(r["l"], r["r"]) for r in QUERIES["candidate_pairs_owner_key"](spark, D).collect()}
    some = [(r["l"], r["r"]) for r in QUERIES["candidate_pairs_capped"](spark, D).collect()]
    degree: dict = {}
    for pair in some:
        for x in pair:
            degree[x] = degree.get(x, 0) + 1
    assert set(some) <= every and len(some) == len(set(some)) and max(degree.values()) <= 32
    # a pair is left out only where one of both is full
    assert all(max(degree.get(x, 0) for x in pair) == 32 for pair in every - set(some))


def test_every_query_is_held_to_something():
    assert set(QUERIES) - set(SQL) == {"date_normalize", "date_standard", "ocr_normalize", "utf8_wrap", "profile_key_freq", "candidate_pairs_capped"}


def test_entry_needs_no_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
