"""Every registered query of the library against its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from ledgerloom import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    """All but those that compare too many names by runs of letters for SQL: test_similar and test_scopes hold them to brute force and properties."""
    assert plans.queries().keys() - plans.oracle_sql().keys() == {"po_line_match", "po_fitted_rank", "fuzzy_parts_words", "fuzzy_parts_weighted"}
