"""Registered queries against their SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from streetlink import queries

SF = "/root/testdata/sf0.001"
NAMES = ["grammar_fields", "grammar_canonical", "grammar_notes", "grammar_note_families", "grammar_scores", "link_struct_order", "transform_texts", "parse_fields", "match_reason", "link_exact"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(queries.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == columns
    rows = sorted(repr(tuple(r[at[c]] for c in columns)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows and rows


def test_every_query_with_sql_is_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())
