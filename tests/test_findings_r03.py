"""Odd layouts and rules that findings named."""

import os
import shutil

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def test_stream_over_a_folder(spark, tmp_path):
    """A table may be a folder of files with other names, beside tables with similar names."""
    from scholia.queries import streams

    for name in ("documents", "events"):
        os.mkdir(tmp_path / f"{name}.parquet")
        shutil.copy(f"{DIR}/{name}.parquet", tmp_path / f"{name}.parquet" / "part-0000.parquet")
    shutil.copy(f"{DIR}/labels.parquet", tmp_path / "documents.parquet.old")
    for query in (streams.stream_inc_extract, streams.stream_sessions_live):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(map(tuple, query(spark, DIR).collect()))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_reference_without_parentheses(spark):
    """Where a piece of a name with parentheses is asked for, the SQL drops them on both sides, as the rule has it."""
    from scholia.queries.rules import QUERIES

    query, sql = QUERIES["resolve_reference"]
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{LARGER}/part.parquet'")
    got = sorted(tuple(r) for r in query(spark, LARGER).select("qid", "id", "strategy").collect())
    assert got == sorted(c.sql(f"select qid, id, strategy from ({sql})").fetchall())
    assert any(strategy == "contained" for *_, strategy in got)
