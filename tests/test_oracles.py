"""Queries against their SQL on values that the given tables may lack."""

import duckdb

from readloom import queries, queries_tables  # noqa: F401


def test_fold_inputs_rounds(spark, tmp_path):
    """A rate that only its seventh digit lifts over a limit: the lines have six, and so has the SQL."""
    path = str(tmp_path / "embeddings.parquet")
    duckdb.sql(f"copy (select 1::bigint as vec_id, (list_value(0.3333002, 0.6666702, 0.5) || list_transform(range(61), lambda x: 1.0))::float[] as embedding, 0 as label) to '{path}' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    want = [tuple(r) for r in con.execute(queries.ORACLES["fold_inputs"]).fetchall()]
    found = queries.QUERIES["fold_inputs"](spark, str(tmp_path))
    assert [tuple(r) for r in found.select("vec_id", "n", "high", "places").collect()] == want == [(1, 64, 63 - 0, sum(range(4, 65)))]
