"""An order with more hits than a page is judged whole."""

import os

import duckdb
from loomgraph.plans import catalogue, retrieval  # noqa: F401  registers its queries


def test_an_order_of_many_hits(spark, sf, tmp_path):
    parts = duckdb.sql(f"SELECT p_partkey FROM '{sf}/part.parquet' WHERE p_type LIKE 'STANDARD%' OR p_type LIKE 'LARGE%' ORDER BY p_type, p_partkey").fetchall()
    keys = [k for (k,) in parts][:3] + [k for (k,) in parts][-12:]
    rows = ", ".join(f"(1, {k}, 1, 1 + 2 * {i})" for i, k in enumerate(reversed(keys)))
    os.symlink(f"{sf}/part.parquet", tmp_path / "part.parquet")
    lines = f"SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, n::INT AS l_linenumber, 'A' AS l_returnflag, 'O' AS l_linestatus FROM (VALUES {rows}) t(o, p, s, n)"
    duckdb.sql(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["eval_comparison"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalogue.SQL["eval_comparison"]).fetchall()
    assert got[0][4] == 0.8
