"""Every registered query of the graph catalogue against its SQL in DuckDB."""

import duckdb
import loomgraph.plans.change_sets
import loomgraph.plans.deltas
import loomgraph.plans.ordered
import loomgraph.plans.outputs
import loomgraph.plans.phrases
import loomgraph.plans.retrieval
import loomgraph.plans.streams
import loomgraph.plans.vector_cells  # noqa: F401  register their queries
import pytest
from loomgraph.plans import catalogue

TABLES = "part orders lineitem events documents embeddings pages benchmark".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in catalogue.SQL:
        found = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
        assert got == want
