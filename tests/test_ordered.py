"""As-of joins, freshness and quantiles against plain computations."""

import random

import duckdb
import pytest
from loomgraph.operators import ordered


def test_asof_and_freshness(spark):
    """A key with most rows, ties in time, null keys and times, keys with only one feed."""
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None]
    right = [(rng.choice(keys), rng.choice([None, *range(40)]), i, f"v{i}") for i in range(120)] + [("only right", 3, 900, "x")]
    left = [(rng.choice(keys), rng.choice([None, *range(45)]), 1000 + i) for i in range(80)] + [("only left", 3, 2000)]
    r = spark.createDataFrame(right, "k string, t int, id long, v string").repartition(5)
    found = ordered.asof(spark.createDataFrame(left, "k string, t int, id long"), r, "k", "t", "id")
    want = set()
    for k, t, i in left:
        best = max(((rt, ri, v) for rk, rt, ri, v in right if rk == k and rt is not None and t is not None and rt <= t), default=None)
        want.add((k, t, i, best))
    assert {(x.k, x.t, x.id, tuple(x.found) if x.found else None) for x in found.collect()} == want
    commits = [x[:3] for x in right if x[1] is not None]
    runs = [(k, t, i) for k, t, i in left if t is not None and t < 30]
    c, u = (spark.createDataFrame(x, "k string, t int, id long") for x in (commits, runs))
    got = {x.k: (x.head, x.last_indexed, x.behind, x.stale) for x in ordered.freshness(c, u, "k", "t", "id").collect()}
    for k in {c[0] for c in commits}:
        own = sorted((t, i) for j, t, i in commits if j == k)
        last = max((t for j, t, _ in runs if j == k), default=None)
        seen = max((x for x in own if last is not None and x[0] <= last), default=None)
        later = [x for x in own if seen and x > seen]
        assert got[k] == (own[-1][1], seen and seen[1], len(later) if seen else None, (own[-1] != seen) if seen else None)


@pytest.mark.parametrize("bins", [4096, 3])
def test_quantiles(spark, bins, monkeypatch):
    monkeypatch.setattr(ordered, "BINS", bins)
    rng = random.Random(4)
    groups = {"a": [rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(301)], "same": [2.5] * 50, "one": [-1.0], "two": [1e300, -1e300], "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51], "none": [None, float("nan")]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(None, 3.0), (None, 5.0), ("a", None)]
    got = {(r.k, r.share): r.value for r in ordered.quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    for k, vs in [*groups.items(), (None, [3.0, 5.0])]:
        for share in (0.0, 0.5, 0.95, 1.0):
            if k == "none":
                assert (k, share) not in got
            else:
                want = duckdb.execute("SELECT quantile_cont(v, ?) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [share, vs]).fetchone()[0]
                assert got[k, share] == pytest.approx(want, rel=1e-12)
