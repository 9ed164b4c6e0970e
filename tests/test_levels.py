"""Multilevel partitioning deals a level's edges out once: matching, merging and refinement read them where they lie."""

import random

import pytest

from tessera.operators import graph_etl as X
from tessera.operators import partition as P


@pytest.fixture(scope="module")
def hub(spark):
    """Weighted edges both ways: a hub with most of them, the others at random; all vertices' weights as a dict."""
    rng, w = random.Random(3), {}
    for a, b in [(0, v) for v in range(1, 300)] + [(rng.randrange(1, 300), rng.randrange(300, 340)) for _ in range(150)]:
        w[a, b] = w[b, a] = 1 + (a + b) % 4
    return spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, weight long").cache(), w


def test_edges_of_a_level_are_written_once(spark, monkeypatch):
    wrote = []
    for module, name in ((P, "materialize"), (X, "materialize"), (X, "bucketed")):
        monkeypatch.setattr(module, name, lambda df, *a, f=getattr(module, name): wrote.append(({"src", "dst"} <= {*df.columns}, a[-1 if len(a) == 1 else 1])) or f(df, *a))
    n = 60
    edges = X.symmetrize(spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst"))
    got = {r["vertex"]: r["part"] for r in P.multilevel(edges, 2, levels=1, coarsen_to=10).collect()}
    assert [label for both, label in wrote if both and label != "left"] == ["edges"] * 2  # "left": what a matching hasn't matched yet
    assert got.keys() == set(range(n)) and sum(got[v] != got[(v + 1) % n] for v in range(n)) < n


def test_merged_edges_are_those_of_contract(spark, hub):
    edges, w = hub
    cut = P.in_slices(edges)
    cmap = P.coarse_map(P.match_vertices(cut)).cache()
    assert sorted(cmap.collect()) == sorted(P.coarse_map(P.match_vertices(edges)).collect())
    got, want = P.coarser(cut, cmap), P.contract(edges, cmap)
    assert sorted(got.select("src", "dst", "weight").collect()) == sorted(want.collect())
    assert got._slices.filter("slices > 1").count() > 0 and got.select("src", "slice").distinct().groupBy("src").count().agg({"count": "max"}).first()[0] > 1
    assert {r["vertex"]: r["out"] for r in got._slices.collect()} == {r["src"]: r["count"] for r in want.groupBy("src").count().collect()}
    parts = P.initial_parts(want, 3)
    assert sorted(P.d_values(got, parts).collect()) == sorted(P.d_values(want, parts).collect())
    assert P.pair_swaps(got, parts, 0, 1).orderBy("pick").collect() == P.pair_swaps(want, parts, 0, 1).orderBy("pick").collect()


def test_sources_are_looked_up_where_edges_lie(spark, hub):
    cut = P.in_slices(hub[0])
    cmap = P.coarse_map(P.match_vertices(cut))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        to, on = P.dealt(cut, cmap.select(cmap["vertex"].alias("src"), "coarse"))
        plan = cut.join(to, on)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    edges = plan[: plan.index("Bucketed: true")]
    assert "SortMergeJoin" not in edges and edges.count("Exchange") == 0  # the first side of the join: a scan of buckets


def test_symmetric_edges_with_loops_and_nulls(spark):
    rows = [(1, 2), (2, 1), (3, 3), (None, 5), (5, None), (6, None), (None, 7), (None, None), (9, 8), (9, 8)]
    got = X.symmetrize(spark.createDataFrame(rows, "src long, dst long")).collect()
    assert len(got) == len({*got}) and {*map(tuple, got)} == {*rows} | {(b, a) for a, b in rows}


def test_nothing_to_partition(spark):
    none = spark.createDataFrame([], "src long, dst long")
    loops = spark.createDataFrame([(1, 1), (4, 4)], "src long, dst long")
    assert P.multilevel(none, 2, coarsen_to=0).collect() == [] and P.refine(none, P.initial_parts(none, 2), 2).collect() == []
    assert {r["vertex"]: r["part"] for r in P.multilevel(loops, 2, coarsen_to=0).collect()} == {1: 1, 4: 0}
