"""The queries without SQL see every part-supplier edge: against plain Python over all of lineitem."""

from collections import defaultdict
from hashlib import md5

import pytest

from tessera.operators import pagerank as R
from tessera.operators import partition as P
from tessera.operators.sssp import shortest_paths
from tessera.plans import catalog


@pytest.fixture(scope="module")
def links(spark, sf):
    out = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        a, b = 2 * r[0], 2 * r[1] + 1
        out[a].add(b)
        out[b].add(a)
    return dict(out)


def ranked(links, rounds, tol=None):
    rank = {v: 1 / len(links) for v in links}
    for _ in range(rounds):
        new = {v: 0.15 + 0.85 * sum(rank[u] / len(links[u]) for u in links[v]) for v in links}
        moved, rank = max(abs(new[v] - rank[v]) for v in links), new
        if tol is not None and moved <= tol:
            break
    return rank


def refined(links, n):
    """Each pair of parts once: the best pair by fixed gains, both masked, until none is positive."""
    part = {v: v % n for v in links}
    for p in range(n):
        for q in range(p + 1, n):
            d = {v: sum(1 if part[u] != part[v] else -1 for u in links[v]) for v in links}
            pairs = sorted((-(d[a] + d[b] - 2 * (b in links[a])), a, b) for a in links if part[a] == p for b in links if part[b] == q)
            used = set()
            for g, a, b in pairs:
                if g < 0 and a not in used and b not in used:
                    used |= {a, b}
                    part[a], part[b] = q, p
    return part


def test_refinement_and_ranks(spark, sf, links):
    part, rank = refined(links, catalog.PARTS), ranked(links, 2)
    assert {r["vertex"]: r["part"] for r in catalog.refine_partition(spark, sf).collect()} == part
    got = {r["vertex"]: (r["part"], r["rank"]) for r in catalog.refine_then_rank(spark, sf).collect()}
    assert {v: x[0] for v, x in got.items()} == part and all(abs(got[v][1] - rank[v]) < 2e-6 for v in links)


def matched(w):
    """Handshakes by md5 until no edge is left: a vertex and its mate, in plain Python."""
    left, mate, i = {v: {u for u in w[v] if u != v} for v in w}, {v: v for v in w}, 0
    while any(left.values()):
        to = {v: min(us, key=lambda u: (md5(f"{min(u, v)}:{max(u, v)}{i or ''}".encode()).hexdigest(), u)) for v, us in left.items() if us}
        gone = {v for v in to if to.get(to[v]) == v}
        for v in gone:
            mate[v] = to[v]
        left, i = {v: us - gone for v, us in left.items() if v not in gone}, i + 1
    return mate


def weighted_refined(w, part, n):
    """``refined`` for edges with weights."""
    part = dict(part)
    for p in range(n):
        for q in range(p + 1, n):
            d = {v: sum(x if part[u] != part[v] else -x for u, x in w[v].items()) for v in w}
            pairs = sorted((-(d[a] + d[b] - 2 * w[a].get(b, 0)), a, b) for a in w if part[a] == p for b in w if part[b] == q)
            used = set()
            for g, a, b in pairs:
                if g < 0 and a not in used and b not in used:
                    used |= {a, b}
                    part[a], part[b] = q, p
    return part


def multilevelled(links, n, levels=2, coarsen_to=100, shrink=catalog.SHRINK):
    graphs, maps = [{v: dict.fromkeys(us, 1) for v, us in links.items()}], []
    for _ in range(levels):
        w = graphs[-1]
        if len(w) <= coarsen_to:
            break
        mate = matched(w)
        ids = {h: i for i, h in enumerate(sorted({min(v, m) for v, m in mate.items()}))}
        coarse = {v: ids[min(v, m)] for v, m in mate.items()}
        if len(ids) > shrink * len(w):
            break
        c = defaultdict(lambda: defaultdict(int))
        for v in w:
            for u, x in w[v].items():
                if coarse[v] != coarse[u]:
                    c[coarse[v]][coarse[u]] += x
        maps.append(coarse)
        graphs.append({v: dict(us) for v, us in c.items()})
    part = {v: v % n for v in (set(maps[-1].values()) if maps else graphs[0])}
    part |= weighted_refined(graphs[-1], {v: part[v] for v in graphs[-1]}, n)
    for w, coarse in zip(graphs[-2::-1], maps[::-1]):
        part = weighted_refined(w, {v: part[c] for v, c in coarse.items()}, n)
    return part, len(maps)


def test_multilevel(spark, sf, links):
    want, levels = multilevelled(links, catalog.PARTS)
    assert levels == 2
    assert {r["vertex"]: r["part"] for r in catalog.multilevel_partition(spark, sf).collect()} == want
    rank, got = ranked(links, 2), {r["vertex"]: (r["part"], r["rank"]) for r in catalog.multilevel_then_rank(spark, sf).collect()}
    assert {v: x[0] for v, x in got.items()} == want and all(abs(got[v][1] - rank[v]) < 2e-6 for v in links)


def test_waves_give_what_pairs_one_after_another_do(spark, links):
    some = {v: us for v, us in sorted(links.items())[:150]}
    w = {v: {u: 1 + (u + v) % 3 for u in us if u in some} for v, us in some.items()}
    edges = spark.createDataFrame([(v, u, x) for v in w for u, x in w[v].items()], "src long, dst long, weight long")
    n = 5
    start = spark.createDataFrame([(v, v % n) for v in w], "vertex long, part int")
    assert {r["vertex"]: r["part"] for r in P.refine(edges, start, n).collect()} == weighted_refined(w, {v: v % n for v in w}, n)


def test_rounds_do_not_shuffle_edges(spark, sf):
    e = catalog.customer_supplier(spark, sf)
    weighted, verts = R.weighted_edges(e)
    assert weighted.count() == e.count() and weighted.groupBy("src", "slice").count().agg({"count": "max"}).first()[0] <= e.count() / 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.sums(weighted, verts.selectExpr("vertex", "slices", "1.0D AS rank"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange deals the ranks, one the partial sums
    assert plan.count("Exchange") == 2 and "Bucketed: true" in plan


def test_rank_to_tolerance(spark, sf, links):
    want = ranked(links, 60, 1e-4)
    got = {r["vertex"]: r["rank"] for r in catalog.pagerank_tol(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 2e-6 for v in want)


def test_paths_of_any_length(spark):
    """A path longer than any round limit would be: every vertex of it is reached."""
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert {r["vertex"]: r["dist"] for r in shortest_paths(edges, 0).collect()} == {i: i for i in range(n + 1)}
