"""Greedy swaps: what all pairs in order give, and work that doesn't grow with equal gains."""

import random

import numpy as np

from tessera.operators import partition as P
from tessera.operators.graph_etl import sliced, symmetrize


def test_many_equal_gains(spark):
    """Every unlinked pair gains 2: going through all ties for each swap would take hours."""
    n = 6000
    edges = symmetrize(spark.range(0, 2 * n, 2).selectExpr("id AS src", "id + 1 AS dst"))
    got = [(r["a"], r["b"], r["gain"]) for r in P.pair_swaps(edges, P.initial_parts(edges, 2), 0, 1).orderBy("pick").collect()]
    assert got == [x for a in range(0, 2 * n, 4) for x in ((a, a + 3, 2), (a + 2, a + 1, 2))]


def test_swaps_are_those_of_all_pairs_in_order():
    rng = random.Random(1)
    for _ in range(1500):
        n, m, most, share = rng.randint(0, 10), rng.randint(0, 10), rng.choice([1, 3, 20]), rng.choice([0, 0.1, 0.5, 0.9, 1])
        ids = rng.sample(range(100), n + m)
        a, b = ({v: rng.randint(-most, 2 * most) for v in some} for some in (ids[:n], ids[n:]))
        links = [(x, y, rng.randint(1, rng.choice([1, 4]))) for x in a for y in b if rng.random() < share for _ in range(rng.choice([1, 1, 2]))]
        rng.shuffle(links)
        limit, used, want = rng.choice([None, None, 1, 3]), set(), []
        for g, x, y in sorted((2 * sum(w for u, v, w in links if (u, v) == (x, y)) - a[x] - b[y], x, y) for x in a for y in b):
            if g < 0 and not used & {x, y} and (limit is None or len(want) < limit):
                used |= {x, y}
                want.append((x, y, -g))
        ends = [np.array([*x], "int64") for x in (a, a.values(), b, b.values())]
        assert P.pick_swaps(*ends, tuple(np.array([x[k] for x in links], "int64") for k in range(3)), limit) == want


def test_hubs_in_slices_keep_their_gains(spark):
    """A hub's edges in several slices, weights, several edges of a pair, a vertex without a part."""
    rows = [(0, v, 1 + v % 3) for v in range(1, 400)] + [(v, v % 7, 2) for v in range(7, 400)] + [(5, 401, 4)]
    edges = spark.createDataFrame([y for s, d, w in rows for y in ((s, d, w), (d, s, w))], "src long, dst long, weight long")
    parts = P.initial_parts(edges, 3).filter("vertex <> 401")
    cut = sliced(edges)
    assert cut._slices.filter("slices > 1").count() > 0 and cut.count() == edges.count()
    part, want = {v: v % 3 for v in range(400)}, {}
    for s, d, w in ((s, d, w) for x, y, w in rows for s, d in ((x, y), (y, x))):
        e, g = want.get(d, (0, 0))
        want[d] = (e + w * (s in part and part[s] != part.get(d)), g + w)
    for e in (edges, cut):
        assert {r["vertex"]: (r["ext"], r["deg"]) for r in P.d_values(e, parts).collect()} == want
    assert P.pair_swaps(cut, parts, 0, 1).orderBy("pick").collect() == P.pair_swaps(edges, parts, 0, 1).orderBy("pick").collect()
