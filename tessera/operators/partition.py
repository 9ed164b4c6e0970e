"""Partitions of a graph's vertices: cuts, gains, refinement by swaps, matching, coarsening."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush, merge
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import is_cut, key_part
from ..session import discard, materialize, ship_package
from .aggregate import dense_numbers
from .graph_etl import every_slice, merged_slices, sliced, vertices
from .pagerank import pagerank, sharded_pagerank, weighted_edges


def initial_parts(edges: DataFrame, parts: int) -> DataFrame:
    """(vertex, part): vertex mod parts."""
    return vertices(edges).withColumn("part", key_part("vertex", parts))


def with_parts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with src_part and dst_part, null where unassigned."""
    s, d = (parts.select(F.col("vertex").alias(k), F.col("part").alias(f"{k}_part")) for k in ("src", "dst"))
    return edges.join(s, "src", "left").join(d, "dst", "left")


def weight_of(edges: DataFrame) -> Column:
    """An edge's weight: its column ``weight``, else 1."""
    return F.col("weight") if "weight" in edges.columns else F.lit(1).cast("bigint")


def dealt(edges: DataFrame, vertex: DataFrame) -> tuple[DataFrame, list[str]]:
    """``vertex`` (src, ...) ready to be joined with edges, and the columns to join on: with ``sliced`` edges a row a slice, so that those aren't moved or sorted."""
    slices = getattr(edges, "_slices", None)
    if slices is None:
        return vertex, ["src"]
    return every_slice(vertex, slices).hint("shuffle_hash"), ["src", "slice"]


def d_values(edges: DataFrame, parts: DataFrame, *keep: str) -> DataFrame:
    """(vertex, ext, deg, d): weight of edges to other parts, of all edges, external minus internal; ``keep``: with part, too.

    Neighbours' weights are added up by part before a vertex's own part is looked up: edges are joined once.
    """
    s, d = (parts.select(F.col("vertex").alias(k), F.col("part").alias(f"{k}_part")) for k in ("src", "dst"))
    s, on = dealt(edges, s)
    near = edges.withColumn("_w", weight_of(edges)).join(s, on, "left").groupBy("dst", "src_part").agg(F.sum("_w").alias("_w"))
    cut = F.sum(F.when(is_cut(F.col("src_part"), F.col("dst_part")), F.col("_w")).otherwise(0))
    g = near.join(d, "dst", "left").groupBy(F.col("dst").alias("vertex"), F.col("dst_part").alias("part")).agg(cut.alias("ext"), F.sum("_w").alias("deg"))
    return g.select("vertex", *keep, "ext", "deg", (F.col("ext") * 2 - F.col("deg")).alias("d"))


def boundary_counts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(vertex, n): external edges of each source on the boundary."""
    e = with_parts(edges, parts).filter(is_cut(F.col("src_part"), F.col("dst_part")))
    return e.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("n"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: weight of the cut edges of a symmetric edge set, each counted once."""
    return with_parts(edges, parts).agg(F.floor(F.sum(F.when(is_cut(F.col("src_part"), F.col("dst_part")), weight_of(edges)).otherwise(0)) / 2).cast("bigint").alias("cut"))


class _Levels:
    """Places (of an ascending list of vertices) by their D, falling; places that were taken are unhooked in passing."""

    def __init__(self, d: np.ndarray):
        order = np.argsort(-d, kind="stable")
        values, starts = np.unique(-d[order], return_index=True)
        self.values = (-values).tolist()
        self.places = [x.tolist() for x in np.split(order, starts[1:])] if len(d) else []
        self.after = [list(range(len(x) + 1)) for x in self.places]  # the first one left, then the one after each
        self.taken = bytearray(len(d))

    def left(self, level: int) -> Iterator[int]:
        places, after, before = self.places[level], self.after[level], 0
        while (k := after[before]) < len(places):
            if self.taken[places[k]]:
                after[before] = after[k + 1]
            else:
                yield places[k]
                before = k + 1

    def any(self, level: int) -> bool:
        return next(self.left(level), None) is not None

    def next(self, level: int) -> int:
        """The first level from ``level`` on that has places left, or the number of levels."""
        while level < len(self.values) and not self.any(level):
            level += 1
        return level


def pick_swaps(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray], limit: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy (a, b, gain): the best pair, both masked, until no gain is positive; ties: the least (a, b).

    gain = D(a) + D(b) - 2 * weight of their edge; ``links``: the edges' ends in a
    and in b and their weights. Gains are gone through falling, and at one gain
    the a's ascending: each takes the least b left that has just this gain with
    it, one without a link from the level of D that fits or one of its links.
    A pair of levels that had its turn has linked pairs left at most, so a link
    is met twice and the work grows with vertices and links, not with ties.
    """
    by_a, by_b = np.argsort(a), np.argsort(b)
    a, da, b, db = a[by_a], da[by_a], b[by_b], db[by_b]
    x, y = np.searchsorted(a, links[0]), np.searchsorted(b, links[1])
    by = np.lexsort((y, x))
    x, y, w = x[by], y[by], links[2][by]
    if len(x):  # several edges of one pair add up
        new = np.flatnonzero(np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0)))
        x, y, w = x[new], y[new], np.add.reduceat(w, new)
    first, linked = np.searchsorted(x, np.arange(len(a) + 1)).tolist(), memoryview(np.ascontiguousarray(y, "int64"))
    gains = da[x] + db[y] - 2 * w
    by = np.argsort(-gains, kind="stable")[: int((gains > 0).sum())]
    x, y, fall = x[by], y[by], -gains[by]
    ends = np.searchsorted(fall, fall, "right")  # where each gain's links end
    left, right = _Levels(da), _Levels(db)
    gone = [np.frombuffer(side.taken, "uint8") for side in (left, right)]

    def unlinked(p: int, level: int) -> int | None:
        for q in right.left(level):
            i = bisect_left(linked, q, first[p], first[p + 1])
            if i == first[p + 1] or linked[i] != q:
                return q
        return None

    def turn(i: int, j: int) -> Iterator[tuple[int, int, int]]:
        for p in left.left(i):
            if not right.any(j):
                return
            yield p, -1, j

    out: list[tuple[int, int, int]] = []
    turns = [(-(left.values[0] + right.values[0]), 0, 0)] if len(a) and len(b) else []
    begun, top, at = 0, 0, 0
    while limit is None or len(out) < limit:
        gain = max(-turns[0][0] if turns else 0, -int(fall[at]) if at < len(fall) else 0)
        if gain <= 0:
            break
        now = []
        while turns and -turns[0][0] == gain:
            _, i, j = heappop(turns)
            top = right.next(top)
            if i == begun and i + 1 < len(left.values) and top < len(right.values):
                begun = i + 1
                heappush(turns, (-(left.values[begun] + right.values[top]), begun, top))
            j = right.next(max(j, top))
            if j < len(right.values) and left.any(i):
                if left.values[i] + right.values[j] == gain:
                    now.append((i, j))
                    j += 1
                if j < len(right.values):
                    heappush(turns, (-(left.values[i] + right.values[j]), i, j))
        to = int(ends[at]) if at < len(fall) and fall[at] == -gain else at
        free = at + np.flatnonzero((gone[0][x[at:to]] | gone[1][y[at:to]]) == 0)
        edges, at = zip(x[free].tolist(), y[free].tolist(), repeat(-1)), to
        for p, found in groupby(merge(edges, *(turn(i, j) for i, j in now)), itemgetter(0)):
            if left.taken[p]:
                continue
            fit = [q for q in (unlinked(p, j) if j >= 0 else None if right.taken[q] else q for _, q, j in found) if q is not None]
            if fit:
                q = min(fit)
                left.taken[p] = right.taken[q] = 1
                out.append((int(a[p]), int(b[q]), gain))
                if len(out) == limit:
                    break
    return out


def wave_swaps(edges: DataFrame, parts: DataFrame, pairs: list[tuple[int, int]], limit: int | None = None) -> DataFrame:
    """(p, q, pick, a, b, gain) of the greedy swaps between the parts of each pair, with D as it stands; no part is in two pairs.

    Picking is sequential by its definition, so a pair is a task; the pairs run
    side by side. Only vertices that some partner could give a positive gain
    reach it (a's D plus the other side's largest must be positive).
    """
    spark = edges.sparkSession
    sides = [(k, side, part) for k, pq in enumerate(pairs) for side, part in enumerate(pq)]
    named = F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, sides))} AS t(pair, side, part)"))  # two rows a pair
    d = materialize(d_values(edges, parts, "part").join(named, "part").select("vertex", "d", "pair", "side"), "gains")
    top = d.groupBy("pair").agg(*[F.max(F.when(F.col("side") == k, F.col("d"))).alias(f"top{k}") for k in (0, 1)])
    own, other = ("IF(side = 0, top0, top1) AS own", "IF(side = 0, top1, top0) AS other")
    live = d.join(F.broadcast(top), "pair").selectExpr("pair", "side", "vertex", "d", own, other).filter("d + other > 0")
    if limit == 1 and "weight" not in edges.columns:  # the two largest give the sum of tops or 2 less: nothing below that can win
        live = live.filter("d >= own - 2")
    a, b = (live.filter(F.col("side") == k).select(F.col("vertex").alias(v), F.col("pair").alias(f"{v}_pair")) for k, v in ((0, "src"), (1, "dst")))
    a, on = dealt(edges, a)
    links = edges.withColumn("w", weight_of(edges)).join(a, on).join(b.hint("shuffle_hash"), "dst").filter("src_pair = dst_pair")
    out = "p int, q int, pick bigint, a bigint, b bigint, gain bigint"
    rows = live.select("pair", "vertex", "d", "side", F.lit(None).cast("bigint").alias("dst")).union(links.select("src_pair", "src", "w", F.lit(-1), "dst"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, vertex, d = (table[c].to_numpy() for c in ("side", "vertex", "d"))
        at = [side == k for k in (0, 1, -1)]
        links = vertex[at[2]], table["dst"].filter(pa.array(at[2])).to_numpy(), d[at[2]]
        picks = pick_swaps(vertex[at[0]], d[at[0]], vertex[at[1]], d[at[1]], links, limit)
        p, q = pairs[key[0].as_py()]
        a, b, gain = zip(*picks, strict=True) if picks else ((), (), ())
        columns = [p] * len(picks), [q] * len(picks), range(len(picks)), a, b, gain
        return pa.table({c.split()[0]: pa.array(x, pa.int32() if c.endswith(" int") else pa.int64()) for c, x in zip(out.split(", "), columns, strict=True)})

    ship_package(spark)
    picked = rows.groupBy("pair").applyInArrow(run, out)
    picked._gains = d
    return picked


def pair_swaps(edges: DataFrame, parts: DataFrame, p: int, q: int, limit: int | None = None) -> DataFrame:
    """(pick, a, b, gain) of the greedy swaps between parts p and q."""
    return wave_swaps(edges, parts, [(p, q)], limit).drop("p", "q")


def swap(parts: DataFrame, swaps: DataFrame, p: int | None = None, q: int | None = None) -> DataFrame:
    """``parts`` with the labels of the pairs (a in p, b in q) exchanged; p and q may be columns of ``swaps``."""
    to_a, to_b = (F.col(c) if k is None else F.lit(k) for c, k in (("q", q), ("p", p)))
    moves = F.array(*[F.struct(F.col(v).alias("vertex"), to.alias("_to")) for v, to in (("a", to_a), ("b", to_b))])
    moves = swaps.select(F.inline(moves))  # swaps are read, or picked, once
    return parts.join(moves, "vertex", "left").select("vertex", F.coalesce("_to", "part").cast("int").alias("part"))


def in_slices(edges: DataFrame) -> DataFrame:
    """``sliced`` edges, with weights if there are any."""
    return sliced(edges.select("src", "dst", *({"weight"} & {*edges.columns})))


def refine(edges: DataFrame, parts: DataFrame, n: int, update_d: bool = False) -> DataFrame:
    """Each pair p < q once, in order: greedy swaps with fixed D, then all labels exchanged.

    ``update_d``: one swap of a pair at a time with fresh D, until no gain is
    positive. Pairs of one sum p + q share no part, and a vertex's D depends on
    its neighbours' being in its own part or not, so they don't touch each
    other: such pairs are one wave of tasks, and 2 n - 3 waves give what all
    pairs one after another would.
    """
    own = None if hasattr(edges, "_slices") else in_slices(edges)
    edges, parts = own or edges, materialize(parts.select("vertex", "part"), "parts")
    for total in range(1, 2 * n - 2):
        wave = [(p, total - p) for p in range(n) if p < total - p < n]
        while wave:
            picked = swaps = wave_swaps(edges, parts, wave, 1 if update_d else None)
            if update_d:
                swaps = materialize(picked, "swaps")
                wave = [(r["p"], r["q"]) for r in swaps.select("p", "q").distinct().collect()]  # at most a row a pair
            if wave:
                old, parts = parts, materialize(swap(parts, swaps), "parts")
                discard(old)
            discard(swaps, picked._gains)
            if not update_d:
                break
    if own:
        discard(own, own._slices)
    return parts


def merge_parts(vectors: DataFrame) -> DataFrame:
    """(vertex, part) of partition vectors (vertex, worker, part): of what is assigned the last worker's wins, null or negative is unassigned."""
    given = F.when(F.col("part") >= 0, F.col("worker"))
    return vectors.groupBy("vertex").agg(F.max_by("part", given).alias("part"))


def matching_round(edges: DataFrame, seed: str = "") -> DataFrame:
    """(vertex, mate) of one handshake: each vertex points along its edge with the least md5, mutual ones match.

    The hash is the edge's, the same from both ends, so an edge that is the least
    at both of its ends is matched: a share of all edges' ends each round, hubs
    or not, and rounds grow with the logarithm of the graph.
    """
    edge = F.concat(F.least("src", "dst").cast("string"), F.lit(":"), F.greatest("src", "dst").cast("string"), F.lit(seed))
    rank = F.struct(F.md5(edge.cast("binary")).alias("h"), F.col("dst").alias("u"))
    to = edges.filter("src <> dst").groupBy(F.col("src").alias("vertex")).agg(F.min(rank).alias("m")).select("vertex", F.col("m.u").alias("mate"))
    back = to.select(F.col("vertex").alias("mate"), F.col("mate").alias("vertex"))
    return to.join(back, ["vertex", "mate"])


def match_vertices(edges: DataFrame, seed: str = "") -> DataFrame:
    """(vertex, mate): handshakes until none is left; unmatched vertices are their own mates.

    The edge of least rank among those left is matched, so every round matches
    some while there are edges.
    """
    slices = getattr(edges, "_slices", None)
    verts = materialize(vertices(edges), "vertices") if slices is None else slices.select("vertex")
    left, found, i, more = edges.filter("src <> dst"), None, 0, True
    while more:
        seen, still = Observation(), Observation()
        one = materialize(matching_round(left, f"{seed}{i}" if seed or i else "").observe(seen, F.count("*").alias("n")), "mates")
        if not seen.get["n"]:
            break
        found, i = one if found is None else found.union(one), i + 1
        gone, on, old = one.select(F.col("vertex").alias("src")), ["src"], left
        if i == 1:  # the first round's edges lie as they were given
            gone, on = dealt(edges, gone)
        rest = left.join(gone, on, "left_anti").join(one.select(F.col("vertex").alias("dst")), "dst", "left_anti").select("src", "dst")
        left = materialize(rest.observe(still, F.count("*").alias("n")), "left")
        discard(old)
        more = still.get["n"] > 0
    if found is None:
        return verts.withColumn("mate", F.col("vertex"))
    return verts.join(found, "vertex", "left").select("vertex", F.coalesce("mate", "vertex").alias("mate"))


def coarse_map(mates: DataFrame) -> DataFrame:
    """(vertex, coarse): pairs numbered from 0 by their smaller vertex."""
    head = mates.withColumn("head", F.least("vertex", "mate"))
    ids = dense_numbers(head.select("head").distinct(), ["head"], "coarse", 0)
    return head.join(ids, "head").select("vertex", "coarse")


def contract(edges: DataFrame, cmap: DataFrame) -> DataFrame:
    """(src, dst, weight) between coarse vertices: weights added up, inner edges dropped."""
    w = edges.select("src", "dst", weight_of(edges).alias("weight"))
    s, d = (cmap.select(F.col("vertex").alias(k), F.col("coarse").alias(f"c_{k}")) for k in ("src", "dst"))
    return w.join(s, "src").join(d, "dst").filter("c_src <> c_dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def coarser(edges: DataFrame, cmap: DataFrame) -> DataFrame:
    """``contract`` of ``sliced`` edges, ``sliced`` again: a source's coarse vertex is looked up where its edges lie, and weights are added up in their new buckets."""
    s, on = dealt(edges, cmap.select(F.col("vertex").alias("src"), F.col("coarse").alias("c_src")))
    d = cmap.select(F.col("vertex").alias("dst"), F.col("coarse").alias("c_dst")).hint("shuffle_hash")
    e = edges.select("src", "slice", "dst", weight_of(edges).alias("weight")).join(s, on).join(d, "dst").filter("c_src <> c_dst")
    ends = cmap.join(edges._slices, "vertex").groupBy(F.col("coarse").alias("vertex")).agg(F.sum("out").alias("out"))
    return merged_slices(e.select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"), "weight"), ends)


def multilevel(edges: DataFrame, parts: int, levels: int = 2, coarsen_to: int = 100, shrink: float = 0.85) -> DataFrame:
    """(vertex, part): coarsen, partition the coarsest graph, project back and refine on each level.

    Merged edges keep their added weight on the coarser levels, so a cut there is
    the cut of the projected partition. Symmetric ``edges``. Each level's edges
    are shuffled into their buckets once, for matching, merging and refinement.
    """
    graphs, maps = [edges if hasattr(edges, "_slices") else in_slices(edges)], []
    n = graphs[0]._slices.count()
    for _ in range(levels):
        if n <= coarsen_to:
            break
        seen = Observation()
        cmap = materialize(coarse_map(match_vertices(graphs[-1])).observe(seen, (F.max("coarse") + 1).alias("n")), "cmap")
        smaller = seen.get["n"] or 0
        if smaller > shrink * n:
            break
        maps.append(cmap)
        graphs.append(coarser(graphs[-1], cmap))
        n = smaller
    if maps:  # coarse vertices whose every edge was contracted still get a part
        where = maps[-1].select(F.col("coarse").alias("vertex")).distinct().withColumn("part", key_part("vertex", parts))
    else:
        where = graphs[0]._slices.select("vertex").withColumn("part", key_part("vertex", parts))
    where = refine(graphs[-1], where, parts)
    for g, cmap in zip(graphs[-2::-1], maps[::-1], strict=True):
        done, fine = where, cmap.join(where.withColumnRenamed("vertex", "coarse"), "coarse").select("vertex", "part")
        where = refine(g, fine, parts)
        discard(done, cmap)
    for g in graphs:
        if g is not edges:
            discard(g, g._slices)
    return where


def for_both(edges: DataFrame) -> DataFrame:
    """Edges shuffled once for refinement and PageRank together, if they have no weights, which PageRank doesn't keep."""
    return edges if "weight" in edges.columns else weighted_edges(edges)[0]


def multilevel_then_rank(edges: DataFrame, parts: int, iterations: int = 2, **options) -> DataFrame:
    """(vertex, part, rank): ``multilevel``, then PageRank of the graph."""
    edges = for_both(edges)
    return multilevel(edges, parts, **options).join(pagerank(edges, iterations), "vertex")


def refine_then_rank(edges: DataFrame, parts: int, iterations: int = 2, width: int | None = None) -> DataFrame:
    """(vertex, part, rank) after refinement of the initial parts and PageRank; ``width``: by shards, with (shard) too."""
    edges = for_both(edges)
    ranks = pagerank(edges, iterations) if width is None else sharded_pagerank(edges, width, iterations)
    return refine(edges, initial_parts(edges, parts), parts).join(ranks, "vertex")
