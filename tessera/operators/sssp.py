"""Unit-weight shortest paths by frontier relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import bucketed, discard, materialize
from .graph_etl import vertices

#: Rounds after which the frontiers found so far become one table.
CUT_EVERY = 16


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """(vertex, dist) along edges src -> dst; null where unreachable.

    Edges are shuffled once, into buckets of their source. A round joins the
    frontier alone with them and keeps what is new, so an edge is relaxed once in
    all and only vertices are shuffled; its one action writes the new frontier
    and counts it. The loop ends with an empty frontier, however far that is.
    """
    spark = edges.sparkSession
    verts = materialize(vertices(edges), "vertices")
    edges = bucketed(edges.select("src", "dst"), ["src"], "edges")
    frontier = known = spark.createDataFrame([(source, 0)], "vertex bigint, dist bigint")
    parts, d = [], 0
    while True:
        d += 1
        new = edges.join(frontier.select(F.col("vertex").alias("src")), "src").select(F.col("dst").alias("vertex")).distinct()
        seen = Observation()
        new = new.join(known.select("vertex"), "vertex", "left_anti").withColumn("dist", F.lit(d).cast("bigint"))
        frontier = materialize(new.observe(seen, F.count("*").alias("n")), "frontier")
        if not seen.get["n"]:
            break
        known = known.union(frontier)
        parts.append(frontier)
        if d % CUT_EVERY == 0:
            known = materialize(known, "known")
            discard(*parts[:-1])  # the last one is still the frontier
            parts = [known]
    return verts.join(known, "vertex", "left").select("vertex", "dist")
