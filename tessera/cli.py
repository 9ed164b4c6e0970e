"""Command line: ``python -m tessera.cli JOB FOLDER --out PATH``; prints the job's times in milliseconds.

Jobs read a folder of text: words for ``wordcount``, lines ``vertex nbr nbr ...``
for the others. Results are tab-separated text, ``sssp`` writes its own lines.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens
from .operators.graph_etl import explode_adjacency
from .operators.pagerank import pagerank
from .operators.partition import initial_parts, multilevel, refine
from .operators.sssp import shortest_paths
from .plans.mapreduce import JobConfig, MapReduceJob
from .session import drop_scratch
from .sources import distance_line, manifest, parse_numbered, read_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("job", choices=("wordcount", "pagerank", "sssp", "partition"))
    p.add_argument("folder")
    p.add_argument("--out", required=True, help="folder of the result, overwritten")
    p.add_argument("--gb", type=float, help="read files, in path order, up to this many GiB")
    p.add_argument("--reducers", type=int, help="partitions of the shuffles")
    p.add_argument("--split-mb", type=int, help="MB of input a map task")
    p.add_argument("--batch-keys", type=int, default=1000)
    p.add_argument("--vertices", type=int, help="number that ranks start from (default: the endpoints)")
    p.add_argument("--iterations", type=int, default=3)
    p.add_argument("--degree", choices=("source", "stored"), default="source")
    p.add_argument("--source", type=int, default=1, help="vertex that distances start from")
    p.add_argument("--parts", type=int, default=2)
    p.add_argument("--multilevel", action="store_true", help="partition by coarsening first")
    return p


def _lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    lines = read_lines(spark, args.folder)
    if args.gb is None:
        return lines
    chosen = manifest(spark, args.folder, int(args.gb * 2**30)).select(F.col("path").alias("file"))
    return lines.join(chosen, "file", "left_semi")


def _result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    lines = _lines(spark, args)
    if args.job == "wordcount":
        pairs = F.transform(tokens("value"), lambda t: F.struct(t.alias("key"), F.lit(1).cast("bigint").alias("value")))
        return MapReduceJob(map=pairs, combine="sum").run(lines)
    edges = explode_adjacency(parse_numbered(lines)).select("src", "dst")
    if args.job == "pagerank":
        return pagerank(edges, args.iterations, args.degree, n_vertices=args.vertices)
    if args.job == "sssp":
        return shortest_paths(edges, args.source).select(distance_line())
    return multilevel(edges, args.parts) if args.multilevel else refine(edges, initial_parts(edges, args.parts), args.parts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    args = parser().parse_args(argv)
    began = time.perf_counter()
    own = spark is None
    spark = spark or SparkSession.builder.appName(f"tessera {args.job}").getOrCreate()
    ready = time.perf_counter()
    split = args.split_mb * 2**20 if args.split_mb else None
    with JobConfig(reducers=args.reducers, split_bytes=split, batch_keys=args.batch_keys).applied(spark):
        out = _result(spark, args)
        writer = out.write.mode("overwrite")
        writer.text(args.out) if args.job == "sssp" else writer.csv(args.out, sep="\t")
    ended = time.perf_counter()
    times = {"init_ms": round(1000 * (ready - began), 1), "job_ms": round(1000 * (ended - ready), 1), "total_ms": round(1000 * (ended - began), 1)}
    print(json.dumps(times))
    if own:
        drop_scratch(spark)
        spark.stop()
    return times


if __name__ == "__main__":
    main()
