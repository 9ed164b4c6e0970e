"""The query catalogue: each operator on the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import byte_sum, chunks, digit_count, key_part, random_integer, tokens, zero_padded
from ..operators import aggregate as A
from ..operators import graph_etl as X
from ..operators import pagerank as R
from ..operators import partition as P
from ..operators.sssp import shortest_paths
from ..session import scratch
from ..sources import RecordStore, binary_edges, distance_line, manifest, numbered_line, parse_edges, parse_numbered, read_binary_edges, read_lines, read_parts, size_capped, with_header, write_lines
from .graphs import GC, GP, customer_supplier, part_supplier, table
from .mapreduce import JobConfig, MapReduceJob

PARTS, SHARD = 3, 500
#: Suppliers are few beside parts, so a matching merges few vertices: coarsen all the same.
SHRINK = 0.99


def _words(s, d):
    return table(s, d, "documents").select(F.explode(tokens("text")).alias("word"))


def _rank(df):
    return df.select("vertex", F.round("rank", 6).alias("rank"))


def _long(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def word_count(s, d):
    return _words(s, d).groupBy("word").agg(F.count("*").alias("cnt"))


def word_total(s, d):
    return _words(s, d).agg(F.count("*").alias("total"), F.count_distinct("word").alias("n_words"))


def token_chunks(s, d):
    return _words(s, d).select(F.explode(chunks(F.col("word"))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("cnt"))


def mapreduce_word_count(s, d):
    pairs = F.transform(tokens("text"), lambda t: F.struct(t.alias("key"), F.lit(1).cast("bigint").alias("value")))
    return MapReduceJob(map=pairs, combine="sum").run(table(s, d, "documents")).select(F.col("key").alias("word"), F.col("value").alias("cnt"))


def mapreduce_pandas_reduce(s, d):
    import pandas as pd

    def spread(key, pdf):
        return pd.DataFrame({"key": [key[0]], "value": [float(pdf["value"].max() - pdf["value"].min())]})

    pair = F.array(F.struct(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("value")))
    job = MapReduceJob(map=pair, reduce=spread, reduce_schema="key string, value double", partition=F.col("key"))
    return job.run(table(s, d, "orders")).select("key", F.round("value", 2).alias("spread"))


def line_count_by_source(s, d):
    return table(s, d, "documents").select("source", F.size(F.split("text", "\n")).alias("n")).groupBy("source").agg(F.sum("n").cast("bigint").alias("n_lines"), F.count("*").alias("n_docs"))


def byte_hash(s, d):
    return table(s, d, "part").select("p_partkey", byte_sum(F.col("p_name")).alias("h"))


def key_formats(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", digit_count(k).alias("digits"), zero_padded(k).alias("padded"), key_part(k, 7).cast("bigint").alias("part"), F.least(k, F.col("o_custkey")).alias("smaller"))


def group_values_sorted(s, d):
    g = A.group_sorted(table(s, d, "orders"), "o_custkey", "o_orderkey")
    return g.select("o_custkey", F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("keys"))


def symmetrize_edges(s, d):
    return customer_supplier(s, d)


def adjacency_lists(s, d):
    return X.adjacency(part_supplier(s, d)).select("vertex", F.array_join(F.transform("nbrs", lambda v: v.cast("string")), " ").alias("nbrs"))


def adjacency_dense(s, d):
    return X.adjacency(part_supplier(s, d), dense=True).select("vertex", F.size("nbrs").cast("bigint").alias("n"))


def adjacency_round_trip(s, d):
    lines = X.adjacency(part_supplier(s, d)).select(F.concat(F.lit(" "), numbered_line()).alias("value"))
    return X.explode_adjacency(parse_numbered(lines))


def edge_list_parse(s, d):
    e = part_supplier(s, d).select(F.concat_ws(" ", "src", "dst").alias("value")).union(s.createDataFrame([("# to from",), ("",)], "value string"))
    return parse_edges(e)


def graph_stats(s, d):
    return X.graph_stats(part_supplier(s, d))


def degree(s, d):
    return X.degrees(part_supplier(s, d))


def neighbor_hot_keys(s, d):
    """Neighbours' id sums of all vertices, salted against suppliers with very many parts."""
    return A.salted_sum(part_supplier(s, d), "src", F.col("dst"), "total")


def salted_group_sum(s, d):
    return A.salted_sum(table(s, d, "lineitem"), "l_suppkey", F.col("l_quantity").cast("bigint"), "qty")


def pagerank_source_3(s, d):
    return _rank(R.pagerank(customer_supplier(s, d), 3))


def pagerank_stored_3(s, d):
    return _rank(R.pagerank(customer_supplier(s, d), 3, degree="stored"))


def pagerank_tol(s, d):
    return _rank(R.pagerank(part_supplier(s, d), 60, tol=1e-4))


def pagerank_grid_blocks(s, d):
    return R.grid_blocks(customer_supplier(s, d), 4)


def shard_intervals(s, d):
    return R.shard_ranges(customer_supplier(s, d), SHARD)


def shard_interval_lengths(s, d):
    return R.shard_lengths(customer_supplier(s, d), SHARD)


def rank_updates_count(s, d):
    return R.rank_updates(part_supplier(s, d), 2)


def _first_vertex(e):
    return e.agg(F.min("src")).first()[0]


def sssp(s, d):
    e = part_supplier(s, d)
    return shortest_paths(e, _first_vertex(e))


def sssp_lines(s, d):
    return sssp(s, d).select(distance_line().alias("line"))


def init_partition(s, d):
    return _long(P.initial_parts(customer_supplier(s, d), PARTS))


def edge_cut_total(s, d):
    e = customer_supplier(s, d)
    return P.edge_cut(e, P.initial_parts(e, PARTS))


def d_values(s, d):
    e = customer_supplier(s, d)
    return P.d_values(e, P.initial_parts(e, PARTS))


def boundary_counts(s, d):
    e = customer_supplier(s, d)
    return P.boundary_counts(e, P.initial_parts(e, PARTS))


def best_swap_pair(s, d):
    e = customer_supplier(s, d)
    return P.pair_swaps(e, P.initial_parts(e, PARTS), 0, 1, 1).select("a", "b", "gain")


def cut_after_best_swap(s, d):
    e = customer_supplier(s, d)
    w = P.initial_parts(e, PARTS)
    return P.edge_cut(e, P.swap(w, P.pair_swaps(e, w, 0, 1, 1), 0, 1))


def refine_partition(s, d):
    e = part_supplier(s, d)
    return _long(P.refine(e, P.initial_parts(e, PARTS), PARTS))


def multilevel_partition(s, d):
    return _long(P.multilevel(part_supplier(s, d), PARTS, shrink=SHRINK))


def refine_then_rank(s, d):
    r = P.refine_then_rank(part_supplier(s, d), PARTS)
    return _long(r.select("vertex", "part", F.round("rank", 6).alias("rank")))


def relabel_vertices(s, d):
    return _long(X.relabel(P.initial_parts(customer_supplier(s, d), PARTS)))


def part_boundaries(s, d):
    return _long(X.boundaries(P.initial_parts(customer_supplier(s, d), PARTS)))


def relabelled_edges(s, d):
    e = customer_supplier(s, d)
    return X.relabel_edges(e, X.relabel(P.initial_parts(e, PARTS)))


def partition_histogram(s, d):
    return X.part_histogram(P.initial_parts(customer_supplier(s, d), PARTS), 8)


def extract_partition(s, d):
    return P.initial_parts(customer_supplier(s, d), PARTS).filter("part = 1").select("vertex")


def handshake_matching_round(s, d):
    return P.matching_round(customer_supplier(s, d))


def coarse_graph(s, d):
    e = customer_supplier(s, d)
    m = P.matching_round(e)
    mates = X.vertices(e).join(m, "vertex", "left").select("vertex", F.coalesce("mate", "vertex").alias("mate"))
    return P.contract(e, P.coarse_map(mates))


def key_batches_topk(s, d):
    return A.key_batches(table(s, d, "lineitem"), "l_partkey", 100)


def cyclic_distribution(s, d):
    return A.deal_out(table(s, d, "customer").select("c_custkey"), ["c_custkey"], 7)


def size_capped_prefix(s, d):
    return size_capped(table(s, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("n_chars").alias("length")), 100000)


def _store(s, d):
    """A store of customers after a put, a delete and a range read; what was read."""
    store = RecordStore(s, scratch(s, "store"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    store.write(c)
    store.put(c.filter("key % 10 = 0").withColumn("value", F.concat("value", F.lit("!"))))
    store.delete(c.filter("key % 7 = 0"))
    return store, store.get_range(20, 60)


def record_store(s, d):
    """Write, overwrite, delete and read a range of keyed records."""
    return _store(s, d)[1]


def record_store_stats(s, d):
    store, _ = _store(s, d)
    store.get(21).count()
    return s.createDataFrame([(k, n) for k, n in sorted(store.stats.items()) if k != "write_ms"], "operation string, n bigint")


def _quantities():
    return F.array(F.struct(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value")))


def mapreduce_batch_reduce(s, d):
    """A reduce that gets all rows of up to 50 keys at once."""

    def reduce_batch(rows, state):
        return rows.groupby("key", as_index=False).agg(total=("value", "sum"), n=("value", "size"))

    job = MapReduceJob(map=_quantities(), reduce_batch=reduce_batch, reduce_schema="key bigint, total bigint, n bigint", config=JobConfig(batch_keys=50))
    return job.run(table(s, d, "lineitem"))


def mapreduce_reducer_totals(s, d):
    """Each reducer counts from its start to its end; one aggregate merges the counts."""
    import pandas as pd

    def count(rows, state):
        state["rows"] += len(rows)
        state["keys"] += rows["key"].nunique()
        return pd.DataFrame({"n_rows": [], "n_keys": []}, dtype="int64")

    job = MapReduceJob(map=_quantities(), reduce_batch=count, before_reduce=lambda: {"rows": 0, "keys": 0}, after_reduce=lambda t: pd.DataFrame({"n_rows": [t["rows"]], "n_keys": [t["keys"]]}), reduce_schema="n_rows bigint, n_keys bigint")
    return job.run(table(s, d, "lineitem")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys"))


def mapreduce_routed(s, d):
    """Keys go to the reducers of a route of their own: key mod 3."""

    def by_route(rows, state):
        return rows.assign(route=rows["key"] % 3).groupby("route", as_index=False).agg(n_keys=("key", "nunique"), total=("value", "sum"))

    job = MapReduceJob(map=_quantities(), reduce_batch=by_route, reduce_schema="route bigint, n_keys bigint, total bigint", partition=F.col("key") % 3, config=JobConfig(batch_keys=1 << 20))
    return job.run(table(s, d, "lineitem"))


def job_metrics(s, d):
    pairs = F.transform(tokens("text"), lambda t: F.struct(t.alias("key"), F.lit(1).cast("bigint").alias("value")))
    _, m = MapReduceJob(map=pairs, combine="sum").measured(table(s, d, "documents"))
    return s.createDataFrame([(m["emitted"], m["keys"], m["combined"])], "emitted bigint, n_keys bigint, combined bigint")


def _customer_files(s, d):
    """A folder of text files of customers' names, one or more a nation."""
    at = scratch(s, "lines")
    table(s, d, "customer").select("c_nationkey", F.col("c_name").alias("value")).repartition(4, "c_nationkey").write.partitionBy("c_nationkey").text(at)
    return at


def _nation(path):
    return F.regexp_extract(path, "c_nationkey=([0-9]+)", 1).cast("bigint").alias("nation")


def file_line_counts(s, d):
    return X.line_counts(read_lines(s, _customer_files(s, d))).groupBy(_nation("file")).agg(F.sum("n_lines").alias("n_lines"))


def input_manifest(s, d):
    return manifest(s, _customer_files(s, d)).filter("length > 0").select(_nation("path")).distinct()


def numbered_vector(s, d):
    """A partition vector written a part a line and read back by line numbers."""
    at = scratch(s, "vector")
    write_lines(table(s, d, "customer"), F.col("c_nationkey").cast("string"), at, order=["c_custkey"])
    return _long(read_parts(s, at))


def adjacency_file_lines(s, d):
    return X.adjacency_file(part_supplier(s, d))


def adjacency_new_header(s, d):
    return with_header(X.adjacency_file(part_supplier(s, d)), "% header")


def binary_edge_files(s, d):
    return read_binary_edges(binary_edges(part_supplier(s, d), scratch(s, "binary")))


def edge_records(s, d):
    e = customer_supplier(s, d)
    return X.explode_adjacency(X.adjacency(e), X.vertices(e).count()).withColumns({c: F.round(c, 9) for c in ("v_rank", "rank")})


def edges_by_destination(s, d):
    return A.dense_numbers(customer_supplier(s, d), ["dst", "src"], "place")


def random_integers(s, d):
    r = table(s, d, "customer").select(random_integer(3, 9, 42).alias("r"))
    return r.agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("largest"))


def seeded_permutation(s, d):
    return A.shuffled(table(s, d, "customer").select("c_custkey"), "c_custkey", 7)


def first_wins_union(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return A.first_wins(*(c.filter(f"c_custkey % {k} = 0").select("c_custkey", F.concat(F.lit(f"{k}:"), "c_name").alias("name")) for k in (2, 3)), key="c_custkey")


def merged_partition_vectors(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("vertex"))
    v = [c.select("vertex", F.lit(w).alias("worker"), F.when(F.col("vertex") % (w + 2) == 0, F.col("vertex") % 5).otherwise(F.lit(-1)).cast("bigint").alias("part")) for w in range(3)]
    return P.merge_parts(v[0].union(v[1]).union(v[2]).withColumn("part", F.expr("IF(part < 0, part, part * 10 + worker)")))


def sharded_pagerank_2(s, d):
    r = R.sharded_pagerank(customer_supplier(s, d), SHARD, 2)
    return r.select("vertex", "shard", F.round("rank", 6).alias("rank"))


def relabel_sweep(s, d):
    return _long(X.relabel_sweep(P.initial_parts(customer_supplier(s, d), 24), [2, 3, 8]))


def histogram_sweep(s, d):
    e = customer_supplier(s, d)
    return _long(X.histogram_sweep({"mod24": P.initial_parts(e, 24), "mod7": P.initial_parts(e, 7)}, [8, 16]))


def projected_parts(s, d):
    """The parts of coarse vertices, handed down to the vertices they were made of."""
    e = customer_supplier(s, d)
    mates = X.vertices(e).join(P.matching_round(e), "vertex", "left").select("vertex", F.coalesce("mate", "vertex").alias("mate"))
    return _long(P.coarse_map(mates).select("vertex", key_part("coarse", PARTS).alias("part")))


def multilevel_then_rank(s, d):
    r = P.multilevel_then_rank(part_supplier(s, d), PARTS, shrink=SHRINK)
    return _long(r.select("vertex", "part", F.round("rank", 6).alias("rank")))


_WORDS = r"(SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\v\f\r]+')) AS word FROM documents)"
_PART = f"w AS (SELECT DISTINCT src AS vertex, src % {PARTS} AS part FROM e)"
_CUT = "x AS (SELECT src, dst, (ws.part <> wd.part)::BIGINT AS cut FROM e JOIN w ws ON src = ws.vertex JOIN w wd ON dst = wd.vertex)"
_D = "dv AS (SELECT dst AS vertex, sum(cut)::BIGINT AS ext, count(*) AS deg, (2 * sum(cut) - count(*))::BIGINT AS d FROM x GROUP BY 1)"
_BEST = "best AS (SELECT a.vertex AS a, b.vertex AS b, a.d + b.d - 2 * (c.src IS NOT NULL)::BIGINT AS gain FROM dv a JOIN dv b ON a.vertex % 3 = 0 AND b.vertex % 3 = 1 LEFT JOIN e c ON c.src = a.vertex AND c.dst = b.vertex WHERE a.d + b.d - 2 * (c.src IS NOT NULL)::BIGINT > 0 ORDER BY gain DESC, a, b LIMIT 1)"
_ADJ = "k AS (SELECT * FROM e WHERE src <> 0 AND dst <> 0), lines AS (SELECT i.n::BIGINT AS n, coalesce(string_agg(k.dst::VARCHAR, ' ' ORDER BY k.dst), '') AS value FROM (SELECT unnest(generate_series(1, (SELECT max(src) FROM k))) AS n) i LEFT JOIN k ON k.src = i.n GROUP BY 1)"
_COARSE = "v AS (SELECT DISTINCT src AS vertex FROM e), h AS (SELECT v.vertex, least(v.vertex, coalesce(m.mate, v.vertex)) AS head FROM v LEFT JOIN m ON m.vertex = v.vertex), c AS (SELECT vertex, dense_rank() OVER (ORDER BY head) - 1 AS id FROM h)"
_MATCH = """p AS (SELECT src AS vertex, arg_min(dst, md5(least(src, dst) || ':' || greatest(src, dst))) AS mate FROM e WHERE src <> dst GROUP BY 1),
m AS (SELECT p.vertex, p.mate FROM p JOIN p q ON q.vertex = p.mate AND q.mate = p.vertex)"""


def _ranks(graph: str, rounds: int, key: str) -> str:
    """Unrolled rounds; key: the end whose degree counts."""
    out = [f"WITH {graph}", f"deg AS (SELECT {key} AS v, count(*) AS d FROM e GROUP BY 1)", "v AS (SELECT DISTINCT src AS vertex FROM e)", "r0 AS (SELECT vertex, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS (SELECT dst AS vertex, 0.15::DOUBLE + 0.85::DOUBLE * sum(rank / d) AS rank FROM e JOIN r{i - 1} ON vertex = src JOIN deg ON deg.v = e.{key} GROUP BY 1)")
    return ",\n".join(out)


_SSSP = f"""WITH RECURSIVE {GP}, t(v, d) AS (
  SELECT min(src), 0::BIGINT FROM e UNION SELECT e.dst, t.d + 1 FROM t JOIN e ON e.src = t.v WHERE t.d < 40
), best AS (SELECT v, min(d) AS dist FROM t GROUP BY 1)
SELECT vertex, dist FROM (SELECT DISTINCT src AS vertex FROM e) LEFT JOIN best ON v = vertex"""

SQL = {
    "word_count": f"SELECT word, count(*) AS cnt FROM {_WORDS} WHERE word <> '' GROUP BY 1",
    "mapreduce_word_count": f"SELECT word, count(*) AS cnt FROM {_WORDS} WHERE word <> '' GROUP BY 1",
    "word_total": f"SELECT count(*) AS total, count(DISTINCT word) AS n_words FROM {_WORDS} WHERE word <> ''",
    "token_chunks": f"SELECT chunk, count(*) AS cnt FROM (SELECT unnest(list_transform(generate_series(0, (length(word) - 1) // 32), lambda i: substr(word, (i * 32 + 1)::BIGINT, 32))) AS chunk FROM {_WORDS} WHERE word <> '') GROUP BY 1",
    "mapreduce_pandas_reduce": "SELECT o_orderpriority AS key, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1",
    "line_count_by_source": "SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, count(*) AS n_docs FROM documents GROUP BY 1",
    "byte_hash": "SELECT p_partkey, list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c)))::BIGINT AS h FROM part",
    "key_formats": "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 0 ELSE length(o_orderkey::VARCHAR) END::BIGINT AS digits, lpad(o_orderkey::VARCHAR, 19, '0') AS padded, (o_orderkey % 7)::BIGINT AS part, least(o_orderkey, o_custkey) AS smaller FROM orders",
    "group_values_sorted": "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1",
    "symmetrize_edges": f"WITH {GC} SELECT * FROM e",
    "adjacency_lists": f"WITH {GP} SELECT src AS vertex, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS nbrs FROM e GROUP BY 1",
    "adjacency_dense": f"WITH {GP}, k AS (SELECT * FROM e WHERE src <> 0 AND dst <> 0), i AS (SELECT unnest(generate_series(1, (SELECT max(src) FROM k))) AS vertex) SELECT i.vertex::BIGINT AS vertex, count(k.src) AS n FROM i LEFT JOIN k ON k.src = i.vertex GROUP BY 1",
    "adjacency_round_trip": f"WITH {GP} SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY src) AS num_neighbors FROM e",
    "edge_list_parse": f'WITH {GP} SELECT src AS "to", dst AS "from" FROM e',
    "graph_stats": f"WITH {GP} SELECT (max(greatest(src, dst)) + 1)::BIGINT AS n_vertices, count(*) * 2 AS doubled_edges, count(*) AS symmetric_edges FROM e",
    "degree": f"WITH {GP} SELECT src AS vertex, count(*) AS degree FROM e GROUP BY 1",
    "neighbor_hot_keys": f"WITH {GP} SELECT src, sum(dst)::BIGINT AS total FROM e GROUP BY 1",
    "salted_group_sum": "SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY 1",
    "pagerank_source_3": _ranks(GC, 3, "src") + "\nSELECT vertex, round(rank, 6) AS rank FROM r3",
    "pagerank_stored_3": _ranks(GC, 3, "dst") + "\nSELECT vertex, round(rank, 6) AS rank FROM r3",
    "rank_updates_count": _ranks(GP, 2, "src") + "\nSELECT 1::BIGINT AS iteration, count(*) FILTER (abs(r1.rank - r0.rank) > 1e-12) AS updated FROM r1 JOIN r0 USING (vertex) UNION ALL SELECT 2, count(*) FILTER (abs(r2.rank - r1.rank) > 1e-12) FROM r2 JOIN r1 USING (vertex)",
    "pagerank_grid_blocks": f"WITH {GC} SELECT src % 4 AS src_block, dst % 4 AS dst_block, count(*) AS n_edges FROM e GROUP BY 1, 2",
    "shard_intervals": f"WITH {GC} SELECT dst // {SHARD} AS shard, min(dst) AS lb, max(dst) AS ub, count(DISTINCT dst) AS n_keys, count(*) AS n_edges FROM e GROUP BY 1",
    "shard_interval_lengths": f"WITH {GC}, r AS (SELECT dst // {SHARD} AS shard, min(dst) AS lb, max(dst) AS ub FROM e GROUP BY 1) SELECT e.dst // {SHARD} AS shard, r.shard AS \"interval\", count(*) AS n_edges FROM e JOIN r ON e.src BETWEEN r.lb AND r.ub GROUP BY 1, 2",
    "sssp": _SSSP,
    "sssp_lines": f"SELECT 'Node: ' || vertex || ' Distance: ' || coalesce(dist::VARCHAR, '18446744073709551615') AS line FROM ({_SSSP})",
    "init_partition": f"WITH {GC}, {_PART} SELECT * FROM w",
    "edge_cut_total": f"WITH {GC}, {_PART}, {_CUT} SELECT (sum(cut) // 2)::BIGINT AS cut FROM x",
    "d_values": f"WITH {GC}, {_PART}, {_CUT}, {_D} SELECT * FROM dv",
    "boundary_counts": f"WITH {GC}, {_PART}, {_CUT} SELECT src AS vertex, count(*) AS n FROM x WHERE cut = 1 GROUP BY 1",
    "best_swap_pair": f"WITH {GC}, {_PART}, {_CUT}, {_D}, {_BEST} SELECT * FROM best",
    "cut_after_best_swap": f"WITH {GC}, {_PART}, {_CUT}, {_D}, {_BEST}, s AS (SELECT vertex, CASE WHEN vertex = (SELECT a FROM best) THEN 1 WHEN vertex = (SELECT b FROM best) THEN 0 ELSE part END AS part FROM w) SELECT (count(*) FILTER (p.part <> q.part) // 2)::BIGINT AS cut FROM e JOIN s p ON p.vertex = src JOIN s q ON q.vertex = dst",
    "relabel_vertices": f"WITH {GC}, {_PART} SELECT vertex, part, row_number() OVER (ORDER BY part, vertex) AS new_id FROM w",
    "part_boundaries": f"WITH {GC}, {_PART} SELECT part, (sum(count(*)) OVER (ORDER BY part) + 1)::BIGINT AS bound FROM w GROUP BY 1",
    "relabelled_edges": f"WITH {GC}, {_PART}, l AS (SELECT vertex, row_number() OVER (ORDER BY part, vertex) AS id FROM w) SELECT a.id AS src, b.id AS dst FROM e JOIN l a ON a.vertex = src JOIN l b ON b.vertex = dst",
    "partition_histogram": f"WITH {GC}, {_PART}, b AS (SELECT unnest(range(8)) AS part) SELECT b.part, count(w.vertex) AS n FROM b LEFT JOIN w ON w.part % 8 = b.part GROUP BY 1",
    "extract_partition": f"WITH {GC}, {_PART} SELECT vertex FROM w WHERE part = 1",
    "handshake_matching_round": f"WITH {GC}, {_MATCH} SELECT * FROM m",
    "coarse_graph": f"WITH {GC}, {_MATCH}, {_COARSE} SELECT a.id AS src, b.id AS dst, count(*) AS weight FROM e JOIN c a ON a.vertex = e.src JOIN c b ON b.vertex = e.dst WHERE a.id <> b.id GROUP BY 1, 2",
    "key_batches_topk": "SELECT l_partkey, (row_number() OVER (ORDER BY l_partkey) - 1) // 100 AS batch FROM (SELECT DISTINCT l_partkey FROM lineitem)",
    "cyclic_distribution": "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) % 7 AS part FROM customer",
    "size_capped_prefix": "SELECT path, length FROM (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, n_chars AS length, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 100000",
    "record_store_stats": "SELECT * FROM (VALUES ('delete', 1::BIGINT), ('get', 1), ('get_range', 1), ('put', 1), ('scan', 0), ('write', 1)) t(operation, n)",
    "mapreduce_batch_reduce": "SELECT l_suppkey AS key, sum(l_quantity::BIGINT)::BIGINT AS total, count(*) AS n FROM lineitem GROUP BY 1",
    "mapreduce_reducer_totals": "SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_keys FROM lineitem",
    "mapreduce_routed": "SELECT l_suppkey % 3 AS route, count(DISTINCT l_suppkey) AS n_keys, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1",
    "job_metrics": f"SELECT count(*) AS emitted, count(DISTINCT word) AS n_keys, count(*) - count(DISTINCT word) AS combined FROM {_WORDS} WHERE word <> ''",
    "file_line_counts": "SELECT c_nationkey::BIGINT AS nation, count(*) AS n_lines FROM customer GROUP BY 1",
    "input_manifest": "SELECT DISTINCT c_nationkey::BIGINT AS nation FROM customer",
    "numbered_vector": "SELECT row_number() OVER (ORDER BY c_custkey) AS vertex, c_nationkey::BIGINT AS part FROM customer",
    "adjacency_file_lines": f"WITH {GP}, {_ADJ} SELECT * FROM lines UNION ALL SELECT 0, (SELECT max(src) FROM e) || ' ' || (SELECT count(*) // 2 FROM e)",
    "adjacency_new_header": f"WITH {GP}, {_ADJ} SELECT * FROM lines UNION ALL SELECT 0, '% header'",
    "binary_edge_files": f"WITH {GP} SELECT * FROM e",
    "edge_records": f"WITH {GC}, n AS (SELECT round(1.0::DOUBLE / count(DISTINCT src), 9) AS r FROM e) SELECT dst AS src, src AS dst, r AS v_rank, r AS rank, count(*) OVER (PARTITION BY src) AS num_neighbors FROM e, n",
    "edges_by_destination": f"WITH {GC} SELECT src, dst, row_number() OVER (ORDER BY dst, src) AS place FROM e",
    "random_integers": "SELECT count(*) AS n, 3::BIGINT AS least, 8::BIGINT AS largest FROM customer",
    "seeded_permutation": "SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey) AS place FROM customer",
    "first_wins_union": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '2:' ELSE '3:' END || c_name AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "merged_partition_vectors": "SELECT c_custkey AS vertex, c_custkey % 5 * 10 + CASE WHEN c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 2 = 0 THEN 0 END AS part FROM customer",
    "sharded_pagerank_2": _ranks(GC, 2, "src") + f"\nSELECT vertex, vertex // {SHARD} AS shard, round(rank, 6) AS rank FROM r2",
    "relabel_sweep": f"WITH {GC}, v AS (SELECT DISTINCT src AS vertex FROM e) SELECT k.k::BIGINT AS parts, vertex, vertex % 24 % k.k AS part, row_number() OVER (PARTITION BY k.k ORDER BY vertex % 24 % k.k, vertex) AS new_id FROM v, (VALUES (2), (3), (8)) k(k)",
    "histogram_sweep": f"WITH {GC}, v AS (SELECT DISTINCT src AS vertex FROM e), w AS (SELECT vertex, 'mod' || m.m AS vector, vertex % m.m AS part FROM v, (VALUES (24), (7)) m(m)), b AS (SELECT x.vector, k.k AS parts, unnest(range(k.k)) AS part FROM (SELECT DISTINCT vector FROM w) x, (VALUES (8), (16)) k(k)) SELECT b.vector, b.parts::BIGINT AS parts, b.part, count(w.vertex) AS n FROM b LEFT JOIN w ON w.vector = b.vector AND w.part % b.parts = b.part GROUP BY 1, 2, 3",
    "projected_parts": f"WITH {GC}, {_MATCH}, {_COARSE} SELECT vertex, id % {PARTS} AS part FROM c",
    "record_store": "SELECT c_custkey AS key, c_name || CASE WHEN c_custkey % 10 = 0 THEN '!' ELSE '' END AS value FROM customer WHERE c_custkey BETWEEN 20 AND 79 AND c_custkey % 7 <> 0",
}

QUERIES = (
    word_count, word_total, token_chunks, mapreduce_word_count, mapreduce_pandas_reduce, line_count_by_source, byte_hash, key_formats, group_values_sorted,
    symmetrize_edges, adjacency_lists, adjacency_dense, adjacency_round_trip, edge_list_parse, graph_stats, degree, neighbor_hot_keys, salted_group_sum,
    pagerank_source_3, pagerank_stored_3, pagerank_tol, pagerank_grid_blocks, shard_intervals, shard_interval_lengths, rank_updates_count, sssp, sssp_lines,
    init_partition, edge_cut_total, d_values, boundary_counts, best_swap_pair, cut_after_best_swap, refine_partition, multilevel_partition, refine_then_rank,
    relabel_vertices, part_boundaries, relabelled_edges, partition_histogram, extract_partition, handshake_matching_round, coarse_graph,
    key_batches_topk, cyclic_distribution, size_capped_prefix, record_store, record_store_stats, mapreduce_batch_reduce, mapreduce_reducer_totals,
    mapreduce_routed, job_metrics, file_line_counts, input_manifest, numbered_vector, adjacency_file_lines, adjacency_new_header, binary_edge_files,
    edge_records, edges_by_destination, random_integers, seeded_permutation, first_wins_union, merged_partition_vectors, sharded_pagerank_2,
    relabel_sweep, histogram_sweep, projected_parts, multilevel_then_rank,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
