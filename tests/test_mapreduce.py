import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import byte_sum, chunks, digit_count, tokens, zero_padded
from tessera.operators.graph_etl import line_counts
from tessera.plans.mapreduce import JobConfig, MapReduceJob, key_batches
from tessera.sources import RecordStore, manifest, numbered_lines, parse_edges, read_lines, size_capped, write_manifest


def test_functions(spark):
    df = spark.createDataFrame([("ab  cd\tx" + "y" * 40, 0), ("é", 7), (None, 120)], "t string, n long")
    assert [len(r[0]) for r in df.select(tokens("t")).collect()] == [3, 1, 0]
    assert [len(c) for c in df.filter("n = 0").select(chunks(F.element_at(tokens("t"), -1))).first()[0]] == [32, 9]
    assert [r[0] for r in df.select(byte_sum(F.col("t"))).collect()][1] == (0xC3 - 256) + (0xA9 - 256)
    assert [r[0] for r in df.select(digit_count(F.col("n"))).collect()] == [0, 1, 3]
    assert df.select(zero_padded(F.col("n"))).first()[0] == "0" * 19


def test_job_forms(spark):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "text string")
    pairs = F.transform(tokens("text"), lambda t: F.struct(t.alias("key"), F.lit(1).alias("value")))
    assert {r["key"]: r["value"] for r in MapReduceJob(map=pairs, combine="sum").run(df).collect()} == {"a": 2, "b": 2}

    def mapper(batches):
        n = 0  # before the loop, and after it, once a task
        for b in batches:
            n += len(b)
            yield pd.DataFrame([(w, 1) for t in b["text"].dropna() for w in t.split()], columns=["key", "value"])

    def reducer(key, pdf):
        return pd.DataFrame({"key": [key[0]], "n": [len(pdf)]})

    job = MapReduceJob(map=mapper, map_schema="key string, value long", reduce=reducer, reduce_schema="key string, n long")
    assert {r["key"]: r["n"] for r in job.run(df).collect()} == {"a": 2, "b": 2}
    rounds = MapReduceJob(map=pairs, combine="count", config=JobConfig(max_rounds=9), update=lambda out, i: (out.select(F.concat_ws(" ", "key", F.col("value").cast("string")).alias("text")), i == 3))
    assert {(r["key"], r["value"]) for r in rounds.run(df).collect()} == {("a", 1), ("b", 1), ("1", 2), ("2", 2)}
    out, seen = MapReduceJob(map=pairs, combine="sum", config=JobConfig(reducers=3, split_bytes=1 << 20)).measured(df)
    assert out.count() == 2 and (seen["emitted"], seen["keys"], seen["combined"]) == (4, 2, 2) and seen["map_ms"] + seen["reduce_ms"] <= seen["total_ms"] + 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert MapReduceJob(map=pairs).run(df.limit(0)).count() == 0


def test_batches_of_keys():
    frame = lambda *k: pd.DataFrame({"key": list(k), "value": range(len(k))})
    for frames in ([frame("a", "a", "b"), frame("b"), frame(), frame("b", "c", "d"), frame("d")], [frame("a", "a", "b", "b", "b", "c", "d", "d")], [frame(k) for k in "aabbbcdd"]):
        for n in (1, 2, 3, 9):
            got = [list(f["key"]) for f in key_batches(iter(frames), n)]
            assert sum(got, []) == list("aabbbcdd") and [sorted(set(g)) for g in got] == [list("abcd")[i : i + n] for i in range(0, 4, n)]
    assert list(key_batches(iter([]), 3)) == [] and [len(f) for f in key_batches(iter([frame(None, None), frame("x")]), 1)] == [2, 1]


def test_routes_and_lifecycle(spark):
    """Each reducer starts once, sees its route's keys only and ends once."""
    df = spark.range(300).selectExpr("id % 30 AS k", "id AS v")
    pair = F.array(F.struct(F.col("k").alias("key"), F.col("v").alias("value")))

    def batch(rows, state):
        state["keys"] |= set(rows["key"])
        return pd.DataFrame({"routes": [], "n": []}, dtype="int64")

    def end(state):
        return pd.DataFrame({"routes": [len({k % 5 for k in state["keys"]})], "n": [len(state["keys"])]}) if state["keys"] else None

    job = MapReduceJob(map=pair, reduce_batch=batch, before_reduce=lambda: {"keys": set()}, after_reduce=end, reduce_schema="routes long, n long", partition=F.col("key") % 5, config=JobConfig(reducers=40, batch_keys=2))
    out = job.run(df).collect()
    assert sum(r["n"] for r in out) == 30 and sum(r["routes"] for r in out) == 5
    plan = job.run(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    one = MapReduceJob(map=pair, reduce=lambda key, pdf: pd.DataFrame({"key": [key[0]], "n": [len(pdf)]}), reduce_schema="key long, n long", partition=F.col("key") % 5)
    assert {(r["key"], r["n"]) for r in one.run(df).collect()} == {(k, 10) for k in range(30)}


def test_store_and_sizes(spark, tmp_path):
    s = RecordStore(spark, str(tmp_path / "s"))
    s.write(spark.range(100).selectExpr("id AS key", "id * 2 AS value"))
    before = s.read()
    assert s.get(7).first()["value"] == 14 and s.get_range(10, 5).count() == 5
    s.delete(spark.range(5).toDF("key"))
    assert s.read().count() == 95 and before.count() == 100 and s.get(3).count() == 0
    s.put(spark.createDataFrame([(7, 0), (200, 1)], "key long, value long"))
    again = RecordStore(spark, str(tmp_path / "s"))  # what was put and deleted lasts
    assert again.get(7).first()["value"] == 0 and again.read().count() == 96 and len(again.versions()) == 2
    assert (s.stats["put"], s.stats["delete"], s.stats["get"], s.stats["scan"]) == (1, 1, 2, 2) and s.stats["write_ms"] > 0
    s.clear_stats()
    assert s.stats["put"] == 0
    files = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "path string, length long")
    assert {r["path"] for r in size_capped(files, 6).collect()} == {"a", "b"}
    assert size_capped(files.limit(0), 6).count() == 0


def test_manifest_and_lines(spark, tmp_path):
    for name, text in (("a.txt", "1 2\n3 4\n"), ("b.txt", "# x\nto from\n5\n6 7 9\n\nx 1"), ("c.txt", "")):
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1]: r["n_lines"] for r in line_counts(read_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": 2, "b.txt": 6}
    assert [r["path"].rsplit("/", 1)[1] for r in manifest(spark, str(tmp_path), 9).collect()] == ["a.txt", "b.txt"]
    assert {(r["to"], r["from"]) for r in parse_edges(read_lines(spark, str(tmp_path))).collect()} == {(1, 2), (3, 4), (6, 7)}
    write_manifest(manifest(spark, str(tmp_path)), str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list")).count() == 2
    with JobConfig(split_bytes=64).applied(spark):
        (tmp_path / "n").mkdir()
        (tmp_path / "n" / "x.txt").write_text("".join(f"line {i}\n" for i in range(500)))
        assert spark.read.text(str(tmp_path / "n")).rdd.getNumPartitions() > 10
        rows = numbered_lines(spark, str(tmp_path / "n"), header=True).collect()
    assert {(r["n"], r["value"]) for r in rows} == {(i, f"line {i}") for i in range(1, 500)}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from tessera import session

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_folder(Elsewhere)


def test_command_line(spark, tmp_path, capsys):
    from tessera import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1 2 3\n2 1\n3 1\n")
    cli.main(["wordcount", str(tmp_path / "in"), "--out", str(tmp_path / "w")], spark)
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "w"), sep="\t").collect()} == {("1", "3"), ("2", "2"), ("3", "2")}
    cli.main(["pagerank", str(tmp_path / "in"), "--iterations", "1", "--out", str(tmp_path / "r")], spark)
    assert {r[0] for r in spark.read.csv(str(tmp_path / "r"), sep="\t").collect()} == {"1", "2", "3"}
    cli.main(["sssp", str(tmp_path / "in"), "--source", "2", "--out", str(tmp_path / "d")], spark)
    assert {r[0] for r in spark.read.text(str(tmp_path / "d")).collect()} == {"Node: 2 Distance: 0", "Node: 1 Distance: 1", "Node: 3 Distance: 2"}
    cli.main(["partition", str(tmp_path / "in"), "--parts", "2", "--out", str(tmp_path / "p")], spark)
    assert spark.read.csv(str(tmp_path / "p"), sep="\t").count() == 3
    assert "total_ms" in capsys.readouterr().out
