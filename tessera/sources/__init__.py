"""Text and record formats: readers, writers and a keyed record store on Parquet."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of all files of a directory."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def parse_numbered(lines: DataFrame, column: str = "value") -> DataFrame:
    """(vertex, nbrs) of lines ``vertex nbr nbr ...``; leading blanks are tolerated, blank lines dropped, neighbours sorted."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    rows = lines.filter(F.trim(F.col(column)) != "").select(F.transform(parts, lambda x: x.try_cast("bigint")).alias("p"))
    return rows.select(F.col("p")[0].alias("vertex"), F.array_sort(F.slice("p", 2, 1 << 30)).alias("nbrs"))


def parse_edges(lines: DataFrame, column: str = "value", comment: str | None = "#") -> DataFrame:
    """(to, from) of lines ``to from``; blank lines, comments and lines that don't begin with two whole numbers (a header row) are skipped."""
    kept = lines.filter(F.trim(F.col(column)) != "")
    if comment:
        kept = kept.filter(~F.col(column).startswith(comment))
    p = F.split(F.trim(F.col(column)), r"\s+")
    a, b = (F.get(p, F.lit(i)).try_cast("bigint") for i in (0, 1))
    return kept.select(a.alias("to"), b.alias("from")).filter(F.col("to").isNotNull() & F.col("from").isNotNull())


def numbered_lines(spark: SparkSession, path: str, base: int = 1, header: bool = False) -> DataFrame:
    """(n, value) of the lines of a file, or of a folder's files in the order of their names, numbered from ``base``.

    Lines are written once with their split's file and offset and their place in
    the split; numbers come from the counts of the splits before, a row a split,
    so no task reads the whole file.
    """
    mark = F.monotonically_increasing_id()  # ascending inside a split, which one task reads
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at")).alias("_at"), mark.alias("_id"), "value")
    lines = materialize(lines, "lines")
    splits = lines.groupBy("_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    df = lines.join(F.broadcast(splits), "_at").select((F.col("_base") + F.col("_id") - F.col("_first")).alias("n"), "value")  # a row a split
    return df.filter("n > 0").withColumn("n", F.col("n") - 1 + base) if header else df.withColumn("n", F.col("n") + base)


def read_implicit_adjacency(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(vertex, nbrs) of a file whose line i lists the neighbours of vertex i, behind a header ``V E``."""
    n = numbered_lines(spark, path, 1, header)
    p = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return n.select(F.col("n").alias("vertex"), F.filter(F.transform(p, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()).alias("nbrs"))


def read_parts(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """(vertex, part) of a partition vector, one part a line; null where a line is no number."""
    return numbered_lines(spark, path, base).select(F.col("n").alias("vertex"), F.trim("value").try_cast("int").alias("part"))


def write_lines(df: DataFrame, line: Column, path: str, lines_per_file: int | None = None, order: list[str] | None = None) -> None:
    """One text line a row; ``lines_per_file`` splits files at that many."""
    out = df.orderBy(*order) if order else df
    writer = out.select(line.alias("value")).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", lines_per_file) if lines_per_file else writer).text(path)


def distance_line() -> Column:
    """``Node: i Distance: d``; an unreachable vertex has the largest unsigned 64-bit number."""
    return F.concat(F.lit("Node: "), F.col("vertex"), F.lit(" Distance: "), F.coalesce(F.col("dist").cast("string"), F.lit(str(2**64 - 1))))


def adjacency_line() -> Column:
    return F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ")


def numbered_line() -> Column:
    return F.concat_ws(" ", F.col("vertex").cast("string"), adjacency_line())


def edge_line(a: str = "src", b: str = "dst", sep: str = " ") -> Column:
    return F.concat_ws(sep, F.col(a).cast("string"), F.col(b).cast("string"))


def with_header(lines: DataFrame, header: str | None) -> DataFrame:
    """Numbered lines (n, value) from 0 with ``header`` in the place of line 0, before which others stay; null: without line 0."""
    rest = lines.filter("n > 0")
    if header is None:
        return rest
    return lines.sparkSession.createDataFrame([(0, header)], "n bigint, value string").union(rest.select("n", "value"))


def write_numbered(lines: DataFrame, path: str) -> None:
    """The values of (n, value) as text in the order of n; part files follow one another."""
    lines.orderBy("n").select("value").write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, length) of a folder's files in path order, with ``limit`` the size-capped ones; empty files aren't listed."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return (size_capped(files, limit) if limit is not None else files).orderBy("path")


def write_manifest(files: DataFrame, path: str) -> None:
    """One path a line."""
    files.orderBy("path").select(F.col("path").alias("value")).write.mode("overwrite").text(path)


def binary_edges(edges: DataFrame, folder: str) -> DataFrame:
    """Files of consecutive little-endian int32 pairs (src, dst), one a partition: (path, edges, max_id) of each.

    A file's name holds a fresh mark, and only files of tasks that ended are
    listed, so a task that is run again does no harm. Ids beyond int32 fail.
    """
    import uuid

    import numpy as np
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches):
        sink, n, top = None, 0, -1
        for b in batches:
            pairs = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], 1)
            if not len(pairs):
                continue
            if pairs.max() >= 2**31 or pairs.min() < -(2**31):
                raise ValueError("a vertex id doesn't fit 32 bits")
            if sink is None:
                fs, at = pafs.FileSystem.from_uri(folder)
                fs.create_dir(at, recursive=True)
                name = f"edges-{uuid.uuid4().hex}.bin"
                sink = fs.open_output_stream(f"{at}/{name}")
            sink.write(pairs.astype("<i4").tobytes())
            n, top = n + len(pairs), max(top, int(pairs.max()))
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "edges": [n], "max_id": [top]})

    ship_package(edges.sparkSession)
    written = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).mapInArrow(run, "path string, edges bigint, max_id bigint")
    return materialize(written, "binary")


def read_binary_edges(files: DataFrame) -> DataFrame:
    """(src, dst) of the files in ``files`` (path), a block of a file at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as source:
                    rest = b""
                    while raw := source.read(1 << 20):
                        raw = rest + raw
                        cut = len(raw) // 8 * 8
                        pairs, rest = np.frombuffer(raw[:cut], "<i4").reshape(-1, 2).astype(np.int64), raw[cut:]
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    ship_package(files.sparkSession)
    return files.select("path").mapInArrow(run, "src bigint, dst bigint")


def size_capped(files: DataFrame, limit: int, path: str = "path", length: str = "length") -> DataFrame:
    """Files in path order until their sizes reach ``limit``, the one that crosses it included.

    Sums of ranges of paths first, so one task sees no more than a range's files
    or a row a range.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(files.repartitionByRange(parts, path).withColumn("_part", F.spark_partition_id()), "files")
    upto = (Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("_part").alias("_p")).agg(F.sum(length).alias("_total"))
    bases = totals.select("_p", F.coalesce(F.sum("_total").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(*upto)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("_part").orderBy(path).rowsBetween(*upto)), F.lit(0))
    summed = ranged.withColumn("_before", inside).join(F.broadcast(bases), F.col("_part") == F.col("_p"))  # a row a range
    return summed.filter(F.col("_base") + F.col("_before") < limit).drop("_part", "_p", "_base", "_before")


class RecordStore:
    """Keyed records on Parquet, in ranges of the key: points and ranges prune row groups.

    Each change writes a new version of the store beside the one before, so
    readers of that aren't disturbed; older versions are deleted. A key has one
    record. ``stats`` counts reads and writes (single and of ranges) and adds up
    the milliseconds of the writes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.clear_stats()

    def clear_stats(self) -> None:
        self.stats = {"get": 0, "get_range": 0, "scan": 0, "write": 0, "put": 0, "delete": 0, "write_ms": 0.0}

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        fs, at = self._folder()
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v")]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(done(p, "_SUCCESS")))

    def _write(self, df: DataFrame, kind: str) -> None:
        began, old = time.perf_counter(), self.versions()
        new = (old[-1] if old else 0) + 1
        df.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/v{new}")
        fs, _ = self._folder()
        for v in old[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)
        self.stats[kind] += 1
        self.stats["write_ms"] += 1000 * (time.perf_counter() - began)

    def _records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")

    def write(self, df: DataFrame) -> None:
        """All records anew."""
        self._write(df, "write")

    def read(self) -> DataFrame:
        self.stats["scan"] += 1
        return self._records()

    def get(self, key: int) -> DataFrame:
        self.stats["get"] += 1
        return self._records().filter(F.col(self.key) == key)

    def get_range(self, first: int, n: int) -> DataFrame:
        self.stats["get_range"] += 1
        return self._records().filter(F.col(self.key).between(first, first + n - 1))

    def put(self, new: DataFrame) -> None:
        """Records of ``new`` take the place of those with the same key."""
        self._write(self._records().join(new.select(self.key), self.key, "left_anti").unionByName(new), "put")

    def delete(self, keys: DataFrame) -> None:
        self._write(self._records().join(keys.select(self.key), self.key, "left_anti"), "delete")
