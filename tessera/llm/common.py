"""Helpers shared by the operators: scratch tables, total order, prefix sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch, ship_package  # noqa: F401

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, and Spark's own value, in whose place it is set.
BATCH_BYTES, SPARK_BATCH_BYTES = 8 << 20, 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold no more than BATCH_BYTES, or one row beyond it; a session's own value other than Spark's stays.

    Both sides of the pipe hold a batch several times over, outside the heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(SPARK_BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with the package on the executors and the worker's memory given back.

    A Python worker outlives its task and serves other stages; what a task's
    caches and batches took would stay with it.
    """
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def release_memory() -> None:
    """Give free memory of this process back to the system: Arrow's pool and the C heap (glibc; elsewhere the latter is left out)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(name: str, value: str, body: str) -> str:
    """SQL text that evaluates ``value`` once and names it inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def range_ordered(df: DataFrame, *keys: Column, label: str) -> DataFrame:
    """``df`` in ranges of ``keys``, each range sorted, with its number in ``_part``.

    It is written once: the numbers do not change when a task is run again.
    """
    parts = shuffle_parts(df.sparkSession)
    return materialize(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), label)


def exclusive_prefix(df: DataFrame, part: str, order: list[Column], value: str, out: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``value`` over the rows before, in the order (part, order).

    Two levels: sums inside each (within, part), and a running sum of the
    parts' totals. No task ever takes more than one part's rows, and the second
    level has a row for each part only. ``within``: columns each of whose
    values has an order of its own.
    """
    keys = [*within, part]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    over = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [df[k].eqNullSafe(bases[f"_b_{k}"]) for k in keys]
    summed = df.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    on = [summed[k].eqNullSafe(bases[f"_b_{k}"]) for k in keys]
    return summed.join(bases, on).withColumn(out, F.col("_base") + F.col("_local")).drop("_local", "_base", *[f"_b_{k}" for k in keys])


def hot_keys(rows: DataFrame, key: str, how_many: int) -> DataFrame:
    """(_hot, _slices) of the values of ``key`` with more of ``how_many`` rows than a task's even share, to be broadcast.

    No more keys than there are tasks can have so many rows.
    """
    most = max(1, how_many // shuffle_parts(rows.sparkSession))
    counts = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_c")).filter(F.col("_c") > most)
    return F.broadcast(counts.select("_hot", F.ceil(F.col("_c") / most).cast("int").alias("_slices")))


def dealt(rows: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """``rows`` with ``_slice``: a hot key's rows are dealt out by a hash of column ``spread``."""
    j = rows.join(hot, rows[key] == hot["_hot"], "left")
    return j.withColumn("_slice", F.pmod(F.xxhash64(spread), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_hot", "_slices")


def copied(table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``table``, which has one row a key, with a row for each ``_slice`` of a key."""
    j = table.join(hot, table[key] == hot["_hot"], "left")
    return j.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_hot", "_slices")


def sliced_join(rows: DataFrame, table: DataFrame, key: str, spread: str, how_many: int) -> DataFrame:
    """``rows`` joined on ``key`` with ``table``, which has one row a key, while ``rows`` may have very many of one."""
    hot = hot_keys(rows, key, how_many)
    return dealt(rows, key, spread, hot).join(copied(table, key, hot), [key, "_slice"]).drop("_slice")
