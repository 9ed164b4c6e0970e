"""Sessions, scratch tables in the shared folder, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run (once an application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    base = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in this one process (tests, local
    mode) a temporary folder of this machine is taken, and the session is told of
    it. On a cluster that would lose data, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``drop_scratch`` removes it."""
    path = f"{shared_folder(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Later reads do not depend on any executor that took part in writing.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, keys: list[str], label: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in buckets of ``keys`` and sorted by them, a file a bucket: joins on ``keys`` don't shuffle it again.

    A frame that is dealt out so already says it by ``_dealt``, (buckets, keys); it is neither dealt out again nor sorted.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = scratch(spark, label), f"tessera_{uuid.uuid4().hex}"
    if getattr(df, "_dealt", None) == (n, keys):
        to = df.write.bucketBy(n, *keys)
    else:
        to = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
    to.option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._scratch_path, out._scratch_table = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` or ``bucketed`` wrote and nothing will read again; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _written:
            _written.remove(path)
            if name := getattr(df, "_scratch_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process (their readers must be done)."""
    while _written:
        _delete(spark, _written.pop())


@atexit.register
def _at_exit() -> None:
    """Scratch tables go with the driver, where its session still answers."""
    from pyspark import SparkContext

    if _written and SparkContext._active_spark_context is not None:
        try:
            drop_scratch(SparkSession.builder.getOrCreate())
        except Exception:  # the JVM may be gone already
            pass
