"""Operators on frames that no helper of this library has read: workers have the package all the same."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tessera.llm import bitplanes, jaccard_join, language_id, media, packing, url_filter
sys.path.remove({ROOT!r})
from pyspark.sql import SparkSession
import numpy as np
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.createDataFrame([(1, "one two three four five six", "en"), (2, None, None)], "doc_id long, text string, lang string")
assert language_id.identify(df, language_id.learn(df)).count() == 2
assert packing.pack(df).count() == 2 and bitplanes.round_trip(df).count() == 2 and media.stored_texts(df).count() == 2
assert url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), url_filter.fit([], np.zeros(0))).collect()
assert media.sniff_column(spark.createDataFrame([(1, b"GIF89a", "image/gif")], "i long, m binary, d string"), row_id="i", media="m", declared="d").count() == 1
assert jaccard_join.near_duplicates(df).count() == 2
print("all ran")
"""


def test_operators_ship_the_package(tmp_path):
    """From another folder, and without the repository on the workers' path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
