"""Percentiles with hot values, and the checkpoint-directory contract."""

import math
import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from escalade.functions import quantiles as QN


def test_percentiles_without_a_hot_task(spark):
    """90 % equal values: the value is one row before the layout, so no range holds most rows."""
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 > 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    probs = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.0}
    for by in (["g"], []):
        got = sorted(map(tuple, QN.percentiles(df, "x", probs, by).collect()))
        want = sorted(map(tuple, QN.percentiles(df, "x", probs, by, "builtin").collect()))
        assert len(got) == len(want) and all(math.isclose(p, q) for r, s in zip(got, want) for p, q in zip(r, s))
    spans = QN.value_spans(df, "x", ["g"])
    assert spans.count() == df.select("g", "x").distinct().count()


def test_checkpoint_dir_is_read_from_the_session():
    target = tempfile.mkdtemp(prefix="escalade-shared-", dir="/tmp")
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "from escalade.session import ensure_checkpoint_dir\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', %r).getOrCreate()\n"
        "print('DIR=' + ensure_checkpoint_dir(s))\n"
        "s.stop()\n" % (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), target))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    line = [x for x in out.splitlines() if x.startswith("DIR=")][0]
    assert target in line
