"""Shuffle files of a table that has been written are not kept until the driver collects its garbage."""

from __future__ import annotations

import subprocess
import sys
import textwrap
from pathlib import Path

RUN = """
    import os, sys, time
    sys.path.insert(0, {repo!r})
    from pyspark.sql import SparkSession, functions as F
    from tillview.llm.common import stored, stored_by
    from tillview.session import written_once
    conf = {{"spark.ui.enabled": "false", "spark.local.dir": {local!r}, "spark.sql.warehouse.dir": {local!r} + "-w", "spark.sql.shuffle.partitions": "3"}}
    spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
    rows = lambda: spark.range(5000).groupBy((F.col("id") % 999).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tables = [stored(rows(), "a"), stored_by(rows(), "b", "k")[0], written_once(rows(), "c"), written_once(rows(), "d", "k")]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"
    for _ in range(50):
        left = [f for d, _, files in os.walk({local!r}) for f in files if f.startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.1)
    assert not left, left
    assert [t.agg(F.sum("n")).first()[0] for t in tables] == [5000] * 4
"""


def test_shuffle_files_go_with_the_write(tmp_path):
    code = textwrap.dedent(RUN.format(repo=str(Path(__file__).parents[1]), local=str(tmp_path / "local")))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=170, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
