"""A local session that names no shared folder: families, components and the operators that write get one of their own; a cluster is refused."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from terravane.operators import graph

ROOT = Path(__file__).resolve().parents[1]
CODE = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
from terravane.operators import graph
edges = s.createDataFrame([(1, 2), (2, 3), (5, 6)], "a bigint, b bigint")
assert sorted(map(tuple, graph.components(edges, "a", "b").collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
try:
    from terravane.llm import exact_dedup, common
except ImportError:
    raise SystemExit
assert common.shared_dir(s) == common.shared_dir(s)
docs = s.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
assert exact_dedup.exact_dedup(docs).where("kept").count() == 1
"""


def test_a_session_without_a_shared_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: Context)

        getCheckpointDir = staticmethod(lambda: Context)
        isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph._checkpoint_dir(Session)
