"""The corpus operators on executors that know nothing of this repository's folder."""

import os
import subprocess
import sys
import tempfile
import zipfile

from ledgerlens import shipping

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from ledgerlens.llm import simhash
found = simhash.components(spark.createDataFrame([(1, "a b"), (2, "A b"), (3, "c")], "doc_id long, text string"))
print("FOUND", sorted((r.doc_id, r.component_id) for r in found.collect()))
"""


def test_archive_holds_the_package(tmp_path):
    names = zipfile.ZipFile(shipping.archive(str(tmp_path / "x.zip"))).namelist()
    assert {"ledgerlens/__init__.py", "ledgerlens/scratch.py", "ledgerlens/operators/facts.py"} <= set(names)


def test_library_reaches_the_workers(tmp_path):
    folder = tempfile.mkdtemp(prefix="spark-workers-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": _spark_home(tmp_path)}
    done = subprocess.run([sys.executable, "-c", RUN, ROOT, f"file://{folder}"], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=240)
    assert "FOUND [(1, 1), (2, 1), (3, 3)]" in done.stdout, done.stderr[-2000:]


def _spark_home(tmp_path):
    """Spark's folder by links, so that the executors' logs do not go there."""
    import pyspark

    home = tmp_path / "home"
    home.mkdir()
    source = os.path.dirname(pyspark.__file__)
    for name in os.listdir(source):
        if name != "work":
            os.symlink(os.path.join(source, name), home / name)
    (home / "work").mkdir()
    return str(home)
