"""A session started elsewhere, with the package on the driver only, runs every operator query."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1500]").config(map={
    "spark.executor.memory": "1g", "spark.checkpoint.dir": sys.argv[2], "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
    "spark.executorEnv.PYTHONPATH": "", "spark.driver.host": "127.0.0.1"}).getOrCreate()
list(spark.range(2).repartition(2).rdd.map(lambda r: r).collect())
sys.path.insert(0, sys.argv[1])
from sightlake.llm.queries import QUERIES
for name in sys.argv[4:]:
    print(name, QUERIES[name](spark, sys.argv[3]).count(), flush=True)
spark.stop()
"""


def test_package_on_the_driver_only(tmp_path):
    names = ["op2_decontaminate", "op8_language_id", "op11_alignment", "op12_packing", "op13_whitening"]
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO), str(tmp_path / "shared"), "/root/testdata/sf0.001", *names],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names, done.stderr[-3000:]
