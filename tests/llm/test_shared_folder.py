"""What operators write goes when the application ends."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

RUN = """
from pyspark.sql import SparkSession
from scriptorium.ship import ship
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
from scriptorium.llm import exact, repair
docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
assert exact.exact_groups(docs).where("kept").count() == 2
import os
print("held", len(os.listdir({folder!r})))
"""


def test_nothing_is_left_after_exit(tmp_path):
    folder = str(tmp_path / "shared")
    os.mkdir(folder)
    done = subprocess.run([sys.executable, "-c", RUN.format(folder=folder)], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300, check=True)
    assert "held 0" not in done.stdout and "held" in done.stdout
    assert not [p for p in os.listdir(folder) if p.startswith("exact-")]
