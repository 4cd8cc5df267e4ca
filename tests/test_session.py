import os
import pathlib
import subprocess
import sys

from gateflow.session import materialise, release, store_table

ROOT = str(pathlib.Path(__file__).parent.parent)
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from gateflow.session import local_session, materialise, release, store_table
spark = local_session("2", "stored")
{folder}
small = materialise(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
large = store_table(spark.range(1000).selectExpr("id", "id % 3 AS k"))
assert small.count() == 7 and large.where("k = 1").count() == 333
print("DIR", spark.sparkContext.getCheckpointDir(), "PLAN", large.where("k = 1").select("id")
      ._jdf.queryExecution().executedPlan().toString().replace(chr(10), " "))
release(spark)
print("CACHED", spark.sparkContext._jsc.getPersistentRDDs().size())
"""


def run(tmp_path, folder=""):
    made = tmp_path / "tmp"
    made.mkdir()
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, folder=folder)],
        env=os.environ | {"TMPDIR": str(made), "SPARK_CONF_DIR": str(made)},
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "DIR" in done.stdout, done.stderr[-2000:]
    return done.stdout, made


def test_without_a_folder_tables_are_cached_and_nothing_is_made(tmp_path):
    out, made = run(tmp_path)
    assert "DIR None" in out and "InMemoryTableScan" in out
    assert "CACHED 0" in out
    assert not [p for p in made.iterdir() if p.name.startswith("gateflow")]


def test_with_a_folder_large_tables_are_parquet_until_released(tmp_path):
    shared = tmp_path / "shared"
    out, _ = run(tmp_path, f"spark.sparkContext.setCheckpointDir({str(shared)!r})")
    assert f"DIR file:{shared}" in out
    assert "FileScan parquet" in out and "EqualTo(k,1)" in out
    assert not list(shared.glob("*/table-*"))


def test_stored_table_is_cut_from_its_source(spark):
    stored = materialise(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    assert stored.count() == 7
    kept = store_table(spark.range(10))
    assert kept.count() == 10
    release(spark)
