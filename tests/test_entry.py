"""The entry points without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

from __spark_entry__ import oracle_sql, queries
from tablescout.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_a_missing_library_leaves_out_the_corpus_queries_alone():
    blocked = "import sys; sys.modules['zstandard'] = None; " + PROBE
    env = {**os.environ, "PYTHONPATH": ROOT}
    done = subprocess.run(
        [sys.executable, "-c", blocked], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120
    )
    assert done.stdout.split() == [str(len(QUERIES)), str(len(QUERIES))], done.stderr
    assert "zstandard" in done.stderr


def test_python_workers_get_the_package_from_the_session(tmp_path):
    probe = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
import __spark_entry__ as e
def names(batches):
    import tablescout.functions.types as m
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([m.__file__] * b.num_rows)], names=["f"])
query = e._with_modules(lambda s, d: s.range(1).mapInArrow(names, "f string"))
print("FOUND", query(spark, "").first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", probe], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    found = [x for x in done.stdout.splitlines() if x.startswith("FOUND")]
    assert found and "tablescout.zip" in found[0], done.stderr[-2000:]


def test_the_rest_works_without_the_corpus_folder(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(
        f"{ROOT}/tablescout", f"{tmp_path}/tablescout", ignore=shutil.ignore_patterns("llm", "__pycache__")
    )
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run(
        [sys.executable, "-c", PROBE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert done.stdout.split() == [str(len(QUERIES)), str(len(QUERIES))], done.stderr
