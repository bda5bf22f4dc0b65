"""Test discovery and results as relations; running a test is one process for each row, on the driver."""

from __future__ import annotations

import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, indented, lines_of, tail


def discover(files: DataFrame, pattern: str = "") -> DataFrame:
    """(root, path) of test_*.py of all roots, none from __pycache__, whose path has the pattern, in order. A relative path is tested, so that a checkout's own place never matches."""
    found = files.where(F.col("is_file") & ~F.col("is_symlink") & basename(F.col("path")).rlike(r"^test_.*\.py$") & ~F.concat(F.lit("/"), "path").contains("/__pycache__/"))
    return found.where(F.contains("path", F.lit(pattern))).select("root", "path").orderBy("root", "path")


def run_tests(spark: SparkSession, tests: DataFrame, timeout: int = 600) -> DataFrame:
    """(path, ok, output): every test runs, whatever others do. No test at all is an error."""
    rows = []
    for r in tests.collect():
        try:
            done = subprocess.run([sys.executable, r["path"]], cwd=r["root"], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, timeout=timeout)
            rows.append((r["path"], done.returncode == 0, done.stdout))
        except subprocess.TimeoutExpired as e:
            rows.append((r["path"], False, f"timed out after {e.timeout} s"))
    if not rows:
        raise ValueError("no tests found")
    return spark.createDataFrame(rows, "path string, ok boolean, output string")


def results(done: DataFrame) -> DataFrame:
    """One row: passed, failed, and the failing paths."""
    return done.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("path")))).alias("failing"))


def failure_logs(done: DataFrame, n: int = 15) -> DataFrame:
    """(path, log): the last lines of each failing test's output, indented."""
    return done.where("not ok").select("path", F.array_join(indented(tail(lines_of(F.col("output")), n)), "\n").alias("log"))
