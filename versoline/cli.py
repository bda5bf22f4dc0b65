"""The command line: python -m versoline.cli check | sync | test [PATTERN], with --root for the repository's root.

Rows become lines here and nowhere else. Exit status 0 says that all agrees or passes, 1 that something differs, fails or
is missing; unknown arguments are an error (2).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import mirrors, runner
from .sources import read_files


def parsed(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="versoline", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("check", "sync", "test"))
    parser.add_argument("pattern", nargs="?", default="", help="of test: run only tests whose path has it")
    parser.add_argument("--root", default=".", help="the folder that holds the canonical tree")
    found = parser.parse_args(args)
    if found.pattern and found.command != "test":
        parser.error(f"{found.command} takes no pattern")
    return found


def lacking(command: str, root: str) -> list[str]:
    """What must be there before anything is run, and is not."""
    tree = os.path.join(root, mirrors.CANONICAL)
    needed = {tree: os.path.isdir(tree)}
    if command == "test":
        needed |= {os.path.join(tree, "pixi.toml"): os.path.isfile(os.path.join(tree, "pixi.toml")), sys.executable or "python": bool(sys.executable)}
    else:
        needed |= {os.path.join(tree, "instructions.md"): os.path.isfile(os.path.join(tree, "instructions.md"))}
    return [f"there is no {path}" for path, there in needed.items() if not there]


def checked(spark: SparkSession, root: str) -> int:
    found = mirrors.check(read_files(spark, os.path.join(root, mirrors.CANONICAL)), targets(spark, root))
    for r in found.where("status <> 'same'").orderBy("path").toLocalIterator():
        print(f"{r['status']:<8} {r['path']}")
    ok, n = mirrors.verdict(found).first()
    found.unpersist()
    print("all mirrors agree" if ok else f"{n} paths differ; run sync", file=sys.stdout if ok else sys.stderr)
    return 0 if ok else 1


def targets(spark: SparkSession, root: str) -> DataFrame:
    """What is at root beside the canonical tree; only what is managed matters, and is read."""
    files = read_files(spark, root)
    return files.where(mirrors.area_of(F.col("path")).isNotNull())


def synced(spark: SparkSession, root: str) -> int:
    n = mirrors.sync(read_files(spark, os.path.join(root, mirrors.CANONICAL)), targets(spark, root), root)
    print(f"{n} paths written or removed")
    return 0


def tested(spark: SparkSession, root: str, pattern: str) -> int:
    trees = [os.path.join(root, mirrors.CANONICAL, name) for name in ("skills", "scripts")]
    tests = runner.discover(read_files(spark, *trees), pattern)
    if tests.isEmpty():
        raise ValueError(f"no test matches {pattern!r}" if pattern else "no tests found")
    done = runner.run_tests(spark, tests)
    logs = {r["path"]: r["log"] for r in runner.failure_logs(done).collect()}
    for r in done.select("path", "ok").collect():
        print(f"  {'ok' if r['ok'] else 'FAIL':<5} {r['path']}")
        if not r["ok"]:
            print(logs[r["path"]])
    passed, failed, failing = runner.results(done).first()
    print(f"{failed} of {passed + failed} failed: {', '.join(failing)}" if failed else f"all {passed} tests passed")
    return 1 if failed else 0


def main(args: list[str], spark: SparkSession | None = None) -> int:
    what = parsed(args)
    if missing := lacking(what.command, what.root):
        print("\n".join(missing), file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if what.command == "test":
            return tested(spark, what.root, what.pattern)
        return (checked if what.command == "check" else synced)(spark, what.root)
    except ValueError as e:  # a leak, or nothing to run
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
