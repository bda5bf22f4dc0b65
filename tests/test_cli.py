import pytest

from tests.test_mirrors import put, tree  # noqa: F401
from versoline import cli
from versoline.operators import measures as M
from versoline.sources import read_files


def test_check_sync_and_leaks(spark, tree, capsys):  # noqa: F811
    run = lambda *a: cli.main([*a, "--root", str(tree)], spark)
    assert run("check") == 1 and "missing  AGENTS.md" in capsys.readouterr().out
    assert run("sync") == 0
    (tree / ".cursor/skills/empty/inner").mkdir(parents=True)
    assert run("check") == 1 and "extra    .cursor/skills/empty/inner" in capsys.readouterr().out
    assert run("sync") == 0 and not (tree / ".cursor/skills/empty").exists()
    assert run("check") == 0 and "all mirrors agree" in capsys.readouterr().out
    put(tree, ".claude/scripts/bad.sh", "cat .claude/x\n")
    assert run("check") == 1 and "bad.sh:1" in capsys.readouterr().err


def test_preconditions_and_arguments(spark, tmp_path, capsys):
    assert cli.main(["check", "--root", str(tmp_path)], spark) == 1
    assert "instructions.md" in capsys.readouterr().err
    for args in (["--checks"], ["check", "x"], ["other"], []):
        with pytest.raises(SystemExit) as e:
            cli.main(args, spark)
        assert e.value.code == 2


def test_tests(spark, tmp_path, capsys):
    put(tmp_path, ".claude/skills/a/test_ok.py", "print('fine')\n")
    assert cli.main(["test", "--root", str(tmp_path)], spark) == 1 and "pixi.toml" in capsys.readouterr().err
    put(tmp_path, ".claude/pixi.toml", "[x]\n")
    assert cli.main(["test", "--root", str(tmp_path)], spark) == 0
    assert "ok    a/test_ok.py" in capsys.readouterr().out
    put(tmp_path, ".claude/scripts/test_bad.py", "raise SystemExit('broken')\n")
    assert cli.main(["test", "--root", str(tmp_path)], spark) == 1
    out = capsys.readouterr().out
    assert "FAIL  test_bad.py" in out and " " * 10 + "broken" in out and "1 of 2 failed: test_bad.py" in out
    assert cli.main(["test", "ok", "--root", str(tmp_path)], spark) == 0
    assert cli.main(["test", "nothing", "--root", str(tmp_path)], spark) == 1


def test_path_filters_are_pushed_down(spark, tmp_path):
    """A file that no filter lets through isn't opened: one that can't be read does no harm."""
    from versoline.sources import files as source

    put(tmp_path, "a/deep/test_x.py", "x")
    put(tmp_path, "a/other.bin", "y")
    reader = source.FilesReader({"path": str(tmp_path)})
    assert [*reader.pushFilters([source.StringEndsWith(("path",), ".py")])]
    got = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert got == ["a/deep/test_x.py"]
    assert [r["path"] for r in read_files(spark, str(tmp_path)).where("path like 'a/%.py'").collect()] == ["a/deep/test_x.py"]


def test_gate_keeps_citations(spark):
    rows = [("as [12] says", "as [12] said"), ("as [12] says", "as 12 says"), ("so (Doe, 1999a)", "so it was 1999"), ("plain", "other")]
    df = spark.createDataFrame(rows, "a string, b string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(M.gated(F.col("a"), F.col("b"))).collect()] == ["as [12] said", "as [12] says", "so (Doe, 1999a)", "other"]
