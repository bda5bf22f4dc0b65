"""Trees: the files source, building, checking and syncing mirrors, discovery and runs."""

import os

import pytest

from versoline.plans import mirrors, runner
from versoline.sources import read_files

BODY = '---\ndescription: "Does x"\n---\nrun .claude/skills/a/run.py\n'


def put(root, path, text="", mode=0o644):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)
    full.chmod(mode)


@pytest.fixture
def tree(tmp_path):
    c = tmp_path / ".claude"
    put(c, "commands/go.md", BODY)
    put(c, "commands/plain.md", "First line.\nuse .claude/commands/go.md\n")
    put(tmp_path, "other/linked.md", "x\n")
    os.symlink(tmp_path / "other/linked.md", c / "commands/linked.md")
    put(c, "skills/a/SKILL.md", BODY)
    put(c, "skills/a/run.py", "print('.claude/rules/r.md')\n", 0o755)
    put(c, "skills/a/__pycache__/run.pyc", "z")
    put(c, "skills/a/empty.txt")
    put(c, "skills/bare/notes.txt", "n\n")
    put(c, "rules/r.md", "# Rule R\n\nKeep it. More.\n")
    put(c, "instructions.md", "Read rules/r.md\n")
    put(c, "scripts/tool.sh", "echo\n")
    put(c, "pixi.toml", "[x]\n")
    return tmp_path


def canonical(spark, tree):
    return read_files(spark, str(tree / ".claude"))


def present(spark, tree):
    return read_files(spark, str(tree))


def test_files_source(spark, tree):
    rows = {r["path"]: r for r in canonical(spark, tree).collect()}
    assert bytes(rows["skills/a/empty.txt"]["content"]) == b""
    assert rows["commands/linked.md"]["is_symlink"] and rows["commands/linked.md"]["is_file"]
    assert rows["skills/a/run.py"]["is_exec"] and not rows["skills/a/SKILL.md"]["is_exec"]
    assert "skills/a/__pycache__/run.pyc" in rows and rows["skills"]["is_dir"]
    assert read_files(spark, str(tree / "nowhere")).count() == 0


def test_stage(spark, tree):
    stage = {r["path"]: r for r in mirrors.build_stage(canonical(spark, tree)).collect()}
    text = lambda p: bytes(stage[p]["content"]).decode()
    assert not any("linked" in p or "__pycache__" in p for p in stage)
    assert text(".cursor/commands/go.md") == BODY.replace(".claude/skills", ".cursor/skills")
    assert text(".opencode/commands/plain.md") == '---\ndescription: "First line."\n---\n\nFirst line.\nuse .claude/commands/go.md\n'
    assert text(".github/prompts/plain.prompt.md").endswith("First line.\nuse .github/prompts/go.md\n")
    assert text(".agents/skills/go/SKILL.md").startswith('---\nname: "go"\ndescription: "Does x"\n---\n')
    assert text(".github/skills/a/run.py") == "print('r.md')\n" and stage[".github/skills/a/run.py"]["is_exec"]
    assert stage[".cursor/scripts/tool.sh"]["is_exec"] and ".agents/pixi.toml" in stage and ".agents/pixi.lock" not in stage
    assert text(".github/copilot-instructions.md").endswith("Read r.md\n\n# Rule R\n\nKeep it. More.\n")
    agents = text("AGENTS.md")
    assert "Skills (2): a, bare." in agents and "Commands (2): go, plain." in agents and "- **Rule R** — Keep it. See `.claude/rules/r.md`." in agents
    assert ".github/prompts/bare.prompt.md" not in stage


def test_problems(spark, tree):
    put(tree, ".claude/skills/go/SKILL.md", BODY)
    files = canonical(spark, tree)
    found = {(r["path"], r["problem"]) for r in mirrors.problems(files, mirrors.build_stage(files)).collect()}
    assert ("skills/bare/SKILL.md", "missing") in found
    assert (".agents/skills/go/SKILL.md", "written twice") in found and (".github/prompts/go.prompt.md", "written twice") in found


def test_check_and_sync(spark, tree):
    files = canonical(spark, tree)
    before = mirrors.check(files, present(spark, tree))
    assert {r["status"] for r in before.collect()} == {"missing"}
    put(tree, ".cursor/skills/gone/x.md", "old\n")
    put(tree, ".cursor/pixi.lock", "old\n")
    put(tree, ".opencode/node_modules/keep.js", "k\n")
    states = {r["path"]: r["status"] for r in mirrors.check(files, present(spark, tree)).collect()}
    assert states[".cursor/skills/gone/x.md"] == "extra" and states[".cursor/pixi.lock"] == "stale"
    assert mirrors.sync(files, present(spark, tree), str(tree)) == len(states)
    after = mirrors.check(files, present(spark, tree))
    assert {r["status"] for r in after.collect()} == {"same"} and not any(r["exec_differs"] for r in after.collect())
    assert tuple(mirrors.verdict(after).first()) == (True, 0)
    assert not (tree / ".cursor/skills/gone/x.md").exists() and (tree / ".opencode/node_modules/keep.js").exists()
    assert os.access(tree / ".github/skills/a/run.py", os.X_OK)
    put(tree, ".agents/skills/a/SKILL.md", "changed\n")
    os.chmod(tree / ".github/skills/a/run.py", 0o644)
    rows = {r["path"]: r for r in mirrors.check(files, present(spark, tree)).collect()}
    assert rows[".agents/skills/a/SKILL.md"]["status"] == "changed" and rows[".github/skills/a/run.py"]["exec_differs"]
    head = mirrors.diff_head(mirrors.build_stage(files), present(spark, tree)).collect()
    assert {r["area"] for r in head} == {".agents/skills"} and head[0]["have"] == "changed"
    assert mirrors.sync(files, present(spark, tree), str(tree)) == 2


def test_leak_stops_before_writing(spark, tree):
    put(tree, ".claude/scripts/bad.sh", "cat .claude/x\n")
    with pytest.raises(mirrors.LeakError, match="bad.sh:1"):
        mirrors.sync(canonical(spark, tree), present(spark, tree), str(tree))
    assert not (tree / ".github").exists()


def test_no_skills_at_all(spark, tmp_path):
    put(tmp_path, ".claude/commands/go.md", BODY.replace(".claude/skills/a", "a"))
    put(tmp_path, ".claude/instructions.md", "x\n")
    stage = {r["path"] for r in mirrors.build_stage(canonical(spark, tmp_path)).collect()}
    assert ".cursor/commands/go.md" in stage and not any("/skills/" in p and not p.startswith(".agents") for p in stage)
    assert mirrors.sync(canonical(spark, tmp_path), present(spark, tmp_path), str(tmp_path)) > 0
    assert mirrors.verdict(mirrors.check(canonical(spark, tmp_path), present(spark, tmp_path))).first()["ok"]


def test_runner(spark, tmp_path):
    put(tmp_path, "one/test_ok.py", "print('fine')\n")
    put(tmp_path, "two/x/test_bad.py", "for i in range(20): print(i)\nraise SystemExit(1)\n")
    put(tmp_path, "two/__pycache__/test_no.py", "")
    files = read_files(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    tests = runner.discover(files)
    assert [r["path"] for r in tests.collect()] == ["test_ok.py", "x/test_bad.py"]
    done = runner.run_tests(spark, tests)
    assert tuple(runner.results(done).first()) == (1, 1, ["x/test_bad.py"])
    log = runner.failure_logs(done).first()["log"]
    assert log.split("\n")[0] == " " * 10 + "5" and len(log.split("\n")) == 15
    assert runner.discover(files, "ok").count() == 1
    with pytest.raises(ValueError, match="no tests"):
        runner.run_tests(spark, runner.discover(files, "nothing"))
