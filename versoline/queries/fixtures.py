"""Inline relations, as DataFrames and as SQL: branches that the tables don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Line-extractor cases: stem and content.
FILES = (
    ("fm", '---\nname: x\ndescription: "Do it"\n---\n\n# T\nbody\n'),
    ("nofm", '\n# Head  er\n\nFirst "prose" line. Second.\nmore\n\nlater\n'),
    ("comment_then_fm", "<!-- c -->\n---\ndescription: a\n---\nx\n"),
    ("unterminated", "---\nfoo: 1\nbar\n"),
    ("fm_nodesc", "---\nk: v\n---\n<b>\n# H\nProse\n---\nend\n"),
    ("nested_desc", "---\n  description: no\n---\ntext\n"),
    ("empty", ""),
    ("para_heading_glued", "intro one\n# Glued\nstill same. cut here\n"),
    ("empty_desc", "---\ndescription:\n---\nbody\n"),
    ("crlf", "---\r\ndescription: q\r\n---\r\n"),
    ("escaped_comment", "<\\!-- x -->\n\n# A\nb\n"),
    ("long_bytes", "---\ndescription: " + "é" * 100 + "\n---\n"),
    ("copyright", "<!-- Copyright x -->\nsee .claude/skills/a and .claude/rules/b.md, rules/c\n<\\!-- Copyright y -->\nend .claude/commands/d.md .claude/e"),
)

PATHS = (
    ("skills", "a/scripts/test_one.py", True),
    ("skills", "a/scripts/__pycache__/test_one.py", True),
    ("skills", "a/scripts/test_two.txt", True),
    ("skills", "a/scripts/test_dir.py", False),
    ("scripts", "test_three.py", True),
    ("scripts", "tool.py", True),
)

MANAGED = ("AGENTS.md", "a/pixi.toml", "a/pixi.lock", "b/pixi.toml", "b/pixi.lock")
STAGED = (("AGENTS.md", "one"), ("a/pixi.toml", "two"), ("a/pixi.lock", "three"))
PRESENT = (("AGENTS.md", "one"), ("a/pixi.toml", "other"), ("b/pixi.toml", "old"))

TREE = (("skills/a/SKILL.md", "see .claude/skills/b and .claude/rules/c.md"), ("skills/a/scripts/run.py", "print(1)\n.claude/commands/x"), ("skills/a/__pycache__/run.py", "x"), ("scripts/tool.sh", "echo .claude/x"), ("scripts/.hidden", "x"), ("scripts/deep/x.sh", "x"), ("pixi.toml", "[x]"), ("rules/c.md", "# C"))
LEAKY = ((".github/a.md", "fine\nsee .claude/skills/x\n.cursor/y and .opencode/z\nclaude/"), (".agents/skills/a/SKILL.md", "x .claude/a\n.cursor/b is fine"), (".cursor/a", ".claude/b"), (".github/b.md", ""))
DONE = (("b/test_x.py", "false"), ("a/test_y.py", "true"), ("a/test_z.py", "false"), ("c/test_w.py", "true"))

COMMANDS = (("pop", False), ("work", True), ("push", False))


def relation(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def values(rows, name: str, *columns: str) -> str:
    """The same relation as a common table expression's VALUES; texts go through hex, so that any character survives."""

    def one(v) -> str:
        return str(v).lower() if isinstance(v, bool) else f"decode(unhex('{v.encode().hex()}'))"

    body = ", ".join("(" + ", ".join(one(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
