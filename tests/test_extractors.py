"""Line extractors against values worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoline.functions import lines as L
from versoline.functions import text as X
from versoline.plans.relations import REWRITES
from versoline.queries.fixtures import FILES

EXPECTED = {
    "fm": ("Do it", "\n# T\nbody", "T", '--- name: x description: "Do it" ---'),
    "nofm": ("First prose line. Second.", '# Head  er\n\nFirst "prose" line. Second.\nmore\n\nlater', "Head  er", 'First "prose" line.'),
    "comment_then_fm": ("---", "---\ndescription: a\n---\nx", "comment_then_fm", "--- description: a --- x"),
    "unterminated": ("", "", "unterminated", "--- foo: 1 bar"),
    "fm_nodesc": ("Prose", "<b>\n# H\nProse\n---\nend", "H", "--- k: v --- <b> Prose --- end"),
    "nested_desc": ("text", "text", "nested_desc", "--- description: no --- text"),
    "empty": ("", "", "empty", ""),
    "para_heading_glued": ("intro one", "intro one\n# Glued\nstill same. cut here", "Glued", "intro one still same."),
    "empty_desc": ("", "body", "empty_desc", "--- description: --- body"),
    "crlf": ("---\r", "---\r\ndescription: q\r\n---\r", "crlf", "---\r description: q\r ---\r"),
    "escaped_comment": ("b", "# A\nb", "A", "<\\!-- x -->"),
}


def test_cases(spark):
    rows = spark.createDataFrame(FILES, "stem string, text string").select("stem", X.lines_of(F.col("text")).alias("a"))
    a = F.col("a")
    got = {r["stem"]: r for r in rows.select("stem", L.description(a).alias("d"), L.command_body(a).alias("b"), L.title(a, F.col("stem")).alias("t"), L.summary(a).alias("s")).collect()}
    for stem, want in EXPECTED.items():
        assert (bytes(got[stem]["d"]).decode(), got[stem]["b"], got[stem]["t"], got[stem]["s"]) == want, stem
    assert bytes(got["long_bytes"]["d"]) == ("é" * 75).encode()


def test_inline_rules(spark):
    text = "<!-- Copyright a -->\nsee .claude/rules/x.md and rules/y, .claude/commands/z\n<\\!-- Copyright b -->\n.claude/w"
    row = spark.createDataFrame([(text,)], "t string").select(L.inline_rules(X.lines_of(F.col("t"))).alias("x")).first()
    assert row["x"] == "see x.md and y, .github/prompts/z\nw"


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\nb", ["a", "b"])])
def test_lines(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.lines_of(F.col("t"))).first()[0] == want


def test_scalars(spark):
    row = spark.createDataFrame([("a/b/c.md", "x  y. z", ["1", "2", "3"])], "p string, t string, l array<string>").select(
        X.basename(F.col("p"), ".md"), X.dirname(F.col("p")), X.relative(F.col("p"), "a"), X.first_sentence(F.col("t")), X.tail(F.col("l"), 2), X.tail(F.col("l"), 15), X.or_default(F.lit(""), F.col("p")), X.is_script(F.lit("x.sh")), X.byte_prefix(F.lit("éé"), 3)
    ).first()
    assert list(row)[:8] == ["c", "a/b", "b/c.md", "x y.", ["2", "3"], ["1", "2", "3"], "a/b/c.md", True]
    assert bytes(row[8]) == "éé".encode()[:3]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from([".claude/", "skills/", "commands/", "rules/", "x", " ", "\n"]), max_size=12))
def test_github_rewrite_is_idempotent(spark, parts):
    text = "".join(parts).replace(".claude/.claude/", ".claude/ ")
    once = X.rewrite(F.col("t"), "github")
    row = spark.createDataFrame([(text,)], "t string").select(once.alias("one"), X.rewrite(once, "github").alias("two")).first()
    assert row["one"] == row["two"]
    want = text
    for old, new in REWRITES["github"]:
        want = want.replace(old, new)
    assert row["one"] == want
