"""Building, checking and reconciling mirror trees of a canonical tree.

The stage, all that the mirrors should hold, is one lazy plan over the files relation: scan, extract, rewrite, fan
out over surfaces, union. A check compares it with what is there by a full outer join; a sync
differs only in its sink.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import basename, dirname, is_script, lines_of, name_list, rewrite, rewrite_by
from .relations import AREAS, MANAGED_FILES, SURFACES

CANONICAL = ".claude"
STAGE = ("path", "is_exec", "content")


@dataclass(frozen=True)
class Texts:
    """The wording of generated files; {name}, {count} and {names} stand for what a row holds."""

    prompt: str = "Run the /{name} command as described here; text after the prompt is its $ARGUMENTS.\n\n"
    skill_prompt: str = "Use the {name} skill: follow `.github/skills/{name}/SKILL.md` and the files\nbeside it. Text after the prompt is the skill's input.\n"
    instructions: str = "<!-- Generated; edit the canonical sources instead. -->\n\n# Instructions\n\n## Agent instructions\n\n"
    command_skill: str = "# {name} command\n\nFollow this workflow; text after its invocation is the command's input.\n\n"
    agents: str = "<!-- Generated; edit the canonical sources instead. -->\n\n# Repository instructions\n"
    workflow: str = ""
    workflow_needs: tuple[str, ...] = ()
    listing: str = "\n## Skills and commands\n\n"
    skills: str = "Skills ({count}): {names}.\n\n"
    commands: str = "Commands ({count}): {names}.\n"
    secrets: str = ""
    secrets_rule: str = "secrets.md"
    conventions: str = "\n## Conventions\n\n"
    closing: str = ""


def filled(template: str, **columns: Column) -> Column:
    out = F.lit(template)
    for key, value in columns.items():
        out = F.replace(out, F.lit(f"{{{key}}}"), value.cast("string"))
    return out


def joined(*parts: Column | str) -> Column:
    """Bytes one after another; a description may end inside a character."""
    return F.concat(*((F.lit(p) if isinstance(p, str) else p).cast("binary") for p in parts))


def text_of(column: str = "content") -> Column:
    return F.col(column).cast("string")


def commands(files: DataFrame) -> DataFrame:
    """Real files, no links, directly under commands: name, text, description, body."""
    here = files.where(F.col("path").rlike(r"^commands/[^./][^/]*\.md$") & F.col("is_file") & ~F.col("is_symlink"))
    lines = lines_of(text_of())
    return here.select("path", basename(F.col("path"), ".md").alias("name"), text_of().alias("text"), L.description(lines).alias("description"), L.command_body(lines).alias("body"), F.coalesce(F.try_element_at(lines, F.lit(1)) == "---", F.lit(False)).alias("has_front"))


def skill_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").startswith("skills/") & F.col("is_file") & ~F.col("is_symlink") & ~F.col("path").contains("/__pycache__/"))


def skills(files: DataFrame) -> DataFrame:
    """Directories under skills, links to directories too but no hidden ones, with the description of their SKILL.md (null without one)."""
    dirs = files.where(F.col("path").rlike("^skills/[^./][^/]*$") & F.col("is_dir")).select(basename(F.col("path")).alias("name"), F.col("is_symlink"))
    said = files.where(F.col("path").rlike("^skills/[^/]+/SKILL[.]md$") & F.col("is_file")).select(basename(dirname(F.col("path"))).alias("name"), L.description(lines_of(text_of())).alias("description"))
    return dirs.join(said, "name", "left")


def rules(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"^rules/[^./][^/]*\.md$") & F.col("is_file"))


def with_surface(rows: DataFrame, surfaces: tuple[str, ...]) -> DataFrame:
    """Each row for each surface: a constant of four at most, so no join is needed."""
    return rows.withColumn("surface", F.explode(F.array(*map(F.lit, surfaces))))


def front(*pairs: tuple[str, Column]) -> list[Column | str]:
    out: list[Column | str] = ["---\n"]
    for key, value in pairs:
        out += [f'{key}: "', value, '"\n']
    return [*out, "---\n\n"]


def ended(body: Column) -> Column:
    return F.when(body == "", body).otherwise(F.concat(body, F.lit("\n")))


def producers(files: DataFrame, texts: Texts) -> list[DataFrame]:
    """What each step stages, later steps overwriting earlier ones."""
    no = F.lit(False)
    cmds, trees, dirs = commands(files), skill_trees(files), skills(files)
    paired = with_surface(cmds, SURFACES[:2])
    own = rewrite_by(F.col("text"), F.col("surface"))
    copies = paired.select(F.concat_ws("/", "surface", F.lit("commands"), basename(F.col("path"))).alias("path"), no.alias("is_exec"), F.when(F.col("has_front"), own.cast("binary")).otherwise(joined(*front(("description", F.col("description"))), own)).alias("content"))
    prompts = cmds.select(F.concat(F.lit(".github/prompts/"), "name", F.lit(".prompt.md")).alias("path"), no.alias("is_exec"), joined(*front(("description", F.col("description"))), filled(texts.prompt, name=F.col("name")), ended(rewrite(F.col("body"), "github"))).alias("content"))
    skill_prompts = dirs.where("description is not null").select(F.concat(F.lit(".github/prompts/"), "name", F.lit(".prompt.md")).alias("path"), no.alias("is_exec"), joined(*front(("description", F.col("description"))), filled(texts.skill_prompt, name=F.col("name"))).alias("content"))
    command_skills = cmds.select(F.concat(F.lit(".agents/skills/"), "name", F.lit("/SKILL.md")).alias("path"), no.alias("is_exec"), joined(*front(("name", F.col("name")), ("description", F.col("description"))), filled(texts.command_skill, name=F.col("name")), ended(rewrite(F.col("body"), "agents"))).alias("content"))
    mirrored = trees.where("path not like '.agents/%'")
    return [copies, mirrored, prompts, skill_prompts, instructions(files, texts), command_skills, trees.where("path like '.agents/%'"), agents_file(files, texts), shared(files)]


def shared(files: DataFrame) -> DataFrame:
    """Scripts and manifests, which go to each surface as they are."""
    found = files.where(F.col("path").isin("pixi.toml", "pixi.lock") & F.col("is_file") | F.col("path").rlike("^scripts/[^./][^/]*$") & F.col("is_file"))
    return with_surface(found, SURFACES).select(F.concat_ws("/", "surface", "path").alias("path"), (F.col("is_exec") | (F.col("path").startswith("scripts/") & is_script(F.col("path")))).alias("is_exec"), "content")


def skill_trees(files: DataFrame) -> DataFrame:
    """The files of skills for each surface, rewritten for it."""
    return with_surface(skill_files(files), SURFACES).select(F.concat_ws("/", "surface", "path").alias("path"), "is_exec", rewrite_by(text_of(), F.col("surface")).cast("binary").alias("content"))


def instructions(files: DataFrame, texts: Texts) -> DataFrame:
    """One file: a header, the instructions, then each rule by name."""
    parts = files.where(F.col("path") == "instructions.md").unionByName(rules(files))
    parts = parts.select(F.when(F.col("path") == "instructions.md", 0).otherwise(1).alias("seq"), "path", ended(L.inline_rules(lines_of(text_of()))).alias("text"))
    order = F.array_sort(F.collect_list(F.struct("seq", "path", "text")))
    body = parts.agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n").alias("body"))
    return body.select(F.lit(".github/copilot-instructions.md").alias("path"), F.lit(False).alias("is_exec"), joined(texts.instructions, F.col("body")).alias("content"))


def agents_file(files: DataFrame, texts: Texts) -> DataFrame:
    """One file that lists skills, commands and rules; parts without anything to list are left out."""
    lines = lines_of(text_of())
    ruled = rules(files).select("path", F.concat(F.lit("- **"), L.title(lines, basename(F.col("path"), ".md")), F.lit("** — "), L.summary(lines), F.lit(f" See `{CANONICAL}/"), "path", F.lit("`.\n")).alias("line"))
    ruled = ruled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "").alias("rules"), F.coalesce(F.bool_or(F.col("path") == f"rules/{texts.secrets_rule}"), F.lit(False)).alias("secret"))
    # the count takes hidden directories and no links; the list does the opposite
    counted = files.where(F.col("path").rlike("^skills/[^/]+$") & F.col("is_dir")).agg(F.count_if(~F.col("is_symlink")).alias("n_skills"))
    named = skills(files).agg(name_list(F.collect_list("name")).alias("skills"))
    listed = commands(files).agg(F.count("*").alias("n_commands"), name_list(F.collect_list("name")).alias("commands"), F.count_if(F.col("name").isin(*texts.workflow_needs) if texts.workflow_needs else F.lit(False)).alias("needed"))
    one = ruled
    for part in (counted, named, listed):  # each has one row
        one = one.withColumn("one", F.lit(1)).join(part.withColumn("one", F.lit(1)), "one").drop("one")
    when = lambda test, value: F.when(test, value).otherwise(F.lit(""))
    text = F.concat(
        F.lit(texts.agents),
        when(F.col("needed") == len(texts.workflow_needs), F.lit(texts.workflow)),
        F.lit(texts.listing),
        when(F.col("skills") != "", filled(texts.skills, count=F.col("n_skills"), names=F.col("skills"))),
        when(F.col("commands") != "", filled(texts.commands, count=F.col("n_commands"), names=F.col("commands"))),
        when(F.col("secret"), F.lit(texts.secrets)),
        F.lit(texts.conventions),
        F.col("rules"),
        F.lit(texts.closing),
    )
    return one.select(F.lit("AGENTS.md").alias("path"), F.lit(False).alias("is_exec"), text.cast("binary").alias("content"))


def last_writer(parts: list[DataFrame]) -> DataFrame:
    """The union of producers: of several rows of a path, the last producer's; copies counts them."""
    rows = None
    for seq, part in enumerate(parts):
        part = part.select(*STAGE, F.lit(seq).alias("seq"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("path").agg(F.max_by(F.struct("is_exec", "content"), "seq").alias("last"), F.count("*").alias("copies")).select("path", "last.*", "copies")


def build_stage(files: DataFrame, texts: Texts = Texts()) -> DataFrame:
    """(path, is_exec, content, copies) of all mirrors. files: the canonical tree, as the files source reads it."""
    return last_writer(producers(files, texts))


def problems(files: DataFrame, stage: DataFrame) -> DataFrame:
    """(path, problem): what would make a build incomplete, and paths that several producers write."""
    has = lambda path: F.count_if(F.col("path") == path) == 0
    missing = files.agg(has("instructions.md").alias("bad")).where("bad").select(F.lit("instructions.md").alias("path"), F.lit("missing").alias("problem"))
    bare = skills(files).where("description is null").select(F.concat(F.lit("skills/"), "name", F.lit("/SKILL.md")).alias("path"), F.lit("missing").alias("problem"))
    linked = skills(files).where("is_symlink").select(F.concat(F.lit("skills/"), "name").alias("path"), F.lit("linked skill has no files").alias("problem"))
    twice = stage.where("copies > 1").select("path", F.lit("written twice").alias("problem"))
    return missing.unionByName(bare).unionByName(linked).unionByName(twice)


def leaks(stage: DataFrame) -> DataFrame:
    """(path, n, line): lines that lead out of a tree that must stand alone."""
    rows = L.with_lines(stage.where("path like '.github/%' or path like '.agents/%'")).select("path", "n", "line")
    out = F.when(F.col("path").startswith(".github/"), F.col("line").rlike(r"\.(claude|cursor|opencode)/")).otherwise(F.col("line").rlike(r"\.claude/"))
    return rows.where(out)


def area_of(path: Column) -> Column:
    """The managed area or file that a path belongs to; null for others."""
    out = F.when(path.isin(*MANAGED_FILES), path)
    for area in AREAS:
        out = out.when(path.startswith(area + "/"), F.lit(area))
    return out


def drift(stage: DataFrame, target: DataFrame) -> DataFrame:
    """(area, path, status, exec_differs): same, changed, missing, extra, or stale for a single file without a source.

    A directory that nothing staged is in is extra, as an area is replaced as a whole.
    """
    mine = stage.select("path", F.sha2("content", 256).alias("want"), F.col("is_exec").alias("want_exec"))
    theirs = target.where("is_file").select("path", F.sha2("content", 256).alias("have"), F.col("is_exec").alias("have_exec"))
    both = mine.join(theirs, "path", "full_outer").withColumn("area", area_of(F.col("path"))).where("area is not null")
    extra = F.when(F.col("area") == F.col("path"), "stale").otherwise("extra")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), extra).when(F.col("want") == F.col("have"), "same").otherwise("changed")
    files = both.select("area", "path", status.alias("status"), F.coalesce(F.col("want_exec") != F.col("have_exec"), F.lit(False)).alias("exec_differs"))
    parts = F.split("path", "/")
    needed = stage.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    dirs = target.where("is_dir and not is_symlink").select("path").withColumn("area", area_of(F.col("path"))).where("area is not null").join(needed, "path", "left_anti")
    return files.unionByName(dirs.select("area", "path", F.lit("extra").alias("status"), F.lit(False).alias("exec_differs")))


def verdict(drifted: DataFrame) -> DataFrame:
    """One row: ok, and how many paths differ."""
    return drifted.agg(F.coalesce(~F.bool_or(F.col("status") != "same"), F.lit(True)).alias("ok"), F.count_if(F.col("status") != "same").alias("n"))


def diff_head(stage: DataFrame, target: DataFrame, n: int = 20) -> DataFrame:
    """(area, path, n, want, have): the first differing lines of each area."""
    lines = lambda df, c: L.with_lines(df).select("path", "n", F.col("line").alias(c))
    both = lines(stage, "want").join(lines(target.where("is_file"), "have"), ["path", "n"], "full_outer").withColumn("area", area_of(F.col("path")))
    both = both.where("area is not null and not (want <=> have)")
    rank = F.row_number().over(Window.partitionBy("area").orderBy("path", "n"))
    return both.withColumn("at", rank).where(F.col("at") <= n).select("area", "path", "n", "want", "have")


class LeakError(ValueError):
    """The stage refers to a tree that its readers may not have."""


@contextmanager
def staged(files: DataFrame, texts: Texts = Texts()) -> Iterator[DataFrame]:
    """The stage, built by one scan of files and held while it is used. A leak is an error."""
    files = files.persist()
    stage = build_stage(files, texts).persist()
    try:
        found = leaks(stage).orderBy("path", "n").take(20)
        if found:
            raise LeakError("; ".join(f"{r['path']}:{r['n']}: {r['line']}" for r in found))
        yield stage
    finally:
        stage.unpersist()
        files.unpersist()


def check(files: DataFrame, target: DataFrame, texts: Texts = Texts()) -> DataFrame:
    """The drift of target from files' stage: paths and states, which are persisted; their texts are not."""
    with staged(files, texts) as stage:
        found = drift(stage, target).persist()
        found.count()
        return found


def sync(files: DataFrame, target: DataFrame, root: str, texts: Texts = Texts()) -> int:
    """Makes the tree at root equal to the stage, writing only what differs; how many paths changed.

    Rows come to the driver one partition at a time, as the sink is a local tree.
    """
    with staged(files, texts) as stage:
        todo = drift(stage, target).where("status <> 'same' or exec_differs").join(stage.drop("copies"), "path", "left").persist()
        n = 0
        for r in todo.toLocalIterator():
            full = os.path.join(root, r["path"])
            if r["status"] in ("extra", "stale"):
                removed(full)
            else:
                os.makedirs(os.path.dirname(full), exist_ok=True)
                if os.path.isdir(full) and not os.path.islink(full):
                    shutil.rmtree(full)
                with open(full, "wb") as f:
                    f.write(bytes(r["content"]))
                os.chmod(full, 0o755 if r["is_exec"] else 0o644)
            n += 1
        todo.unpersist()
    return n


def removed(full: str) -> None:
    """Takes a file or a directory away, which may have gone with its parent."""
    if os.path.isdir(full) and not os.path.islink(full):
        shutil.rmtree(full)
    elif os.path.lexists(full):
        os.remove(full)
