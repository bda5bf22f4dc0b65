"""Fan-out, reconciliation, listings and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_script, lines_of, name_list
from ..operators.sets import head_by, holds_all, last_by, reconcile, stale
from ..plans import mirrors, runner
from ..plans.relations import REWRITES, SURFACES
from ..registry import query
from ..sources import read_files
from ..sources.tables import table
from .fixtures import COMMANDS, DONE, FILES, LEAKY, MANAGED, PATHS, PRESENT, STAGED, TREE, relation, values
from .texts import LINES_SQL


@query(f"""
SELECT surface, doc_id, surface || '/documents/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.sh' ELSE '.md' END AS path, doc_id % 3 = 0 AS is_exec
FROM documents CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in SURFACES)}) AS s(surface)
""")
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mirrors.with_surface(table(spark, sf_dir, "documents").select("doc_id", "source"), SURFACES)
    path = F.concat(F.col("surface"), F.lit("/documents/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".sh").otherwise(".md"))
    return rows.select("surface", "doc_id", path.alias("path"), is_script(path).alias("is_exec"))


@query("SELECT lang, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, count(*) AS n FROM documents GROUP BY lang")
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rows.groupBy("lang").agg(name_list(F.collect_list("source")).alias("sources"), F.sum("n").alias("n"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id")
def doc_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.count("*").alias("n"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("turns", lambda x: x["text"]), "\n").cast("binary")).alias("digest"), "n")


DRIFT = """
WITH want AS (SELECT doc_id, md5(text) AS digest FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id ELSE doc_id END AS doc_id, text FROM documents)),
have AS (SELECT CASE WHEN doc_id % 7 = 0 THEN -1000000000 - doc_id ELSE doc_id END AS doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS digest FROM documents),
s AS (SELECT coalesce(w.doc_id, h.doc_id) AS doc_id, CASE WHEN w.doc_id IS NULL THEN 'extra' WHEN h.doc_id IS NULL THEN 'missing' WHEN w.digest = h.digest THEN 'same' ELSE 'changed' END AS status
FROM want w FULL OUTER JOIN have h ON w.doc_id = h.doc_id)
"""


def two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each document in one derived version against another. Other keys for some rows of either make them missing and extra."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda t: F.md5(t.cast("binary")).alias("digest")
    key = lambda m, other: F.when(F.col("doc_id") % m == 0, other).otherwise(F.col("doc_id")).alias("doc_id")
    want = docs.select(key(11, -F.col("doc_id")), digest(F.col("text")))
    have = docs.select(key(7, -1000000000 - F.col("doc_id")), digest(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return reconcile(want, have, "doc_id", "digest")


@query(DRIFT + "SELECT doc_id, status FROM s")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_versions(spark, sf_dir)


@query(DRIFT + "SELECT NOT bool_or(status <> 'same') AS ok, count(*) FILTER (WHERE status <> 'same') AS n FROM s")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrors.verdict(two_versions(spark, sf_dir))


@query("WITH " + values(MANAGED, "managed", "path") + ", " + values(STAGED, "stage", "path", "content") + ", " + values(PRESENT, "present", "path", "content") + """
SELECT m.path, CASE WHEN s.path IS NULL AND p.path IS NULL THEN 'absent' WHEN s.path IS NULL THEN 'stale' WHEN p.path IS NULL THEN 'missing' WHEN s.content = p.content THEN 'same' ELSE 'changed' END AS status
FROM managed m LEFT JOIN stage s ON m.path = s.path LEFT JOIN present p ON m.path = p.path
""")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda rows: relation(spark, rows, "path string, content string")
    return stale(relation(spark, MANAGED, "path string"), one(STAGED), one(PRESENT))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("WITH " + values(COMMANDS, "commands", "name", "is_symlink") + """
SELECT (SELECT count(DISTINCT name) FROM commands WHERE name IN ('pop', 'work') AND NOT is_symlink) = 2 AS ok
""")
def workflow_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holds_all(relation(spark, COMMANDS, "name string, is_symlink boolean").where("not is_symlink"), "name", ["pop", "work"])


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_by(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "role", "text")
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("WITH " + values(PATHS, "paths", "root", "path", "is_file") + r"""
SELECT root, path FROM paths WHERE is_file AND regexp_matches(path, '(^|/)test_[^/]*\.py$') AND NOT contains('/' || path, '/__pycache__/') AND contains(path, 't')
""")
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = relation(spark, PATHS, "root string, path string, is_file boolean").withColumn("is_symlink", F.lit(False))
    return runner.discover(files, "t")


@query(f"""
WITH l AS (SELECT doc_id, source, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, source, {LINES_SQL} AS a FROM documents WHERE text IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, n) AS place FROM l)
SELECT source, doc_id, CAST(n AS INTEGER) AS n, CAST(place AS INTEGER) AS place, md5(line) AS digest FROM r WHERE place <= 20
""")
def diff_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("source", "doc_id", F.posexplode(lines_of(F.col("text"))).alias("n", "line")).withColumn("n", F.col("n") + 1)
    return head_by(lines, "source", 20, "doc_id", "n").select("source", "doc_id", "n", F.col("at").alias("place"), F.md5(F.col("line").cast("binary")).alias("digest"))


@query("SELECT toxic = 0 AS ok, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) FILTER (WHERE quality = 0) AS n_poor FROM labels GROUP BY 1")
def label_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").groupBy((F.col("toxic") == 0).alias("ok"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_if(F.col("quality") == 0).alias("n_poor"))


def tree(spark: SparkSession) -> DataFrame:
    """The inline tree, all of it plain files, as the files source gives it."""
    return relation(spark, TREE, "path string, content string").select("path", F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"), F.lit(True).alias("is_file"), F.lit(False).alias("is_exec"), F.col("content").cast("binary").alias("content"))


SURFACE_ROWS = ", ".join(f"('{s}')" for s in SURFACES)


@query("WITH " + values(TREE, "tree", "path", "content") + f""", s AS (SELECT * FROM tree CROSS JOIN (VALUES {SURFACE_ROWS}) AS v(surface))
SELECT surface || '/' || path AS path, regexp_matches(path, '^scripts/.*[.](sh|py)$') AS is_exec, md5(content) AS digest FROM s WHERE path IN ('pixi.toml', 'pixi.lock') OR regexp_matches(path, '^scripts/[^./][^/]*$')
""")
def shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrors.shared(tree(spark)).select("path", "is_exec", F.md5("content").alias("digest"))


def folded(surface: str) -> str:
    """The rewrites of a surface, one inside the other."""
    out = "content"
    for old, new in REWRITES[surface.removeprefix(".")]:
        out = f"replace({out}, '{old}', '{new}')"
    return out


@query("WITH " + values(TREE, "tree", "path", "content") + ", s AS (SELECT * FROM tree WHERE starts_with(path, 'skills/') AND NOT contains(path, '/__pycache__/')) " + " UNION ALL ".join(f"SELECT '{s}/' || path AS path, md5({folded(s)}) AS digest FROM s" for s in SURFACES))
def skill_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrors.skill_trees(tree(spark)).select("path", F.md5("content").alias("digest"))


@query("WITH " + values(LEAKY, "stage", "path", "content") + r""", l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM stage)
SELECT path, CAST(n AS INTEGER) AS n, line FROM l WHERE starts_with(path, '.github/') AND regexp_matches(line, '\.(claude|cursor|opencode)/') OR starts_with(path, '.agents/') AND regexp_matches(line, '\.claude/')
""")
def stage_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mirrors.leaks(relation(spark, LEAKY, "path string, content string"))
    return found.select("path", F.col("n").cast("int").alias("n"), "line")


@query("WITH " + values(DONE, "done", "path", "ok") + """
SELECT count(*) FILTER (WHERE ok = 'true') AS passed, count(*) FILTER (WHERE ok = 'false') AS failed, string_agg(path, ',' ORDER BY path) FILTER (WHERE ok = 'false') AS failing FROM done
""")
def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = relation(spark, DONE, "path string, ok string").withColumn("ok", F.col("ok").cast("boolean"))
    return runner.results(done).withColumn("failing", F.array_join("failing", ","))


@query("WITH " + values(PATHS, "paths", "root", "path", "is_file") + r""", u AS (SELECT * FROM paths WHERE root = 'skills' UNION ALL SELECT * FROM paths WHERE root = 'scripts')
SELECT root, path FROM u WHERE is_file AND regexp_matches(path, '(^|/)test_[^/]*\.py$') AND NOT contains('/' || path, '/__pycache__/')
""")
def discover_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of two roots, each scanned for itself."""
    files = relation(spark, PATHS, "root string, path string, is_file boolean").withColumn("is_symlink", F.lit(False))
    return runner.discover(files.where("root = 'skills'").unionByName(files.where("root = 'scripts'")))


@query()
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the tables' own tree, by the files source."""
    return read_files(spark, sf_dir).select("path", "is_dir", "is_symlink", "is_exec", F.sha2("content", 256).alias("digest"))


CANONICAL = [*((f"commands/{stem}.md", text) for stem, text in FILES), ("skills/a/SKILL.md", FILES[0][1]), ("rules/r.md", FILES[1][1]), ("instructions.md", FILES[-1][1]), ("scripts/x.sh", "echo"), ("pixi.toml", "[x]")]


def canonical_stage(spark: SparkSession) -> DataFrame:
    files = relation(spark, [(p, False, False, True, False, t) for p, t in CANONICAL] + [("skills/a", True, False, False, False, None)], "path string, is_dir boolean, is_symlink boolean, is_file boolean, is_exec boolean, content string")
    return mirrors.build_stage(files.withColumn("content", F.col("content").cast("binary")))


@query()
def mirror_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mirrors of a small canonical tree hold."""
    return canonical_stage(spark).select("path", "is_exec", "copies", F.sha2("content", 256).alias("digest"))


@query("WITH " + values([p for p, _ in CANONICAL], "tree", "path") + f""", surfaces(surface) AS (VALUES {SURFACE_ROWS}),
c AS (SELECT regexp_extract(path, '^commands/(.*)[.]md$', 1) AS name FROM tree WHERE starts_with(path, 'commands/')),
k AS (SELECT regexp_extract(path, '^skills/(.*)/SKILL[.]md$', 1) AS name FROM tree WHERE starts_with(path, 'skills/')),
p AS (SELECT surface || '/commands/' || name || '.md' AS path FROM c CROSS JOIN surfaces WHERE surface IN ('{SURFACES[0]}', '{SURFACES[1]}')
UNION ALL SELECT '.github/prompts/' || name || '.prompt.md' FROM c
UNION ALL SELECT '.github/prompts/' || name || '.prompt.md' FROM k
UNION ALL SELECT '.agents/skills/' || name || '/SKILL.md' FROM c
UNION ALL SELECT surface || '/' || path FROM tree CROSS JOIN surfaces WHERE starts_with(path, 'skills/') OR starts_with(path, 'scripts/') OR path = 'pixi.toml'
UNION ALL VALUES ('.github/copilot-instructions.md'), ('AGENTS.md'))
SELECT path, contains(path, '/scripts/') AS is_exec, count(*) AS copies FROM p GROUP BY path
""")
def mirror_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the producers of a stage write, and how many write there."""
    return canonical_stage(spark).select("path", "is_exec", "copies")
