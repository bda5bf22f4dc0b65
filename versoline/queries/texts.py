"""Line extractors, rewrites and scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import byte_prefix, first_sentence, lines_of, or_default, rewrite
from ..plans.relations import REWRITES
from ..registry import query
from ..sources.tables import table
from .fixtures import FILES, relation, values

LINES_SQL = r"CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\n\z', ''), chr(10)) END"


@query(f"""
WITH l AS (SELECT doc_id, {LINES_SQL} AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(len(list_filter(a, lambda x: regexp_full_match(x, '\\s*'))) AS BIGINT) AS n_blank,
  CAST(coalesce(list_max(list_transform(a, lambda x: length(x))), 0) AS BIGINT) AS longest FROM l
""")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", lines_of(F.col("text")).alias("a"))
    return rows.select(
        "doc_id",
        F.size("a").cast("long").alias("n_lines"),
        F.size(F.filter("a", lambda x: x.rlike(L.BLANK))).cast("long").alias("n_blank"),
        F.coalesce(F.array_max(F.transform("a", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"),
    )


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'), ' \z', ''), '(?s)\. .*', '.') AS sentence FROM documents
""")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_sentence(F.replace("text", F.lit("\n"), F.lit(" "))).alias("sentence"))


FOLD = [("the ", "THE "), ("THE th", "[th]"), (" de la", " <de la>"), ("<de", "(de"), ("er ", "er_")]


def fold_sql(column: str, rules) -> str:
    for old, new in rules:
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query(f"SELECT doc_id, md5({fold_sql('text', FOLD)}) AS digest FROM documents")
def rewrite_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rewrite(F.col("text"), FOLD).cast("binary")).alias("digest"))


@query("SELECT doc_id, left(hex(encode(text)), 300) AS prefix FROM documents")
def byte_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(byte_prefix(F.col("text"))).alias("prefix"))


META_SQL = (
    "WITH "
    + values(FILES, "files", "stem", "text")
    + rf""",
l AS (SELECT stem, {LINES_SQL} AS a FROM files),
n AS (SELECT stem, a, CAST(len(a) AS BIGINT) AS size, CASE WHEN len(a) > 0 AND a[1] = '---' THEN coalesce(nullif(list_position(a[2:], '---'), 0) + 1, len(a) + 1) ELSE 0 END AS fin FROM l),
d AS (SELECT *, list_filter(a[1:fin], lambda x: starts_with(x, 'description:')) AS keyed,
  list_filter(a[fin + 1:], lambda x: NOT starts_with(x, '<') AND NOT starts_with(x, '#') AND NOT regexp_full_match(x, '\s*')) AS prose,
  CASE WHEN len(a) > 0 AND regexp_matches(a[1], '^<(\\!|!)--') THEN 1 ELSE 0 END AS skipped,
  list_filter(a, lambda x: NOT starts_with(x, '<!--') AND NOT starts_with(x, '#')) AS kept,
  list_filter(a, lambda x: starts_with(x, '# ')) AS heads FROM n),
e AS (SELECT *, coalesce(list_position(list_transform(a[skipped + 1:], lambda x: NOT regexp_full_match(x, '\s*')), true), 0) AS body_at,
  coalesce(list_position(list_transform(kept, lambda x: NOT regexp_full_match(x, '\s*')), true), 0) AS para_at FROM d),
f AS (SELECT *, kept[para_at:] AS rest FROM e),
g AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: regexp_full_match(x, '\s*')), true), 0) AS stop FROM f)
SELECT stem,
  left(hex(encode(replace(CASE WHEN len(keyed) > 0 THEN regexp_replace(keyed[1], '^description:[ ]*', '') ELSE coalesce(prose[1], '') END, '"', ''))), 300) AS description,
  CASE WHEN fin > 0 THEN array_to_string(a[fin + 1:], chr(10)) WHEN body_at = 0 THEN '' ELSE array_to_string(a[skipped + body_at:], chr(10)) END AS body,
  coalesce(nullif(coalesce(regexp_replace(heads[1], '^# +', ''), ''), ''), stem) AS title,
  CASE WHEN para_at = 0 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(array_to_string(CASE WHEN stop = 0 THEN rest ELSE rest[1:stop - 1] END, ' ') || ' ', ' +', ' ', 'g'), ' \z', ''), '(?s)\. .*', '.') END AS summary
FROM g
"""
)


@query(META_SQL)
def extract_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, FILES, "stem string, text string").select("stem", lines_of(F.col("text")).alias("a"))
    a = F.col("a")
    return rows.select("stem", F.hex(L.description(a)).alias("description"), L.command_body(a).alias("body"), L.title(a, F.col("stem")).alias("title"), L.summary(a).alias("summary"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), ''), url) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.trim(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", or_default(found, F.col("url")).alias("title"))


@query("WITH " + values(FILES, "files", "stem", "text") + rf""",
l AS (SELECT stem, list_filter({LINES_SQL}, lambda x: NOT contains(x, '<!-- Copyright') AND NOT contains(x, '<\!-- Copyright')) AS a FROM files)
SELECT stem, {fold_sql("array_to_string(a, chr(10))", REWRITES["inline_rules"])} AS text FROM l
""")
def inline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, FILES, "stem string, text string").select("stem", L.inline_rules(lines_of(F.col("text"))).alias("text"))


@query("""
SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, """ + LINES_SQL + """ AS a FROM documents WHERE text IS NOT NULL))
WHERE contains(line, 'license')
""")
def leak_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.with_lines(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "text")
    return rows.where(F.contains("line", F.lit("license"))).select("doc_id", "n", "line")


@query(f"""
SELECT doc_id, md5(array_to_string(list_transform(a[greatest(len(a) - 14, 1):], lambda x: '          ' || x), chr(10))) AS digest
FROM (SELECT doc_id, {LINES_SQL} AS a FROM documents WHERE text IS NOT NULL)
""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import indented, tail

    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(F.array_join(indented(tail(lines_of(F.col("text")))), "\n").cast("binary")).alias("digest"))
