"""Window scores, verdicts, distances, gates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines_of, sentences_of
from ..operators import measures as M
from ..operators.sets import head_by
from ..registry import query
from ..sources.tables import table
from .texts import LINES_SQL

WINDOWS = f"""
WITH l AS (SELECT doc_id, lang, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, lang, {LINES_SQL} AS a FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, lang, avg(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS score FROM l)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with windows. As a generator's output, scores are worked out once, whatever reads them."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    found = M.window_means(F.transform(lines_of(F.col("text")), lambda x: F.length(x).cast("double")))
    return rows.select("doc_id", "lang", F.explode(F.filter(F.array(found), lambda s: F.size(s) > 0)).alias("scores"))


@query(WINDOWS + "SELECT doc_id, count(*) AS n_windows, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM w GROUP BY doc_id")
def window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rows.select("doc_id", F.size("scores").cast("long").alias("n_windows"), F.round(M.mean(F.col("scores")), 6).alias("mean_score"), F.round(F.array_max("scores"), 6).alias("max_score"))


@query(WINDOWS + """, v AS (SELECT doc_id, lang, CASE WHEN min(score) >= 200 THEN 'all' WHEN max(score) < 200 THEN 'none' ELSE 'mixed' END AS verdict FROM w GROUP BY doc_id, lang)
SELECT lang, verdict, count(*) AS n FROM v GROUP BY lang, verdict""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rows.groupBy("lang", M.verdict(F.col("scores"), 200.0).alias("verdict")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS score, CAST(lag(length(text)) OVER w AS BIGINT) AS before, CAST(length(text) - lag(length(text)) OVER w AS BIGINT) AS change
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("score"))
    return M.before_after(rows, "conv_id", "turn", "score")


CENTRES = """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
c AS (SELECT label, dim, avg(v) AS mean FROM x GROUP BY label, dim),
d AS (SELECT x.vec_id, x.label, sqrt(sum((v - mean) * (v - mean))) AS distance FROM x JOIN c ON x.label = c.label AND x.dim = c.dim GROUP BY x.vec_id, x.label)
"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.centre_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query(CENTRES + "SELECT label, count(*) AS n, round(avg(distance), 4) AS mean_distance, round(max(distance), 4) AS max_distance FROM d GROUP BY label")
def corpus_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances(spark, sf_dir).groupBy("label")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("distance"), 4).alias("mean_distance"), F.round(F.max("distance"), 4).alias("max_distance"))


@query(CENTRES + """, r AS (SELECT label, vec_id, round(distance, 4) AS distance, row_number() OVER (PARTITION BY label ORDER BY round(distance, 4), vec_id) AS place FROM d)
SELECT label, CAST(place AS INTEGER) AS place, vec_id, distance FROM r WHERE place <= 5""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distances(spark, sf_dir).withColumn("distance", F.round("distance", 4))
    return head_by(rows, "label", 5, "distance", "vec_id").select("label", F.col("at").alias("place"), "vec_id", "distance")


@query(r"""
WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN replace(text, '1', '7') ELSE upper(text) END AS candidate FROM documents),
n AS (SELECT *, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)*')), lambda x: NOT list_contains(regexp_extract_all(candidate, '[0-9]+(?:[.][0-9]+)*'), x)))
  + len(list_filter(list_distinct(regexp_extract_all(text, '\[[^\[\]]+\]|\([^()]*[0-9]{4}[a-z]?\)')), lambda x: NOT list_contains(regexp_extract_all(candidate, '\[[^\[\]]+\]|\([^()]*[0-9]{4}[a-z]?\)'), x))) AS lost FROM c)
SELECT doc_id, CASE WHEN lost = 0 AND candidate <> text THEN 'candidate' ELSE 'original' END AS kept FROM n
""")
def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("1"), F.lit("7"))).otherwise(F.upper("text")).alias("candidate"))
    return rows.select("doc_id", F.when(M.gated(F.col("text"), F.col("candidate")) != F.col("text"), "candidate").otherwise("original").alias("kept"))


@query("""
WITH cited AS (SELECT DISTINCT doc_id % 50 + 3 AS item_id FROM documents)
SELECT item_id, 'dangling' AS problem FROM cited WHERE item_id NOT IN (SELECT item_id FROM benchmark)
UNION ALL SELECT item_id, 'unused' FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM cited)
""")
def ref_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50 + 3).alias("item_id"))
    return M.audit(cited, table(spark, sf_dir, "benchmark"), "item_id")


@query("""
SELECT coalesce(k.item_id, f.item_id) AS item_id, coalesce(k.text, f.text) AS text FROM (SELECT CASE WHEN item_id % 4 = 0 THEN -item_id ELSE item_id END AS item_id, CASE WHEN item_id % 3 > 0 THEN md5(text) END AS text FROM benchmark) k
FULL OUTER JOIN (SELECT CASE WHEN item_id % 5 = 0 THEN -1000000 - item_id ELSE item_id END AS item_id, md5(text || '+') AS text FROM benchmark) f ON k.item_id = f.item_id
""")
def ref_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    key = lambda m, other: F.when(F.col("item_id") % m == 0, other).otherwise(F.col("item_id")).alias("item_id")
    kept = items.select(key(4, -F.col("item_id")), F.when(F.col("item_id") % 3 > 0, F.md5(F.col("text").cast("binary"))).alias("text"))
    found = items.select(key(5, -1000000 - F.col("item_id")), F.md5(F.concat("text", F.lit("+")).cast("binary")).alias("text"))
    return M.merged(kept, found, "item_id", ["text"])


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang")
def consented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return rows.groupBy("lang").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT item_id, md5(text) AS digest, length(text) AS size FROM benchmark),
c AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN digest || '0' ELSE digest END AS digest, CASE WHEN item_id % 3 = 0 THEN size + 1 ELSE size END AS size FROM s)
SELECT c.item_id, 'digest' AS field FROM c JOIN s ON c.item_id = s.item_id WHERE c.digest <> s.digest
UNION ALL SELECT c.item_id, 'size' FROM c JOIN s ON c.item_id = s.item_id WHERE c.size <> s.size
""")
def ref_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that state a field otherwise than their source."""
    sources = table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("size"))
    by = F.col("item_id") % 4
    digest = F.when(by == 1, F.concat("digest", F.lit("0"))).when(by != 0, F.col("digest"))
    cited = sources.select("item_id", digest.alias("digest"), F.when(F.col("item_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return M.mismatches(cited, sources, "item_id", ["digest", "size"])


@query(r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(a, lambda x: length(x))), 0) AS BIGINT) AS longest FROM s
""")
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.array(sentences_of(F.col("text")))).alias("a"))
    return rows.select("doc_id", F.size("a").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("a", F.length)), F.lit(0)).cast("long").alias("longest"))
