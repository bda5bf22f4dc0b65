"""Measures on documents. The definitions are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citations_in, numbers_in


def window_means(scores: Column, width: int = 3) -> Column:
    """Means over each element and those before it, up to width; the array stays in its row, so nothing shuffles.

    The array of one array binds scores to a variable, which is evaluated once; named within a lambda, it would be for each element.
    """
    of = lambda s: F.transform(s, lambda _, i: mean(F.slice(s, F.greatest(i + 2 - width, F.lit(1)), F.least(i + 1, F.lit(width)))))
    return F.transform(F.array(scores), of)[0]


def mean(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(items))


def verdict(scores: Column, threshold: float) -> Column:
    """all, none or mixed: how many windows reach the threshold; none without windows."""
    return F.when(F.size(scores) == 0, "none").when(F.array_min(scores) >= threshold, "all").when(F.array_max(scores) < threshold, "none").otherwise("mixed")


def before_after(scores: DataFrame, key: str, step: str, score: str) -> DataFrame:
    """Adds before and change: the score at the last step, and the difference."""
    before = F.lag(score).over(Window.partitionBy(key).orderBy(step))
    return scores.withColumn("before", before).withColumn("change", F.col(score) - F.col("before"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean): a row for each dimension, from 0."""
    return vectors.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centre_distances(vectors: DataFrame, group: str, id_column: str, vector: str) -> DataFrame:
    """(group, id, distance): Euclidean, to the centroid of the vector's own group."""
    middle = centroids(vectors, group, vector).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("centre"))
    apart = F.zip_with(F.col(vector), F.col("centre"), lambda x, c: (x.cast("double") - c["mean"]) * (x.cast("double") - c["mean"]))
    return vectors.join(middle, group).select(group, id_column, F.sqrt(F.aggregate(apart, F.lit(0.0), lambda a, x: a + x)).alias("distance"))


def gated(original: Column, candidate: Column) -> Column:
    """The candidate where it keeps all numbers and citations of the original, else the original."""
    lost = lambda parts: F.size(F.array_except(parts(original), parts(candidate))) == 0
    return F.when(lost(numbers_in) & lost(citations_in), candidate).otherwise(original)


def audit(cited: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, problem): dangling if it is cited without a source, unused if it is never cited."""
    dangling = cited.select(key).distinct().join(sources, key, "left_anti").select(key, F.lit("dangling").alias("problem"))
    unused = sources.select(key).join(cited, key, "left_anti").select(key, F.lit("unused").alias("problem"))
    return dangling.unionByName(unused)


def mismatches(cited: DataFrame, sources: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field): fields that a reference states otherwise than its source; what it doesn't state is no mismatch."""
    one, two = cited.select(key, *(F.col(f).alias(f"cited_{f}") for f in fields)), sources.select(key, *fields)
    apart = [F.when(F.col(f"cited_{f}").isNotNull() & ~F.col(f"cited_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]
    return one.join(two, key).select(key, F.explode(F.array_compact(F.array(*apart))).alias("field"))


def merged(kept: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A bibliography brought up to date: entries of either side, fields of what is kept first."""
    one, two = kept.alias("one"), found.alias("two")
    both = one.join(two, F.col(f"one.{key}") == F.col(f"two.{key}"), "full_outer")
    return both.select(F.coalesce(f"one.{key}", f"two.{key}").alias(key), *(F.coalesce(f"one.{f}", f"two.{f}").alias(f) for f in fields))
