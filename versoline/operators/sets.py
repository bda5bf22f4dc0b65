"""Joins, set operations and ordered aggregates on keyed relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(wanted: DataFrame, present: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of all keys of either side: same, changed, missing or extra."""
    one, two = wanted.select(key, F.col(value).alias("want"), F.lit(1).alias("in_want")), present.select(key, F.col(value).alias("have"), F.lit(1).alias("in_have"))
    status = F.when(F.col("in_have").isNull(), "missing").when(F.col("in_want").isNull(), "extra").when(F.col("want").eqNullSafe(F.col("have")), "same").otherwise("changed")
    return one.join(two, key, "full_outer").select(key, status.alias("status"))


def stale(managed: DataFrame, stage: DataFrame, present: DataFrame, key: str = "path", value: str = "content") -> DataFrame:
    """(key, status) of managed keys: same, changed, missing, stale (present without a source) or absent."""
    out = managed.select(key).join(stage.select(key, F.col(value).alias("want")), key, "left").join(present.select(key, F.col(value).alias("have")), key, "left")
    status = F.when(F.col("want").isNull() & F.col("have").isNull(), "absent").when(F.col("want").isNull(), "stale").when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "same").otherwise("changed")
    return out.select(key, status.alias("status"))


def last_by(rows: DataFrame, key: str | list[str], order: Column | str, *columns: str) -> DataFrame:
    """For each key the columns of the row that comes last; one pre-aggregated shuffle, no sort."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("last")).select(*keys, "last.*")


def head_by(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each key, numbered at; Spark limits each group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("at", rank).where(F.col("at") <= n)


def holds_all(rows: DataFrame, column: str, needed: list[str]) -> DataFrame:
    """One row: whether every needed value occurs."""
    return rows.agg((F.count_distinct(F.when(F.col(column).isin(needed), F.col(column))) == len(needed)).alias("ok"))
