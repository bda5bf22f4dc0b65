"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; it puts a unit vector on the
signed axis nearest to its rotation. A table has two of them, and a pair of axes is a bucket. Each row goes to one
bucket of every table; a query probes, in every table, the pairs whose axes are nearest to it in sum. How many is the
same for every table of rows: whether a row is a candidate of a query depends on these two vectors alone. Candidates are
reranked exactly, by Euclidean distance between the original vectors in double precision.

What is shuffled and grouped are groups of buckets: those with one first axis, or, as rows get more, with one first axis
and one part of the second ones. A query goes once to each group that it probes, with the bits of the second axes it asks for.
A group may hold any share of the rows, so its rows and its queries are dealt to blocks of bounded size by a
hash, and each pair of blocks is one task's unit; it returns a query's k nearest of its own, and those are merged.
A query for which the probes find fewer than k rows is searched again over every bucket of one table.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
different lengths never meet; rows that share an id are different rows but for the query's own, which never is
its neighbour; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, table, tidy

TABLES, SEED = 8, 20240229
#: Buckets that a query probes in a table, whatever the rows.
PROBES = 740
#: For probes_among(): so many probes among so many rows, and the power of the rows by which they get fewer.
FIRST_PROBES, PROBED_ROWS, FEWER = 600, 2000, 0.15
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of this number, of rows padded with zeros to a power of two."""
    n = x.shape[1]
    size = 1 << max(0, (n - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, :n] = x
    rng = np.random.default_rng([SEED, number, size])
    for _ in range(3):
        y *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            y = y.reshape(len(x), -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
            step *= 2
        y /= np.sqrt(size)
    return y


def signed(y: np.ndarray) -> np.ndarray:
    """Nearness to each signed axis: axis i is column 2i, its opposite 2i + 1."""
    return np.stack([y, -y], 2).reshape(len(y), -1)


def unit(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def probes_among(rows: int) -> int:
    """For callers of search() that know their rows: the more there are, the nearer are neighbours, and fewer probes find them. No query uses it."""
    return max(16, round(FIRST_PROBES * (PROBED_ROWS / max(rows, 1)) ** FEWER))


def parts_among(rows: int, axes: int) -> int:
    """Parts that the second axes are grouped in: a power of two, so that a group has about BLOCK_ROWS rows as long as there are axes."""
    return 1 << min((axes - 1).bit_length(), max(0, (rows // (axes * BLOCK_ROWS)).bit_length()))


def sound(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, dims, vector) of the vectors that take part; floats stay floats, all else are doubles."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = F.col(vector) if kind == "array<float>" else v
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.size(v).alias("dims"), held.alias("vector")).where(F.col("vector").isNotNull() & fine)


def by_dims(batch: pa.RecordBatch, rows: int = 1024):
    """(part of the batch, its vectors as a matrix of doubles), of one length each."""
    dims = batch.column("dims").to_numpy()
    for n in np.unique(dims):
        part = batch.take(pa.array(np.flatnonzero(dims == n)))
        for a in range(0, len(part), rows):
            some = part.slice(a, rows)
            yield some, some.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), n)


KEY = ["dims", "tab", "bucket"]
KEYS = "dims int, tab int, bucket long"


def placed(rows: DataFrame, tables: int, total: int) -> DataFrame:
    """A row per row and table: its group of buckets, and its second axis."""

    def run(batches):
        for batch in batches:
            for some, x in by_dims(batch):
                x = unit(x)
                for t in range(tables):
                    first, second = (signed(rotated(x, 2 * t + k)) for k in (0, 1))
                    parts, b = parts_among(total, first.shape[1]), second.argmax(1)
                    yield pa.RecordBatch.from_arrays([some.column("id"), some.column("vector"), some.column("dims"), pa.array(np.full(len(some), t, np.int32)), pa.array(first.argmax(1) * parts + b % parts), pa.array(b.astype(np.int32))], ["id", "vector", "dims", "tab", "bucket", "second"])

    return rows.mapInArrow(tidy(run), f"id long, vector {rows.schema['vector'].dataType.simpleString()}, {KEYS}, second int")


def top_pairs(first: np.ndarray, second: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first axis, second axis) of each row's pairs with the greatest sums.

    A pair of the i-th and the j-th nearest axis has i * j pairs that are as near, so only some of few ranks can be among the first.
    """
    axes = first.shape[1]
    m = min(probes, axes * axes)
    i = np.repeat(np.arange(axes), np.minimum(axes, m // np.arange(1, axes + 1)))
    j = np.arange(len(i)) - np.searchsorted(i, i)
    a, b = np.argsort(-first, 1, kind="stable"), np.argsort(-second, 1, kind="stable")
    sums = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
    top = np.argpartition(-sums, m - 1, axis=1)[:, :m]
    return np.repeat(np.arange(len(first)), m), np.take_along_axis(a, i[top], 1).ravel(), np.take_along_axis(b, j[top], 1).ravel()


def asking(rows: DataFrame, tables: int, probes: int, total: int) -> DataFrame:
    """A row per query, table and group of buckets that it probes: bits say which second axes."""

    def run(batches):
        for batch in batches:
            for some, x in by_dims(batch, 16):
                x = unit(x)
                for t in range(tables):
                    first, second = (signed(rotated(x, 2 * t + k)) for k in (0, 1))
                    axes = first.shape[1]
                    parts = parts_among(total, axes)
                    who, a, b = top_pairs(first, second, probes)
                    groups, at = np.unique(np.stack([who, a * parts + b % parts]), axis=1, return_inverse=True)
                    asked = np.zeros((groups.shape[1], axes), bool)
                    asked[at.ravel(), b] = True
                    bits = pa.array([row.tobytes() for row in np.packbits(asked, axis=1)], pa.binary())
                    order = pa.array(groups[0])
                    yield pa.RecordBatch.from_arrays([some.column("id").take(order), some.column("vector").take(order), some.column("dims").take(order), pa.array(np.full(len(order), t, np.int32)), pa.array(groups[1]), bits], ["id", "vector", "dims", "tab", "bucket", "bits"])

    return rows.mapInArrow(tidy(run), f"id long, vector {rows.schema['vector'].dataType.simpleString()}, {KEYS}, bits binary")


def nearest(rows: np.ndarray, ids: np.ndarray, second: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, k: int):
    """(query, id, distance) of the k nearest of the rows that each query asks for; components are subtracted, so that near ones lose no digits."""
    for q, own, wanted in zip(queries, query_ids, asked, strict=True):
        at = np.flatnonzero(wanted[second] & (ids != own))
        d = np.sqrt(((rows[at] - q) ** 2).sum(1))
        keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        keep = keep[np.lexsort((ids[at[keep]], d[keep]))][:k]
        yield from zip([int(own)] * len(keep), ids[at[keep]].tolist(), d[keep].tolist(), strict=True)


def found(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each pair of blocks that share a group of buckets."""
    sizes = stored(index.groupBy(KEY).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks")).join(asked.groupBy(KEY).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")), KEY), "blocks")
    spread = lambda own: F.pmod(F.xxhash64("id", "vector", F.lit(own)), F.col(own).cast("long")).cast("int")
    rows = index.join(sizes, KEY).withColumn("row_block", spread("row_blocks")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    queries = asked.join(sizes, KEY).withColumn("query_block", spread("query_blocks")).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    pair = [*KEY, "row_block", "query_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            dims = left.column("dims")[0].as_py()
            x, q = (part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) for part in (left, right))
            asked = np.unpackbits(np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(len(q), -1), axis=1).astype(bool)
            out = list(nearest(x, left.column("id").to_numpy(), left.column("second").to_numpy(), q, right.column("id").to_numpy(), asked, k))
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    one, two = rows.select(*pair, "id", "vector", "second").groupBy(*pair), queries.select(*pair, "id", "vector", "bits").groupBy(*pair)
    return one.cogroup(two).applyInArrow(search, "query_id long, vec_id long, score double")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The first k distinct rows of each query, ranked from 1. A row that shares its id with others counts once, at its nearest."""
    one = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, but the row of its own id."""
    rows, asked = sound(vectors, id_column, vector), sound(queries, id_column, vector)
    total = rows.count()  # for the size of groups, which no result depends on
    first = stored(best(found(placed(rows, tables, total), asking(asked, tables, probes, total), k), k), "nearest")
    enough = first.groupBy("query_id").agg(F.max("rank").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    few = cut(asked.join(enough, "id", "left_anti"))
    if few.isEmpty():
        return first.select("query_id", "rank", "vec_id", "score")
    again = best(found(placed(rows, 1, 0), asking(few, 1, 1 << 62, 0), k), k)  # groups of whole first axes, which are the fewest
    kept = first.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.unionByName(again).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
