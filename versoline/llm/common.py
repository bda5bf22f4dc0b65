"""What the operators of this subpackage share: tables, shared scratch space, words."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java character class body.
WS = r"\x20\x09-\x0D"

U = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U)

#: Bytes of text that a Python worker takes apart at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a temporary folder serves, but
    only for a local master: on a cluster no executor would see it, so that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="versoline-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables in the shared folder that can be dropped together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        """df, written once as a table and read back, which cuts its lineage."""
        path = f"{shared_dir(self.spark)}/versoline-{self.spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
        self.paths.append(path)
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables. Shuffle files go when the driver collects the plans that made them, so that is asked for."""
        sc = self.spark.sparkContext
        for p in self.paths:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []
        give_back()
        sc._jvm.System.gc()


#: What stored() has written for results that are read later, by application.
_kept: dict[str, Scratch] = {}


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once in the shared folder and read back; the table stays until release()."""
    spark = df.sparkSession
    return _kept.setdefault(spark.sparkContext.applicationId, Scratch(spark)).stored(df, what)


def release(spark: SparkSession) -> None:
    """Drops all tables that stored() has written; results that aren't written out yet can't be read afterwards."""
    if (scratch := _kept.get(spark.sparkContext.applicationId)) is not None:
        scratch.drop()


def give_back() -> None:
    """Returns free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder; Spark removes the files once df is gone."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def aside(docs: DataFrame, needed) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the needed ones renamed, so that none clashes, and a function that restores the columns of docs in a result.

    Names go by position and are never read as expressions, so they may hold dots, and may differ by case from any other.
    """
    names = docs.columns
    safe = [c if c in needed else f"aside_{k}" for k, c in enumerate(names)]
    return docs.toDF(*safe), lambda out: out.select(*safe).toDF(*names)


def but(docs: DataFrame, prefix: str) -> DataFrame:
    """docs without the columns whose names begin so, in any case."""
    return docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if not c.lower().startswith(prefix)))


def word_count(text: Column) -> Column:
    """Number of words, that is of maximal runs without white space; 0 for null."""
    white = [chr(c) for c in (32, *range(9, 14))]
    ends = F.substring(text, 1, 1).isin(white).cast("int") + F.substring(text, -1, 1).isin(white).cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, f"[{WS}]+")) - ends).cast("long")


def held(text: pa.Array) -> pa.Array:
    """Strings with null as empty."""
    return pc.fill_null(text.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 13):
    """(start, stop) of runs of rows of about so many bytes and so many rows at most, one row at least."""
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        floor = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, floor + most, side="right")))
        stop = min(stop, start + rows, len(sizes))
        yield start, stop
        start = stop


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, dictionary): row r has the words dictionary[codes[offsets[r]:offsets[r + 1]]].

    White space is that of WS; words are never empty. text has no nulls.
    """
    split = pc.ascii_split_whitespace(text)
    offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets, flat = kept[offsets], flat.filter(full)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (large strings, none empty or null): a sum of bytes by a number for each place, mixed."""
    if not len(words):
        return np.zeros(0, U)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = mixed(np.arange(1, sizes.max() + 1, dtype=U) * ODD[0]) | U(1)
    values = (data.astype(U) + U(1)) * place[np.arange(len(data)) - np.repeat(starts, sizes)]
    return mixed(np.add.reduceat(values, starts) + sizes.astype(U) * ODD[1])


def tidy(run):
    """A function for mapInArrow that gives its memory back when its task is over, as workers live on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def in_slices(df: DataFrame, by: str, work, schema, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with work(RecordBatch) -> RecordBatch or Table over runs of rows of about so many bytes of a column.

    A worker holds one incoming batch (Spark bounds its bytes) and what one run needs.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(by)
            for start, stop in slices(batch.column(at), most):
                out = work(batch.slice(start, stop - start))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(tidy(run), schema)
