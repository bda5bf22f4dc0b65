"""Mixing sources to target weights over a time-varying curriculum.

Each source has a schedule: its weight as a piecewise linear function of training time 0 to 1. The
schedule's integral is the source's overall weight; targets share all words by it, no source above
`repeat` times its own size. A source's documents form a stream in hash order, run through again where the
target is above its size. Cumulative demand up to time t is target x integral(0, t) / integral(0, 1);
its inverse gives the training time at which a document's first word is due in each pass of the stream, and
passes are range-sorted by that time.

Everything is DataFrame code. A source may hold any share of the rows: its stream is split into about
sqrt(rows) buckets by hash, running sums are taken within buckets and over bucket totals, and no task
gets a whole source.

Defined cases: null text and texts of white space have size 0 and take nothing; null is a source of its
own, the last; repeated rows are separate documents; an empty table gives no rows; other columns are
carried or ignored. Order within a source depends on doc_id and size alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, aside, but, stored, table, word_count

#: A phase: its length, and the weight at its start and end.
Phase = tuple[float, float, float]

#: Of the production mix, repeating over sources: integrals 5, 2 and 1.
CURRICULUM: tuple[tuple[Phase, ...], ...] = (
    ((0.5, 6.0, 5.0), (0.5, 5.0, 4.0)),
    ((1.0, 2.0, 2.0),),
    ((0.5, 0.5, 1.0), (0.5, 1.0, 1.5)),
)


def integral(schedule: Sequence[Phase]) -> float:
    return sum(n * (a + b) / 2 for n, a, b in schedule)


def inverse_demand(share: Column, schedule: Sequence[Phase]) -> Column:
    """The time at which this share (0 to 1) of a source's target has been asked for."""
    need = share * integral(schedule)
    out, start, area = F.lit(None).cast("double"), 0.0, 0.0
    for n, a, b in schedule:
        x = need - F.lit(area)
        # n * (root of (b - a) / 2 * y^2 + a * y = x / n), in a form that also holds for b = a
        root = F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * F.lit(b - a) * x / F.lit(n), F.lit(0.0)))
        here = F.lit(start) + F.coalesce(F.try_divide(2 * x, root), F.lit(0.0))
        out = F.when(out.isNull() & (x <= F.lit(n * (a + b) / 2 + 1e-12)), here).otherwise(out)
        start, area = start + n, area + n * (a + b) / 2
    return F.coalesce(out, F.lit(start))


def source_targets(sizes: DataFrame, curriculum: Sequence[Sequence[Phase]], repeat: float) -> DataFrame:
    """A row per source: its number, class, size, rows and target.

    The level L = left / free with sum(min(L * weight, cap)) = all words is found by one pass over sources in the order of
    cap / weight: the first source that isn't capped at its own level sets it. The window without
    partitions runs over one row per source.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    one = one.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weights = F.array(*(F.lit(integral(s)) for s in curriculum))
    one = one.withColumn("class", ((F.col("source_no") - 1) % len(curriculum)).cast("int")).withColumn("weight", weights[F.col("class")])
    one = one.withColumn("cap", repeat * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, from_here, every = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("free", F.sum("weight").over(from_here))
    # products of whole numbers, so that both the comparison and the target are those of the exact quotient
    level = F.min(F.when(F.col("cap") * F.col("free") >= F.col("left") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_no", "left", "free"))).over(every)
    one = one.withColumn("level", level).withColumn("share", F.col("level")["left"] * F.col("weight") / F.col("level")["free"])
    return one.select("source", "source_no", "class", "source_size", "source_rows", F.least(F.coalesce("share", "cap"), F.col("cap")).alias("target"))


def streamed(docs: DataFrame, curriculum: Sequence[Sequence[Phase]], repeat: float, whole: bool = True) -> DataFrame:
    """Every row of docs with its mix columns but the position, in no order; where not whole, of docs only doc_id and source."""
    docs = but(docs, "mix_")
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = stored(source_targets(sizes, curriculum, repeat), "sources")
    key = F.xxhash64("doc_id", "mix_size")

    def placed(df: DataFrame) -> DataFrame:
        s = sources.select(*(F.col(c).alias(f"mix_{c}") for c in sources.columns))
        joined = df.join(s, df["source"].eqNullSafe(s["mix_source"]))
        return joined.withColumn("mix_key", key).withColumn("mix_bucket", F.pmod(F.col("mix_key"), F.ceil(F.sqrt("mix_source_rows")).cast("long")))

    totals = placed(sizes.withColumnRenamed("size", "mix_size")).groupBy("mix_source_no", "mix_bucket").agg(F.sum("mix_size").alias("total"))
    run = Window.partitionBy("mix_source_no").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(totals.select("mix_source_no", "mix_bucket", F.coalesce(F.sum("total").over(run), F.lit(0)).alias("mix_start")), "starts")
    rows = placed(docs.withColumn("mix_size", word_count(F.col("text"))) if whole else sizes.withColumnRenamed("size", "mix_size"))
    rows = rows.join(starts, ["mix_source_no", "mix_bucket"])
    within = Window.partitionBy("mix_source_no", "mix_bucket").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_offset", F.col("mix_start") + F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    whole = F.floor(F.col("mix_target") + 1e-6)
    passes = F.floor(whole / F.greatest(F.col("mix_source_size"), F.lit(1)))
    rest = whole - passes * F.col("mix_source_size") - F.col("mix_offset")
    rows = rows.withColumn("mix_taken", (passes * F.col("mix_size") + F.greatest(F.least(rest, F.col("mix_size")), F.lit(0))).cast("long"))
    return rows.drop("mix_source", "mix_source_no", "mix_source_rows", "mix_key", "mix_bucket", "mix_start")


def due(offset: Column, curriculum: Sequence[Sequence[Phase]]) -> Column:
    """The time at which the stream of a row's source has come to this offset."""
    share = F.try_divide(offset, F.col("mix_target"))
    at = F.lit(None).cast("double")
    for k, schedule in enumerate(curriculum):
        at = F.when(F.col("mix_class") == k, inverse_demand(share, schedule)).otherwise(at)
    return at


def sorted_by_position(rows: DataFrame, curriculum: Sequence[Sequence[Phase]]) -> DataFrame:
    """rows with the time at which the stream has come to their offset, range-sorted by it."""
    rows = rows.withColumn("mix_position", F.when(F.col("mix_taken") > 0, due(F.col("mix_offset"), curriculum)))
    order = [F.col("mix_position").asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, curriculum: Sequence[Sequence[Phase]] = CURRICULUM, repeat: float = 3.0) -> DataFrame:
    """Every row of docs (doc_id, source, text and others) with its mix columns, range-sorted by its first position.

    Added: mix_size, mix_source_size, mix_target, mix_taken (words the mix takes, repeats counted),
    mix_offset (words of its source's stream before it), mix_class and mix_position (0 to 1, null where
    nothing is taken). The columns of docs that have such names are replaced.
    """
    return sorted_by_position(streamed(docs, curriculum, repeat), curriculum)


def by_pass(rows: DataFrame) -> DataFrame:
    """A row for each pass that takes words of a row of streamed(): mix_pass, and mix_taken and mix_offset of that pass.

    Rows that nothing is taken of stay, as a pass without words.
    """
    passes = F.coalesce(F.ceil(F.try_divide("mix_taken", "mix_size")), F.lit(0)).cast("int")
    rows = rows.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
    before = (F.col("mix_pass") - 1).cast("long")
    return rows.withColumn("mix_taken", F.least(F.col("mix_taken") - before * F.col("mix_size"), F.col("mix_size"))).withColumn("mix_offset", before * F.col("mix_source_size") + F.col("mix_offset"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{WS}])(?=[{WS}])"), F.lit(1), n.cast("int")), "")


def emit(docs: DataFrame, curriculum: Sequence[Sequence[Phase]] = CURRICULUM, repeat: float = 3.0) -> DataFrame:
    """The mixed documents themselves: the columns of docs, a row per pass that takes words of a document, sorted by its position.

    A pass that ends inside a document keeps its text up to there. Rows that the mix takes nothing of go.
    """
    docs, restored = aside(docs, ("doc_id", "source", "text", "n_chars"))
    rows = by_pass(streamed(docs, curriculum, repeat).where("mix_taken > 0"))
    part = F.col("mix_taken")
    text = F.when(part < F.col("mix_size"), first_words(F.col("text"), part)).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(part < F.col("mix_size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(sorted_by_position(rows, curriculum))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per pass of each document, in the order of training: what the pass takes, and when. The registered query is op1_documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = sorted_by_position(by_pass(streamed(docs, CURRICULUM, 3.0, whole=False)), CURRICULUM)
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_pass").alias("pass"), F.col("mix_taken").alias("taken"), F.col("mix_position").alias("position"))


def op1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query op1_mixing: a row per document, in the order of first passes: what all its passes take, and when each is due.

    With a repeat of 3, a document has three passes at most.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = sorted_by_position(streamed(docs, CURRICULUM, 3.0, whole=False), CURRICULUM)
    positions = [F.when(F.col("mix_taken") > k * F.col("mix_size"), due(k * F.col("mix_source_size") + F.col("mix_offset"), CURRICULUM)).alias(f"position_{k + 1}") for k in (1, 2)]
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_position").alias("position"), *positions)
