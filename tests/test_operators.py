"""Properties of the keyed operators, measures and streams."""

import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoline.operators import measures, sets
from versoline.streaming import events

PAIRS = st.dictionaries(st.integers(0, 9), st.integers(0, 2), max_size=8)


@settings(max_examples=15, deadline=None)
@given(PAIRS, PAIRS)
def test_reconcile_covers_all_keys(spark, one, two):
    df = lambda d: spark.createDataFrame(list(d.items()), "k int, v int")
    got = {r["k"]: r["status"] for r in sets.reconcile(df(one), df(two), "k", "v").collect()}
    want = {k: "missing" if k not in two else "extra" if k not in one else "same" if one[k] == two[k] else "changed" for k in one.keys() | two.keys()}
    assert got == want
    assert set(r["status"] for r in sets.reconcile(df(one), df(one), "k", "v").collect()) <= {"same"}


def test_gate_keeps_numbers(spark):
    rows = spark.createDataFrame([("a 1 b 2.5", "x 2.5 y 1"), ("a 1", "b 2"), ("none", "other")], "o string, c string")
    assert [r[0] for r in rows.select(measures.gated(F.col("o"), F.col("c"))).collect()] == ["x 2.5 y 1", "a 1", "other"]


def test_window_means_and_verdicts(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 6.0, 1.0],), ([],)], "s array<double>").select(measures.window_means(F.col("s")).alias("w"))
    got = [r["w"] for r in rows.collect()]
    assert got == [[1.0, 1.5, 3.0, 3.0], []]
    assert [r[0] for r in rows.select(measures.verdict(F.col("w"), 2.0)).collect()] == ["mixed", "none"]


def test_stream_equals_table(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), whole.schema)
    got = events.run_once(events.windowed_counts(stream, late="400 days"), "counted", str(tmp_path / "check"), "complete")
    want = events.windowed_counts(whole.withColumn("ts", F.col("ts").cast("timestamp")))
    count = lambda df: Counter((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert count(got) == count(want)
    assert events.sessions(whole.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == whole.count()


def test_late_events_are_dropped(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(t, "a", 1.0) for t in ts], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    first = rows("2024-01-01 00:10:00", "2024-01-05 00:00:00")
    # files are taken in the order of their times; a watermark drops rows from the batch after next on
    for batch in (first, rows("2024-01-05 00:30:00"), rows("2024-01-01 00:20:00", "2024-01-05 03:00:00")):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = events.read_events(spark, str(tmp_path / "in"), first.schema)
    got = events.run_once(events.windowed_counts(stream, "1 hour", "1 hour"), "late", str(tmp_path / "check"))
    assert {(str(r["start"]), r["n"]) for r in got.collect()} == {("2024-01-01 00:00:00", 1), ("2024-01-05 00:00:00", 2)}


def test_merged_prefers_what_is_kept(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    two = spark.createDataFrame([(2, "b"), (3, "c"), (1, "z")], "id int, t string")
    assert sorted(map(tuple, measures.merged(one, two, "id", ["t"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
