import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from versoline.llm import mixing, registry


def targets(sizes: dict, weights: dict) -> dict:
    """Water-filling by repeated resharing, as the contract words it."""
    total, capped, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        out = {s: 3.0 * sizes[s] for s in capped} | {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def order(s):
    return (s is None, (s or "").encode())


def check(rows, docs):
    sizes = defaultdict(int)
    for _, source, text in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=order))}
    want = targets(dict(sizes), weights)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["mix_target"] == pytest.approx(want[r["source"]], abs=1e-6) and r["mix_source_size"] == sizes[r["source"]]
        assert 0 <= r["mix_taken"] <= 3 * r["mix_size"] and (r["mix_position"] is None) == (r["mix_taken"] == 0)
        taken[r["source"]] += r["mix_taken"]
    for s, n in taken.items():
        assert n == math.floor(want[s] + 1e-6)


DOCS = [(1, "a", "one two three"), (2, "a", None), (3, "a", " \t\n"), (3, "b", "x"), (3, "b", "x"), (4, None, "p q r s t u v w " * 40), (5, "c", "é\xa0é k"), (6, "", "z z")]


def test_small(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, source string, text string")
    check(mixing.mix(df).collect(), DOCS)
    clash = df.withColumn("mix_size", F.lit("x")).withColumn("class", F.lit(1)).withColumn("total", F.lit(2))
    check(mixing.mix(clash).collect(), DOCS)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    docs = [tuple(r) for r in df.collect()]
    one, two = (sorted(map(tuple, mixing.op1_mixing(spark, sf_dir).collect()), key=str) for _ in range(2))
    assert one == two
    check(mixing.mix(df).collect(), docs)


def test_hot_source(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    check(mixing.mix(df).collect(), [tuple(r) for r in df.collect()])


def test_positions_follow_the_schedule(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("w w w").alias("text"))
    early, late = ((0.5, 3.0, 1.0), (0.5, 1.0, 1.0)), ((1.0, 0.0, 3.0),)
    rows = mixing.mix(df, (early, late)).collect()
    share = lambda s: [r["mix_position"] for r in rows if r["source"] == s and r["mix_taken"]]
    area = lambda t: 3 * t - 2 * t * t if t <= 0.5 else 1 + (t - 0.5)
    for source, cumulative in (("a", lambda t: area(t) / 1.5), ("b", lambda t: t * t)):
        got = sorted(share(source))
        for t in (0.25, 0.5, 0.75):
            assert sum(p <= t for p in got) / len(got) == pytest.approx(cumulative(t), abs=0.01)
    placed = [r["mix_position"] for r in rows if r["mix_position"] is not None]
    assert placed == sorted(placed)


def test_emit(spark):
    df = spark.createDataFrame([(d, t, s, len(t or "")) for d, s, t in DOCS], "doc_id long, text string, source string, n_chars long").withColumn("extra", F.lit(7)).withColumn("mix_taken", F.lit("x"))
    out = mixing.emit(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert any(t and t.startswith(r["text"]) for _, _, t in DOCS) and r["n_chars"] == len(r["text"])
    for s in {d[1] for d in DOCS}:
        assert words[s] == sum(r["mix_taken"] for r in mixing.mix(df).collect() if r["source"] == s)


def test_repeats_have_positions_of_their_own(spark):
    """A source at 3x: its passes follow one another over the whole curriculum, each in the order of the stream."""
    df = spark.range(2300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "small").otherwise("z").alias("source"), F.lit("w w").alias("text"))
    flat = (((1.0, 1.0, 1.0),), ((1.0, 1.0, 1.0),))
    order = [r["doc_id"] for r in mixing.emit(df, flat).collect()]
    at = [k for k, d in enumerate(order) if d < 300]
    small = [order[k] for k in at]
    assert len(small) == 900 and small[:300] == small[300:600] == small[600:] and len(set(small)) == 300
    for t in (0.25, 0.5, 0.75):
        assert sum(k < t * len(order) for k in at) / 900 == pytest.approx(t, abs=0.02)


def test_query_has_a_row_for_each_pass(spark, sf_dir):
    rows = mixing.op1_mixing(spark, sf_dir).collect()
    docs = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).collect()
    taken, first = defaultdict(int), {}
    for r in rows:
        taken[r["doc_id"]] += r["taken"]
        assert r["taken"] <= r["size"] and (r["position"] is None) == (r["taken"] == 0)
        if r["pass"] == 1:
            first[r["doc_id"]] = r["position"]
    want = defaultdict(int)
    for r in docs:
        want[r["doc_id"]] += r["mix_taken"]
    assert taken == want and first == {r["doc_id"]: r["mix_position"] for r in docs}
    placed = [r["position"] for r in rows if r["position"] is not None]
    assert placed == sorted(placed) and {r["pass"] for r in rows} >= {1, 2}


ODD = [(1, "a", "one two three"), (1, "a", "one two three"), (2, "a", None), (None, "a", " \t\x0b"), (3, None, "p q r s t u v " * 41), (4, "\uffff", "\x1cx\x85 y"), (5, "\U0001f600", "z"), (6, "", "é\xa0é k"), (7, "a ", "m " * 9), (2**63 - 1, "b", "\r\n")]


def test_query_has_a_row_for_each_document(spark, tmp_path):
    """The contract's exact columns, a row per document, whatever its passes; its passes are those of the listing by pass."""
    spark.createDataFrame(ODD, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["op1_mixing"](spark, str(tmp_path))
    assert found.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    rows = found.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in ODD:
        sizes[s] += size(t)
    want = targets(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=order))})
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == Counter((d, size(t), sizes[s], round(want[s], 6)) for d, s, t in ODD)
    assert sum(r["taken"] for r in rows) == sum(math.floor(t + 1e-6) for t in want.values())
    assert max(r["taken"] - 2 * r["size"] for r in rows) > 0 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    positions = [r[f"position{k}"] for r in rows for k in ("", "_2", "_3") if r[f"position{k}"] is not None]
    assert sorted(positions) == [r["position"] for r in mixing.op1_mixing(spark, str(tmp_path)).collect() if r["taken"]]
    first = [r["position"] for r in rows if r["position"] is not None]
    assert first == sorted(first)


def test_targets_are_the_nearest_doubles(spark):
    weights = {f"s{k:02d}": (5, 2, 1)[k % 3] for k in range(13)}
    for words in (91, 1009, 100003):
        sizes = {s: words + k for k, s in enumerate(weights)}
        df = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df, mixing.CURRICULUM, 3.0).collect()}
        assert got == {s: float(Fraction(sum(sizes.values()) * w, sum(weights.values()))) for s, w in weights.items()}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert {r["mix_taken"] for r in mixing.mix(nothing).collect()} == {0}
