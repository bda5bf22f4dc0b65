import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versoline.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), no, m.end()) for no, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found)


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_base(df).select("doc_id", "pii_base").collect()
    return {r["doc_id"]: [tuple(x) for x in r["pii_base"]] for r in rows}


CASES = [
    "", None, "a@b.c_d@e.f", "x@y.z.", "..@a.b", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 00255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "5" * 13, "0" * 14, "0" * 19 + " " + "0" * 20,
    "+1 (499) 555-6503 +12 +123456789012345 +1234567890123456", "+1+2345678901", "é😀 a@b.cd 日本 10.0.0.1", "4111 1111 1111 1111  4111 1111 1111 1111", "a" * 3000 + "@b.c", "1" * 3000, "1 " * 4000, "9." * 3000, "x@" + "a." * 2000 + "b",
]


def test_base_cases(spark):
    got = spans(spark, CASES)
    for k, text in enumerate(CASES):
        assert got[k] == base(text), text


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("0123459 .-()+@ab_é\n") + ["4111 1111 1111 1111", "10.0.0.", "a@b.co", "+1 (499) 555-"]), max_size=25), min_size=30, max_size=30))
def test_base_is_the_plain_expressions(spark, lists):
    texts = ["".join(x) for x in lists]
    got = spans(spark, texts)
    for k, text in enumerate(texts):
        assert got[k] == base(text), text


def corpus():
    """Contexts that identifiers follow, one that they mostly do not, and identifiers that base patterns miss."""
    rows = [f"please call extension {'+1 212 555 0%03d' % k} for help with item {k}" for k in range(8)]
    rows += [f"some filler the {'10.0.0.%d' % k} the end and the other the more" for k in range(8)]
    rows += ["please call extension X-4471-B today", "we met the R2D2-99 robot", "nothing here", None, ""]
    return list(enumerate(rows))


def test_patterns_find_unseen_identifiers(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("pii_row", F.lit("clash"))
    rows = {r["doc_id"]: r for r in pii.with_spans(df).withColumn("s", pii.as_text("pii_spans")).collect()}
    text = corpus()[16][1]
    at = text.index("X-4471-B")
    assert rows[16]["s"] == f"id:{at}:{at + 8}"
    assert rows[17]["s"] == "" and rows[19]["s"] == "" and rows[20]["s"] == ""
    assert all([tuple(x) for x in rows[k]["pii_base"]] == base(t) for k, t in corpus())


def test_rounds_trust_patterns_of_discovered_instances(spark):
    rows = [(f"dial number +1 212 555 0{k:03d} now",) for k in range(6)] + [(f"dial number AB-{k:04d} now",) for k in range(6)] + [(f"ticket ref AB-{k:04d} closed",) for k in range(6)] + [("ticket ref ZZ-7777 closed",)]
    df = spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string")
    found = lambda rounds: {r["doc_id"] for r in pii.with_spans(df, rounds=rounds).collect() if any(s["no"] == 4 for s in r["pii_spans"])}
    assert 18 not in found(1) and 18 in found(2) and 18 in found(None)


def test_hops_go_on(spark):
    """Four contexts that only instances of the one before lead to."""
    rows = [f"dial number +1 212 555 0{k:03d} now" for k in range(15)]
    names = ["dial number", "ticket ref", "order slip", "parcel box", "badge tag"]
    for a, (one, two) in enumerate(zip(names, names[1:])):
        rows += [f"{c} Q{a}-{'abcdef'[k] * 4}7 ok" for c in (one, two, two, two) for k in range(6)]
    df = spark.createDataFrame(list(enumerate([*rows, "badge tag ZZ-7777 ok"])), "doc_id long, text string")
    last = {r["doc_id"]: [tuple(s) for s in r["pii_spans"]] for r in pii.with_spans(df).collect()}[len(rows)]
    assert last == [(10, 4, 17)]


def test_adjacent_identifiers(spark):
    """What stands before the second of two is the first, its numbers as 0."""
    rows = [f"pair 10.0.0.{k} 10.0.1.{k} end" for k in range(8)] + ["pair 10.0.0.9 AB-9 end", "pair 7-x end"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [s["no"] for s in r["pii_spans"]] for r in pii.with_spans(df).collect()}
    assert got[8] == [1, 4] and got[0] == [1, 1]


def test_secrets_need_a_context(spark):
    """Keys that always follow a word are found, as is another that follows it; a checksum after an ordinary word is not."""
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [f'use secret = "{key(k)}" then the {"word " * k}end' for k in range(9)]
    rows += [f"the {w} file" for w in ("red", "blue", "green", "old", "new")] + ['use secret = "short-77" then', f"the {key(99)} file"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["pii_spans"]] for r in pii.with_spans(df).collect()}
    assert all(got[k] == [(14, 4, 54)] for k in range(9)) and got[14] == [(14, 4, 22)]
    assert all(got[k] == [] for k in (9, 10, 11, 12, 13, 15))


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a@b.co", 1, 2)], "doc_id long, text string, `a.b` int, PII_TEXT int")
    out = pii.redact(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "<EMAIL>", 1, 2)
    assert pii.with_spans(df).columns == ["doc_id", "text", "a.b", "pii_base", "pii_spans"]


def test_redact(spark):
    rows = [(1, "mail a@b.co or +1 (499) 555-6503.", 5, "k"), (2, None, None, "k"), (3, "clean", 99, "k"), (4, "a@10.0.0.1.b é", 3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pii_row string")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "mail <EMAIL> or <PHONE>." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["n_chars"] == 99
    assert got[4]["text"] == "<EMAIL> é"


def test_running_sums(spark):
    items = list(range(1, 1200))
    got = spark.createDataFrame([(items,)], "l array<int>").select(pii.running(F.col("l"))).first()[0]
    assert got == [sum(items[:k]) for k in range(len(items))]


def test_time_is_near_linear_in_tokens(spark):
    """Each number of a long text used to cost a pass over all of it."""
    import time

    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"word n{k}" for k in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.with_candidates(pii.with_base(df)).select(F.size("pii_tokens")).first()[0] == n - 100
        return time.perf_counter() - began

    took(500)
    assert took(20_000) < 10 * took(4000) + 5


def test_empty_table(spark):
    assert pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["documents"])
def test_query(spark, sf_dir, name):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()}
    rows = pii.op5_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(no == k for _, no, _ in want) for k in range(4)]
        text = ",".join(f"{PATTERNS[no][0]}:{a}:{b}" for a, no, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
