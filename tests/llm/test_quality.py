import random
import zlib

import numpy as np
import pytest

from versoline.llm import quality as Q


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows = []
    for k in range(n):
        good = int(rng.random() < 0.7)
        words = [word() for _ in range(rng.randrange(8, 80))]
        if not good:
            kind = rng.randrange(3)
            words = [w + "%%%" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words for _ in range(5)]
        rows.append((k, " ".join(words), good))
    return rows


def brute(text):
    """The statistics in plain Python."""
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    rows = [x for x in text.split("\n") if x]
    n, chars = max(1, len(words)), max(1, len(text))
    letters = sum(c.isalpha() for c in text)
    count = lambda marks: sum(text.count(c) for c in marks)
    return [
        len(words), sum(map(len, words)) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(rows)) / max(1, len(rows)), n / max(1, len(rows)), letters / chars,
        sum(c.isupper() for c in text) / max(1, letters), count("0123456789") / chars, count(Q.SYMBOLS) / n, count("!?") / n, count(".,;:") / n, sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 16 for w in words) / n,
    ]


TEXTS = ["", None, " \n", "a", "One two two\nTWO é😀 12.5% {x}", "x\n\nx\n", "A" * 30 + " b"]


def test_statistics(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in Q.with_statistics(df).collect():
        assert [r[f"q_{s}"] for s in Q.STATISTICS] == pytest.approx(brute(TEXTS[r["doc_id"]])), TEXTS[r["doc_id"]]


def test_expression_is_the_model(spark):
    """Scores of the compiled expression against the rules applied by hand; held-out accuracy."""
    rows = corpus()
    df = spark.createDataFrame([(k, t, "clash") for k, t, _ in rows], "doc_id long, text string, q_letters string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = Q.fit(df, labels)
    assert 0 < len(model.rules) < 200
    got = {r["doc_id"]: r["quality_score"] for r in Q.score(df, model).collect()}
    x = np.array([brute(t) for _, t, _ in rows])
    z = model.bias + sum(w * Q.holds(x, rule) for rule, w in model.rules)
    assert [got[k] for k, _, _ in rows] == pytest.approx((1 / (1 + np.exp(-z))).tolist())
    test = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.3) == bool(y) for k, y in test) >= 0.95 * len(test)


def test_edges(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["quality_score"] for r in Q.score(df, Q.fit(df, nothing)).collect()} == {0.5}
    assert Q.train(np.zeros((3, 14)), np.ones(3)).bias > 0
    assert Q.score(df.limit(0), Q.train(np.zeros((3, 14)), np.zeros(3))).count() == 0
    assert Q.score(df, Q.train(np.zeros((3, 14)), np.zeros(3))).columns == ["doc_id", "text", "quality_score"]


def test_lasso_is_sparse():
    rng = np.random.default_rng(0)
    z = (rng.random((500, 40)) < 0.5).astype(float)
    y = (z[:, 0] + z[:, 1] > 1).astype(float)
    _, w = Q.lasso(z, y, 0.02)
    assert np.abs(w[:2]).min() > 0.3 and np.count_nonzero(w) <= 12


def test_query(spark, sf_dir):
    rows = Q.op7_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy_on_a_table(spark):
    table = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{table}/labels.parquet").collect()}
    rows = [(r["predicted"], truth[r["doc_id"]]) for r in Q.op7_quality(spark, table).where("held_out").collect() if truth.get(r["doc_id"]) is not None]
    right = sum(p == y for p, y in rows)
    print(f"held out: {right} of {len(rows)} right")
    assert right >= 0.97 * len(rows)
