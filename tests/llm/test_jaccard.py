import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versoline.llm import jaccard
from versoline.llm.components import components, merged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(docs, width=4, percent=85):
    """(doc_id, n_shingles, component) of each row, all pairs of sets that share a shingle compared."""
    sets = [(d, shingles(t, width)) for d, t in docs]
    root = {s: s for _, s in sets if s}
    have = defaultdict(list)

    def find(s):
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for s in list(root):
        seen = defaultdict(int)
        for x in s:
            for other in have[x]:
                seen[other] += 1
            have[x].append(s)
        for other, both in seen.items():
            if 100 * both >= percent * (len(s) + len(other) - both):
                root[find(s)] = find(other)
    least = {}
    for d, s in sets:
        if s:
            least[find(s)] = min(d, least.get(find(s), d))
    return sorted((d, len(s), least[find(s)] if s else d) for d, s in sets)


def found(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, jaccard.near_duplicates(df, **more).collect()))


def variants(seed, bases=6, copies=12, words=60):
    """Families of near copies around the threshold, with passages that families share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    shared = [word() for _ in range(20)]
    docs = []
    for b in range(bases):
        base = [word() for _ in range(words * (1 + b % 3))] + shared
        for _ in range(copies):
            one = list(base)
            for _ in range(rng.randrange(0, 5)):
                one[rng.randrange(len(one))] = word()
            docs.append(" ".join(one).upper() if rng.random() < 0.2 else "\t".join(one))
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    docs = variants(seed)
    assert found(spark, docs) == brute(docs)


def test_frequent_classes_lose_nothing(spark, monkeypatch):
    """With every repeated shingle in the frequent class, pairs of tokens do the work."""
    monkeypatch.setattr(jaccard, "OVERALL", 2)
    docs = variants(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)  # one task sees all, so nothing is rare that repeats
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == brute(docs)


def test_other_widths(spark):
    docs = variants(4, bases=3)
    assert found(spark, docs, width=5, percent=80) == brute(docs, 5, 80)


def test_edges(spark):
    docs = [(5, None), (4, ""), (9, " \n\t"), (8, "a b"), (7, "A  b"), (6, "b a"), (3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (11, "x " * 5000), (12, "x " * 9), (1, "y")]
    assert found(spark, docs) == brute(docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e", 3), (2, "a b c d e", 4)], "doc_id long, text string, node int").withColumn("key", F.lit(0))
    assert sorted(map(tuple, jaccard.near_duplicates(clash).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_one_of_each(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (4, "q"), (4, "q"), (None, "a b c d e f"), (6, None)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (4, "q"), (6, "")]


def test_index_shares_a_key_for_every_link():
    """The prefix theorem on sets around the threshold, whatever is frequent."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(6, 400))
        base = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        drop = rng.random(len(base)) < 0.08
        other = np.unique(np.concatenate([base[~drop], rng.integers(0, 1 << 48, int(drop.sum() * rng.random())).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        frequent = np.sort(base[rng.random(len(base)) < rng.choice([0.0, 0.5, 0.95, 1.0])])
        row = np.repeat([0, 1], [len(base), len(other)])
        parts = jaccard.index_rows(row, np.concatenate([base, other]), np.array([len(base), len(other)]), frequent, 85)
        r, key, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
        linked = 100 * both >= 85 * (len(base) + len(other) - both) and both < max(len(base), len(other))
        if linked:
            assert set(key[r == 0]) & set(key[r == 1]), trial


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((5, 5), (100, 110), (500, 520), (510, 515), (3000, 3100)):
        a = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 48, m - n // 2).astype(np.uint64)]))
        sizes = np.array([len(a), len(b)])
        one, two = (np.array(x, np.int64).view(np.uint64) for x in jaccard.sketches(np.repeat([0, 1], sizes), np.concatenate([a, b]), sizes).to_pylist())
        if len(one) > len(two):
            one = one[: len(two)] ^ one[len(two) :]
        if len(two) > len(one):
            two = two[: len(one)] ^ two[len(one) :]
        bits = sum(int(x).bit_count() for x in one ^ two)
        assert bits <= len(np.setxor1d(a, b))


def test_hashed_words_do_not_depend_on_slices():
    texts = pa.array(["One two three four five", "x", "", "a b c d e f g"] * 3, pa.large_string())
    whole = jaccard.shingle_sets(texts)
    part = jaccard.shingle_sets(texts.slice(4, 4))
    mine = (whole[0] >= 4) & (whole[0] < 8)
    assert np.array_equal(whole[1][mine], part[1]) and np.array_equal(whole[0][mine] - 4, part[0])


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (5, 5), (200, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_any_graph(spark):
    """Random links against a search; then the same links in two halves, merged."""
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(300):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert {r["node"]: r["root"] for r in components(df(links)).collect()} == root
    halves = merged(merged(None, df(links[:95])), df(links[95:]))
    assert {r["node"]: r["root"] for r in halves.collect()} == root


def test_rounds_hand_nothing_on_to_the_optimizer(spark, monkeypatch):
    """A path in random order takes several rounds; what the optimizer infers of their tables would grow with each, in the driver's memory."""
    order = random.Random(8).sample(range(400), 400)
    seen = []
    kind = type(spark.range(1))
    plain = kind.isEmpty

    def watched(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().constraints().size())
        assert seen[-1] <= 4, seen
        return plain(df)

    monkeypatch.setattr(kind, "isEmpty", watched)
    got = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
    assert {r["root"] for r in got.collect()} == {0} and got.count() == 400
    got = merged(got, spark.createDataFrame([(0, 500), (501, 399)], "a long, b long"))
    assert {r["root"] for r in got.collect()} == {0} and got.count() == 402
    assert len(seen) > 8


def test_null_ids(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "A b c d e f g h i j k l m n o p q r s t u v w x y zz", "a b c d e f g h i j k l m n o p q r s t u v w x y"]
    assert found_rows(spark, [(None, texts[0]), (7, texts[1]), (None, texts[2])]) == [(None, 22, 7), (None, 23, 7), (7, 23, 7)]
    assert found_rows(spark, [(None, texts[0]), (None, texts[1])]) == [(None, 23, None)] * 2


def found_rows(spark, docs):
    out = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sorted(map(tuple, out), key=lambda r: (r[0] is not None, r))


def test_families_of_hot_keys(spark, monkeypatch):
    """Keys of many nodes whose nodes are of several components meet in families, and by key where that means fewer comparisons."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "ORDERS", (1,))
    for seed in (6, 7):
        docs = variants(seed, bases=4, copies=14, words=30)
        assert found(spark, docs) == brute(docs)


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, jaccard.op6_jaccard_join(spark, sf_dir).collect())) == brute(docs)


def test_ids_with_several_texts(spark):
    """A text that is no near copy stays, though its id has another text that is one; odd names of columns are no matter."""
    copy, other = "a b c d e f g h", "p q r s t u v w"
    docs = [(1, copy, 0), (2, copy, 0), (2, other, 0), (2, other, 0), (3, " ", 1), (3, "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, `a.b` int").withColumn("TAG", F.lit("x"))
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["a.b"], r["TAG"]) for r in out.collect()) == [(1, copy, 0, "x"), (2, other, 0, "x"), (3, "", 1, "x"), (3, " ", 1, "x")]
