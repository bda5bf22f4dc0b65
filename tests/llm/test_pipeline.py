from collections import Counter

import pytest

import corpus_pipeline as P
from versoline.llm import mixing, packing, toxicity
from versoline.llm.common import Scratch, table

from .test_jaccard import brute
from .test_pii import base


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and made."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in P.STAGES:
        made = Scratch(spark).stored(stage(spark, docs, sf_dir), name)
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_order_and_columns(stages, spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "n_gram_jaccard_join", "pii", "mixing", "packing"]
    for name, (_, made) in stages.items():
        assert name == "packing" or made.columns == table(spark, sf_dir, "documents").columns


def test_toxicity(stages, spark, sf_dir):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    want = [r["doc_id"] for r in toxicity.score(before, model).collect() if r["toxicity"] < 0.3]
    assert sorted(want) == sorted(r[0] for r in rows(after)) and set(rows(after)) <= set(rows(before))


def test_near_copies(stages):
    before, after = map(rows, stages["n_gram_jaccard_join"])
    groups = {c for _, _, c in brute([(r[0], r[1]) for r in before], 5, 80)}
    assert sorted(r[0] for r in after) == sorted(groups) and set(after) <= set(before)


def test_personal_data(stages):
    before, after = ({r[0]: r for r in rows(df)} for df in stages["pii"])
    assert before.keys() == after.keys()
    for d, r in before.items():
        found = base(r[1])
        assert (after[d][1] == r[1]) if not found and "<ID>" not in (after[d][1] or "") else not base(after[d][1])
        assert after[d][1] is None or after[d][4] == len(after[d][1]) or after[d][1] == r[1]


def test_mixing(stages, spark):
    before, after = stages["mixing"]
    taken = Counter()
    for r in mixing.mix(before).collect():
        taken[r["doc_id"]] += r["mix_taken"]
    got = Counter()
    for r in rows(after):
        got[r[0]] += len((r[1] or "").split())
    assert got == Counter({d: n for d, n in taken.items() if n})


def test_packing(stages):
    before, after = stages["packing"]
    encoder = packing.Encoder(packing.default_tokenizer())
    want = Counter()
    for d, text, *_ in rows(before):
        want[d] += len(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, a text of one long word, and columns whose names clash, through all stages; then no rows at all."""
    long = " ".join(f"w{k}" for k in range(20_000))
    data = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, "one two three four five six", "en", None, 27), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, "x" * 100_000, "en", "b", 100_000), (5, long, "en", "b", len(long)), (6, "mail a@b.co now please or never", "en", None, 31)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(data, schema).selectExpr("*", "1 AS `a.b`", "2 AS node", "3 AS MIX_SIZE", "4 AS pii_text", "5 AS toxicity", "6 AS tag")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {"toxicity": 8, "n_gram_jaccard_join": 7, "pii": 7}
    for given in (docs, docs.limit(0)):
        at = given
        for name, stage in P.STAGES:
            at = Scratch(spark).stored(stage(spark, at, str(tmp_path)), name)
            rows = at.collect()
            if name != "packing":
                assert at.columns == docs.columns and all(r["MIX_SIZE"] == 3 and r["a.b"] == 1 for r in rows)
            assert len(rows) == 0 if given is not docs else len(rows) == kept.get(name, len(rows))
            if name == "mixing" and given is docs:
                assert not any(r["text"] in (None, "") for r in rows) and any(r["doc_id"] is None for r in rows)
                assert any("<EMAIL>" in r["text"] for r in rows)


def test_run(spark, sf_dir, stages):
    assert P.run(spark, sf_dir).count() == stages["packing"][1].count()
    assert P.ORACLE_SQL is None


def test_packing_of_the_pipeline_needs_no_table_of_words(spark, sf_dir, monkeypatch):
    """The last stage gives the same pieces whether every task gets all counts or none."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/mixed"
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.mode("overwrite").parquet(path)
    out = []
    for most in (10**6, 0):
        monkeypatch.setattr(packing, "MOST_WORDS", most)
        out.append(sorted(map(tuple, P.packed(spark, spark.read.parquet(path), sf_dir).collect())))
    assert out[0] == out[1]
