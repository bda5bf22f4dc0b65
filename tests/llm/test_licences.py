import textwrap

import pyarrow as pa
import pytest

from versoline.llm import licences as lic

FILLER = ["the river ran over stones and the mill was old", "copy the numbers to any page of the work", "a license plate was found without rust", "permission slips are due on Friday", "free soup for all persons of the town"] * 20


@pytest.fixture(scope="module")
def model():
    return lic.train(FILLER)


def test_templates_are_recognised(model):
    for family, lines in lic.TEMPLATES.items():
        for t in lines:
            assert model.classify(t)[0] == family, t
            assert model.classify("Note: " + t.replace("2.0", "2.1") + " Thanks all.")[0] in (family, "unknown"), t


def test_ordinary_text_is_none(model):
    for line in FILLER + ["", "rights and wrongs", "Version 2.0 of the plan", "software licenses are a topic of talk at dinner with friends and family"]:
        assert model.classify(line) is None or model.classify(line)[0] == "unknown", line
    assert sum(model.classify(line) is None for line in FILLER) == len(FILLER)


def test_other_licences_are_unknown(model):
    got = model.classify("This software is licensed under the Sample Institute Public License, version 9.")
    assert got is None or got[0] in ("unknown", "gpl")
    assert lic.likeness("entirely other words", 0) == 0


@pytest.mark.parametrize("line", ["Licensed under the Eclipse Public License 2.0.", "Licensed under the Example Public License, Version 2.0.", "This library is licensed under the Frobnicate Public License, version 2.1."])
def test_a_family_needs_a_pair_of_its_own(model, line):
    """Statements of licences that no template has share most words with some that do."""
    got = model.classify(line)
    assert got is not None and got[0] == "unknown"


def test_short_statements(model):
    assert model.classify("License: MIT")[0] == "mit"


def test_sample_is_spread_over_all_lines(spark, monkeypatch):
    """A line counts once however often it is there, and long lines are not left out."""
    monkeypatch.setattr(lic, "SAMPLE_LINES", 20)
    texts = ["the same\n" * 500, *(f"line {k}\n" + "long " * 300 + str(k) for k in range(40)), None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = lic.sample(df)
    assert 15 <= len(got) <= 20 and len(set(got)) == len(got) and any(len(x) > 1000 for x in got)
    assert lic.sample(df) == got and lic.sample(df.limit(0)) == []


def test_scan_is_the_plain_classification(spark, sf_dir, model):
    """Gate and batches against every line of every text classified one by one."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", "Released under the MIT License.\n\né\nAll rights reserved.", "a\n" * 50 + "Licensed under CC BY-NC 4.0."]
    got = lic.scan_lines(pa.array(texts, pa.large_string()), model, {})
    for text, spans in zip(texts, got, strict=True):
        want, at = [], 0
        for line in text.split("\n"):
            found = model.classify(line) if lic.is_candidate(line) else None
            if found:
                want.append((found[0], at, at + len(line)))
            at += len(line) + 1
        assert [(s["family"], s["start"], s["end"]) for s in spans] == want
        assert all(text[s["start"] : s["end"]].strip() for s in spans)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_notices_are_found(model, mark):
    """The usual form of notices: lines of 60 characters, behind the marks of a comment, in a text without blank lines."""
    for family, k in (("mit", 2), ("apache-2.0", 1), ("bsd", 0), ("gpl", 1), ("lgpl", 1), ("mpl-2.0", 0)):
        notice = "\n".join(mark + x for x in textwrap.wrap(lic.TEMPLATES[family][k], 60))
        text = "\n".join([FILLER[0], "Other words.", notice, FILLER[1], FILLER[2]])
        spans = lic.scan_lines(pa.array([FILLER[0], text], pa.large_string()), model, {})
        start = text.index(notice)
        assert spans[0] == [] and [(s["family"], s["start"], s["end"]) for s in spans[1]] == [(family, start, start + len(notice))], (family, spans)


def test_a_tag_alone_is_a_cue(model):
    spans = lic.scan_lines(pa.array(["x\n// SPDX-License-Identifier: ISC\ny"], pa.large_string()), model, {})
    assert [s["family"] for s in spans[0]] == ["unknown"]


def test_columns(spark, model):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Released under the MIT License.", 1), (3, "Released under the MIT License.", 1)], "doc_id int, text string, licences int")
    rows = lic.scan(df, model).collect()
    assert sorted((r["doc_id"], [s["family"] for s in r["licences"]]) for r in rows) == [(1, []), (2, []), (3, ["mit"]), (3, ["mit"])]
    assert lic.scan(df.limit(0), model).count() == 0


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in lic.op2_licence_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for family, text in (("mit", "Released under the MIT License."), ("apache-2.0", "Licensed under the Apache License, Version 2.0."), ("proprietary", "All rights reserved.")):
            assert (text in (r["text"] or "").split("\n")) <= (family in rows[r["doc_id"]]["families"].split(","))
