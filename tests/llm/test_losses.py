"""Cases that caps, prefixes and blind patterns used to lose."""

import time

import numpy as np
import pandas as pd
import pytest

from tallyspark.llm import extract, langid, linedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quotes_inside_unquoted_attributes_swallow_nothing():
    got = [b.text for b in extract.blocks("<p class=o'x>Hello there</p><p>it's here</p><p>more</p>")]
    assert got == ["Hello there", "it's here", "more"]
    got = [b.text for b in extract.blocks("<p title='a>b' data-x = \"c>'d\">x</p><p>a < b & c</p><p y='open>z</p>")]
    assert got == ["x", "a < b & c", "z"]
    start = time.time()
    extract.blocks("<p " + "a=\"1\" " * 50_000)       # a tag that never ends
    assert time.time() - start < 5


def test_training_runs_start_anywhere():
    rng = np.random.default_rng(0)
    runs = [extract._run(rng, list(range(500)), 90) for _ in range(40)]
    assert all(r == list(range(r[0], r[0] + 90)) for r in runs) and max(r[0] for r in runs) > 300
    assert extract._run(rng, [1, 2], 90) == [1, 2]


def test_letters_of_all_planes_are_letters():
    assert (langid.symbols(chr(0x30010) * 3)[1:-1] != 0).all() and (langid.symbols("😀 1")[1:-1] == 0).all()


def test_long_words_can_be_terms():
    word = "x" * 30 + "bad"
    assert word in toxicity._candidates({word})


def test_hits_inside_many_exceptions_in_linear_time():
    auto = toxicity.Lexicon({"bad": 1.0, "worse*": 2.0}, ["not bad", "bad not bad"]).automaton()
    start = time.time()
    assert toxicity.hits(auto, "not bad".split() * 50_000 + ["bad"] + ["ok", "worsening"]) == [1.0, 2.0]
    assert time.time() - start < 5
    assert toxicity.hits(auto, "bad not bad bad".split()) == [1.0]


def test_frames_of_counts_are_bounded(monkeypatch):
    from collections import Counter
    monkeypatch.setattr(toxicity, "FRAME_CHARS", 50)
    frames = list(toxicity._tables(Counter({"a" * 40: 2, "b" * 40: 1, "c": 3}), Counter({"c": 1})))
    got = pd.concat(frames).groupby("term").sum()
    assert got.loc["c"].tolist() == [3, 1] and got.loc["a" * 40].tolist() == [2, 0] and max(len(f) for f in frames) <= 2


@pytest.mark.parametrize("sites", [5, 6, 7, 30])
def test_line_spread_is_decided_by_the_sketch_and_exact_near_the_threshold(spark, sites):
    rows = [(k, f"Shared line of words here\nOwn line number {k} stands", "en", f"s{k % sites}", 1) for k in range(60)]
    rows += [(100 + k, "Shared line of words here", "en", "s0", 1) for k in range(40)] + [(100, "Shared line of words here", "en", "s0", 1), (None, None, None, None, None)]
    got = linedup.remove_boilerplate(spark.createDataFrame(rows, DOCS), 6, 3).collect()
    removed = sum(r.lines_removed for r in got)
    assert len(got) == len(rows) and removed == (0 if sites < 6 else 100)


def test_line_spread_shuffles_no_pairs_of_line_and_site(spark):
    rows = [(k, "Shared line of words here", "en", f"s{k % 9}", 1) for k in range(30)]
    lines = spark.createDataFrame([(1, 2, 3, 4, f"s{k}") for k in range(9)], "id long, row_hash long, h1 long, h2 long, site string")
    seen = []
    real = linedup.written
    linedup.written = lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name)
    try:
        linedup.boilerplate(lines, 6).collect()
    finally:
        linedup.written = real
    plan = dict(seen)["line-estimates"]
    assert "hll_sketch_agg" in plan and "Distinct" not in plan and "site" not in plan.split("Aggregate [")[1].split("]")[0] and rows
