"""Scorer isolation and exports that survive their own text."""

import datetime as dt
import random

import pandas as pd
import pytest

from tallyspark.operators import analyze as A
from tallyspark.sources import export as X

MSG = "account_id string, message_id string, subject string, sender string, date string, body string"


@pytest.mark.parametrize("n,bad", [(1, {0}), (8, set()), (50, {0, 1, 7, 49}), (1000, set(range(0, 1000, 100)))])
def test_only_the_rows_that_raise_lose_their_answer(n, bad):
    calls = []

    def scorer(x):
        calls.append(len(x))
        if any(v in bad for v in x):
            raise KeyError("bad")
        return pd.Series([f"a{v}" for v in x])

    got = A.isolated(scorer, pd.Series(range(n), index=range(5, n + 5)))
    assert got.answer.tolist() == [None if k in bad else f"a{k}" for k in range(n)]
    assert [e is not None for e in got.error] == [k in bad for k in range(n)]
    assert len(calls) <= 1 + 2 * max(1, len(bad)) * (n.bit_length() + 1)


def test_one_bad_row_in_a_hundred_costs_fewer_calls_than_halving_every_span():
    rng, calls = random.Random(4), []
    rows = pd.Series([rng.random() < 0.01 for _ in range(10_000)])

    def scorer(x):
        calls.append(len(x))
        if x.any():
            raise ValueError("bad")
        return ["a"] * len(x)

    got = A.isolated(scorer, rows)
    assert got.error.notna().tolist() == rows.tolist() and got.answer.isna().tolist() == rows.tolist()
    assert len(calls) < 10.5 * rows.sum() and sum(calls) < 10 * len(rows)


def test_wrong_number_of_answers_and_odd_answers():
    got = A.isolated(lambda x: ["only one"], pd.Series([1, 2, 3]))
    assert got.answer.tolist() == ["only one"] * 3
    assert A.isolated(lambda x: [], pd.Series([1, 2])).error.notna().all()
    assert A.isolated(lambda x: [None, float("nan"), 5], pd.Series([1, 2, 3])).answer.tolist() == [None, None, "5"]
    assert len(A.isolated(lambda x: 1 / 0, pd.Series([], dtype=object))) == 0


def test_bad_rows_fall_to_the_rules_path(spark):
    rows = [("a", f"m{k}", "Alert", "x@chase.com", None, "boom" if k % 100 == 7 else "Rs 50 paid at Netflix") for k in range(400)]

    def scorer(subject, body, bank):
        if (body == "boom").any():
            raise ValueError("boom")
        return pd.Series(['{"category": "Food", "vendor": "V"}'] * len(body))

    out = A.score_hook(spark.createDataFrame(rows, MSG), scorer, errors=True).collect()
    assert {r.message_id for r in out if r.analysis_source == "rules"} == {f"m{k}" for k in range(7, 400, 100)}
    assert {r.score_error for r in out} == {None, "ValueError: boom"} and len(out) == 400


def test_csv_keeps_every_text(spark):
    rng = random.Random(2)
    hard = [None, "", " ", "  both  ", "a,b", 'say "hi"', '"', '""', "line\nbreak", "cr\rlf\r\nend\r", "tab\t", "\\", "\\N", 'a\\"b', "#c", "é日😀", "null", "NULL",
            "\n", ",", "a\n\n\"b\",\r\n", "x" * 70_000, "-", "1.0"]
    rows = [(k, rng.choice(hard), rng.choice(hard), dt.datetime(2025, 1, 2, 3, 4, 5, 678901), rng.choice([None, True, False])) for k in range(500)]
    rows += [(1000 + k, h, None, None, None) for k, h in enumerate(hard)]
    df = spark.createDataFrame(rows, "k long, a string, b string, at timestamp_ntz, f boolean").repartition(3)
    back = X.export_csv_roundtrip(df).collect()
    assert sorted(map(tuple, back), key=lambda r: r[0]) == rows
    only = spark.createDataFrame([(h,) for h in hard], "a string")
    got = [r.a for r in X.export_csv_roundtrip(only).collect()]
    assert sorted(got, key=str) == sorted(hard, key=str)
