"""Hand-derived goldens for the text expressions (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import amount as A
from tallyspark.functions import classify as C
from tallyspark.functions import dates as D
from tallyspark.functions import text as T

AMOUNT_CASES = [
    ("Rs. 1,200.50 debited", "1200.50"),
    ("$20 fee, later Rs 15", "15"),
    ("INR 99 paid", "99"),
    ("USD 12.5 charged", "12.5"),
    ("Amount: 750", "750"),
    ("Debited from card XX1234 today", "1234"),
    ("Paid 45.00 now", "45.00"),
    ("Ref 2025 ok", "2025"),
    ("Your code 7 is ready", None),
    ("Call within 24 hours 48", "48"),
    ("Rs 0.00 then INR 5", "5"),
    ("Rs 99999999 fee $20", "20"),
    ("Rs. 500", "500"),
]


def _one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", AMOUNT_CASES)
def test_amount_cascade(spark, text, expected):
    assert _one(spark, A.extract_amount(F.col("t")), text) == expected


def test_amount_cascade_batch(spark):
    df = spark.createDataFrame([(t,) for t, _ in AMOUNT_CASES], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", A.extract_amount("t").alias("x")).collect()}
    assert got == {t: e for t, e in AMOUNT_CASES}


def test_amount_strict_word_boundary(spark):
    # "hours 48" is no rupee amount with word boundaries: the bare-integer rung finds 24 first
    assert _one(spark, A.extract_amount(F.col("t"), strict=True), "Call within 24 hours 48") == "24"
    assert _one(spark, A.extract_amount(F.col("t"), strict=True), "rs 5 and hours 48x") == "5"


def test_title_case_python_semantics(spark):
    assert _one(spark, T.title_case(F.col("t")), "mcdonald's a&b 12-jan") == "Mcdonald'S A&B 12-Jan"
    assert _one(spark, T.title_case(F.col("t")), "") == ""
    assert _one(spark, T.title_case(F.col("t")), None) is None


@pytest.mark.parametrize("sender,bank", [
    ("x@praxis.example", "Axis Bank"),
    ("news@example.com", "Unknown Bank"),
    ("HDFC <Alerts@HDFCBank.net>", "HDFC Bank"),
    ("someone@kotak.example", "Kotak Bank"),
])
def test_bank(spark, sender, bank):
    assert _one(spark, C.resolve_bank(F.col("t")), sender) == bank


def test_bank_canonical(spark):
    assert _one(spark, C.resolve_bank(F.col("t"), canonical=True), "a@kotak.example") == "Kotak Mahindra Bank"


@pytest.mark.parametrize("score,conf", [(0, 25), (1, 15), (9, 135)])
def test_rule_confidence(spark, score, conf):
    assert _one(spark, C.rule_confidence(F.col("t")), score, "t int") == conf


def test_category_tie_goes_to_earlier_rule(spark):
    rules = [("first", ["aa", "bb"], "#1"), ("second", ["cc", "dd"], "#2")]
    best = _one(spark, C.category_score(F.col("t"), rules), "aa cc")
    assert (best["score"], best["label"]) == (1, "first")
    best = _one(spark, C.category_score(F.col("t"), rules), "cc dd aa")
    assert (best["score"], best["label"]) == (2, "second")
    assert _one(spark, C.category_label(C.category_score(F.col("t"), rules)), "zz") == "other transactions"


@pytest.mark.parametrize("amount,display", [(950, "₹950"), (1500, "₹1.5K"), (250000, "₹2.5L"),
                                            (12000000, "₹1.2Cr")])
def test_format_amount(spark, amount, display):
    assert _one(spark, A.format_amount(F.col("t")), float(amount), "t double") == display


def test_clean_amount(spark):
    df = spark.createDataFrame([("895.62",), (None,), ("-5",), ("abc",), ("1.2.3",)], "t string")
    got = [r["x"] for r in df.select(A.clean_amount("t").alias("x")).collect()]
    assert [None if g is None else float(g) for g in got] == [895.62, 0.0, -5.0, 0.0, None]


def test_header_dates(spark):
    df = spark.createDataFrame([("Mon, 06 Jan 2025 10:15:00 +0530 (IST)",), ("junk",)], "date string")
    rows = D.with_parsed_dates(df, "date").select(
        F.col("event_ts").cast("timestamp_ntz").alias("e"), "local_ts").collect()
    assert rows[0]["e"] == dt.datetime(2025, 1, 6, 4, 45)
    assert rows[0]["local_ts"] == dt.datetime(2025, 1, 6, 10, 15)
    assert rows[1]["e"] is None and rows[1]["local_ts"] is None


def test_vendor_cascade(spark):
    assert _one(spark, C.extract_vendor(F.col("t")), "Payment at Starbucks Coffee, thanks") == "Starbucks Coffee"
    # every candidate rejected: the last rejected text stays
    assert _one(spark, C.extract_vendor(F.col("t")), "paid to the bank") == "The Bank"
    assert _one(spark, C.extract_vendor(F.col("t")), "nothing here") == "Unknown Vendor"


def test_html_to_text(spark):
    html = "<html><script>x</script><style>p{}</style><p>Hello&amp;  world</p>\n <b>b</b><!-- c --></html>"
    assert _one(spark, T.html_to_text(F.col("t")), html) == "Hello& world b"


def test_html_to_text_of_hard_sources(spark):
    from tallyspark.plans.q_text import HARD_HTML
    for html, want in HARD_HTML + [("<p " + "a='>' " * 20_000 + ">x</p>", "x"), ("<" * 5000, "<" * 5000), ("<p title='open>x</p> y", "x y"),
                                   ("<br/>a<br />b", "a b"), ("</p>x</ p>y", "x y"), ("<!doctype html><?xml a?>x", "x"), ("<style>p>q{}", ""), (None, None), ("", "")]:
        assert _one(spark, T.html_to_text(F.col("t")), html) == want, html[:60]


def test_preview(spark):
    assert _one(spark, T.preview(F.col("t"), 5), "abcdefgh") == "abcde..."
    assert _one(spark, T.preview(F.col("t"), 5), "abc") == "abc"
