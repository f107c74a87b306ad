"""Model-output handling goldens (FIXTURES.md section 3, C1-C3)."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.model import model_analysis

CASES = [
    ('ok {"amount":"₹1,299.00","category":"X","vendor":"V"} bye', (1299.0, "X", "V", 50, False)),
    ('{"amount":500,"category":"X","vendor":"V"}', (500.0, "X", "V", 50, False)),
    ('{"amount":"-5","category":"X","vendor":"V"}', (5.0, "X", "V", 50, True)),
    ('{"amount":"1.2.3","category":"X","vendor":"V"}', (None, "X", "V", 50, False)),
    ('{"amount":"20000000","category":"X","vendor":"V"}', (None, "X", "V", 50, False)),
    ('{"vendor":"V"}', (None, "Other Transactions", "V", 50, False)),
    ('{"category":"X"}', (None, "X", "Unknown Vendor", 50, False)),
    ('{"category":null,"vendor":"V"}', None),
    ("not json", None),
    ('{"amount":3,"category":"X","vendor":"V","confidence":70}', (3.0, "X", "V", 70, True)),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_model_output(spark, text, expected):
    df = spark.createDataFrame([(text, "subject", "body")], "m string, s string, b string")
    r = df.select(model_analysis("m", F.col("s"), F.col("b")).alias("x")).first()["x"]
    if expected is None:
        assert r is None
        return
    amt = None if r["amount"] is None else float(r["amount"])
    assert (amt, r["category"], r["merchant_name"], r["confidence"], r["is_trial"]) == expected


def test_trial_words_from_raw_text(spark):
    df = spark.createDataFrame([('{"category":"X","vendor":"V"}', "Free trial", "")], "m string, s string, b string")
    r = df.select(model_analysis("m", F.col("s"), F.col("b")).alias("x")).first()["x"]
    assert r["is_trial"] is True
