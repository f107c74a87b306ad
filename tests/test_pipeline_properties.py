"""Properties over the driver tables: every registered query runs on sf0.001,
results do not depend on input order or partitioning, the flagship entry
works, and the MIME parser selects bodies as described."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tallyspark.plans import catalog  # noqa: E402
from tallyspark.operators import spend as S  # noqa: E402
from tallyspark.plans import standins as V  # noqa: E402
from tallyspark.sources import mail as MAIL  # noqa: E402

from .conftest import SF  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["account_id", "category", "total_amount", "txn_count", "avg_amount"]


def test_every_query_has_oracle_or_reason():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


catalog.load_all()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs_on_smallest_tables(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.limit(5).collect()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_order_and_partitioning_invariance(spark):
    t = V.txn_events(spark, SF)
    shuffled = t.orderBy(F.rand(7)).repartition(7)
    one = t.coalesce(1)
    for fn in (S.spend_summary, S.by_category, S.month_over_month, S.top5_categories):
        a, b, c = _rows(fn(t)), _rows(fn(shuffled)), _rows(fn(one))
        assert a == b == c


def _parsed(spark, *contents):
    raw = spark.createDataFrame([("a@b.example", str(k), c) for k, c in enumerate(contents)], "account_id string, message_id string, content binary")
    return MAIL.parse_messages(raw).orderBy("message_id").collect()


def test_mime_body_selection(spark):
    html_first = (b'Subject: s\r\nFrom: f\r\nDate: d\r\nContent-Type: multipart/alternative; boundary="b"\r\n\r\n'
                  b'--b\r\nContent-Type: text/html\r\n\r\n<style>.a{width:600}</style><p>Rs.&nbsp;500 &#8377;750 <b>debited</b></p>\r\n'
                  b'--b\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b--\r\n')
    plain_first = html_first.replace(b"text/html", b"text/TMP").replace(b"text/plain", b"text/html").replace(b"text/TMP", b"text/plain")
    single = b"Subject: s\r\n\r\n" + b"x" * 7000
    a, b, c, d = _parsed(spark, html_first, plain_first, single, None)
    assert a.body == "Rs. 500 \u20b9750 debited" and a.account_id == "a@b.example"
    assert b.body.startswith("<style>")
    assert len(c.body) == 7000
    assert d.error == "missing content" and d.body is None


def test_stream_keeps_late_and_misdated_mail(spark):
    from tallyspark.session import scratch_path
    from tallyspark.streaming.mail_stream import MESSAGE_SCHEMA, run_available
    rows = [(1, str(k), "s", "x@y.example", f"{1 + k % 28} Jan {2099 if k == 3 else 2030 - k % 9} 10:00:00 +0000", f"Rs {k + 20} paid") for k in range(12)]
    got = []
    for files in (1, 4, 12):
        landing = scratch_path(spark, "landing")
        for f in range(files):
            part = rows[f::files] + rows[:2]
            spark.createDataFrame(part, MESSAGE_SCHEMA).coalesce(1).write.parquet(f"{landing}/part={f}")
        out = run_available(spark, landing, max_files_per_trigger=1)
        got.append(sorted(r.message_id for r in spark.read.parquet(out).collect()))
    assert got[0] == got[1] == got[2] == sorted(str(k) for k in range(12))


def test_bad_model_answers_do_not_end_the_job(spark):
    from tallyspark.functions.model import model_analysis
    df = spark.createDataFrame([('{"amount":1e20,"category":"X","vendor":"V"}',), ('{"amount":5,"category":"X","vendor":"V","is_subscription":"true"}',)], "m string")
    a, b = [r.r for r in df.select(model_analysis("m", F.lit("s"), F.lit("b")).alias("r")).collect()]
    assert a.amount is None and b.is_subscription is False


def test_zones_are_never_read_as_utc(spark):
    from tallyspark.functions.dates import with_parsed_dates
    heads = ["6 Jan 2025 10:15 +0530", "2025-01-06 10:15:00 +0530", "2025-01-06 10:15:00+05:30", "6 Jan 25 10:15:00 +0530", "6 Jan 2025 10:15:00 QQQZ"]
    got = [r.t for r in with_parsed_dates(spark.createDataFrame([(h,) for h in heads], "date string")).select(F.date_format("event_ts", "yyyy-MM-dd HH:mm").alias("t")).collect()]
    assert got[:4] == ["2025-01-06 04:45"] * 4 and got[4] is None


def test_totals_keep_accounts_without_live_subscriptions(spark):
    from decimal import Decimal
    from tallyspark.operators.metrics import subscription_totals
    df = spark.createDataFrame([(1, "Inactive", Decimal("5.00"), "Monthly")], "account_id int, status string, amount decimal(18,2), billing_cycle string")
    (r,) = subscription_totals(df, "2025-10-15").collect()
    assert r.total_monthly == 0.0


def test_ids_stay_unique_next_to_taken_suffixes(spark):
    from tallyspark.operators.ledger import unique_ids
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a_dup_1", 3), (1, "a", 4)], "account_id int, id string, seq int")
    assert [r.id for r in unique_ids(df).orderBy("seq").collect()] == ["a", "a_dup_2", "a_dup_1", "a_dup_3"]
