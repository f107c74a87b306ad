"""Registered queries for spending aggregates (E), run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spend as S
from ..session import scratch_path
from . import standins as V
from .catalog import register

EV = V.with_ctes(V.SQL_TXN_EVENTS)
OR = V.with_ctes(V.SQL_TXN_ORDERS)
SB = V.with_ctes(V.SQL_SUBS)


@register("spend_summary", EV + """
SELECT account_id, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount, COUNT(*) AS txn_count,
       CAST(SUM(amount_numeric) AS DOUBLE) / CAST(COUNT(amount_numeric) AS DOUBLE) AS avg_amount,
       COUNT(DISTINCT merchant_name) AS unique_merchants
FROM v_txn_events GROUP BY account_id""", headline=True)
def q_spend_summary(spark, d):
    return S.spend_summary(V.txn_events(spark, d))


@register("by_category", OR + """
SELECT account_id, category, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount,
       COUNT(amount_numeric) AS txn_count,
       CAST(SUM(amount_numeric) AS DOUBLE) / CAST(COUNT(amount_numeric) AS DOUBLE) AS avg_amount
FROM v_txn_orders GROUP BY account_id, category""", headline=True)
def q_by_category(spark, d):
    return S.by_category(V.txn_orders(spark, d))


@register("flagged_insights", EV + """
SELECT account_id, COUNT(*) AS sub_txn_count, CAST(SUM(amount_numeric) AS DOUBLE) AS sub_amount,
       COUNT(*) FILTER (WHERE is_trial) AS trial_count
FROM v_txn_events WHERE is_subscription GROUP BY account_id""")
def q_flagged_insights(spark, d):
    return S.flagged_insights(V.txn_events(spark, d))


@register("category_totals", EV + """
SELECT account_id, category, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount
FROM v_txn_events GROUP BY account_id, category""")
def q_category_totals(spark, d):
    return S.category_totals(V.txn_events(spark, d))


@register("bank_totals", OR + """
SELECT account_id, bank, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount
FROM v_txn_orders GROUP BY account_id, bank""")
def q_bank_totals(spark, d):
    return S.bank_totals(V.txn_orders(spark, d))


@register("month_category", OR + """
SELECT account_id, strftime(local_ts, '%Y-%m') AS month, category,
       CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount
FROM v_txn_orders GROUP BY ALL""", headline=True)
def q_month_category(spark, d):
    return S.month_category(V.txn_orders(spark, d))


@register("weekday_week_heatmap", EV + """
SELECT account_id, CAST(isodow(local_ts) AS INTEGER) AS weekday_ord, dayname(local_ts) AS weekday,
       CAST(week(local_ts) AS INTEGER) AS week, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount
FROM v_txn_events GROUP BY ALL""")
def q_weekday_week_heatmap(spark, d):
    return S.weekday_week_heatmap(V.txn_events(spark, d))


@register("hourly", EV + """
SELECT account_id, CAST(hour(local_ts) AS INTEGER) AS hour, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount
FROM v_txn_events GROUP BY ALL""")
def q_hourly(spark, d):
    return S.hourly(V.txn_events(spark, d))


@register("timeline", EV + """
SELECT account_id, message_id, local_ts, CAST(amount_numeric AS DOUBLE) AS amount, category
FROM v_txn_events""")
def q_timeline(spark, d):
    return S.timeline(V.txn_events(spark, d))


@register("top5_categories", OR + """
, t AS (SELECT account_id, category, SUM(amount_numeric) AS s FROM v_txn_orders GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY s DESC, category ASC) AS rank,
               SUM(s) OVER (PARTITION BY account_id) AS tot FROM t)
SELECT account_id, category, CAST(rank AS INTEGER) AS rank, CAST(s AS DOUBLE) AS total_amount,
       CAST(s AS DOUBLE) / CAST(tot AS DOUBLE) * 100.0 AS share_pct
FROM r WHERE rank <= 5""", headline=True)
def q_top5_categories(spark, d):
    return S.top5_categories(V.txn_orders(spark, d))


@register("top5_merchants", OR + """
, t AS (SELECT account_id, merchant_name, SUM(amount_numeric) AS s FROM v_txn_orders GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY s DESC, merchant_name ASC) AS rank FROM t)
SELECT account_id, merchant_name, CAST(rank AS INTEGER) AS rank, CAST(s AS DOUBLE) AS total_amount
FROM r WHERE rank <= 5""")
def q_top5_merchants(spark, d):
    return S.top5_merchants(V.txn_orders(spark, d))


@register("month_over_month", OR + """
, m AS (SELECT account_id, strftime(local_ts, '%Y-%m') AS month, SUM(amount_numeric) AS s
        FROM v_txn_orders GROUP BY ALL)
, x AS (SELECT *, lag(month) OVER (PARTITION BY account_id ORDER BY month) AS prev_month,
               lag(s) OVER (PARTITION BY account_id ORDER BY month) AS prev_s,
               row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS r FROM m)
SELECT account_id, month AS latest_month, CAST(s AS DOUBLE) AS latest_amount, prev_month,
       CAST(prev_s AS DOUBLE) AS prev_amount,
       (CAST(s AS DOUBLE) - CAST(prev_s AS DOUBLE)) / CAST(prev_s AS DOUBLE) * 100.0 AS change_pct
FROM x WHERE r = 1 AND prev_month IS NOT NULL""", headline=True)
def q_month_over_month(spark, d):
    return S.month_over_month(V.txn_orders(spark, d))


@register("weekend_vs_weekday", EV + """
SELECT account_id,
  CAST(SUM(amount_numeric) FILTER (WHERE isodow(local_ts) >= 6) AS DOUBLE)
    / CAST(COUNT(amount_numeric) FILTER (WHERE isodow(local_ts) >= 6) AS DOUBLE) AS weekend_avg,
  CAST(SUM(amount_numeric) FILTER (WHERE isodow(local_ts) < 6) AS DOUBLE)
    / CAST(COUNT(amount_numeric) FILTER (WHERE isodow(local_ts) < 6) AS DOUBLE) AS weekday_avg
FROM v_txn_events GROUP BY account_id""")
def q_weekend_vs_weekday(spark, d):
    return S.weekend_vs_weekday(V.txn_events(spark, d))


def _event_records(spark, d):
    """Raw records of the event stand-in with amount as text and one run per
    account and day (runs are what the reference logs)."""
    t = V.txn_events(spark, d)
    return t.select("account_id", F.date_format("local_ts", "yyyy-MM-dd").alias("run_id"),
                    F.col("amount_numeric").cast("string").alias("amount"), "is_subscription")


@register("run_totals", EV + """
, runs AS (SELECT account_id, strftime(local_ts, '%Y-%m-%d') AS run_id,
                  SUM(amount_numeric) AS amount_detected, COUNT(*) FILTER (WHERE is_subscription) AS subs
           FROM v_txn_events GROUP BY ALL)
SELECT account_id, COUNT(*) AS runs, CAST(SUM(amount_detected) AS DOUBLE) AS total_amount_detected,
       CAST(SUM(subs) AS BIGINT) AS total_subscriptions_detected
FROM runs GROUP BY account_id""")
def q_run_totals(spark, d):
    return S.run_totals(S.run_log(_event_records(spark, d)))


@register("run_log_append", EV + """
SELECT account_id, strftime(local_ts, '%Y-%m-%d') AS run_id, CAST(SUM(amount_numeric) AS DOUBLE) AS amount_detected,
       COUNT(*) FILTER (WHERE is_subscription) AS subscriptions_detected
FROM v_txn_events GROUP BY ALL""")
def q_run_log_append(spark, d):
    """The daily runs appended in two parts, the first one twice, and read back."""
    runs = S.run_log(_event_records(spark, d))
    path = scratch_path(spark, "runs")
    early = F.col("run_id") < "2024-01-16"
    for part in (early, ~early, early):
        S.append_runs(path, runs.where(part))
    back = S.read_runs(spark, path, runs.schema)
    return back.withColumn("amount_detected", F.col("amount_detected").cast("double"))


def _user_runs(spark, d):
    """Records of single users, three runs a month."""
    t = V.table(spark, d, "events")
    day = F.dayofmonth("ts")
    run = F.when(day <= 10, "2024-01-a").when(day <= 20, "2024-01-b").otherwise("2024-01-c")
    return t.select(F.col("user_id").cast("string").alias("account_id"), run.alias("run_id"))


@register("accounts_seen", """
WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT COUNT(*) AS exact_users, true AS within_error FROM u""")
def q_accounts_seen(spark, d):
    """A sketch per run, one run appended twice, against the full recount."""
    records = _user_runs(spark, d)
    path = scratch_path(spark, "sketches")
    sketches = S.account_sketches(records)
    for part in ("2024-01-b", "2024-01-a", "2024-01-c", "2024-01-a"):
        S.append_runs(path, sketches.where(F.col("run_id") == part))
    guess = S.accounts_seen(S.read_runs(spark, path, sketches.schema)).select(F.lit(None).cast("long").alias("exact_users"), "total_users")
    exact = S.distinct_accounts(records).select(F.col("total_users").alias("exact_users"), F.lit(None).cast("long").alias("total_users"))
    both = exact.unionByName(guess).agg(F.max("exact_users").alias("exact_users"), F.max("total_users").alias("total_users"))
    near = F.abs(F.col("total_users") - F.col("exact_users")) <= S.SEEN_ERROR * F.col("exact_users")
    return both.select("exact_users", near.alias("within_error"))


@register("new_accounts", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS account_id,
                  CASE WHEN day(ts) <= 10 THEN '2024-01-a' WHEN day(ts) <= 20 THEN '2024-01-b' ELSE '2024-01-c' END AS run_id FROM events)
SELECT account_id, min(run_id) AS run_id FROM r GROUP BY account_id""")
def q_new_accounts(spark, d):
    """The accounts that each run saw first; the second run is repeated."""
    records = _user_runs(spark, d)
    path = scratch_path(spark, "accounts")
    schema = "account_id string, run_id string"
    S.append_runs(path, spark.createDataFrame([], schema))
    for part in ("2024-01-a", "2024-01-b", "2024-01-b", "2024-01-c"):
        seen = S.read_runs(spark, path, schema)
        found = S.new_accounts(records.where(F.col("run_id") == part), seen)
        S.append_runs(path, found)
    return S.read_runs(spark, path, schema)


@register("distinct_accounts", """
SELECT COUNT(DISTINCT user_id % 10) AS total_users FROM events""")
def q_distinct_accounts(spark, d):
    return S.distinct_accounts(V.txn_events(spark, d))


@register("category_brand_color", SB + """
SELECT account_id, COALESCE(category, 'Other') AS category,
       COALESCE(arg_min(COALESCE(brand_color, '#007bff'), CASE WHEN category IS NOT NULL THEN seq END),
                '#007bff') AS color
FROM v_subs WHERE COALESCE(status, 'Active') IN ('Active', 'Trial') GROUP BY ALL""")
def q_category_brand_color(spark, d):
    return S.category_brand_color(V.subs(spark, d))
