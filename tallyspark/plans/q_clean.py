"""Registered queries for cleaning, filters, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as D
from . import standins as V
from .catalog import register

OR = V.with_ctes(V.SQL_TXN_ORDERS)
# Expected number for each amount text of the order stand-in, straight from
# the order columns: k=0 '-x' (parsed as negative), k=1 NULL (0), k=2 'abc' (0),
# k=3 '1.2.3' (not a number: NULL), else the total.
_EXPECTED = """
v_expect AS (
  SELECT v.*, CASE CAST(message_id AS BIGINT) % 10 WHEN 0 THEN -amount_numeric WHEN 1 THEN 0 WHEN 2 THEN 0
                   WHEN 3 THEN NULL ELSE amount_numeric END AS expected
  FROM v_txn_orders v)"""
ORX = V.with_ctes(V.SQL_TXN_ORDERS, _EXPECTED)


def _orders_text(spark, d):
    return V.txn_orders(spark, d).drop("amount_numeric")


@register("clean_amount", ORX + """
SELECT account_id, message_id, amount, CAST(expected AS DOUBLE) AS amount_numeric FROM v_expect""")
def q_clean_amount(spark, d):
    t = D.with_amount_numeric(_orders_text(spark, d))
    return t.select("account_id", "message_id", "amount", F.col("amount_numeric").cast("double"))


@register("positive_only", ORX + """
SELECT account_id, message_id, CAST(expected AS DOUBLE) AS amount_numeric FROM v_expect WHERE expected > 0""")
def q_positive_only(spark, d):
    t = D.positive_only(D.with_amount_numeric(_orders_text(spark, d)))
    return t.select("account_id", "message_id", F.col("amount_numeric").cast("double"))


MS = V.with_ctes(V.SQL_MSG)
_DATES = """
v_dates AS (
  SELECT account_id, message_id, o_orderkey,
         CASE WHEN o_orderkey % 50 = 7 THEN NULL
              WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 330 MINUTE
              WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 8 HOUR
              ELSE o_orderdate END AS event_ts,
         CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderdate END AS local_ts
  FROM v_msg)"""
MSD = V.with_ctes(V.SQL_MSG, _DATES)


def _dated(spark, d):
    return D.parse_dates(V.messages(spark, d), "date")


@register("parse_dates", MSD + """
SELECT account_id, message_id, event_ts, local_ts FROM v_dates""")
def q_parse_dates(spark, d):
    return _dated(spark, d).select("account_id", "message_id",
                                   F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "local_ts")


@register("drop_bad_dates", MSD + """
SELECT account_id, message_id, event_ts, local_ts FROM v_dates WHERE event_ts IS NOT NULL""")
def q_drop_bad_dates(spark, d):
    return D.drop_bad_dates(_dated(spark, d)).select(
        "account_id", "message_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "local_ts")


@register("newest_first", MSD + """
SELECT account_id, message_id, event_ts FROM v_dates WHERE event_ts IS NOT NULL
ORDER BY event_ts DESC, message_id""")
def q_newest_first(spark, d):
    return D.newest_first(D.drop_bad_dates(_dated(spark, d))).select(
        "account_id", "message_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"))


@register("date_range", MSD + """
SELECT account_id, message_id, local_ts FROM v_dates
WHERE CAST(local_ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def q_date_range(spark, d):
    t = D.date_range(D.drop_bad_dates(_dated(spark, d)), "1996-01-01", "1996-12-31")
    return t.select("account_id", "message_id", "local_ts")


@register("facet_filter", OR + """
SELECT account_id, message_id, category, bank, CAST(amount_numeric AS DOUBLE) AS amount_numeric
FROM v_txn_orders
WHERE category IN ('1-URGENT', '2-HIGH') AND bank IN ('BUILDING', 'MACHINERY')
  AND amount_numeric BETWEEN 10000 AND 200000""")
def q_facet_filter(spark, d):
    t = D.facet_filter(V.txn_orders(spark, d), ["1-URGENT", "2-HIGH"], ["BUILDING", "MACHINERY"], (10000, 200000))
    return t.select("account_id", "message_id", "category", "bank", F.col("amount_numeric").cast("double"))


@register("facet_domains", OR + """
SELECT account_id, facet, value, CAST(MIN(amount_numeric) AS DOUBLE) AS min_amount,
       CAST(MAX(amount_numeric) AS DOUBLE) AS max_amount
FROM (SELECT account_id, 'category' AS facet, category AS value, amount_numeric FROM v_txn_orders WHERE category IS NOT NULL
      UNION ALL SELECT account_id, 'bank', bank, amount_numeric FROM v_txn_orders WHERE bank IS NOT NULL
      UNION ALL SELECT account_id, 'amount', NULL, amount_numeric FROM v_txn_orders)
GROUP BY ALL""")
def q_facet_domains(spark, d):
    return D.facet_domains(V.txn_orders(spark, d))


@register("top20_with_rest", OR + """
, r AS (SELECT account_id, message_id,
               row_number() OVER (PARTITION BY account_id ORDER BY event_ts DESC, message_id) AS rank,
               COUNT(*) OVER (PARTITION BY account_id) AS n FROM v_txn_orders)
SELECT account_id, message_id, CAST(rank AS INTEGER) AS rank, greatest(n - 20, 0) AS rest FROM r WHERE rank <= 20""")
def q_top20_with_rest(spark, d):
    top, rest = D.top_with_rest(V.txn_orders(spark, d), 20)
    return top.select("account_id", "message_id", "rank").join(rest, "account_id")
