"""Registered queries for recommendations (I) and README analytics (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.amount import MONEY
from ..operators import advise as AD
from . import standins as V
from .catalog import register

AS_OF = V.AS_OF


def scaled_events(spark, d):
    """Event transactions with 'purchase' x3 (so a top category can pass 30 %)
    and Saturday/Sunday x2 in odd accounts (so the weekend rule can fire)."""
    t = V.txn_events(spark, d)
    a = F.col("amount_numeric")
    a = F.when(F.col("category") == "purchase", a * 3).otherwise(a)
    a = F.when((F.weekday("local_ts") >= 5) & (F.col("account_id") % 2 == 1), a * 2).otherwise(a)
    return t.withColumn("amount_numeric", a.cast(MONEY))


SQL_SCALED = """
v_scaled AS (
  SELECT * REPLACE (CAST(CASE WHEN isodow(local_ts) >= 6 AND account_id % 2 = 1
                              THEN a1 * 2 ELSE a1 END AS DECIMAL(18,2)) AS amount_numeric)
  FROM (SELECT *, CASE WHEN category = 'purchase' THEN amount_numeric * 3 ELSE amount_numeric END AS a1
        FROM v_txn_events))"""

_MSG = {k: v.replace("'", "''") for k, v in AD.MESSAGES.items()}


@register("recommendations", V.with_ctes(V.SQL_TXN_EVENTS, SQL_SCALED, V.SQL_SUBS) + f"""
, cat AS (SELECT account_id, category, SUM(amount_numeric) AS s FROM v_scaled GROUP BY ALL)
, top AS (SELECT account_id, category AS top_category, s AS top_sum FROM
          (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY s DESC, category) AS r FROM cat) WHERE r = 1)
, agg AS (SELECT account_id, SUM(amount_numeric) AS total, COUNT(amount_numeric) AS n,
                 COUNT(*) FILTER (WHERE amount_numeric < 100) AS small,
                 SUM(amount_numeric) FILTER (WHERE isodow(local_ts) >= 6) AS we_sum,
                 COUNT(amount_numeric) FILTER (WHERE isodow(local_ts) >= 6) AS we_n,
                 SUM(amount_numeric) FILTER (WHERE isodow(local_ts) < 6) AS wd_sum,
                 COUNT(amount_numeric) FILTER (WHERE isodow(local_ts) < 6) AS wd_n
          FROM v_scaled GROUP BY account_id)
, tr AS (SELECT account_id, COUNT(*) FILTER (WHERE is_trial) AS trial_subs FROM v_subs GROUP BY account_id)
, j AS (SELECT * FROM agg LEFT JOIN top USING (account_id) LEFT JOIN tr USING (account_id))
, fired AS (
  SELECT account_id, 'top_category' AS rule_id, top_category AS subject,
         CAST(top_sum AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 AS value FROM j WHERE top_sum * 10 > total * 3
  UNION ALL SELECT account_id, 'small_transactions', NULL, CAST(small AS DOUBLE) FROM j WHERE small * 2 > n
  UNION ALL SELECT account_id, 'trials', NULL, CAST(trial_subs AS DOUBLE) FROM j WHERE trial_subs > 0
  UNION ALL SELECT account_id, 'weekend', NULL,
         (CAST(we_sum AS DOUBLE) / CAST(we_n AS DOUBLE)) / (CAST(wd_sum AS DOUBLE) / CAST(wd_n AS DOUBLE))
         FROM j WHERE we_n > 0 AND wd_n > 0 AND we_sum * wd_n * 2 > wd_sum * we_n * 3)
, allr AS (SELECT * FROM fired UNION ALL
           SELECT account_id, 'balanced', NULL, NULL FROM j WHERE account_id NOT IN (SELECT account_id FROM fired))
SELECT account_id, rule_id, subject, value,
       CASE rule_id WHEN 'top_category' THEN replace('{_MSG['top_category']}', '{{subject}}', subject)
                    WHEN 'small_transactions' THEN '{_MSG['small_transactions']}'
                    WHEN 'trials' THEN replace('{_MSG['trials']}', '{{value}}', CAST(CAST(value AS BIGINT) AS VARCHAR))
                    WHEN 'weekend' THEN '{_MSG['weekend']}'
                    ELSE '{_MSG['balanced']}' END AS message
FROM allr""", headline=True)
def q_recommendations(spark, d):
    return AD.recommendations(scaled_events(spark, d), V.subs(spark, d))


@register("duplicate_services", V.with_ctes(V.SQL_SUBS) + """
SELECT account_id, category, CAST(len(s) AS BIGINT) AS n_services, unnest(s) AS service
FROM (SELECT account_id, category, list_distinct(list(lower(service_name))) AS s
      FROM v_subs WHERE COALESCE(status, 'Active') IN ('Active', 'Trial') GROUP BY ALL)
WHERE len(s) > 1""")
def q_duplicate_services(spark, d):
    return AD.duplicate_services(V.subs(spark, d))


@register("spend_spikes", V.with_ctes(V.SQL_TXN_EVENTS) + """
, w AS (SELECT *, SUM(amount_numeric) OVER f AS ws, SUM(amount_numeric * amount_numeric) OVER f AS wss, COUNT(amount_numeric) OVER f AS wn
        FROM v_txn_events
        WINDOW f AS (PARTITION BY account_id, category ORDER BY event_ts, message_id, amount_numeric ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
, thr AS (SELECT *, CAST(ws AS DOUBLE) / CAST(wn AS DOUBLE) AS window_mean,
                 sqrt(greatest(CAST(CAST(wn AS DECIMAL(20,0)) * wss - ws * ws AS DOUBLE)
                               / (CAST(wn AS DOUBLE) * CAST(wn - 1 AS DOUBLE)), 0.0)) AS window_sd
          FROM w WHERE wn >= 2)
SELECT account_id, message_id, category, CAST(local_ts AS DATE) AS day, CAST(amount_numeric AS DOUBLE) AS amount, window_mean, window_sd
FROM thr WHERE CAST(amount_numeric AS DOUBLE) > window_mean + 3.0 * window_sd""")
def q_spend_spikes(spark, d):
    return AD.spend_spikes(V.txn_events(spark, d))


@register("spend_spikes_by_day", V.with_ctes(V.SQL_TXN_EVENTS) + """
, daily AS (SELECT account_id, category, CAST(local_ts AS DATE) AS day, SUM(amount_numeric) AS s,
                   SUM(amount_numeric * amount_numeric) AS ss, COUNT(amount_numeric) AS n
            FROM v_txn_events GROUP BY ALL)
, w AS (SELECT a.account_id, a.category, a.day, SUM(b.s) AS ws, SUM(b.ss) AS wss, SUM(b.n) AS wn
        FROM daily a JOIN daily b ON a.account_id = b.account_id AND a.category = b.category
         AND b.day >= a.day - 30 AND b.day <= a.day - 1
        GROUP BY ALL HAVING SUM(b.n) >= 2)
, thr AS (SELECT account_id, category, day, CAST(ws AS DOUBLE) / CAST(wn AS DOUBLE) AS window_mean,
                 sqrt(greatest(CAST(CAST(wn AS DECIMAL(20,0)) * wss - ws * ws AS DOUBLE)
                               / (CAST(wn AS DOUBLE) * CAST(wn - 1 AS DOUBLE)), 0.0)) AS window_sd
          FROM w)
SELECT t.account_id, t.message_id, t.category, thr.day, CAST(t.amount_numeric AS DOUBLE) AS amount,
       thr.window_mean, thr.window_sd
FROM v_txn_events t JOIN thr ON t.account_id = thr.account_id AND t.category = thr.category
 AND CAST(t.local_ts AS DATE) = thr.day
WHERE CAST(t.amount_numeric AS DOUBLE) > thr.window_mean + 3.0 * thr.window_sd""")
def q_spend_spikes_by_day(spark, d):
    return AD.spend_spikes_by_day(V.txn_events(spark, d))


@register("trial_savings", V.with_ctes(V.SQL_SUBS) + """
SELECT account_id, COUNT(*) AS trial_count,
       CAST(SUM(CASE billing_cycle WHEN 'Monthly' THEN amount * 12 WHEN 'Quarterly' THEN amount * 4
                WHEN 'Yearly' THEN amount ELSE amount * 12 END) AS DOUBLE) AS potential_yearly_savings
FROM v_subs WHERE status = 'Trial' GROUP BY account_id""")
def q_trial_savings(spark, d):
    return AD.trial_savings(V.subs(spark, d))


def _rvo_sql():
    from .q_ledger import _RVO
    return _RVO


@register("high_subscription_share", _rvo_sql() + """
SELECT account_id, sub AS subscription_monthly, spend AS monthly_spend,
       greatest(spend - sub, 0.0) AS one_time_monthly, sub / spend * 100.0 AS subscription_ratio_pct
FROM r WHERE sub > 0 AND sub / spend * 100.0 > 1.0""")
def q_high_subscription_share(spark, d):
    return AD.high_subscription_share(V.txn_events(spark, d), V.subs(spark, d), 1.0, AS_OF)


def rates_from_orders(spark, d):
    """Monthly USD and EUR rates for the months present in orders (months
    divisible by 5 are missing, so the as-of lookup must reach back)."""
    o = V.table(spark, d, "orders")
    m = o.select(F.trunc(F.to_date("o_orderdate"), "month").alias("rate_date")).distinct()
    m = m.filter(F.month("rate_date") % 5 != 0)
    usd = m.select(F.lit("USD").alias("currency"), "rate_date",
                   (F.lit(80) + F.month("rate_date") * F.lit(0.25)).cast("decimal(10,4)").alias("rate"))
    eur = m.select(F.lit("EUR").alias("currency"), "rate_date",
                   (F.lit(90) + F.year("rate_date") % 10 * F.lit(0.5)).cast("decimal(10,4)").alias("rate"))
    return usd.unionByName(eur)


def orders_with_currency(spark, d):
    t = V.txn_orders(spark, d)
    k = F.col("message_id").cast("long") % 3
    return t.withColumn("currency", F.when(k == 0, "USD").when(k == 1, "EUR").otherwise("GBP"))


@register("convert_currency", V.with_ctes(V.SQL_TXN_ORDERS) + """
, m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS rate_date FROM orders
        WHERE month(o_orderdate) % 5 <> 0)
, rates AS (SELECT 'USD' AS currency, rate_date, CAST(80 + month(rate_date) * 0.25 AS DECIMAL(10,4)) AS rate FROM m
            UNION ALL
            SELECT 'EUR', rate_date, CAST(90 + year(rate_date) % 10 * 0.5 AS DECIMAL(10,4)) FROM m)
, t AS (SELECT *, CASE CAST(message_id AS BIGINT) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
               CAST(local_ts AS DATE) AS day FROM v_txn_orders)
SELECT t.account_id, t.message_id, t.currency, CAST(t.amount_numeric AS DOUBLE) AS amount,
       r.rate_date, CAST(r.rate AS DOUBLE) AS rate, CAST(t.amount_numeric * r.rate AS DOUBLE) AS converted_amount
FROM t ASOF LEFT JOIN rates r ON t.currency = r.currency AND t.day >= r.rate_date""")
def q_convert_currency(spark, d):
    return AD.convert_currency(orders_with_currency(spark, d), rates_from_orders(spark, d))


@register("weekly_trend", V.with_ctes(V.SQL_TXN_EVENTS) + """
SELECT account_id, CAST(date_trunc('week', local_ts) AS DATE) AS week_start,
       CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount, COUNT(*) AS txn_count
FROM v_txn_events GROUP BY ALL""")
def q_weekly_trend(spark, d):
    return AD.weekly_trend(V.txn_events(spark, d))
