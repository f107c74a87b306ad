"""Registered queries for the subscription ledger (G) and metrics (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import metrics as M
from . import standins as V
from .catalog import register
from .q_recur import _enrich_sql, _sid

AS_OF = V.AS_OF
SUBS = V.with_ctes(V.SQL_SUBS)
LED = V.with_ctes(V.SQL_SUBS, V.SQL_LEDGER)


def _money(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


@register("merge_subscriptions", V.with_ctes(V.SQL_SUBS, V.SQL_LEDGER, V.SQL_DETECTED) + """
, cand AS (SELECT d.*, lower(d.service_name) AS nk FROM v_det d
           WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.account_id = d.account_id
                             AND lower(l.service_name) = lower(d.service_name)))
, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, nk ORDER BY nk, amount, id) AS r
                            FROM cand) WHERE r = 1)
, top AS (SELECT account_id, MAX(seq) AS m FROM v_ledger GROUP BY account_id)
, new AS (SELECT f.account_id, f.id, COALESCE(t.m, 0) + row_number() OVER (PARTITION BY f.account_id
                 ORDER BY f.nk, f.amount, f.id) AS seq, f.service_name, f.amount, f.status
          FROM firsts f LEFT JOIN top t USING (account_id))
SELECT account_id, id, seq, service_name, CAST(amount AS DOUBLE) AS amount, status FROM v_ledger
UNION ALL
SELECT account_id, id, seq, service_name, CAST(amount AS DOUBLE) AS amount, status FROM new""")
def q_merge_subscriptions(spark, d):
    m = L.merge_subscriptions(V.ledger_base(spark, d), V.detected_slice(spark, d))
    return _money(m.select("account_id", "id", "seq", "service_name", "amount", "status"), "amount")


@register("unique_ids", SUBS + """
SELECT account_id, seq, CASE WHEN r > 1 THEN id || '_dup_' || CAST(r - 1 AS VARCHAR) ELSE id END AS id
FROM (SELECT account_id, seq, lower(service_name) AS id,
             row_number() OVER (PARTITION BY account_id, lower(service_name) ORDER BY seq) AS r FROM v_subs)""")
def q_unique_ids(spark, d):
    s = V.subs(spark, d).withColumn("id", F.lower("service_name"))
    return L.unique_ids(s).select("account_id", "seq", "id")


_EA = _enrich_sql("service_name")


@register("ledger_add", V.with_ctes(V.SQL_SUBS, V.SQL_LEDGER, V.SQL_ADDS) + f"""
, top AS (SELECT account_id, MAX(seq) AS m FROM v_ledger GROUP BY account_id)
, a AS (SELECT a.*, (service_logo IS NULL OR brand_color IS NULL) AS need, amount <= 10 AS low,
               COALESCE(t.m, 0) + row_number() OVER (PARTITION BY a.account_id ORDER BY add_seq) AS seq
        FROM v_adds a LEFT JOIN top t USING (account_id))
SELECT account_id, id, seq, service_name, CAST(amount AS DOUBLE) AS amount, status, is_trial,
       CAST(NULL AS VARCHAR) AS trial_reason, category, CAST(NULL AS VARCHAR) AS service_logo, brand_color,
       CAST(NULL AS BOOLEAN) AS auto_detected
FROM v_ledger
UNION ALL
SELECT account_id, {_sid('manual', 'service_name', 'amount', 'CAST(account_id AS VARCHAR)')} AS id, seq,
       service_name, CAST(amount AS DOUBLE) AS amount, CASE WHEN low THEN 'Trial' ELSE status END AS status,
       low AS is_trial,
       CASE WHEN low THEN 'Low amount (₹' || format('{{:.2f}}', CAST(amount AS DOUBLE)) || ')' END AS trial_reason,
       CASE WHEN need AND COALESCE(category, '') = '' THEN {_EA['category']} ELSE category END AS category,
       CASE WHEN need THEN {_EA['logo']} ELSE service_logo END AS service_logo,
       CASE WHEN need THEN {_EA['color']} ELSE brand_color END AS brand_color, false AS auto_detected
FROM a""")
def q_ledger_add(spark, d):
    out = L.ledger_add(L.conform(V.ledger_base(spark, d)), V.ledger_adds(spark, d))
    return _money(out.select("account_id", "id", "seq", "service_name", "amount", "status", "is_trial",
                             "trial_reason", "category", "service_logo", "brand_color", "auto_detected"), "amount")


_EN = _enrich_sql("n_service_name")


@register("ledger_update", V.with_ctes(V.SQL_SUBS, V.SQL_LEDGER, V.SQL_EDITS) + f"""
, j AS (SELECT l.*, e.n_amount, e.n_service_name, e.n_status, e.n_category,
               (e.n_amount IS NOT NULL AND e.n_amount <= 10 AND NOT COALESCE(l.is_trial, false)) AS to_trial,
               (e.n_amount IS NOT NULL AND e.n_amount > 10 AND COALESCE(l.is_trial, false)) AS to_active,
               (e.n_service_name IS NOT NULL AND e.n_service_name <> l.service_name) AS renamed
        FROM v_ledger l LEFT JOIN v_edits e USING (account_id, id))
SELECT account_id, id, COALESCE(n_service_name, service_name) AS service_name,
       CAST(COALESCE(n_amount, amount) AS DOUBLE) AS amount,
       CASE WHEN to_trial THEN 'Trial' WHEN to_active THEN 'Active' ELSE COALESCE(n_status, status) END AS status,
       CASE WHEN to_trial THEN true WHEN to_active THEN false ELSE is_trial END AS is_trial,
       CASE WHEN to_trial THEN 'Low amount (₹' || format('{{:.2f}}', CAST(n_amount AS DOUBLE)) || ')' END AS trial_reason,
       CASE WHEN renamed THEN {_EN['category']} ELSE COALESCE(n_category, category) END AS category,
       CASE WHEN renamed THEN {_EN['logo']} END AS service_logo,
       CASE WHEN renamed THEN {_EN['color']} ELSE brand_color END AS brand_color
FROM j""")
def q_ledger_update(spark, d):
    out, _unmatched = L.ledger_update(L.conform(V.ledger_base(spark, d)), V.ledger_edits(spark, d))
    return _money(out.select("account_id", "id", "service_name", "amount", "status", "is_trial", "trial_reason",
                             "category", "service_logo", "brand_color"), "amount")


@register("ledger_update_unmatched", V.with_ctes(V.SQL_SUBS, V.SQL_LEDGER, V.SQL_EDITS) + """
SELECT account_id, id FROM v_edits e
WHERE NOT EXISTS (SELECT 1 FROM v_ledger l WHERE l.account_id = e.account_id AND l.id = e.id)""")
def q_ledger_update_unmatched(spark, d):
    _out, unmatched = L.ledger_update(L.conform(V.ledger_base(spark, d)), V.ledger_edits(spark, d))
    return unmatched.select("account_id", "id")


_ES = _enrich_sql("e.n_service_name")
_TO_TRIAL = "(e.n_amount IS NOT NULL AND e.n_amount <= 10 AND NOT COALESCE(f.is_trial, false))"
_TO_ACTIVE = "(e.n_amount IS NOT NULL AND e.n_amount > 10 AND COALESCE(f.is_trial, false))"
_RENAMED = "(e.n_service_name IS NOT NULL AND e.n_service_name IS DISTINCT FROM f.service_name)"


@register("ledger_update_sequence", V.with_ctes(V.SQL_SUBS, V.SQL_LEDGER, V.SQL_EDIT_LOG).replace("WITH", "WITH RECURSIVE", 1) + f"""
, e AS (SELECT *, row_number() OVER (PARTITION BY account_id, id ORDER BY edit_seq) AS n FROM v_edit_log)
, f AS (SELECT CAST(0 AS BIGINT) AS n, account_id, id, service_name, amount, status, is_trial, CAST(NULL AS VARCHAR) AS trial_reason,
               category, CAST(NULL AS VARCHAR) AS service_logo, brand_color FROM v_ledger
        UNION ALL
        SELECT e.n, f.account_id, f.id, COALESCE(e.n_service_name, f.service_name), COALESCE(e.n_amount, f.amount),
               CASE WHEN {_TO_TRIAL} THEN 'Trial' WHEN {_TO_ACTIVE} THEN 'Active' ELSE COALESCE(e.n_status, f.status) END,
               CASE WHEN {_TO_TRIAL} THEN true WHEN {_TO_ACTIVE} THEN false ELSE f.is_trial END,
               CASE WHEN {_TO_TRIAL} THEN 'Low amount (₹' || format('{{:.2f}}', CAST(e.n_amount AS DOUBLE)) || ')'
                    WHEN {_TO_ACTIVE} THEN NULL ELSE f.trial_reason END,
               CASE WHEN {_RENAMED} THEN {_ES['category']} ELSE COALESCE(e.n_category, f.category) END,
               CASE WHEN {_RENAMED} THEN {_ES['logo']} ELSE f.service_logo END,
               CASE WHEN {_RENAMED} THEN {_ES['color']} ELSE f.brand_color END
        FROM f JOIN e ON e.account_id = f.account_id AND e.id = f.id AND e.n = f.n + 1)
SELECT account_id, id, service_name, CAST(amount AS DOUBLE) AS amount, status, is_trial, trial_reason, category, service_logo, brand_color
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, id ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def q_ledger_update_sequence(spark, d):
    out, _unmatched = L.ledger_update(L.conform(V.ledger_base(spark, d)), V.ledger_edit_log(spark, d))
    return _money(out.select("account_id", "id", "service_name", "amount", "status", "is_trial", "trial_reason",
                             "category", "service_logo", "brand_color"), "amount")


@register("ledger_delete", LED + """
SELECT account_id, id FROM v_ledger WHERE seq % 10 <> 1""")
def q_ledger_delete(spark, d):
    led = V.ledger_base(spark, d)
    dels = led.filter(F.col("seq") % 10 == 1).select("account_id", "id")
    return L.ledger_delete(led, dels).select("account_id", "id")


@register("ledger_view", SUBS + """
SELECT account_id, id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, seq) AS INTEGER)
         AS view_rank
FROM v_subs WHERE COALESCE(status, 'Active') IN ('Active', 'Trial')""")
def q_ledger_view(spark, d):
    return L.ledger_view(V.subs(spark, d), sort="amount_desc").select("account_id", "id", "view_rank")


_NEXT = ("COALESCE(last_payment, start_date) + CAST(CASE billing_cycle WHEN 'Monthly' THEN 30 "
         "WHEN 'Quarterly' THEN 90 WHEN 'Yearly' THEN 365 ELSE 30 END AS INTEGER)")


def _view(sort: str, order: str) -> None:
    """Register the ledger view in another of its orders."""
    @register(f"ledger_view_{sort}", SUBS + f"""
SELECT account_id, id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY {order}, seq) AS INTEGER) AS view_rank
FROM v_subs WHERE COALESCE(status, 'Active') IN ('Active', 'Trial')""")
    def q(spark, d):
        return L.ledger_view(V.subs(spark, d), sort=sort).select("account_id", "id", "view_rank")


_view("amount_asc", "amount")
_view("name", "service_name")
_view("next_payment", f"{_NEXT} NULLS FIRST")


# ----------------------------------------------------------------------------- H

_M = ("CASE billing_cycle WHEN 'Quarterly' THEN CAST(amount AS DOUBLE) / 3.0 "
      "WHEN 'Yearly' THEN CAST(amount AS DOUBLE) / 12.0 ELSE CAST(amount AS DOUBLE) END")
_LIVE = "COALESCE(status, 'Active') IN ('Active', 'Trial')"
_MSUM = ("CAST(COALESCE(SUM(amount) FILTER (WHERE billing_cycle NOT IN ('Quarterly', 'Yearly') "
         "OR billing_cycle IS NULL), 0) AS DOUBLE) "
         "+ CAST(COALESCE(SUM(amount) FILTER (WHERE billing_cycle = 'Quarterly'), 0) AS DOUBLE) / 3.0 "
         "+ CAST(COALESCE(SUM(amount) FILTER (WHERE billing_cycle = 'Yearly'), 0) AS DOUBLE) / 12.0")
_TOT = (f"tot AS (SELECT account_id, {_MSUM} AS tm FROM (SELECT account_id, billing_cycle, "
        f"CASE WHEN {_LIVE} THEN amount END AS amount FROM v_subs) GROUP BY account_id)")


@register("monthly_equivalent", SUBS + f"SELECT account_id, id, {_M} AS monthly_amount FROM v_subs")
def q_monthly_equivalent(spark, d):
    return V.subs(spark, d).select("account_id", "id", M.monthly_equivalent().alias("monthly_amount"))


@register("subscription_totals", SUBS + f", {_TOT}\n" + """
SELECT account_id, tm AS total_monthly, tm * 12.0 AS total_yearly, 3 AS months_remaining, tm * 3 AS remaining_year
FROM tot""", headline=True)
def q_subscription_totals(spark, d):
    return M.subscription_totals(V.subs(spark, d), AS_OF)


@register("status_counts", SUBS + """
SELECT account_id, COUNT(*) FILTER (WHERE status = 'Active') AS active_count,
       COUNT(*) FILTER (WHERE status = 'Inactive') AS inactive_count,
       COUNT(*) FILTER (WHERE status = 'Trial') AS trial_count
FROM v_subs GROUP BY account_id""")
def q_status_counts(spark, d):
    return M.status_counts(V.subs(spark, d))


@register("monthly_by_service", SUBS + f"""
SELECT account_id, service_name, arg_max({_M}, seq) AS monthly_amount
FROM v_subs WHERE {_LIVE} GROUP BY ALL""")
def q_monthly_by_service(spark, d):
    return M.monthly_by_service(V.subs(spark, d))


@register("monthly_by_category", SUBS + f"""
SELECT account_id, COALESCE(category, 'Other') AS category, {_MSUM} AS monthly_amount
FROM v_subs WHERE {_LIVE} GROUP BY ALL""")
def q_monthly_by_category(spark, d):
    return M.monthly_by_category(V.subs(spark, d))


_Y = ("CAST(CASE billing_cycle WHEN 'Monthly' THEN amount * 12 WHEN 'Quarterly' THEN amount * 4 "
      "WHEN 'Yearly' THEN amount ELSE amount * 12 END AS DOUBLE)")


@register("yearly_cost", SUBS + f"SELECT account_id, id, {_Y} AS yearly_cost FROM v_subs")
def q_yearly_cost(spark, d):
    return V.subs(spark, d).select("account_id", "id", M.yearly_cost().alias("yearly_cost"))


@register("next_payment", SUBS + f"SELECT account_id, id, {_NEXT} AS next_payment FROM v_subs")
def q_next_payment(spark, d):
    return V.subs(spark, d).select("account_id", "id", M.next_payment().alias("next_payment"))


@register("due_status", SUBS + f"""
SELECT account_id, id, CAST(date_diff('day', DATE '{AS_OF}', {_NEXT}) AS INTEGER) AS days_until,
       CASE WHEN date_diff('day', DATE '{AS_OF}', {_NEXT}) < 0 THEN 'Overdue'
            WHEN date_diff('day', DATE '{AS_OF}', {_NEXT}) <= 7 THEN 'Due Soon' ELSE 'Scheduled' END AS due_status
FROM v_subs""")
def q_due_status(spark, d):
    s = M.payment_schedule(V.subs(spark, d), AS_OF)
    return s.select("account_id", "id", "days_until", "due_status")


@register("cumulative_projection", SUBS + f", {_TOT}\n" + """
SELECT account_id, CAST(m AS INTEGER) AS month, tm * m AS cumulative, m = 10 AS is_current
FROM tot, range(1, 13) r(m)""")
def q_cumulative_projection(spark, d):
    return M.cumulative_projection(V.subs(spark, d), AS_OF)


_RVO = V.with_ctes(V.SQL_SUBS, V.SQL_TXN_EVENTS) + f", {_TOT}" + """
, tx AS (SELECT account_id, CAST(SUM(amount_numeric) AS DOUBLE)
                / CAST(greatest(COUNT(DISTINCT strftime(local_ts, '%Y-%m')), 1) AS DOUBLE) AS spend
         FROM v_txn_events GROUP BY account_id)
, has AS (SELECT DISTINCT account_id FROM v_subs)
, r AS (SELECT h.account_id, COALESCE(t.tm, 0.0) AS sub, tx.spend FROM has h LEFT JOIN tot t USING (account_id)
        JOIN tx USING (account_id))
"""


@register("recurring_vs_onetime", _RVO + """
SELECT account_id, sub AS subscription_monthly, spend AS monthly_spend,
       greatest(spend - sub, 0.0) AS one_time_monthly,
       CASE WHEN sub > 0 THEN sub / spend * 100.0 END AS subscription_ratio_pct
FROM r""")
def q_recurring_vs_onetime(spark, d):
    return M.recurring_vs_onetime(V.txn_events(spark, d), V.subs(spark, d), AS_OF)
