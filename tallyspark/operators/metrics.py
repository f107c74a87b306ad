"""Subscription metrics and projections (operators H1-H11).

Amounts stay DECIMAL; monthly totals are built as
``monthly + quarterly / 3 + yearly / 12`` from exact per-cycle DECIMAL sums and
divided once in DOUBLE, so totals do not depend on row order.  ``as_of`` is a
parameter wherever the reference reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R

KEYS = ("account_id",)


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def live(subs: DataFrame) -> DataFrame:
    """Active and trial subscriptions (a missing status counts as Active)."""
    return subs.filter(F.coalesce(F.col("status"), F.lit("Active")).isin("Active", "Trial"))


def monthly_equivalent(amount="amount", cycle="billing_cycle") -> Column:
    """H1: Quarterly / 3, Yearly / 12, anything else as is (DOUBLE)."""
    a = F.col(amount).cast("double") if isinstance(amount, str) else amount.cast("double")
    c = F.col(cycle) if isinstance(cycle, str) else cycle
    out = None
    for name, div in R.CYCLE_MONTH_DIVISOR.items():
        out = F.when(c == name, a / float(div)) if out is None else out.when(c == name, a / float(div))
    return out.otherwise(a)


def _monthly_sum(amount: str = "amount", cycle: str = "billing_cycle") -> Column:
    """Exact per-cycle sums combined once: sum(other) + sum(Q)/3 + sum(Y)/12."""
    a, c = F.col(amount), F.col(cycle)
    z = F.lit(0).cast("decimal(38,2)")
    q = F.coalesce(F.sum(F.when(c == "Quarterly", a)), z).cast("double")
    y = F.coalesce(F.sum(F.when(c == "Yearly", a)), z).cast("double")
    m = F.coalesce(F.sum(F.when(~c.isin("Quarterly", "Yearly") | c.isNull(), a)), z).cast("double")
    return m + q / 3.0 + y / 12.0


def months_remaining(as_of=None) -> Column:
    """H3: months left in the year including the current one."""
    return (F.lit(13) - F.month(_as_of(as_of))).cast("int")


def subscription_totals(subs: DataFrame, as_of=None, keys=KEYS) -> DataFrame:
    """H2/H3: monthly, yearly and rest-of-year totals over live subscriptions."""
    # summed over all rows with the others blanked, so that an account without a
    # live subscription keeps its row of zeros
    alive = F.coalesce(F.col("status"), F.lit("Active")).isin("Active", "Trial")
    t = (subs.withColumn("_amount", F.when(alive, F.col("amount"))).groupBy(*keys)
         .agg(_monthly_sum("_amount").alias("total_monthly")))
    return t.select(*keys, "total_monthly", (F.col("total_monthly") * 12.0).alias("total_yearly"),
                    months_remaining(as_of).alias("months_remaining"),
                    (F.col("total_monthly") * months_remaining(as_of)).alias("remaining_year"))


def status_counts(subs: DataFrame, keys=KEYS) -> DataFrame:
    """H4: counts by exact status (a missing status is counted nowhere)."""
    s = F.col("status")
    return subs.groupBy(*keys).agg(F.count_if(s == "Active").alias("active_count"),
                                   F.count_if(s == "Inactive").alias("inactive_count"),
                                   F.count_if(s == "Trial").alias("trial_count"))


def monthly_by_service(subs: DataFrame, keys=KEYS) -> DataFrame:
    """H5: monthly equivalent per service name; the last listed entry (highest
    ``seq``) wins for equal names, as the reference's dict does."""
    return live(subs).groupBy(*keys, "service_name").agg(
        F.max_by(monthly_equivalent(), F.col("seq")).alias("monthly_amount"))


def monthly_by_category(subs: DataFrame, keys=KEYS) -> DataFrame:
    """H6: monthly sums per category (missing category -> 'Other')."""
    return live(subs).groupBy(*keys, F.coalesce("category", F.lit("Other")).alias("category")).agg(
        _monthly_sum().alias("monthly_amount"))


def yearly_cost(amount="amount", cycle="billing_cycle", exact: bool = False) -> Column:
    """H7: Monthly x12, Quarterly x4, Yearly x1, anything else x12 (DOUBLE,
    or DECIMAL with ``exact``)."""
    a = F.col(amount) if isinstance(amount, str) else amount
    c = F.col(cycle) if isinstance(cycle, str) else cycle
    out = None
    for name, k in R.CYCLE_YEAR_FACTOR.items():
        out = F.when(c == name, a * k) if out is None else out.when(c == name, a * k)
    out = out.otherwise(a * 12)
    return out if exact else out.cast("double")


def next_payment(last="last_payment", start="start_date", cycle="billing_cycle") -> Column:
    """H8: last payment (else start) + 30 / 90 / 365 days, else 30."""
    base = F.coalesce(F.col(last), F.col(start))
    c = F.col(cycle)
    days = None
    for name, n in R.CYCLE_DAYS.items():
        days = F.when(c == name, F.lit(n)) if days is None else days.when(c == name, F.lit(n))
    return F.date_add(base, days.otherwise(F.lit(30)))


def due_status(next_col: Column, as_of=None) -> tuple[Column, Column]:
    """H9: (days until payment, 'Overdue' / 'Due Soon' / 'Scheduled')."""
    days = F.datediff(next_col, _as_of(as_of))
    st = F.when(days < 0, F.lit("Overdue")).when(days <= R.DUE_SOON_DAYS, F.lit("Due Soon")) \
        .otherwise(F.lit("Scheduled"))
    return days, st


def payment_schedule(subs: DataFrame, as_of=None, keys=KEYS) -> DataFrame:
    """H7-H9 per subscription."""
    nxt = next_payment()
    days, st = due_status(nxt, as_of)
    return subs.select(*keys, "id", "service_name", yearly_cost().alias("yearly_cost"),
                       nxt.alias("next_payment"), days.alias("days_until"), st.alias("due_status"))


def cumulative_projection(subs: DataFrame, as_of=None, keys=KEYS) -> DataFrame:
    """Month 1..12 x monthly total, with the current month marked."""
    t = subscription_totals(subs, as_of, keys)
    return t.select(*keys, "total_monthly", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select(
        *keys, "month", (F.col("total_monthly") * F.col("month")).alias("cumulative"),
        (F.col("month") == F.month(_as_of(as_of))).alias("is_current"))


def recurring_vs_onetime(txns: DataFrame, subs: DataFrame, as_of=None, keys=KEYS) -> DataFrame:
    """Monthly spend = transaction total / max(1, distinct months);
    one-time = max(0, spend - subscriptions); ratio only when subscriptions
    are positive.  Only accounts with a non-empty ledger get a row.  Both
    sides are one row per account before the join."""
    tx = txns.groupBy(*keys).agg(
        F.sum("amount_numeric").cast("double").alias("_total"),
        F.countDistinct(F.date_format("local_ts", "yyyy-MM")).alias("_months"))
    tx = tx.select(*keys, (F.col("_total") / F.greatest(F.col("_months"), F.lit(1)).cast("double"))
                   .alias("monthly_spend"))
    has = subs.groupBy(*keys).agg(F.count("*").alias("_n"))
    st = subscription_totals(subs, as_of, keys).select(*keys, "total_monthly")
    j = has.join(st, list(keys), "left").join(tx, list(keys), "inner")
    sub = F.coalesce(F.col("total_monthly"), F.lit(0.0))
    spend = F.col("monthly_spend")
    return j.select(*keys, sub.alias("subscription_monthly"), spend.alias("monthly_spend"),
                    F.greatest(spend - sub, F.lit(0.0)).alias("one_time_monthly"),
                    F.when(sub > 0, F.try_divide(sub, spend) * 100.0).alias("subscription_ratio_pct"))
