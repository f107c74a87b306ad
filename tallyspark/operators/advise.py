"""Rule-based recommendations (I1-I5) and the README-only analytics.

Recommendations are computed from one row of conditional aggregates per
account (transactions) joined with one row per account (ledger); the rules
become an array column that is filtered and exploded, with a single
'balanced' row when nothing fires.  Threshold tests use exact DECIMAL
arithmetic (cross-multiplied), so no boundary case depends on rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import over_rows_before
from .metrics import live, recurring_vs_onetime, yearly_cost

KEYS = ("account_id",)

# One sentence per rule, stating what the rule found.
MESSAGES = {
    "top_category": "{subject} takes more than 30% of the total",
    "small_transactions": "Over half of the payments are below 100",
    "trials": "{value} entries of the ledger are trials",
    "weekend": "The mean weekend payment exceeds the mean weekday payment by more than 50%",
    "balanced": "No rule fired for this account",
}


def _msg(rule: str):
    t = MESSAGES[rule]
    parts = t.split("{subject}") if "{subject}" in t else None
    if parts:
        return F.concat(F.lit(parts[0]), F.col("_subject"), F.lit(parts[1]))
    if "{value}" in t:
        a, b = t.split("{value}")
        return F.concat(F.lit(a), F.col("_value").cast("long").cast("string"), F.lit(b))
    return F.lit(t)


def recommendations(txns: DataFrame, subs: DataFrame, keys=KEYS) -> DataFrame:
    """I1-I5 per account of ``txns``: (account_id, rule_id, subject, value,
    message).  I3 reads the ledger of the same account."""
    a = F.col("amount_numeric")
    we = F.weekday("local_ts") >= 5
    cat = txns.groupBy(*keys, "category").agg(F.sum(a).alias("s"))
    w = Window.partitionBy(*keys).orderBy(F.col("s").desc(), F.col("category").asc())
    top = (cat.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
           .select(*keys, F.col("category").alias("top_category"), F.col("s").alias("top_sum")))
    agg = txns.groupBy(*keys).agg(
        F.sum(a).alias("total"), F.count(a).alias("n"), F.count_if(a < 100).alias("small"),
        F.sum(F.when(we, a)).alias("we_sum"), F.count(F.when(we, a)).alias("we_n"),
        F.sum(F.when(~we, a)).alias("wd_sum"), F.count(F.when(~we, a)).alias("wd_n"))
    trials = subs.groupBy(*keys).agg(F.count_if(F.col("is_trial") == F.lit(True)).alias("trial_subs"))
    j = agg.join(top, list(keys), "left").join(trials, list(keys), "left")
    # Exact tests: top > 30 % of total; small > half; weekend mean > 1.5 x weekday mean.
    i1 = F.coalesce(F.col("top_sum") * 10 > F.col("total") * 3, F.lit(False))
    i2 = F.col("small") * 2 > F.col("n")
    i3 = F.coalesce(F.col("trial_subs") > 0, F.lit(False))
    i4 = F.coalesce((F.col("we_n") > 0) & (F.col("wd_n") > 0) &
                    (F.col("we_sum") * F.col("wd_n") * 2 > F.col("wd_sum") * F.col("we_n") * 3), F.lit(False))
    share = F.col("top_sum").cast("double") / F.col("total").cast("double") * 100.0
    ratio = F.try_divide(F.try_divide(F.col("we_sum").cast("double"), F.col("we_n").cast("double")),
                         F.try_divide(F.col("wd_sum").cast("double"), F.col("wd_n").cast("double")))

    def rule(rid, cond, subject, value):
        return F.when(cond, F.struct(F.lit(rid).alias("rule_id"), subject.cast("string").alias("subject"),
                                     value.cast("double").alias("value")))

    arr = F.array(rule("top_category", i1, F.col("top_category"), share),
                  rule("small_transactions", i2, F.lit(None), F.col("small")),
                  rule("trials", i3, F.lit(None), F.col("trial_subs")),
                  rule("weekend", i4, F.lit(None), ratio))
    fired = F.filter(arr, lambda r: r.isNotNull())
    balanced = F.array(F.struct(F.lit("balanced").alias("rule_id"), F.lit(None).cast("string").alias("subject"),
                                F.lit(None).cast("double").alias("value")))
    out = j.select(*keys, F.explode(F.when(F.size(fired) > 0, fired).otherwise(balanced)).alias("r"))
    out = out.select(*keys, "r.rule_id", F.col("r.subject").alias("_subject"), F.col("r.value").alias("_value"))
    msg = F.when(F.col("rule_id") == "top_category", _msg("top_category")) \
        .when(F.col("rule_id") == "small_transactions", _msg("small_transactions")) \
        .when(F.col("rule_id") == "trials", _msg("trials")) \
        .when(F.col("rule_id") == "weekend", _msg("weekend")) \
        .otherwise(_msg("balanced"))
    return out.select(*keys, "rule_id", F.col("_subject").alias("subject"), F.col("_value").alias("value"),
                      msg.alias("message"))


# ----------------------------------------------------------------------------- J

def duplicate_services(subs: DataFrame, keys=KEYS) -> DataFrame:
    """Categories holding more than one distinct (case-blind) live service:
    one row per service with the number of services of its category."""
    names = live(subs).select(*keys, "category", F.lower("service_name").alias("service")).filter("service is not null").distinct()
    group = [*keys, "category"]
    many = (names.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.count("*").alias("n_services"))
            .filter("n_services > 1"))
    return (names.join(many, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
            .select(*group, "n_services", "service"))


def _spikes(df: DataFrame, keys, day: Column, k: float) -> DataFrame:
    """Charges above mean + k * sample sd, from the sums of a window (``ws``,
    ``wss``, ``wn``) of two charges or more."""
    n = F.col("wn").cast("decimal(20,0)")
    var_num = (n * F.col("wss") - F.col("ws") * F.col("ws")).cast("double")
    var = var_num / (F.col("wn").cast("double") * (F.col("wn") - 1).cast("double"))
    amount = F.col("amount_numeric").cast("double")
    out = (df.filter("wn >= 2").withColumn("window_mean", F.col("ws").cast("double") / F.col("wn").cast("double"))
           .withColumn("window_sd", F.sqrt(F.greatest(var, F.lit(0.0)))))
    return out.filter(amount > F.col("window_mean") + k * F.col("window_sd")).select(
        *keys, "message_id", "category", day.alias("day"), amount.alias("amount"), "window_mean", "window_sd")


def spend_spikes(txns: DataFrame, keys=KEYS, rows: int = 30, k: float = 3.0, block_rows: int = 1_000_000) -> DataFrame:
    """Charges above mean + k * sample sd of the ``rows`` charges before
    them in the same account and category (charges without a category are a
    group), in order of (event_ts, message_id, amount); local_ts where event_ts is absent.

    The row frame is split along time, so a hot category is many tasks; sums are
    exact DECIMALs."""
    a = F.col("amount_numeric")
    sums = {"ws": F.sum(a), "wss": F.sum(a * a), "wn": F.count(a)}
    at = "event_ts" if "event_ts" in txns.columns else "local_ts"
    t = txns.select(*keys, "message_id", "category", "local_ts", F.col(at).alias("_at"), "amount_numeric")
    out = over_rows_before(t, [*keys, "category"], ["_at", "message_id", "amount_numeric"], rows, sums, block_rows)
    return _spikes(out, keys, F.to_date("local_ts"), k)


def spend_spikes_by_day(txns: DataFrame, keys=KEYS, days: int = 30, k: float = 3.0) -> DataFrame:
    """Charges above mean + k * sample sd of the same account and category
    over the ``days`` days before the charge's day.

    Skew-safe: the window runs over one pre-aggregated row per (account,
    category, day) with exact DECIMAL sums and sums of squares, never over the
    raw charges of a hot category; the charges are then joined back on
    (account, category, day)."""
    a = F.col("amount_numeric")
    d = F.to_date("local_ts")
    daily = txns.groupBy(*keys, "category", d.alias("day")).agg(
        F.sum(a).alias("s"), F.sum(a * a).alias("ss"), F.count(a).alias("n"))
    dn = F.unix_date("day")
    w = Window.partitionBy(*keys, "category").orderBy(dn).rangeBetween(-days, -1)
    sums = daily.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "category", "day")], F.sum("s").over(w).alias("ws"),
                        F.sum("ss").over(w).alias("wss"), F.sum("n").over(w).alias("wn"))
    t = txns.withColumn("day", d).join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "category", "day")])
    return _spikes(t, keys, F.col("day"), k)


def trial_savings(subs: DataFrame, keys=KEYS) -> DataFrame:
    """Yearly cost of the subscriptions currently in trial."""
    return subs.filter(F.col("status") == "Trial").groupBy(*keys).agg(
        F.count("*").alias("trial_count"), F.sum(yearly_cost(exact=True)).cast("double")
        .alias("potential_yearly_savings"))


def high_subscription_share(txns: DataFrame, subs: DataFrame, threshold_pct: float = 50.0, as_of=None,
                            keys=KEYS) -> DataFrame:
    """Accounts whose subscriptions exceed ``threshold_pct`` of monthly spend."""
    r = recurring_vs_onetime(txns, subs, as_of, keys)
    return r.filter(F.col("subscription_ratio_pct") > threshold_pct)


def monthly_rates(rates: DataFrame) -> DataFrame:
    """Validity intervals [rate_date, next rate_date) per currency."""
    w = Window.partitionBy("currency").orderBy("rate_date")
    return rates.withColumn("valid_to", F.lead("rate_date").over(w))


def convert_currency(txns: DataFrame, rates: DataFrame, keys=KEYS) -> DataFrame:
    """Amount x the latest rate dated on or before the charge's local
    date (as-of join); no earlier rate -> NULL.

    Closed rate intervals [rate_date, next rate_date) are expanded into the
    months they cover and charges join on (currency, month) plus the exact
    interval test; the open last interval of each currency (one row per
    currency) joins on currency.  Both are left equi-joins that Spark can
    shuffle or broadcast as AQE sees fit; no cross join, no window over the
    charges."""
    iv = monthly_rates(rates)
    closed = iv.filter(F.col("valid_to").isNotNull())
    start = F.trunc("rate_date", "month")
    months = F.sequence(start, F.trunc("valid_to", "month"), F.expr("INTERVAL 1 MONTH"))
    buckets = closed.select(F.col("currency").alias("_c1"), F.col("rate_date").alias("_d1"),
                            F.col("valid_to").alias("_v1"), F.col("rate").alias("_r1"),
                            F.explode(months).alias("_b1"))
    open_ = iv.filter(F.col("valid_to").isNull()).select(F.col("currency").alias("_c2"),
                                                         F.col("rate_date").alias("_d2"), F.col("rate").alias("_r2"))
    t = txns.withColumn("_day", F.to_date("local_ts")).withColumn("_bucket", F.trunc("_day", "month"))
    j1 = t.join(buckets, (t.currency == buckets._c1) & (t._bucket == buckets._b1) &
                (t._day >= buckets._d1) & (t._day < buckets._v1), "left")
    j2 = j1.join(open_, (j1.currency == open_._c2) & (j1._day >= open_._d2), "left")
    rate_date = F.coalesce("_d1", "_d2")
    rate = F.coalesce("_r1", "_r2")
    return j2.select(*keys, "message_id", "currency", F.col("amount_numeric").cast("double").alias("amount"),
                     rate_date.alias("rate_date"), rate.cast("double").alias("rate"),
                     (F.col("amount_numeric") * rate).cast("double").alias("converted_amount"))


def weekly_trend(txns: DataFrame, keys=KEYS) -> DataFrame:
    """Spend per calendar week (weeks start on Monday)."""
    return txns.groupBy(*keys, F.to_date(F.date_trunc("week", "local_ts")).alias("week_start")).agg(
        F.sum("amount_numeric").cast("double").alias("total_amount"), F.count("*").alias("txn_count"))
