"""Recurring-charge detection (operators F1-F9).

One aggregate keyed by ``(account_id, path, key, amount)``: partial
aggregation on the map side means a merchant with millions of charges costs
one small row per task before the shuffle.  "First" attributes are the
earliest ``(event_ts, message_id)`` with a non-NULL value (``min_by`` with a
NULL ordering for NULL values), so the result does not depend on row order.
Everything after the aggregate is a narrow projection over the groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.classify import recurrence_trial, service_lookup
from ..functions.text import strip_unicode, title_case
from ..session import scratch_path

KEYS = ("account_id",)
DAY_MICROS = 86_400_000_000


def _first(col: str, order: Column) -> Column:
    """First non-NULL value of ``col`` in ``order``."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), order))


def elapsed_days(first_ts, last_ts) -> Column:
    """Whole elapsed 24-hour days between two instants (not calendar days)."""
    a = F.col(first_ts) if isinstance(first_ts, str) else first_ts
    b = F.col(last_ts) if isinstance(last_ts, str) else last_ts
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / F.lit(DAY_MICROS)).cast("long")


def cycle_band(avg_days: Column) -> Column:
    """'monthly' / 'quarterly' / 'yearly' when the mean gap is inside a band."""
    out = None
    for label, lo, hi in R.CYCLE_BANDS:
        c = avg_days.between(lo, hi)
        out = F.when(c, F.lit(label)) if out is None else out.when(c, F.lit(label))
    return out


def infer_cycle(count: Column, gap_days: Column, stated: Column) -> Column:
    """the stated cycle always wins; otherwise the gap band when there is
    more than one charge; otherwise monthly."""
    stated_ok = F.when(stated != "", stated)
    avg = F.try_divide(gap_days.cast("double"), (count - 1).cast("double"))
    pattern = F.when(count > 1, cycle_band(avg))
    return F.coalesce(stated_ok, pattern, F.lit(R.CYCLE_DEFAULT))


def subscription_id(prefix: str, name: Column, amount: Column, extra: Column) -> Column:
    """prefix + cleaned name + 8 hex digits of an md5 over name, cents
    and a discriminator.  Unlike the reference no wall clock enters, so ids
    are stable across runs."""
    clean = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    cents = F.coalesce((amount * 100).cast("long"), F.lit(0)).cast("string")
    h = F.substring(F.md5(F.concat_ws("_", clean, cents, extra)), 1, 8)
    return F.concat_ws("_", F.lit(prefix), clean, h)


ATTRS = ("merchant_name", "category", "bank", "subscription_type", "billing_cycle", "service_logo", "color",
         "is_trial", "subject")
USUAL = ("merchant_name", "category", "bank", "is_trial", "subject")


def _flagged() -> Column:
    return F.coalesce(F.col("is_subscription"), F.lit(False))


def _merchant_key() -> Column:
    return strip_unicode(F.lower("merchant_name"))


def _subject_key() -> Column:
    return strip_unicode(F.lower("subject"))


def _complete() -> Column:
    return F.col("group_key").isNotNull() & F.col("amount_numeric").isNotNull()


def group_charges(txns: DataFrame, *by: Column) -> DataFrame:
    """Aggregate charges per key columns ``by`` with count, first and last
    instants, the local dates of the first and last charge, the mean
    confidence and the first non-NULL value of each attribute.

    The columns that most charges have in full (USUAL) are kept once with the
    order of the first charge that has them all; only charges that lack one of
    them, and the other attributes, carry an order of their own, so a charge
    enters the shuffle with its message id two to four times and not eleven."""
    order = F.struct("event_ts", "message_id")
    full = F.lit(True)
    for c in USUAL:
        full = full & F.col(c).isNotNull()
    aggs = [F.count("event_ts").alias("transaction_count"),
            F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"),
            F.max_by("local_ts", order).alias("last_local"), F.avg("confidence").alias("confidence"),
            F.min(F.when(full, F.struct(order.alias("at"), "local_ts", *USUAL))).alias("_full"),
            F.min(F.when(~full, F.struct(order.alias("at"), F.col("local_ts").alias("value")))).alias("_local_ts")]
    aggs += [F.min(F.when(~full & F.col(a).isNotNull(), F.struct(order.alias("at"), F.col(a).alias("value")))).alias(f"_{a}") for a in USUAL]
    aggs += [_first(a, order).alias(a) for a in ATTRS if a not in USUAL]
    g = txns.groupBy(*by).agg(*aggs)

    def earlier(c: str) -> Column:
        return F.array_min(F.array(F.when(F.col("_full").isNotNull(), F.struct(F.col("_full.at").alias("at"), F.col(f"_full.{c}").alias("value"))), F.col(f"_{c}")))["value"]

    g = g.withColumns({"first_local": earlier("local_ts"), **{a: earlier(a) for a in USUAL}})
    return g.drop("_full", "_local_ts", *[f"_{a}" for a in USUAL])


def recurring_flagged(txns: DataFrame, keys=KEYS) -> DataFrame:
    """groups of flagged charges by (lower-trim merchant, amount) with the
    mean confidence; every group is kept (count >= 1)."""
    t = txns.filter(_flagged()).withColumn("group_key", _merchant_key()).filter(_complete())
    g = group_charges(t, *keys, F.col("group_key"), F.col("amount_numeric"))
    return g.withColumnRenamed("group_key", "merchant_key")


def _assemble_flagged(g: DataFrame, keys=KEYS) -> DataFrame:
    """F3-F6 over flagged groups."""
    cnt = F.col("transaction_count")
    gap = elapsed_days("first_ts", "last_ts")
    cycle = infer_cycle(cnt, gap, F.col("billing_cycle"))
    trial = recurrence_trial(F.col("merchant_name"), F.col("subject"), F.col("amount_numeric"),
                             F.col("subscription_type"))
    name = F.col("merchant_name")
    icon = F.when(F.lower(name).contains("cloud"), F.coalesce(F.col("service_logo"), F.lit("☁️"))) \
        .otherwise(F.lit(R.DEFAULT_ICON))
    return g.withColumn("_t", trial).select(
        *keys,
        subscription_id("detected", name, F.col("amount_numeric"),
                        F.concat_ws("_", F.coalesce("bank", F.lit("")), F.col(keys[0]).cast("string"))).alias("id"),
        name.alias("service_name"),
        icon.alias("service_logo"),
        F.col("amount_numeric").alias("amount"),
        title_case(cycle).alias("billing_cycle"),
        F.to_date("first_local").alias("start_date"),
        F.to_date("last_local").alias("last_payment"),
        "category",
        F.coalesce("color", F.lit(R.DEFAULT_COLOR)).alias("brand_color"),
        "bank", "transaction_count",
        F.when(F.col("_t.is_trial"), F.lit("Trial")).otherwise(F.lit("Active")).alias("status"),
        F.lit(True).alias("auto_detected"),
        F.concat(name, F.lit(" - "), F.coalesce("subscription_type", F.lit("subscription"))).alias(
            "original_description"),
        F.col("confidence").alias("confidence_score"),
        F.col("_t.subscription_type").alias("subscription_type"),
        F.col("_t.is_trial").alias("is_trial"),
        F.col("_t.trial_reason").alias("trial_reason"),
        F.struct(F.lit(0).alias("path"), F.col("group_key").alias("key"),
                 F.col("amount_numeric").alias("amount")).alias("detect_order"),
    )


def detect_flagged(txns: DataFrame, keys=KEYS) -> DataFrame:
    return _assemble_flagged(recurring_flagged(txns, keys).withColumnRenamed("merchant_key", "group_key"), keys)


def recurring_pattern(txns: DataFrame, keys=KEYS) -> DataFrame:
    """groups by (lower-trim subject, amount) with at least two charges,
    a positive elapsed gap and a mean gap inside a band; name, category and
    confidence come from the service lookup of the subject (F8)."""
    t = txns.withColumn("group_key", _subject_key()).filter(_complete())
    return _assemble_pattern(group_charges(t, *keys, F.col("group_key"), F.col("amount_numeric")), keys)


def _assemble_pattern(g: DataFrame, keys=KEYS) -> DataFrame:
    """F7, F8 over groups by subject."""
    cnt = F.col("transaction_count")
    gap = elapsed_days("first_ts", "last_ts")
    band = cycle_band(F.try_divide(gap.cast("double"), (cnt - 1).cast("double")))
    g = g.filter((cnt >= 2) & (gap > 0)).withColumn("_cycle", band).filter(F.col("_cycle").isNotNull())
    g = g.withColumn("_svc", service_lookup(F.col("subject")))
    g = g.withColumn("_t", recurrence_trial(F.col("_svc.name"), F.col("subject"), F.col("amount_numeric")))
    cycle = title_case(F.col("_cycle"))
    return g.select(
        *keys,
        subscription_id("pattern", F.col("_svc.name"), F.col("amount_numeric"),
                        F.concat_ws("_", cycle, F.col(keys[0]).cast("string"))).alias("id"),
        F.col("_svc.name").alias("service_name"),
        F.col("_svc.logo").alias("service_logo"),
        F.col("amount_numeric").alias("amount"),
        cycle.alias("billing_cycle"),
        F.to_date("first_local").alias("start_date"),
        F.to_date("last_local").alias("last_payment"),
        F.col("_svc.category").alias("category"),
        F.col("_svc.color").alias("brand_color"),
        "bank", "transaction_count",
        F.when(F.col("_t.is_trial"), F.lit("Trial")).otherwise(F.lit("Active")).alias("status"),
        F.lit(True).alias("auto_detected"),
        F.col("subject").alias("original_description"),
        F.col("_svc.confidence").cast("double").alias("confidence_score"),
        F.lit("pattern_detected").alias("subscription_type"),
        F.col("_t.is_trial").alias("is_trial"),
        F.col("_t.trial_reason").alias("trial_reason"),
        F.struct(F.lit(1).alias("path"), F.col("group_key").alias("key"),
                 F.col("amount_numeric").alias("amount")).alias("detect_order"),
    )


def detect_subscriptions(txns: DataFrame, keys=KEYS, mode: str = "compat") -> DataFrame:
    """per account, the flagged path when the account has any flagged
    charge, else the pattern path over all its charges.

    ``mode='both'`` runs the pattern path over the unflagged charges of every
    account as well (the reference switches it off for the whole account).

    The charges are read and shuffled once: flagged charges are grouped by
    merchant, the others by subject, in one aggregate whose groups are written
    once under the shared checkpoint folder.  What follows reads those groups;
    the accounts with a flagged charge are one row each."""
    if mode not in ("compat", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    t = txns.withColumn("flagged", _flagged())
    t = t.withColumn("group_key", F.when(F.col("flagged"), _merchant_key()).otherwise(_subject_key()))
    # a flagged charge without merchant or amount still makes its account a flagged one
    t = t.filter(F.col("flagged") | _complete())
    groups = group_charges(t, *keys, F.col("flagged"), F.col("group_key"), F.col("amount_numeric"))
    path = scratch_path(txns.sparkSession, "charge-groups")
    groups.write.parquet(path)
    groups = txns.sparkSession.read.schema(groups.schema).parquet(path)
    rest = groups.filter(~F.col("flagged"))
    if mode == "compat":
        accounts = groups.filter("flagged").select(*keys).distinct()
        rest = rest.join(accounts, list(keys), "left_anti")
    flagged = _assemble_flagged(groups.filter(F.col("flagged") & _complete()), keys)
    return flagged.unionByName(_assemble_pattern(rest, keys))
