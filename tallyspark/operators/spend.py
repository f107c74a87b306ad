"""Spending aggregates (operators E1-E15).

Input: a clean transaction DataFrame with ``account_id, message_id,
amount_numeric DECIMAL(18,2), category, merchant_name, bank, local_ts,
event_ts, is_subscription, is_trial``.  Every aggregate is a hash aggregate
keyed by ``account_id`` plus the dimension, so Spark combines partially on the
map side before the shuffle (a hot account or category is pre-reduced per
task).  Money is summed as DECIMAL and cast to DOUBLE at the end; means are
``sum / count`` in DOUBLE, so results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("account_id",)


def _total(col: str = "amount_numeric"):
    return F.sum(col).cast("double")


def _mean(col: str = "amount_numeric"):
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def spend_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    """Total, count, mean and distinct merchants (NULL not counted)."""
    return df.groupBy(*keys).agg(
        _total().alias("total_amount"),
        F.count("*").alias("txn_count"),
        _mean().alias("avg_amount"),
        F.countDistinct("merchant_name").alias("unique_merchants"))


def by_category(df: DataFrame, keys=KEYS) -> DataFrame:
    """Per category total, count and mean (unrounded; display rounds)."""
    return df.groupBy(*keys, "category").agg(
        _total().alias("total_amount"),
        F.count("amount_numeric").alias("txn_count"),
        _mean().alias("avg_amount"))


def flagged_insights(df: DataFrame, keys=KEYS) -> DataFrame:
    """Among flagged rows: count, amount, trial count.  Accounts without a
    flagged row get no row (the reference shows no block)."""
    f = df.filter(F.col("is_subscription") == F.lit(True))
    return f.groupBy(*keys).agg(
        F.count("*").alias("sub_txn_count"),
        _total().alias("sub_amount"),
        F.count_if(F.col("is_trial") == F.lit(True)).alias("trial_count"))


def category_totals(df: DataFrame, keys=KEYS) -> DataFrame:
    """Sum per category (feeds the pie and bar charts)."""
    return df.groupBy(*keys, "category").agg(_total().alias("total_amount"))


def bank_totals(df: DataFrame, keys=KEYS) -> DataFrame:
    """E5: sum per bank."""
    return df.groupBy(*keys, "bank").agg(_total().alias("total_amount"))


def month_category(df: DataFrame, keys=KEYS) -> DataFrame:
    """Sum per month ('yyyy-MM' of the local time) and category."""
    return (df.withColumn("month", F.date_format("local_ts", "yyyy-MM"))
            .groupBy(*keys, "month", "category").agg(_total().alias("total_amount")))


WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_week_heatmap(df: DataFrame, keys=KEYS, with_year: bool = False) -> DataFrame:
    """Sum per weekday name and ISO week.  As in the reference the week
    has no year (weeks of different years fold together) unless
    ``with_year``; ``weekday_ord`` is 1 for Monday."""
    wd = F.weekday("local_ts") + 1  # Monday = 1
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    out = df.select(*keys, "amount_numeric",
                    wd.cast("int").alias("weekday_ord"),
                    F.get(names, F.weekday("local_ts")).alias("weekday"),
                    F.weekofyear("local_ts").alias("week"),
                    *([F.year(F.date_sub(F.next_day(F.to_date("local_ts"), "Mon"), 4)).alias("iso_year")]
                      if with_year else []))
    gk = [*keys, "weekday_ord", "weekday", "week"] + (["iso_year"] if with_year else [])
    return out.groupBy(*gk).agg(_total().alias("total_amount"))


def hourly(df: DataFrame, keys=KEYS) -> DataFrame:
    """Sum per hour of the local time."""
    return df.groupBy(*keys, F.hour("local_ts").alias("hour")).agg(_total().alias("total_amount"))


def timeline(df: DataFrame, keys=KEYS) -> DataFrame:
    """Dated amounts per category in time order (message id breaks ties)."""
    return (df.select(*keys, "message_id", "local_ts", F.col("amount_numeric").cast("double").alias("amount"),
                      "category")
            .orderBy(*keys, "local_ts", "message_id"))


def top_n_share(df: DataFrame, dim: str, n: int = 5, keys=KEYS) -> DataFrame:
    """Top ``n`` values of ``dim`` by total (ties: smaller value
    first) with their share of the account total in percent.

    The totals table is one row per (account, value).  Its top-n per account
    uses the window group limit (partial top-n before the shuffle); the account
    totals are a second aggregate of the same table, joined to the n rows."""
    agg = df.groupBy(*keys, dim).agg(F.sum("amount_numeric").alias("s"))
    wr = Window.partitionBy(*keys).orderBy(F.col("s").desc(), F.col(dim).asc_nulls_last())
    top = agg.withColumn("rank", F.row_number().over(wr)).filter(F.col("rank") <= n)
    total = agg.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("s").alias("account_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return top.join(total, same).select(*keys, dim, "rank",
                      F.col("s").cast("double").alias("total_amount"),
                      (F.try_divide(F.col("s").cast("double"), F.col("account_total").cast("double")) * 100.0).alias("share_pct"))


def top5_categories(df: DataFrame, keys=KEYS) -> DataFrame:
    return top_n_share(df, "category", 5, keys)


def top5_merchants(df: DataFrame, keys=KEYS) -> DataFrame:
    return top_n_share(df, "merchant_name", 5, keys).drop("share_pct")


def monthly_totals(df: DataFrame, keys=KEYS) -> DataFrame:
    return (df.withColumn("month", F.date_format("local_ts", "yyyy-MM"))
            .groupBy(*keys, "month").agg(F.sum("amount_numeric").alias("s")))


def month_over_month(df: DataFrame, keys=KEYS) -> DataFrame:
    """Latest and previous *present* months (a gap month is skipped),
    and the change in percent; only accounts with more than one month.

    The lag runs over the monthly totals (one row per account and month), so
    the window input is tiny compared with the transactions."""
    m = monthly_totals(df, keys)
    w = Window.partitionBy(*keys).orderBy("month")
    wl = Window.partitionBy(*keys).orderBy(F.col("month").desc())
    x = (m.withColumn("prev_month", F.lag("month").over(w))
         .withColumn("prev_s", F.lag("s").over(w))
         .withColumn("r", F.row_number().over(wl))
         .filter((F.col("r") == 1) & F.col("prev_month").isNotNull()))
    latest = F.col("s").cast("double")
    prev = F.col("prev_s").cast("double")
    return x.select(*keys, F.col("month").alias("latest_month"), latest.alias("latest_amount"),
                    "prev_month", prev.alias("prev_amount"),
                    (F.try_divide(latest - prev, prev) * 100.0).alias("change_pct"))


def weekend_vs_weekday(df: DataFrame, keys=KEYS) -> DataFrame:
    """Mean amount on Saturdays and Sundays vs other days (NULL when a
    side has no rows)."""
    we = F.weekday("local_ts") >= 5
    a = F.col("amount_numeric")
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(we, a)).cast("double"), F.count(F.when(we, a)).cast("double")).alias("weekend_avg"),
        F.try_divide(F.sum(F.when(~we, a)).cast("double"), F.count(F.when(~we, a)).cast("double")).alias("weekday_avg"))


def run_log(records: DataFrame, keys=KEYS, run_col: str = "run_id") -> DataFrame:
    """One row per run: amount detected (amount text that is a plain
    non-negative number) and flagged count, before any date filter."""
    from ..functions.amount import is_plain_number
    a = F.col("amount")
    return records.groupBy(*keys, run_col).agg(
        F.coalesce(F.sum(F.when(is_plain_number(a), F.regexp_replace(a, ",", "").try_cast("decimal(18,2)"))),
                   F.lit(0).cast("decimal(28,2)")).alias("amount_detected"),
        F.count_if(F.col("is_subscription") == F.lit(True)).alias("subscriptions_detected"))


def run_totals(runs: DataFrame, keys=KEYS) -> DataFrame:
    """Cumulative totals of the run log."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.sum("amount_detected").cast("double").alias("total_amount_detected"),
        F.sum("subscriptions_detected").alias("total_subscriptions_detected"))


def append_runs(path: str, runs: DataFrame, run_col: str = "run_id") -> None:
    """Add runs to the run log in ``path``, a Parquet table with a folder per
    run.  The rows are staged and then replace the folders of their own runs
    alone, so a run that is appended again, in whole or after a failure, is
    there once.  Every row needs a run id."""
    checked = runs.withColumn(run_col, F.when(F.col(run_col).isNull(), F.raise_error(F.lit("a run without an id"))).otherwise(F.col(run_col)))
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """The run log, under the schema of the runs appended."""
    return spark.read.schema(schema).parquet(path)


SEEN_ERROR = 0.03     # of the sketch's estimate: more than three standard errors


def account_sketches(records: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A mergeable sketch of the accounts of each run, for the run log."""
    return records.groupBy(run_col).agg(F.hll_sketch_agg(F.col("account_id").cast("string"), 14).alias("accounts"))


def accounts_seen(sketches: DataFrame) -> DataFrame:
    """The number of accounts ever seen, within SEEN_ERROR, from the
    sketches of all runs; no record is read again."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("accounts")), F.lit(0)).alias("total_users"))


def new_accounts(records: DataFrame, seen: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A9, exact: (account_id, run) for the accounts of a run that no other run
    of ``seen`` (account_id, run) holds; kept in a run log of its own."""
    here = records.select("account_id", run_col).where("account_id is not null").groupBy("account_id").agg(F.min(run_col).alias(run_col))
    known = seen.select("account_id", F.col(run_col).alias("_run"))
    return here.join(known, [here["account_id"] == known["account_id"], F.col(run_col) != F.col("_run")], "left_anti")


def distinct_accounts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Number of distinct accounts of the given records (between runs,
    ``accounts_seen`` and ``new_accounts`` keep it without them)."""
    f = F.approx_count_distinct("account_id") if approx else F.countDistinct("account_id")
    return df.agg(f.alias("total_users"))


def category_brand_color(subs: DataFrame, keys=KEYS, default: str = "#007bff") -> DataFrame:
    """Chart colour per subscription category: the brand colour of the
    first listed (lowest ``seq``) active or trial subscription of that
    category, else a default."""
    live = subs.filter(F.coalesce(F.col("status"), F.lit("Active")).isin("Active", "Trial"))
    return live.groupBy(*keys, F.coalesce("category", F.lit("Other")).alias("category")).agg(
        F.coalesce(F.min_by(F.coalesce("brand_color", F.lit(default)),
                            F.when(F.col("category").isNotNull(), F.col("seq"))),
                   F.lit(default)).alias("color"))
