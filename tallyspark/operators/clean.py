"""Cleaning, filters, sorts and limits (operators D1-D10).

All are narrow transformations except ``facet_domains`` (one aggregate per
account) and ``top_with_rest`` (per-account top-N through Spark's window
group limit, which keeps at most N rows per account on the map side before
the shuffle, so one huge account never lands whole in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amount import clean_amount
from ..functions.dates import with_parsed_dates

KEYS = ("account_id",)


def with_amount_numeric(df: DataFrame, amount_col: str = "amount") -> DataFrame:
    """Amount text -> DECIMAL(18,2) ``amount_numeric``."""
    return df.withColumn("amount_numeric", clean_amount(amount_col))


def positive_only(df: DataFrame) -> DataFrame:
    """Keep rows with a positive amount (NULL is dropped)."""
    return df.filter(F.col("amount_numeric") > 0)


def parse_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """D3: header text -> ``event_ts`` (instant) and ``local_ts`` (wall time)."""
    return with_parsed_dates(df, date_col)


def drop_bad_dates(df: DataFrame) -> DataFrame:
    """Drop rows whose date did not parse."""
    return df.na.drop(subset=["event_ts", "local_ts"])


def clean_transactions(df: DataFrame, amount_col: str = "amount", date_col: str | None = "date") -> DataFrame:
    """D1-D4 in the reference's order: number, positive, dates, drop bad dates."""
    out = positive_only(with_amount_numeric(df, amount_col))
    if date_col is not None:
        out = drop_bad_dates(parse_dates(out, date_col))
    return out


def newest_first(df: DataFrame) -> DataFrame:
    """Total order, newest instant first, message id breaks ties."""
    return df.orderBy(F.col("event_ts").desc(), F.col("message_id").asc())


def date_range(df: DataFrame, start=None, end=None, enabled: bool = True) -> DataFrame:
    """Both ends inclusive on the local date; no-op unless enabled and
    both ends are given."""
    if not enabled or start is None or end is None:
        return df
    d = F.to_date("local_ts")
    return df.filter(d.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def facet_filter(df: DataFrame, categories=None, banks=None, amount_range=None) -> DataFrame:
    """Category in, bank in, amount between (all inclusive).  An empty
    choice list keeps no rows, as in the reference; ``None`` means no filter."""
    cond: Column = F.lit(True)
    if categories is not None:
        cond = cond & F.col("category").isin(list(categories)) if categories else F.lit(False)
    if banks is not None:
        cond = cond & F.col("bank").isin(list(banks)) if banks else F.lit(False)
    if amount_range is not None:
        lo, hi = amount_range
        cond = cond & F.col("amount_numeric").between(F.lit(lo).cast("decimal(18,2)"), F.lit(hi).cast("decimal(18,2)"))
    return df.filter(cond)


def facet_domains(df: DataFrame, keys=KEYS) -> DataFrame:
    """The choices of each filter, one row each: (account, facet, value) with
    facet 'category' or 'bank' and the amount range of its charges, and one row
    with facet 'amount' and the range of the whole account.  Rows instead of
    lists, so an account may have any number of values."""
    facet = F.explode(F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
                              F.struct(F.lit("bank").alias("facet"), F.col("bank").alias("value")),
                              F.struct(F.lit("amount").alias("facet"), F.lit(None).cast("string").alias("value"))))
    rows = df.select(*keys, "amount_numeric", facet.alias("f")).filter((F.col("f.facet") == "amount") | F.col("f.value").isNotNull())
    return rows.groupBy(*keys, F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(
        F.min("amount_numeric").cast("double").alias("min_amount"),
        F.max("amount_numeric").cast("double").alias("max_amount"),
    )


def top_with_rest(df: DataFrame, n: int = 20, keys=KEYS, order=None) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows per account in display order and, separately,
    how many rows are left over per account."""
    order = order or [F.col("event_ts").desc(), F.col("message_id").asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    rest = df.groupBy(*keys).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("rest"))
    return top, rest


def flagged(df: DataFrame, col: str = "is_subscription") -> DataFrame:
    """Rows whose flag is TRUE (NULL counts as false)."""
    return df.filter(F.col(col) == F.lit(True))
