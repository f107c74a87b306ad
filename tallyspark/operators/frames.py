"""Ordered work over groups of any size: blocks along an order column, and row
frames that reach across block borders.

A plain window gives all rows of a group to one task.  Here the rows of a group
are cut into blocks along the order column, each block with copies of the few
rows before it that its frames reach, so a hot group is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BLOCKS = 256


def order_blocks(df: DataFrame, column: str, rows: int, name: str = "_block") -> DataFrame:
    """Adds a block number that never falls as ``column`` (a number, date or
    timestamp) rises; NULLs are in block 0.  The bounds are quantiles over all
    rows, so a hot group has its share of the blocks; there are about
    ``rows`` rows to a block, and at most MOST_BLOCKS blocks."""
    n, bounds = df.agg(F.count("*"), F.percentile_approx(column, [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)])).first()
    step = -(-MOST_BLOCKS // max(1, min(MOST_BLOCKS, -(-n // rows))))
    block = F.lit(0)
    for bound in sorted(set((bounds or [])[step - 1::step])):
        block = block + F.coalesce(F.col(column) >= F.lit(bound), F.lit(False)).cast("int")
    return df.withColumn(name, block)


def over_rows_before(df: DataFrame, by: list[str], order: list[str], n: int, aggregates: dict[str, Column], rows: int = 1_000_000) -> DataFrame:
    """Adds ``aggregates`` (name -> aggregate expression) over the ``n`` rows
    before each row among the rows equal in ``by`` (NULL equals NULL), in
    ascending order of ``order`` (NULL first; its first column is a number, date
    or timestamp; equal rows in any order)."""
    b = order_blocks(df, order[0], rows)
    counts = b.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    later = Window.partitionBy(*by).orderBy("_block").rowsBetween(1, n)
    # the blocks whose frames may reach back into this one, and the rows between
    gap = F.expr("transform(_next, (x, i) -> struct(x._block as _to, aggregate(slice(_next, 1, i), 0L, (s, y) -> s + y._n) as _between))")
    reach = (counts.withColumn("_next", F.collect_list(F.struct("_block", "_n")).over(later)).where(F.size("_next") > 0)
             .select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_block").alias("_from"), F.filter(gap, lambda x: x["_between"] < n).alias("_reach")))
    back = Window.partitionBy(*by, "_block").orderBy(*[F.desc(c) for c in order])
    tails = b.withColumn("_p", F.row_number().over(back)).where(F.col("_p") <= n)
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    copies = (tails.join(reach, [F.col("_block") == F.col("_from"), *same]).withColumn("_r", F.explode("_reach"))
              .where(F.col("_r._between") + F.col("_p") <= n)
              .select(*df.columns, F.col("_r._to").alias("_block"), F.lit(True).alias("_copy")))
    frame = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(-n, -1)
    out = b.withColumn("_copy", F.lit(False)).unionByName(copies)
    for name, agg in aggregates.items():
        out = out.withColumn(name, agg.over(frame))
    return out.where(~F.col("_copy")).drop("_block", "_copy")


def running(df: DataFrame, by: list[str], order: list[str], block: Column, value: Column | None = None, name: str = "_run") -> DataFrame:
    """Adds the sum of ``value`` (default: the number of rows) over the rows equal
    in ``by`` (NULL equals NULL) up to and with each row, in ascending order of
    ``order``.  ``block`` never falls along that order within a group; each
    block of a group is added up by itself and then raised by the blocks before
    it, so a hot group is the work of as many tasks as it has blocks."""
    t = df.withColumn("_value", F.lit(1).cast("long") if value is None else value).withColumn("_block", block)
    sums = t.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_block").alias("_k_block"),
                       F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_here", F.sum("_value").over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    return (t.join(sums, [F.col("_block").eqNullSafe(F.col("_k_block")), *same])
            .select(*df.columns, (F.col("_before") + F.col("_here")).alias(name)))


def text_position(text: Column) -> Column:
    """A number that never falls as texts rise in byte order: the first seven bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
