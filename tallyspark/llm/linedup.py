"""Removal of lines that many sites share, by distinct-site spread.

Lines are compared by a 128-bit hash of their trimmed, lower-cased text.  A
HyperLogLog sketch of the sites of each line hash is merged by aggregation;
lines whose estimate is near the threshold get an exact distinct count.  A
line on at least ``min_sites`` sites is boilerplate: its first document keeps
it, it goes from all others.  DataFrame operations only.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, written

LG_K = 12
KEY = ["id", "row_hash"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first) of the line hashes on at least ``min_sites`` sites;
    ``first`` is the smallest (id, row_hash) that has the line."""
    # a line seen fewer than min_sites times cannot be on that many sites
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("first")).where(F.col("n") >= min_sites)
    often = written(often.drop("n"), "frequent-lines")
    # sketches merge on the map side; only near-threshold lines are counted by their sites
    estimate = (lines.select("h1", "h2", "site").join(often.select("h1", "h2"), ["h1", "h2"], "left_semi")
                .groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites")))
    error = 3 * 1.04 / (1 << (LG_K // 2))
    low, high = min(min_sites - 1, min_sites * (1 - error)), max(min_sites + 1, min_sites * (1 + error))
    estimate = written(estimate.where(F.col("sites") >= low), "line-estimates")
    near = estimate.where(F.col("sites") <= high)
    exact = (lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2")
             .agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites))
    spread = estimate.where(F.col("sites") > high).select("h1", "h2").union(exact.select("h1", "h2"))
    return often.join(spread, ["h1", "h2"], "left_semi")


def remove_boilerplate(docs: DataFrame, min_sites: int = 6, min_words: int = 3, id_col: str = "doc_id",
                       site_col: str = "source") -> DataFrame:
    """All columns of ``docs`` with the text less its boilerplate lines, and
    lines_total and lines_removed.

    Null text stays null with no lines; empty lines and lines of fewer than
    ``min_words`` words stay; a null site counts as one site of its own; a null
    id sorts first; rows equal in id and text are treated alike, so both keep
    the first occurrence; ``n_chars`` is renewed where it exists and lines were
    removed; an empty table gives an empty result.
    """
    names = docs.columns
    rows = docs.withColumn("__row_hash", F.xxhash64("text"))
    flat = rows.select(F.col(id_col).alias("id"), F.col("__row_hash").alias("row_hash"),
                       F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
                       F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    norm = F.lower(F.trim(F.regexp_replace("line", f"[{WHITE}]+", " ")))
    flat = flat.withColumn("norm", norm).where(F.length("norm") - F.length(F.translate("norm", " ", "")) + 1 >= min_words)
    lines = written(flat.where("norm <> ''").select("id", "row_hash", "site", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2")), "lines")
    bad = written(boilerplate(lines, min_sites), "boilerplate")
    hit = lines.join(bad, ["h1", "h2"]).where(~F.struct(*KEY).eqNullSafe(F.col("first")))
    gone = hit.groupBy(*KEY).agg(F.collect_set("pos").alias("__gone"))
    got = rows.join(gone, rows[id_col].eqNullSafe(gone["id"]) & rows["__row_hash"].eqNullSafe(gone["row_hash"]), "left").select(*[rows[c] for c in names], "__gone")
    pieces = _lines(F.col("text"))
    # the lines are split once (bound by the outer lambda) and the positions left are found by hashing
    kept = F.array_join(F.get(F.transform(F.array(pieces), lambda p: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("__gone")), lambda i: F.get(p, i))), F.lit(0)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    got = got.withColumn("__new", text)
    out = [F.col("__new").alias("text") if c == "text" else
           F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.length("__new").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in names]
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long")
    return got.select(*out, total.alias("lines_total"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("lines_removed"))
