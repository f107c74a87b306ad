"""Rules as tables: containment rules of any number over texts of any number.

The column expressions of ``functions.classify`` unroll a short rule list into
the plan.  A rule table (one row per needle) goes through the words of the texts
instead.  Texts and needles are cut into runs of letters and digits (any
character beyond ASCII counts as a letter); a text contains a needle of one run
exactly where one of its own runs does.  A needle of several runs is filed under
one of them and is verified by ``contains`` in the texts that hold it; needles
without a letter or digit go by the runs between.  Runs and needles meet through
n-grams.

A rule table of up to ``FEW`` bytes (counted, not guessed) is broadcast: the
texts are dealt once by row, and all else about a text, its runs, grams, hits and
the choice among its rules, stays in the task that has it.  A larger one is looked
up once for every different run of the whole table of texts, in equi-joins through
the n-grams of those runs, and the runs of each text are joined to what was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R

GRAM = 4
FEW = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# one by one: the regex engine looks single characters up, but compares with each range
OTHER = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]"
ROW = ["_r1", "_r2"]


def rule_rows(spark, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """A short list of (label, needles) as a rule table (ordinal, label, needle)."""
    rows = [(i, label, n) for i, (label, needles) in enumerate(rules) for n in needles]
    return spark.createDataFrame(rows, "ordinal long, label string, needle string")


def _long_grams(text: Column, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _grams(text: Column, n: int) -> Column:
    """Distinct n-grams of a text: short ones by position, others in one pass of
    the regex engine."""
    last = F.length(text) - n + 1
    short = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.length(text) <= 64, short).otherwise(_long_grams(text, n)))


def _filed(pieces: DataFrame) -> DataFrame:
    """(piece, gram): each of ``pieces`` under the one of its grams that the fewest
    pieces hold; short ones are their own gram."""
    own = pieces.select("piece", F.explode(
        F.when(F.length("piece") < GRAM, F.array("piece")).otherwise(_grams(F.col("piece"), GRAM))).alias("gram"))
    seen = own.groupBy("gram").agg(F.count("*").alias("pieces"))
    return own.join(seen, "gram").groupBy("piece").agg(F.min_by("gram", F.struct("pieces", "gram")).alias("gram"))


def _held(runs: DataFrame, pieces: DataFrame, lengths: list[int]) -> DataFrame:
    """(run, piece): the different ``runs`` with each of ``pieces`` they contain."""
    grams = runs.select("run", F.explode(F.concat(*[_grams(F.col("run"), n) for n in lengths])).alias("gram"))
    return grams.join(_filed(pieces), "gram").where(F.contains("run", F.col("piece"))).select("run", "piece")


def _cut(text: str, between: bool) -> Column:
    """The different runs of a text, of letters and digits and with ``between``
    also of other characters."""
    words = F.split(text, f"{OTHER}+")
    return F.array_distinct(F.concat(words, F.split(text, f"{WORD}+")) if between else words)


def with_row_ids(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A row is known by ``keys`` and its text: repeated rows are one."""
    return df.withColumn("_r1", F.xxhash64(*keys, text)).withColumn("_r2", F.xxhash64(F.lit(1), *keys, text))


def _hits_of_few(marked: DataFrame, text: str, cut: DataFrame, lengths: list[int], between: bool, several: bool, found: list[str]) -> DataFrame:
    """``rule_hits`` of needles that are broadcast.  A needle of several runs is filed
    under one that the fewest needles hold, short ones last."""
    pieces = cut.select("needle", F.explode("pieces").alias("piece")).distinct()
    shared = pieces.groupBy("piece").agg(F.count("*").alias("needles"))
    order = F.struct(-F.least(F.length("piece"), F.lit(GRAM)), "needles", "piece")
    one = pieces.join(shared, "piece").groupBy("needle").agg(F.min_by("piece", order).alias("piece")) if several else pieces
    rest = F.when(F.col("piece") != F.col("needle"), F.col("needle"))
    index = (one.join(_filed(one.select("piece").distinct()), "piece").join(cut.drop("pieces"), "needle")
             .select("gram", "piece", rest.alias("_rest"), *found))
    # the texts by row: what is counted for a row from here on needs no other shuffle
    texts = marked.select(*ROW, F.col(text).alias("_text")).repartition(*ROW)
    # every position of a short run, every gram of a long one; the outer explodes let no
    # filter in that would evaluate the runs twice
    is_long, run, at = F.length("run") > 64, F.col("run"), F.col("_at")
    runs = texts.select(*ROW, "_text", F.explode_outer(_cut("_text", between)).alias("run")).where(F.length("run") >= lengths[0])
    runs = runs.withColumn("_long", F.when(is_long, F.array_distinct(F.concat(*[_long_grams(run, n) for n in lengths]))))
    last = F.when(is_long, F.size("_long")).otherwise(F.length("run") - lengths[0] + 1)
    runs = runs.select("*", F.explode_outer(F.sequence(F.lit(1), last)).alias("_at"))
    short = [F.substring(run, at, F.lit(n)) for n in lengths]
    if len(lengths) > 1:
        runs = runs.select("*", F.explode_outer(F.when(is_long, F.array(F.get("_long", at - 1))).otherwise(F.array(*short))).alias("gram"))
    else:
        runs = runs.withColumn("gram", F.coalesce(F.get("_long", at - 1), short[0]))
    got = runs.join(F.broadcast(index), "gram").where(F.contains("run", F.col("piece")))
    if several:
        got = got.where(F.col("_rest").isNull() | F.contains("_text", F.col("_rest")))
    return got.select(*ROW, *found)


def _hits_of_many(marked: DataFrame, text: str, cut: DataFrame, lengths: list[int], between: bool, several: bool, found: list[str]) -> DataFrame:
    """``rule_hits`` of needles of any number.  A needle of several runs is filed under
    the one that the fewest texts hold."""
    # a small file may hold many runs: they are never broadcast, whatever its size promises
    runs = marked.select(*ROW, F.explode(_cut(text, between)).alias("run")).where("run <> ''").hint("merge")
    vocabulary = runs.groupBy("run").agg(F.count("*").alias("texts"))
    needles = cut.select("needle", "pieces").distinct()
    pieces = needles.select("needle", F.explode("pieces").alias("piece"))
    held = _held(vocabulary.select("run"), pieces.select("piece").distinct(), lengths)
    alone = F.get("pieces", F.lit(0)) == F.col("needle")
    single = needles.where(alone).select(F.col("needle").alias("piece"), "needle")
    hits = runs.join(held.join(single, "piece").select("run", "needle"), "run").select(*ROW, "needle")
    if several:
        parts = needles.where(~alone).select("needle", F.explode("pieces").alias("piece"))
        weight = (held.join(parts.select("piece").distinct(), "piece", "left_semi").join(vocabulary, "run")
                  .groupBy("piece").agg(F.sum("texts").alias("texts")))
        filed = (parts.join(weight, "piece", "left").groupBy("needle")
                 .agg(F.min_by("piece", F.struct("texts", "piece")).alias("piece"), F.bool_and(F.col("texts").isNotNull()).alias("there"))
                 .where("there").select("piece", "needle"))
        maybe = runs.join(held.join(filed, "piece").select("run", "needle"), "run").select(*ROW, "needle").distinct()
        texts = marked.select(*ROW, F.col(text).alias("_text")).dropDuplicates(ROW)
        hits = hits.unionByName(maybe.join(texts, ROW).where(F.contains("_text", F.col("needle"))).select(*ROW, "needle"))
    return hits.distinct().join(cut.drop("pieces"), "needle").select(*ROW, *found)


def rule_hits(marked: DataFrame, text: str, rules: DataFrame, found: list[str]) -> DataFrame:
    """(_r1, _r2, *found), some perhaps more than once: the columns ``found`` of those
    ``rules`` whose ``needle`` the column ``text`` of ``marked`` (see
    ``with_row_ids``) contains.

    NULL and empty needles contain nothing; containment is exact, so lower-case
    both sides beforehand where case does not matter.
    """
    rules = rules.where("needle <> ''").select("needle", *found)
    cut = rules.withColumn("pieces", F.array_remove(F.split("needle", f"{OTHER}+"), ""))
    cut = cut.withColumn("pieces", F.when(F.size("pieces") > 0, F.array_distinct("pieces")).otherwise(F.array("needle")))
    short = [F.count_if(F.array_contains(F.transform("pieces", F.length), F.lit(n))) for n in range(1, GRAM)]
    few, between, several, *short = cut.agg(
        F.coalesce(F.sum(F.octet_length("needle") + 100), F.lit(0)) <= FEW, F.count_if(~F.col("needle").rlike(WORD)) > 0,
        F.count_if(F.get("pieces", F.lit(0)) != F.col("needle")) > 0, *short).first()
    lengths = [n for n, some in enumerate(short, 1) if some] + [GRAM]
    return (_hits_of_few if few else _hits_of_many)(marked, text, cut, lengths, between, several, found)


def resolve_by_rules(df: DataFrame, text: str, rules: DataFrame, keys: list[str], out: str = "label", default: str | None = None) -> DataFrame:
    """The label of the first rule (lowest ordinal, then needle) contained in
    ``text``, else ``default`` (B6 for rule tables)."""
    marked = with_row_ids(df, text, keys)
    first = rules.where("needle <> ''").groupBy("needle").agg(F.min(F.struct("ordinal", "needle", "label")).alias("_rule"))
    first = first.select("needle", "_rule.label", F.row_number().over(Window.orderBy("_rule")).cast("long").alias("_n"))
    got = rule_hits(marked, text, first, ["_n"]).groupBy(*ROW).agg(F.min("_n").alias("_n"))
    got = got.join(first.select("_n", F.col("label").alias("_label")), "_n").drop("_n")
    return marked.join(got, ROW, "left").withColumn(out, F.coalesce("_label", F.lit(default))).select(*df.columns, out)


def score_by_rules(df: DataFrame, text: str, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Category arg-max for rule tables (B11): ``score`` is the number of
    distinct needles of a label that the text contains; the highest score wins,
    ties go to the lower ordinal (the lowest of a label's rules), then the lower
    label; without a hit the score is 0 and ``category`` 'other transactions'."""
    marked = with_row_ids(df, text, keys)
    labels = rules.where("needle <> ''").groupBy("needle", "label").agg(F.min("ordinal").alias("first"))
    # (needle, label) pairs by number: a label's lowest is that of its lowest ordinal, so
    # those without an ordinal come last; between labels they come first
    half = 1 << 31
    n = F.row_number().over(Window.orderBy("first", "label", "needle")) + F.when(F.col("first").isNull(), F.lit(half)).otherwise(F.lit(0))
    labels = labels.withColumn("_n", n).withColumn("_l", F.min("_n").over(Window.partitionBy("label")))
    turned = F.min("_n") + F.when(F.min("_n") > half, F.lit(-half)).otherwise(F.lit(half))
    best = (rule_hits(marked, text, labels, ["_n", "_l"]).distinct()
            .groupBy(*ROW, "_l").agg((F.count("*") * F.lit(2 * half) - turned).alias("_best"))
            .groupBy(*ROW).agg(F.max("_best").alias("_best")))
    score = F.shiftright(F.col("_best") + F.lit(2 * half - 1), 32)
    best = best.select(*ROW, score.alias("_score"), (F.shiftleft(score, 32) - F.col("_best")).alias("_turned"))
    names = labels.select((F.col("_n") + F.when(F.col("_n") > half, F.lit(-half)).otherwise(F.lit(half))).alias("_turned"), F.col("label").alias("_label"))
    none = F.lit(R.CATEGORY_NONE)
    return (marked.join(best.join(names, "_turned"), ROW, "left")
            .select(*df.columns, F.coalesce(F.col("_score").cast("int"), F.lit(0)).alias("score"), F.coalesce("_label", none).alias("category")))


def hits_by_rules(df: DataFrame, fields: list[str], terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term_ord): every term (term_ord, field, needle) contained, whatever
    the case, in the field it names (A3 for term tables)."""
    parts = None
    for f in fields:
        rules = terms.where(F.col("field") == f).select("term_ord", F.lower("needle").alias("needle"))
        low = df.select(*keys, F.lower(F.coalesce(F.col(f), F.lit(""))).alias("_text"))
        marked = with_row_ids(low, "_text", keys)
        got = marked.join(rule_hits(marked, "_text", rules, ["term_ord"]).distinct(), ROW).select(*keys, F.col("term_ord").cast("long").alias("term_ord"))
        parts = got if parts is None else parts.unionByName(got)
    return parts.distinct()
