"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines, cut at sentence ends) are hashed to 32-bit digests;
each distinct digest is added to one cell in each of three parts of a table.  A
cell holds a count, the xor of its digests and the xor of their checks.  Tables
have a power of two of cells a part, by the number of digests, so that a larger
one folds down to a smaller one.  Two versions are compared by subtracting
their tables at the smaller size: what they share cancels, and cells with a
single digest left are peeled part by part until every differing digest is
recovered.  A pair that does not peel is tried again with a larger table, made
from the digests.  DataFrame operations only: cells are rows, subtraction and
peeling are aggregations that stay inside one shuffle partition per document.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

BASE_CELLS = 8        # cells per part of the smallest table
PEELS = 5             # rounds over the three parts
ROWS_PER_PARTITION = 2000
BREAK = "\\n|(?<=[.!?]) +"


def digests(text: Column) -> Column:
    """Distinct 32-bit digests of the paragraphs of a text; blank ones do not count."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.hash(p)))


def next_text(docs: DataFrame, id_col: str = "id", text_col: str = "t") -> DataFrame:
    """Adds block, row (unique together) and next: the text of the next
    document by descending id (then text), after the last one the first.

    Blocks are id ranges cut at approximate quantiles (one per shuffle
    partition); only the quantiles and the largest id of each block reach the
    driver.  The first rows of a block are copied to the end of the block
    before it, so the texts are shuffled once.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(id_col, [(k + 1) / parts for k in range(parts - 1)] or [0.5], 20000)).first()[0] or []
    cuts = sorted(set(cuts))
    power = max(1, len(cuts).bit_length())
    if cuts:
        literal = F.array(*[F.lit(c) for c in cuts], *[F.lit(None)] * ((1 << power) - len(cuts)))
        steps = F.array(*[F.lit(1 << k) for k in range(power - 1, -1, -1)])
        block = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(literal, p + s - 1) < F.col(id_col), p + s).otherwise(p))
    else:
        block = F.lit(0)
    rows = docs.withColumn("block", block)
    heads = {r["block"]: r["head"] for r in rows.groupBy("block").agg(F.max(id_col).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    kind = docs.schema[id_col].dataType
    head = F.array(*[F.lit(heads.get(k)).cast(kind) for k in range(max(heads, default=0) + 1)])
    before = {b: order[k - 1] for k, b in enumerate(order)}     # the first block's rows go behind the last block
    target = F.array(*[F.lit(before.get(k, 0)) for k in range(max(heads, default=0) + 1)])
    extra = F.col(id_col).eqNullSafe(F.get(head, F.col("block")))
    at = F.when(extra, F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("e")), F.struct(F.get(target, F.col("block")).alias("b"), F.lit(1).alias("e"))))
    at = at.otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("e"))))
    rows = rows.withColumn("at", F.explode(at)).withColumn("block", F.col("at.b")).withColumn("extra", F.col("at.e")).drop("at")
    w = Window.partitionBy("block").orderBy("extra", F.desc_nulls_last(id_col), F.desc(text_col))
    return rows.withColumn("next", F.lead(text_col).over(w)).withColumn("row", F.row_number().over(w)).where("extra = 0").drop("extra")


def edited_text(text: str = "t", following: str = "next") -> Column:
    """A text whose last half (rounded down) is replaced by the start of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - half), F.substring(F.col(following), F.lit(1), half))


def size_of(n: Column) -> Column:
    """Cells per part of the table of ``n`` digests: a power of two at which
    two texts of that size peel in most cases even if they share nothing."""
    return F.greatest(F.lit(BASE_CELLS), F.pow(F.lit(2), F.ceil(F.log2(1.1 * F.greatest(F.lit(1), n)))).cast("int"))


def _cell(part: int, key: Column, m: Column) -> Column:
    return (F.lit(part) * m + F.pmod(F.xxhash64(F.lit(part), key), m)).cast("int")


def _check(key: Column) -> Column:
    return F.hash(F.lit(99), key)


def table_of(keys: Column, m: Column, sign: int = 1) -> Column:
    """Cell entries (cell, c, k, x) of an array of digests."""
    return F.flatten(F.transform(keys, lambda k: F.array(*[
        F.struct(_cell(j, k, m).alias("cell"), F.lit(sign).alias("c"), k.alias("k"), _check(k).alias("x")) for j in range(3)])))


def _add(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "cell").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x")).where("cell < 0 or c <> 0 or k <> 0 or x <> 0")


def peel(cells: DataFrame, by: list[str], rounds: int = PEELS, keep_digests: bool = False) -> DataFrame:
    """Peel difference tables given as rows (by..., m, cell, c, k, x).

    Found digests leave the table: as rows of cell -2 when ``keep_digests``
    (c is the sign: 1 only in the first version), else counted in cell -1.
    What is left in cells >= 0 did not peel.  Each step peels one part, in
    which a digest has exactly one cell, so none is peeled twice.
    """
    by = [*by, "m"]
    cells = _add(cells, by)
    for step in range(3 * rounds):
        j = step % 3
        m, k = F.col("m"), F.col("k")
        pure = (F.col("cell") >= j * m) & (F.col("cell") < (j + 1) * m) & (F.abs("c") == 1) & (F.col("x") == _check(k)) & (F.col("cell") == _cell(j, k, m))
        entry = lambda cell, c, key, x: F.struct(cell.cast("int").alias("cell"), c.cast("int").alias("c"), key.alias("k"), x.alias("x"))
        zero = F.lit(0)
        found = entry(F.lit(-2), F.col("c"), k, F.col("x")) if keep_digests else entry(F.lit(-1), F.lit(1), zero, zero)
        others = [entry(_cell(i, k, m), -F.col("c"), k, F.col("x")) for i in range(3) if i != j]
        out = F.when(pure, F.array(found, *others)).otherwise(F.array(entry(F.col("cell"), F.col("c"), k, F.col("x"))))
        cells = cells.select(*by, F.explode(out).alias("o")).select(*by, "o.*")
        cells = _add_kept(cells, by) if keep_digests else _add(cells, by)
    return cells


def _add_kept(df: DataFrame, by: list[str]) -> DataFrame:
    """As _add, with found digests as groups of their own."""
    own = F.when(F.col("cell") == -2, F.col("k"))
    got = _add(df.withColumn("own", own), [*by, "own"])
    return got.drop("own")


def differences(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Number of differing digests of each pair of digest arrays.

    pairs: (by..., a, b) with ``by`` unique.  Returns (by..., differing).
    Tables start at the smaller of both sides' own sizes, that is as their
    fingerprints folded to one size, and grow fourfold to an odd size, which
    deals the digests anew, for the pairs that fail.  A pair whose numbers of
    digests are too far apart for that start gets the larger side's size.
    """
    # the table of a pair is decided here; a pair never shuffles after this deal
    few = F.least(size_of(F.size(a)), size_of(F.size(b)))
    todo = pairs.withColumn("m", F.when(F.abs(F.size(a) - F.size(b)) > 2.4 * few, F.greatest(size_of(F.size(a)), size_of(F.size(b)))).otherwise(few))
    total = todo.count()
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_PARTITION))
    done = []
    while True:
        rows = todo.repartition(parts, *by)
        cells = rows.select(*by, "m", F.explode(F.concat(table_of(F.col(a), F.col("m")), table_of(F.col(b), F.col("m"), -1), F.array(
            F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("c"), F.lit(0).alias("k"), F.lit(0).alias("x"))))).alias("o")).select(*by, "m", "o.*")
        left = peel(cells, by).groupBy(*by, "m").agg(F.sum(F.when(F.col("cell") == -1, F.col("c")).otherwise(0)).alias("differing"), F.count_if(F.col("cell") >= 0).alias("left"))
        left = written(left, "peeled")
        done.append(left.where("left = 0").select(*by, "differing"))
        failed = left.where("left > 0").select(*by, "m")
        n = failed.count()
        if not n:
            return reduce(DataFrame.union, done)
        todo = written(todo.drop("m").join(failed.withColumn("m", (F.col("m") * 4 + 1).cast("int")), by), "retry")
        parts = max(1, -(-n // (ROWS_PER_PARTITION // 8)))


def cells_of(fingerprint: Column, m: Column, sign: int = 1) -> Column:
    """Cell entries (cell, c, k, x) of a fingerprint string, folded to ``m``
    cells a part (a power of two, at most the string's own)."""
    def number(word: Column) -> Column:
        v = F.conv(word, 16, 10).cast("long")
        return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int")

    words = F.split(fingerprint, " ")
    own = table_size(fingerprint)

    def entry(w: Column) -> Column:
        cell = number(F.substring_index(w, ":", 1))
        rest = F.substring_index(w, ":", -1)
        return F.struct((F.floor(cell / own) * m + F.pmod(F.pmod(cell, own), m)).cast("int").alias("cell"), (F.lit(sign) * number(F.substr(rest, F.lit(17)))).alias("c"),
                        number(F.substring(rest, 1, 8)).alias("k"), number(F.substring(rest, 9, 8)).alias("x"))

    return F.transform(F.slice(words, F.lit(2), F.size(words) - 1), entry)


def table_size(fingerprint: Column) -> Column:
    """Cells per part of a fingerprint string."""
    return F.conv(F.substring_index(fingerprint, " ", 1), 16, 10).cast("int")


def subtract(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", keep_digests: bool = False) -> DataFrame:
    """Two fingerprint strings of each row of (by..., a, b) subtracted at the
    smaller size and peeled; returns what ``peel`` does (left in cells >= 0 is
    what did not peel; a pair without any difference gives no row)."""
    m = F.least(table_size(F.col(a)), table_size(F.col(b)))
    rows = pairs.select(*by, m.alias("m"), a, b)
    cells = rows.select(*by, "m", F.explode(F.concat(cells_of(F.col(a), F.col("m")), cells_of(F.col(b), F.col("m"), -1))).alias("o"))
    return peel(cells.select(*by, "m", "o.*"), by, keep_digests=keep_digests)


def tables(rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Fingerprint strings of columns of digest arrays: (by..., new names).

    columns: new name -> column of digests.  A string is the cells per part in
    hexadecimal, then by cell, separated by blanks, cell:digests checks count:
    the xors with 8 hexadecimal digits each, the count with as many as it has;
    cells without a digest are left out.  Cells are rows until the end, so the
    work grows with the number of digests.
    """
    word = lambda v: F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    short = lambda v: F.lower(F.hex(v.cast("long")))
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("d")) for i, c in enumerate(columns.values())])).alias("p")).select(*by, "p.*")
    each = each.withColumn("m", size_of(F.size("d")))
    none = F.array(F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("c"), F.lit(0).alias("k"), F.lit(0).alias("x")))
    cells = each.select(*by, "kind", "m", F.explode(F.concat(none, table_of(F.col("d"), F.col("m")))).alias("o")).select(*by, "kind", "m", "o.*")
    cells = cells.groupBy(*by, "kind", "m", "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
    text = F.when(F.col("cell") < 0, short(F.col("m"))).otherwise(F.concat(short(F.col("cell")), F.lit(":"), word(F.col("k")), word(F.col("x")), short(F.col("c"))))
    got = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("kind", "cell", text.alias("w")))).alias("all"))
    part = lambda i: F.array_join(F.transform(F.filter("all", lambda e: e["kind"] == i), lambda e: e["w"]), " ")
    return got.select(*by, *[part(i).alias(name) for i, name in enumerate(columns)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see edited_text),
    and how alike they are.

    Returns per row: id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint (see tables), near_edited, near_next: shared digests over
    all digests of both (1 if neither has any), from subtracting the returned
    fingerprints, of the next row for near_next (see differences).  Null text counts as empty; null ids come
    last in descending order; among equal ids the order is by descending text;
    repeated rows follow one another; a single row is its own next; an empty
    table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = next_text(base).withColumn("edit", edited_text())
    rows = written(rows.select("block", "row", "id", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
                               digests(F.col("t")).alias("a"), digests(F.col("edit")).alias("e"), digests(F.col("next")).alias("n")), "digests")
    pairs = rows.select("block", "row", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("a"), F.col("e").alias("b")),
                                                          F.struct(F.lit(1).alias("kind"), F.col("a"), F.col("n").alias("b")))).alias("p")).select("block", "row", "p.*")
    d = differences(pairs, ["block", "row", "kind"])
    d = d.groupBy("block", "row").agg(F.sum(F.when(F.col("kind") == 0, F.col("differing"))).alias("de"), F.sum(F.when(F.col("kind") == 1, F.col("differing"))).alias("dn"))

    def near(x: str, diff: str) -> Column:
        both = F.col("a") + F.col(x)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(diff)) / (both + F.col(diff)))

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_PARTITION))
    made = tables(rows.select("block", "row", "a", "e").repartition(parts, "block", "row"), ["block", "row"], {"fingerprint": "a", "edited_fingerprint": "e"})
    sizes = rows.select("block", "row", "id", "n_chars", "edited_sha256", *[F.size(c).alias(c) for c in "aen"]).join(made, ["block", "row"]).join(d, ["block", "row"])
    return sizes.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        near("e", "de").alias("near_edited"), near("n", "dn").alias("near_next"))
