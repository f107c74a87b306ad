"""Mixing sources to target weights by iterative proportional fitting.

Token sums per (source, language, topic) cell are raked in turn to the target
share of every source, language and topic; the ratio of a cell's raked to its
own weight, scaled so that the wanted share of all tokens is expected, is the
probability with which each of its documents is sampled.  The draw hashes the
document id, so it repeats.  DataFrame operations only; the cells stay
distributed, and every marginal is summed on the map side.
"""

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

DIMS = ("source", "lang", "topic")
ROUNDS, SCALE_ROUNDS = 6, 6
BOUND_ROUNDS, GOAL_ROUNDS, TOLERANCE = 40, 8, 1e-3      # of bounded raking; a gap above the tolerance is a warning
CELL_ROWS, PLAN_ROUNDS = 200_000, 2      # cells of one task, rounds of one plan over them
NONE = "(none)"


def topic_of(text: str = "text") -> Column:
    """Default topic: what kind of content a text holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.contains("icense"), "licence").when(t.contains("@"), "contact")
            .when(t.contains("###") | t.contains("$$$"), "symbols").when(F.length(t) < 400, "short").otherwise("prose"))


def tokens_of(text: str = "text") -> Column:
    """Default token weight: a quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def uniform(column: str, seed: str = "mix") -> Column:
    """Uniform number in [0, 1) from the md5 of a value."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``w``: shares raked to the
    targets (value, share).  A value without a target keeps its own share."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for d in DIMS:
        own = cells.groupBy(d).agg(F.sum("w").alias("own"))
        t = own.join(targets[d].select(F.col("value").alias(d), "share"), d, "left").select(d, F.coalesce("share", "own").alias(f"t_{d}"))
        cells = cells.join(t, d)
    cells = written(cells, "cells")
    for _ in range(rounds):
        for d in DIMS:
            cells = cells.join(cells.groupBy(d).agg(F.sum("w").alias("m")), d).withColumn("w", F.col("w") * F.col(f"t_{d}") / F.col("m")).drop("m")
        cells = written(cells, "cells")
    return cells


def packed(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written and read in tasks of CELL_ROWS rows: a few hundred cells are
    summed and joined without a shuffle, millions by all tasks."""
    df = written(df, name)
    return df.coalesce(-(-max(1, df.count() if rows is None else rows) // CELL_ROWS))


def within(own: DataFrame, rate: float) -> DataFrame:
    """own (value, own, share): adds ``goal``, the tokens wanted of each value
    when ``rate`` of all are drawn.  A value whose share asks for more tokens
    than it has gives all of them; the others keep their proportions."""
    r = own.agg(F.sum("own").cast("double").alias("n"), F.sum("share").alias("s")).first()
    want = rate * (r["n"] or 0.0)
    scale, filled = want / (r["s"] or 1.0), -1
    for _ in range(GOAL_ROUNDS):     # the filled values only grow in number
        full = F.lit(scale) * F.col("share") >= F.col("own")
        r = own.agg(F.count_if(full).alias("k"), F.sum(F.when(full, F.col("own"))).alias("full"), F.sum(F.when(~full, F.col("share"))).alias("rest")).first()
        if r["k"] == filled or not r["rest"]:
            break
        filled, scale = r["k"], (want - float(r["full"] or 0)) / r["rest"]
    return own.withColumn("goal", F.least(F.col("own").cast("double"), F.lit(scale) * F.col("share")))


def _scaled(d: str) -> str:
    """New weight of a cell, from the drawn tokens (m), full tokens (f) and other
    weights (rest) of its value; a full cell's weight stays within reach of a
    later step."""
    return f"least(w * CASE WHEN rest > 0 AND t_{d} > m THEN (t_{d} - f) / rest ELSE t_{d} / m END, 1e6D * tokens)"


def _step_sql(table: str, d: str) -> str:
    """One step of bounded raking over ``table`` as SQL, summing by windows."""
    over = f"OVER (PARTITION BY {d})"
    return f"""SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, {_scaled(d)} AS w FROM
(SELECT *, sum(least(w, tokens)) {over} AS m, coalesce(sum(CASE WHEN w >= tokens THEN tokens END) {over}, 0) AS f,
 sum(CASE WHEN w < tokens THEN w END) {over} AS rest FROM {table})"""


def rake_bounded(cells: DataFrame, targets: dict[str, DataFrame], rate: float, rounds: int = BOUND_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``w``: tokens to draw of each
    cell, where min(w, tokens) meets the goals of ``within`` in every dimension.

    A step scales the cells of a value that are not full to what its full
    cells leave of the goal.  Goals that contradict one another (a value of one
    dimension found only with a value of another that may give less) stay
    apart after ``rounds``; a gap above ``tolerance`` is a warning.
    """
    cells = cells.withColumn("w", F.lit(rate) * F.col("tokens"))
    for d in DIMS:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("own"))
        all_tokens = own.agg(F.sum("own").cast("double")).first()[0] or 1.0
        own = own.join(targets[d].select(F.col("value").alias(d), "share"), d, "left").withColumn("share", F.coalesce("share", F.col("own") / F.lit(all_tokens)))
        cells = cells.join(within(packed(own, "goals"), rate).select(d, F.col("goal").alias(f"t_{d}")), d)
    n = cells.count()
    cells = packed(cells, "cells", n)
    full, drawn = F.col("w") >= F.col("tokens"), F.least("w", "tokens")
    values = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v"), F.col(f"t_{d}").alias("t")) for d in DIMS]))
    if n <= CELL_ROWS:     # cells of one task are summed in place, several rounds to a plan
        for at in range(0, rounds, PLAN_ROUNDS):
            plan = "{cells}"
            for d in DIMS * min(PLAN_ROUNDS, rounds - at):
                plan = _step_sql(f"({plan})" if plan != "{cells}" else plan, d)
            cells = packed(cells.sparkSession.sql(plan, cells=cells), "cells", n)
    else:
        for _ in range(rounds):
            for d in DIMS:
                sums = cells.groupBy(d).agg(F.sum(drawn).alias("m"), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("f"),
                                            F.sum(F.when(~full, F.col("w"))).alias("rest"))
                cells = cells.join(sums, d).withColumn("w", F.expr(_scaled(d))).drop("m", "f", "rest")
            cells = packed(cells, "cells", n)
    met = cells.select(drawn.alias("u"), values.alias("x")).groupBy("x.d", "x.v").agg(F.sum("u").alias("u"), F.first("x.t").alias("t"))
    gap = met.agg(F.max(F.abs(F.col("u") / F.col("t") - 1))).first()[0] or 0.0
    if gap > tolerance:
        warnings.warn(f"mixing: after {rounds} rounds a share is {gap:.2%} off its goal", stacklevel=2)
    return cells


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares proportional to a power of the token counts."""
    one = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    total = one.agg(F.sum("p")).first()[0] or 1.0
    return one.select(F.col(dim).alias("value"), (F.col("p") / F.lit(total)).alias("share"))


def _scale(cells: DataFrame, rate: float) -> float:
    """Common factor of the raked weights at which ``rate`` of all tokens are expected."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    scale = rate * total
    for _ in range(SCALE_ROUNDS):     # cells that would exceed probability one are full; the rest share what is left
        full = F.lit(scale) * F.col("w") >= F.col("tokens")
        r = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("rest")).first()
        if not r["rest"]:
            break
        scale = (rate * total - float(r["full"] or 0)) / r["rest"]
    return scale


def mix(docs: DataFrame, rate: float = 0.8, powers: tuple[float, float, float] = (0.7, 0.8, 0.9), targets: dict[str, DataFrame] | None = None,
        topic: Column | None = None, tokens: Column | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", bounded: bool = True) -> DataFrame:
    """All columns of ``docs`` with topic, tokens, probability and sampled
    (names that clash are replaced).

    Targets are shares per dimension (value, share); by default tempered token
    shares.  Null sources and languages are a value of their own; null and
    empty texts weigh one token; rows of equal id are drawn alike; an empty
    table gives an empty result.

    ``bounded`` rakes under the bound of probability one (``rake_bounded``), so
    the shares of probability * tokens meet the targets; a value whose target
    asks for more tokens than it has is drawn whole, since nothing is repeated,
    and the rest of its dimension shares what is left.  Without it the raked
    weights are cut at probability one under one common scale, and the shares of
    the sample miss the targets where cells are cut.

    The default topic is the kind of content (``topic_of``) and the default
    weight a quarter of the bytes (``tokens_of``); a table with topics or token
    counts of its own passes their columns.
    """
    names = [c for c in docs.columns if c not in ("topic", "tokens", "probability", "sampled")]
    rows = docs.select(*names, (topic_of() if topic is None else topic).alias("topic"), (tokens_of() if tokens is None else tokens).alias("tokens"))
    place = [F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in DIMS]
    cells = packed(rows.select(*place, "tokens").groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    goal = {d: tempered(cells, d, p) for d, p in zip(DIMS, powers)} | (targets or {})
    if bounded:
        cells, scale = rake_bounded(cells, goal, rate), 1.0
    else:
        cells = rake(cells, goal, rounds)
        scale = _scale(cells, rate)
    cells = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.least(F.lit(1.0), F.lit(scale) * F.col("w") / F.col("tokens")).alias("probability"))
    on = [F.coalesce(rows[d].cast("string"), F.lit(NONE)) == cells[f"__{d}"] for d in DIMS]
    got = rows.join(cells, on[0] & on[1] & on[2]).drop(*[f"__{d}" for d in DIMS])
    return got.withColumn("sampled", uniform(id_col) < F.col("probability"))


def mix_sql(table: str, rate: float = 0.8, powers: tuple[float, float, float] = (0.7, 0.8, 0.9), rounds: int = BOUND_ROUNDS) -> str:
    """DuckDB CTEs (ending in ``mixed``) of the bounded computation over ``table``."""
    sql = [f"""mrows AS MATERIALIZED (SELECT *, CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, 'icense') THEN 'licence' WHEN contains(x, '@') THEN 'contact'
 WHEN contains(x, '###') OR contains(x, '$$$') THEN 'symbols' WHEN length(x) < 400 THEN 'short' ELSE 'prose' END AS topic,
 greatest(1, ceil(strlen(x) / 4.0))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS x FROM {table}))""",
           """cells AS MATERIALIZED (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, topic, sum(tokens)::DOUBLE AS tokens FROM mrows GROUP BY ALL)"""]
    for d, p in zip(DIMS, powers):
        sql.append(f"o_{d} AS MATERIALIZED (SELECT *, pow(own, {p}) / sum(pow(own, {p})) OVER () AS share FROM (SELECT {d}, sum(tokens) AS own FROM cells GROUP BY {d}))")
        sql.append(f"s_{d}_0 AS MATERIALIZED (SELECT {rate} * sum(own) / sum(share) AS s FROM o_{d})")
        for k in range(GOAL_ROUNDS):
            sql.append(f"s_{d}_{k + 1} AS MATERIALIZED (SELECT coalesce(({rate} * sum(own) - coalesce(sum(own) FILTER (WHERE s * share >= own), 0)) / sum(share) FILTER (WHERE s * share < own), min(s)) AS s FROM o_{d}, s_{d}_{k})")
        sql.append(f"g_{d} AS MATERIALIZED (SELECT {d}, least(own, s * share) AS t_{d} FROM o_{d}, s_{d}_{GOAL_ROUNDS})")
    sql.append(f"k0 AS MATERIALIZED (SELECT *, {rate} * tokens AS w FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            sql.append(f"""k{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (w, m, f, rest), least(w * CASE WHEN rest > 0 AND t_{d} > m THEN (t_{d} - f) / rest ELSE t_{d} / m END, 1e6 * tokens) AS w
 FROM (SELECT *, sum(least(w, tokens)) OVER p AS m, coalesce(sum(tokens) FILTER (WHERE w >= tokens) OVER p, 0) AS f, sum(w) FILTER (WHERE w < tokens) OVER p AS rest FROM k{n} WINDOW p AS (PARTITION BY {d})))""")
            n += 1
    sql.append(f"probs AS MATERIALIZED (SELECT source, lang, topic, least(1.0, w / tokens) AS probability FROM k{n})")
    sql.append("""mixed AS MATERIALIZED (SELECT r.* EXCLUDE (x), p.probability, ('0x' || substr(md5('mix:' || coalesce(r.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p.probability AS sampled
 FROM mrows r JOIN probs p ON coalesce(r.source, '(none)') = p.source AND coalesce(r.lang, '(none)') = p.lang AND r.topic = p.topic)""")
    return ",\n".join(sql)
