"""Messages -> typed transactions (operators B15, C5, C6, C7, B14, B16).

One narrow projection per message: bank from the sender, cleaned body, amount
cascade, vendor cascade, flags, category arg-max and confidence — all native
expressions.  The model path reads a ``model_output`` column (produced by any
scorer, see ``score_hook``) and falls back to the rules path per row, exactly
where the reference's model path would raise.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import classify as C
from ..functions.amount import extract_amount
from ..functions.model import model_analysis, parse_model_json
from ..functions.text import html_to_text, preview, strip_unicode, title_case, truncate

from .frames import order_blocks, running, text_position

KEYS = ("account_id",)


def _preset_color(category_lower: Column) -> Column:
    expr = None
    for name, color in R.PRESET_COLORS:
        expr = F.when(category_lower == name, F.lit(color)) if expr is None else \
            expr.when(category_lower == name, F.lit(color))
    return expr


def palette_color(category_lower: Column) -> Column:
    """Palette colour of a category without one of its own, chosen by a hash of
    the name: the same in every account, whatever other categories exist."""
    pal = F.array(*[F.lit(c) for c in R.PALETTE])
    h = F.conv(F.substring(F.md5(category_lower), 1, 7), 16, 10).cast("int")
    return F.get(pal, h % len(R.PALETTE))


ANALYSIS_FIELDS = ["amount", "category", "merchant_name", "color", "confidence", "is_subscription",
                   "subscription_type", "billing_cycle", "service_logo", "is_trial"]


def with_rules_analysis(df: DataFrame, subject: str = "subject", body: str = "body",
                        prefix: str = "r_", only_when: Column | None = None) -> DataFrame:
    """Add the rules-path analysis of each message as flat columns
    ``<prefix><field>`` (fields in ``ANALYSIS_FIELDS``).

    Built in stages (cleaned body, then text, amount and vendor candidates,
    then the category arg-max, then the fields) so each heavy expression is
    evaluated once per row.  The fields stay flat columns rather than one
    struct: a later filter on one field (say ``amount > 0``) is then pushed
    down with that field's expression only.

    ``only_when`` restricts the work to rows where it is true (other rows get
    NULL fields): the model path uses it so the rules run only where the
    scorer's answer is unusable."""
    subj = F.coalesce(F.col(subject), F.lit(""))

    def g(e: Column) -> Column:
        return e if only_when is None else F.when(only_when, e)

    s1 = df.withColumn("_body_clean", g(html_to_text(F.col(body)))).withColumn("_body_low", F.lower("_body_clean"))
    s2 = (s1.withColumn("_text", F.concat_ws(" ", F.lower(subj), F.col("_body_low")))
          .withColumn("_amount", g(extract_amount(F.concat_ws(" ", subj, F.coalesce(F.col(body), F.lit(""))))))
          .withColumn("_vcands", F.array(*C.vendor_candidates(F.col("_body_clean"), F.col("_body_low")))))
    s3 = (s2.withColumn("_vendor", C.pick_vendor([F.col("_vcands")[i] for i in range(len(C.VENDOR_PATTERNS))]))
          .withColumn("_best", C.category_score(F.col("_text")))
          .withColumn("_is_sub", C.flag_subscription(F.col("_text"))))
    text, score, vendor, is_sub = F.col("_text"), F.col("_best.score"), F.col("_vendor"), F.col("_is_sub")
    s4 = s3.withColumn("_vcat", C.category_from_vendor(vendor, score))
    vcat = F.col("_vcat")
    cat_lower = F.coalesce(vcat, C.category_label(F.col("_best")))
    color = F.coalesce(_preset_color(cat_lower), F.when(score > 0, F.col("_best.color")),
                       C.vendor_category_color(vcat), palette_color(cat_lower))
    amount = F.col("_amount")
    trial = C.flag_trial(text, amount.try_cast("decimal(18,2)"), R.TRIAL_WORDS_RULES)
    fields = {
        "amount": amount,
        "category": title_case(cat_lower),
        "merchant_name": vendor,
        "color": color,
        "confidence": C.rule_confidence(score),
        "is_subscription": is_sub,
        "subscription_type": C.subscription_type(text, is_sub),
        "billing_cycle": C.stated_cycle(text, is_sub),
        "service_logo": C.subscription_icon(text, is_sub),
        "is_trial": trial,
    }
    out = s4.select("*", *[fields[f].alias(prefix + f) for f in ANALYSIS_FIELDS])
    return out.drop("_body_clean", "_body_low", "_text", "_amount", "_vcands", "_vendor", "_best", "_is_sub",
                    "_vcat")


def _model_fields(m: Column) -> dict:
    return {
        "amount": m["amount"].cast("string"), "category": m["category"], "merchant_name": m["merchant_name"],
        "color": F.coalesce(_preset_color(F.lower(m["category"])), palette_color(F.lower(m["category"]))), "confidence": m["confidence"],
        "is_subscription": m["is_subscription"], "subscription_type": m["subscription_type"],
        "billing_cycle": m["billing_cycle"], "service_logo": m["service_logo"], "is_trial": m["is_trial"]}


def none_fields(subject: Column) -> dict:
    """No scorer configured: fixed analysis, merchant = first 50
    characters of the subject, rules path not used."""
    return {"amount": F.lit(None).cast("string"), "category": F.lit(R.NONE_CATEGORY),
            "merchant_name": truncate(subject, 50), "color": F.lit(R.NONE_COLOR), "confidence": F.lit(0),
            "is_subscription": F.lit(False), "subscription_type": F.lit(None).cast("string"),
            "billing_cycle": F.lit(None).cast("string"), "service_logo": F.lit(R.DEFAULT_ICON),
            "is_trial": F.lit(False)}


def analyze_messages(messages: DataFrame, mode: str = "rules", keep=()) -> DataFrame:
    """Messages (account_id, message_id, subject, sender, date, body
    [, model_output]) -> transactions.

    ``mode``: 'model' uses ``model_output`` where valid and the rules path
    elsewhere (C5); 'rules' always uses the rules path (B15); 'none' is the
    no-scorer default (C6)."""
    subj = F.col("subject")
    if mode == "model":
        staged = messages.withColumn("_v", parse_model_json(F.col("model_output")))
        staged = staged.withColumn("_m", model_analysis(None, subj, F.col("body"), v=F.col("_v")))
        base = with_rules_analysis(staged, only_when=F.col("_m").isNull())
        m = F.col("_m")
        mf = _model_fields(m)
        fields = {f: F.when(m.isNotNull(), mf[f]).otherwise(F.col("r_" + f)) for f in ANALYSIS_FIELDS}
        src = F.when(m.isNotNull(), F.lit("model")).otherwise(F.lit("rules"))
    elif mode == "rules":
        base = with_rules_analysis(messages)
        fields = {f: F.col("r_" + f) for f in ANALYSIS_FIELDS}
        src = F.lit("rules")
    elif mode == "none":
        base = messages
        fields = none_fields(subj)
        src = F.lit("none")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return base.select(
        "account_id", "message_id", "date", C.resolve_bank("sender").alias("bank"), "subject", "sender",
        *keep,
        *[fields[f].alias(f) for f in ANALYSIS_FIELDS],
        src.alias("analysis_source"),
        preview(F.coalesce(F.col("body"), F.lit("")), 200).alias("email_body_preview"),
    )


def isolated(scorer: Callable, *columns: pd.Series) -> pd.DataFrame:
    """Answers of a scorer over a batch, with the error of each row that it
    cannot answer: spans are scored from the first row on; in a span that raises
    the first bad row is found by halving, and the next span is as long as the
    rows from one bad row to the next were so far, doubled while spans succeed.
    A scorer that gives another number of answers than it got rows counts as
    raising; a missing answer is NULL, any other becomes its text."""
    n = len(columns[0])
    answers: list = [None] * n
    errors: list = [None] * n

    def span(c: pd.Series, low: int, high: int) -> pd.Series:
        part = c.iloc[low:high]
        part.index = pd.RangeIndex(high - low)
        return part

    def scored(low: int, high: int) -> bool:
        try:
            got = list(scorer(*[span(c, low, high) for c in columns]))
            if len(got) != high - low:
                raise ValueError(f"{len(got)} answers to {high - low} rows")
        except Exception as e:  # noqa: BLE001  whatever a scorer raises stays with its row
            if high - low == 1:
                errors[low] = f"{type(e).__name__}: {e}"
            return False
        answers[low:high] = [x if x is None or isinstance(x, str) else None if pd.api.types.is_scalar(x) and pd.isna(x) else str(x) for x in got]
        return True

    at, width, raised = 0, n, 0
    while at < n:
        high = min(at + width, n)
        if scored(at, high):
            at, width = high, 2 * width
            continue
        while high - at > 1:    # the rows before ``at`` have their answers, a bad one is before ``high``
            middle = (at + high) // 2
            if scored(at, middle):
                at = middle
            else:
                high = middle
        if errors[at] is None:
            scored(at, high)
        at, raised = high, raised + 1
        width = max(1, at // raised)
    return pd.DataFrame({"answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})


def score_hook(messages: DataFrame, scorer: Callable, mode: str = "model", errors: bool = False) -> DataFrame:
    """User-supplied scorer in place of the remote model call.

    ``scorer(subject: pd.Series, body: pd.Series, bank: pd.Series) ->
    pd.Series[str]`` runs as an Arrow-batched pandas UDF; its text goes
    through the same C1-C5 handling.  A row on which it raises has no answer
    and falls to the rules path, the other rows of its batch keep theirs
    (``errors`` adds the text of each error as ``score_error``).  A batch of n
    rows with k bad ones costs about k (log2(n / k) + 3) more calls.  No network
    client ships with the library."""
    @F.pandas_udf("struct<answer: string, error: string>")
    def _score(subject: pd.Series, body: pd.Series, bank: pd.Series) -> pd.DataFrame:
        return isolated(scorer, subject, body, bank)

    withbank = messages.withColumn("_bank", C.resolve_bank("sender"))
    scored = withbank.withColumn("_answer", _score(F.col("subject"), F.col("body"), F.col("_bank")))
    scored = scored.withColumn("model_output", F.col("_answer.answer")).withColumn("score_error", F.col("_answer.error")).drop("_bank", "_answer")
    return analyze_messages(scored, mode=mode, keep=("score_error",) if errors else ())


def category_colors(txns: DataFrame, known: DataFrame | None = None, keys=KEYS, block_rows: int = 1_000_000) -> DataFrame:
    """The colour dictionary of each account: one row (account,
    category_key, ordinal, color) per category.

    A known name has its preset colour and no ordinal.  The other categories
    are numbered from 1 and take the palette's colours in turn, so no two share
    one before the palette is used up.  ``known`` is the dictionary so far: its
    rows stay as they are, and new categories, in order of their names, are
    numbered behind them.  Rows without a category have no entry."""
    cats = txns.select(*keys, F.lower("category").alias("category_key")).where("category_key is not null").distinct()
    if known is not None:
        cats = cats.join(known.select(*keys, "category_key"), [*keys, "category_key"], "left_anti")
    cats = cats.withColumn("color", _preset_color(F.col("category_key"))).withColumn("_at", text_position(F.col("category_key")))
    preset = cats.where("color is not null").select(*keys, "category_key", F.lit(None).cast("long").alias("ordinal"), "color")
    new = order_blocks(cats.where("color is null"), "_at", block_rows, "_along")
    new = running(new, list(keys), ["category_key"], F.col("_along"), name="ordinal")
    if known is not None:
        new = (new.join(known.groupBy(*keys).agg(F.max("ordinal").alias("_last")), list(keys), "left")
               .withColumn("ordinal", F.col("ordinal") + F.coalesce("_last", F.lit(0))))
    palette = F.array(*[F.lit(c) for c in R.PALETTE])
    color = F.get(palette, ((F.col("ordinal") - 1) % len(R.PALETTE)).cast("int"))
    out = preset.unionByName(new.select(*keys, "category_key", "ordinal", color.alias("color")))
    return out if known is None else known.select(out.columns).unionByName(out)


def vendor_dim(txns: DataFrame, keys=KEYS) -> DataFrame:
    """First-seen attributes per vendor key (lower-cased, trimmed
    merchant name); "first" is the earliest (event_ts, message_id).  Without a
    colour of its own a vendor has its category's."""
    k = strip_unicode(F.lower("merchant_name"))
    attrs = ("merchant_name", "category", "color", "is_subscription", "subscription_type", "service_logo", "is_trial")
    absent = [c for c in attrs if c not in txns.columns]
    rows = txns.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else txns
    first = F.min_by(F.struct(*attrs), F.struct("event_ts", "message_id"))
    name = F.lower("f.category")
    return (rows.groupBy(*keys, k.alias("vendor_key")).agg(first.alias("f"))
            .select(*keys, "vendor_key", F.col("f.merchant_name").alias("display_name"), "f.category",
                    F.coalesce("f.color", _preset_color(name), palette_color(name)).alias("color"), "f.is_subscription",
                    "f.subscription_type", "f.service_logo", "f.is_trial"))
