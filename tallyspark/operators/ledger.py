"""Subscription ledger with set-style edits (operators G1-G7).

The ledger is a DataFrame (one row per subscription, ``seq`` = list
position).  Edits are DataFrames too, so a batch of adds, updates or deletes
for many accounts is one join, not a loop: merges are anti joins on
``(account_id, lower(name))``, updates a left join on ``(account_id, id)``,
deletes an anti join.  Ties that the reference leaves to list order are
broken by ``seq`` (Python's sort is stable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.amount import MONEY, TRIAL_MAX, low_amount_reason
from ..functions.classify import service_enrich
from .frames import order_blocks, running
from .recur import subscription_id

KEYS = ("account_id",)

LEDGER_COLUMNS = ["account_id", "id", "seq", "service_name", "service_logo", "amount", "billing_cycle",
                  "start_date", "last_payment", "category", "brand_color", "bank", "transaction_count", "status",
                  "auto_detected", "original_description", "confidence_score", "subscription_type", "is_trial",
                  "trial_reason"]
_TYPES = {"account_id": "string", "id": "string", "seq": "long", "service_name": "string", "service_logo": "string",
          "amount": MONEY, "billing_cycle": "string", "start_date": "date", "last_payment": "date",
          "category": "string", "brand_color": "string", "bank": "string", "transaction_count": "long",
          "status": "string", "auto_detected": "boolean", "original_description": "string",
          "confidence_score": "double", "subscription_type": "string", "is_trial": "boolean",
          "trial_reason": "string"}


def conform(df: DataFrame) -> DataFrame:
    """Project any subscription-shaped frame onto the ledger schema (absent
    columns become NULL, i.e. 'key absent').  Accounts keep their type."""
    cols = []
    for c in LEDGER_COLUMNS:
        src = F.col(c) if c in df.columns else F.lit(None)
        kind = df.schema[c].dataType if c == "account_id" and c in df.columns else _TYPES[c]
        cols.append(src.cast(kind).alias(c))
    return df.select(*cols)


def _next_seq(ledger: DataFrame, new: DataFrame, order: list[Column], keys=KEYS) -> DataFrame:
    """Give new rows ledger positions after the account's last ``seq``."""
    top = ledger.groupBy(*keys).agg(F.max("seq").alias("_max_seq"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return (new.join(top, list(keys), "left")
            .withColumn("seq", F.coalesce(F.col("_max_seq"), F.lit(0)) + F.row_number().over(w))
            .drop("_max_seq"))


def merge_subscriptions(ledger: DataFrame, detected: DataFrame, keys=KEYS) -> DataFrame:
    """G1: append detected subscriptions whose lower-case name is not in the
    ledger (any status), keeping only the first of each name in detection
    order (``detect_order``), then positions after the ledger's."""
    name_key = F.lower(F.col("service_name"))
    existing = ledger.select(*keys, name_key.alias("_nk")).distinct()
    cand = detected.withColumn("_nk", name_key).join(existing, [*keys, "_nk"], "left_anti")
    first = (cand.groupBy(*keys, "_nk")
             .agg(F.min_by(F.struct(*[c for c in cand.columns if c not in (*keys, "_nk")]),
                           F.struct("detect_order", "id")).alias("_r"))
             .select(*keys, "_r.*"))
    new = _next_seq(ledger, first, [F.col("detect_order"), F.col("id")], keys)
    return unique_ids(conform(ledger).unionByName(conform(new)), keys)


ID_BLOCK = 100_000     # positions, suffixes or repeats of a block


def unique_ids(ledger: DataFrame, keys=KEYS) -> DataFrame:
    """Repeats (in ``seq`` order) of an id within an account get the
    suffixes ``_dup_1``, ``_dup_2``, ... that no other id of the account has.

    The n-th repeat gets the n-th free number.  A taken number t with j taken
    ones below it has t - 1 - j free ones below it, so it is skipped by every
    repeat from the (t - j)-th on: the number of the n-th repeat is n plus the
    taken ones with t - j <= n.  All three counts are running sums over blocks,
    so one id repeated any number of times is the work of many tasks."""
    group = [*keys, "id"]

    def blocks(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(ID_BLOCK))

    numbered = running(ledger, group, ["seq"], blocks("seq"), name="_n").withColumn("_n", F.col("_n") - 1)
    suffix = r"^(?s)(.*)_dup_([0-9]{1,9})$"
    taken = (ledger.where(F.col("id").rlike(suffix))
             .select(*keys, F.regexp_extract("id", suffix, 1).alias("id"), F.regexp_extract("id", suffix, 2).try_cast("long").alias("_t"))
             .where("_t > 0").distinct())
    taken = running(taken, group, ["_t"], blocks("_t"), name="_j").withColumn("_n", F.col("_t") - F.col("_j") + 1)
    skips = taken.groupBy(*group, "_n").agg(F.count("*").alias("_skip")).withColumn("_row", F.lit(False))
    both = numbered.withColumn("_skip", F.lit(0).cast("long")).withColumn("_row", F.lit(True)).unionByName(skips, allowMissingColumns=True)
    both = running(both, group, ["_n", "_row"], blocks("_n"), F.col("_skip"), name="_skipped").where("_row")
    new = F.when(F.col("_n") > 0, F.concat(F.col("id"), F.lit("_dup_"), (F.col("_n") + F.col("_skipped")).cast("string"))).otherwise(F.col("id"))
    return both.select(*[new.alias("id") if c == "id" else F.col(c) for c in ledger.columns])


def _trial_fields(amount: Column, status: Column) -> tuple[Column, Column, Column]:
    low = F.coalesce(amount <= TRIAL_MAX, F.lit(False))
    return (F.when(low, F.lit("Trial")).otherwise(status), low,
            F.when(low, low_amount_reason(amount)))


def ledger_add(ledger: DataFrame, adds: DataFrame, keys=KEYS) -> DataFrame:
    """Manual adds (``service_name, amount, billing_cycle, category,
    start_date, last_payment, status, bank`` and optionally ``service_logo``,
    ``brand_color``, ordered by ``add_seq``).  Amount at most 10 forces status
    Trial; missing icon or colour is filled from the enrichment rules, and
    the category only when empty."""
    a = adds
    for c in ("service_logo", "brand_color", "category", "bank", "start_date", "last_payment"):
        if c not in a.columns:
            a = a.withColumn(c, F.lit(None))
    amount = F.col("amount").cast(MONEY)
    status, is_trial, reason = _trial_fields(amount, F.col("status"))
    e = service_enrich(F.col("service_name"))
    need = F.col("service_logo").isNull() | F.col("brand_color").isNull()
    a = a.withColumn("_e", e).select(
        *keys, "add_seq",
        subscription_id("manual", F.col("service_name"), amount, F.col(keys[0]).cast("string")).alias("id"),
        "service_name", amount.alias("amount"), "billing_cycle", "start_date", "last_payment", "bank",
        F.when(need, F.col("_e.logo")).otherwise(F.col("service_logo")).alias("service_logo"),
        F.when(need, F.col("_e.color")).otherwise(F.col("brand_color")).alias("brand_color"),
        F.when(need & (F.coalesce(F.col("category"), F.lit("")) == ""), F.col("_e.category"))
         .otherwise(F.col("category")).alias("category"),
        status.alias("status"), is_trial.alias("is_trial"), reason.alias("trial_reason"),
        F.lit(False).alias("auto_detected"))
    new = _next_seq(ledger, a, [F.col("add_seq")], keys)
    return unique_ids(conform(ledger).unionByName(conform(new)), keys)


UPDATABLE = ("service_name", "amount", "billing_cycle", "category", "status", "start_date", "last_payment",
             "bank", "service_logo", "brand_color")


EDIT_BLOCK = 1_000_000     # edits of a block, about


def ledger_update(ledger: DataFrame, edits: DataFrame, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Apply the edits of each id one after the other, in ``edit_seq`` order
    (a NULL field means 'not sent'; equal ``edit_seq`` of one id follow a hash of
    their values).  In each edit, an amount that crosses the trial threshold flips
    trial and status and overrides a sent status; a name that differs from the
    present one re-enriches icon, colour and category (overwriting sent ones).  Of
    rows with one id the first by ``seq`` is edited.  Returns the updated ledger
    and the edits whose id is unknown.

    What an edit does depends only on the last amount and the last name before
    it.  Those come from a window inside its block of edits, else from the blocks
    before, else from the ledger; then each field keeps the last value that some
    edit gave it.
    """
    who = [*keys, "id"]
    e = edits
    for c in UPDATABLE:
        if c not in e.columns:
            e = e.withColumn(c, F.lit(None).cast(_TYPES[c]))
    e = order_blocks(e.select(*who, "edit_seq", *[F.col(c).cast(_TYPES[c]).alias(c) for c in UPDATABLE]), "edit_seq", EDIT_BLOCK)
    e = e.withColumn("_at", F.struct("edit_seq", F.xxhash64(*UPDATABLE))).withColumn("_low", F.col("amount") <= TRIAL_MAX)

    def last_sent(value, sent: Column) -> Column:
        return F.max_by(value, F.when(sent, F.col("_at")))

    def before(w, c: str) -> Column:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    base = ledger.groupBy(*who).agg(F.min(F.struct("seq", "service_name", "is_trial")).alias("_base"))
    blocks = (e.groupBy(*who, "_block").agg(last_sent("_low", F.col("_low").isNotNull()).alias("_low"),
                                            last_sent("service_name", F.col("service_name").isNotNull()).alias("_name")))
    earlier = Window.partitionBy(*who).orderBy("_block")
    blocks = (blocks.withColumn("_low", before(earlier, "_low")).withColumn("_name", before(earlier, "_name")).join(base, who)
              .select(*who, "_block", F.col("_base.seq").alias("_seq"), F.coalesce("_low", "_base.is_trial", F.lit(False)).alias("_was_low"),
                      F.coalesce("_name", "_base.service_name").alias("_was_name")))
    inside = Window.partitionBy(*who, "_block").orderBy("_at")
    steps = (e.withColumn("_enr", service_enrich("service_name"))
             .withColumn("_before_low", before(inside, "_low")).withColumn("_before_name", before(inside, "service_name"))
             .join(blocks, [*who, "_block"]))
    was_low, was_name = F.coalesce("_before_low", "_was_low"), F.coalesce("_before_name", "_was_name")
    to_trial, to_active = F.col("_low") & ~was_low, ~F.col("_low") & was_low
    renamed = F.col("service_name").isNotNull() & ~F.col("service_name").eqNullSafe(was_name)
    steps = (steps.withColumn("_renamed", renamed)
             .withColumn("_turn", F.when(to_trial, F.struct(F.lit("Trial").alias("status"), F.lit(True).alias("is_trial"),
                                                            low_amount_reason("amount").alias("reason")))
                         .when(to_active, F.struct(F.lit("Active").alias("status"), F.lit(False).alias("is_trial"), F.lit(None).cast("string").alias("reason")))))
    given = {c: F.col(c) for c in UPDATABLE}
    given["status"] = F.coalesce("_turn.status", "status")
    for c, part in (("category", "category"), ("service_logo", "logo"), ("brand_color", "color")):
        given[c] = F.when(F.col("_renamed"), F.col(f"_enr.{part}")).otherwise(F.col(c))
    last = steps.groupBy(*who).agg(F.first("_seq").alias("_seq"), last_sent("_turn", F.col("_turn").isNotNull()).alias("_turn"),
                                   *[last_sent(v, v.isNotNull()).alias(f"n_{c}") for c, v in given.items()])
    j = ledger.withColumnRenamed("seq", "_pos").join(last, who, "left").withColumn("seq", F.col("_pos"))
    mine = F.col("_seq").eqNullSafe(F.col("_pos"))
    out = {c: F.when(mine, F.coalesce(f"n_{c}", c)).otherwise(F.col(c)) for c in UPDATABLE if c in ledger.columns}
    turned = mine & F.col("_turn").isNotNull()
    out["is_trial"] = F.when(turned, F.col("_turn.is_trial")).otherwise(F.col("is_trial"))
    if "trial_reason" in ledger.columns:
        out["trial_reason"] = F.when(turned, F.col("_turn.reason")).otherwise(F.col("trial_reason"))
    unmatched = edits.join(ledger.select(*who).distinct(), who, "left_anti")
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in ledger.columns]), unmatched


def ledger_clear(ledger: DataFrame) -> DataFrame:
    """The ledger without any subscription, under the same columns."""
    return ledger.limit(0)


def ledger_delete(ledger: DataFrame, deletes: DataFrame, keys=KEYS) -> DataFrame:
    """Remove every subscription whose id is listed."""
    return ledger.join(deletes.select(*keys, "id"), [*keys, "id"], "left_anti")


def ledger_view(ledger: DataFrame, statuses=("Active", "Trial"), categories=None, sort: str = "amount_desc",
                as_of=None, keys=KEYS) -> DataFrame:
    """Filter by status (missing counts as Active) and category (missing
    counts as 'Other'), then sort; ``seq`` keeps the original order of ties.
    Adds ``view_rank`` per account."""
    st = F.coalesce(F.col("status"), F.lit("Active"))
    df = ledger.filter(st.isin(list(statuses)))
    if categories is not None:
        df = df.filter(F.coalesce(F.col("category"), F.lit("Other")).isin(list(categories)))
    from .metrics import next_payment
    order = {
        "amount_desc": [F.col("amount").desc()],
        "amount_asc": [F.col("amount").asc()],
        "name": [F.col("service_name").asc()],
        "next_payment": [next_payment().asc()],
    }[sort] + [F.col("seq").asc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("view_rank", F.row_number().over(w))
