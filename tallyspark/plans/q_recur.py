"""Registered queries for recurrence detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.classify import recurrence_trial, service_enrich, service_lookup
from ..operators import recur as RC
from . import sqlgen as G
from . import standins as V
from .catalog import register

BILL = V.with_ctes(V.SQL_BILL)
ORD = "(event_ts, message_id)"


def _first(col: str) -> str:
    return f"arg_min({col}, {ORD}) FILTER (WHERE {col} IS NOT NULL) AS {col}"


def _sql_title(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '([A-Za-z]+|[^A-Za-z]+)'), "
            f"lambda x: upper(x[1]) || lower(x[2:])), '')")


_GAP = "(epoch_us(last_ts) - epoch_us(first_ts)) // 86400000000"


def _band(avg: str, titled: bool = False) -> str:
    parts = " ".join(f"WHEN {avg} BETWEEN {lo} AND {hi} THEN {G.q(lbl.title() if titled else lbl)}"
                     for lbl, lo, hi in R.CYCLE_BANDS)
    return f"CASE {parts} END"


def _flag_groups(src: str, attrs) -> str:
    firsts = ",\n         ".join(_first(a) for a in attrs)
    return f"""
g AS (
  SELECT account_id, lower(trim(merchant_name)) AS merchant_key, amount_numeric,
         COUNT(event_ts) AS transaction_count, MIN(event_ts) AS first_ts, MAX(event_ts) AS last_ts,
         arg_min(local_ts, {ORD}) AS first_local, arg_max(local_ts, {ORD}) AS last_local,
         AVG(confidence) AS confidence,
         {firsts}
  FROM {src} WHERE is_subscription AND merchant_name IS NOT NULL AND amount_numeric IS NOT NULL
  GROUP BY ALL)"""


def _trial_sql(name: str, desc: str, amount: str, stype: str) -> tuple[str, str, str]:
    text = f"lower({name} || ' ' || COALESCE({desc}, ''))"
    word = "CASE " + " ".join(f"WHEN contains({text}, {G.q(w)}) THEN {G.q(w)}" for w in R.TRIAL_WORDS_RECUR) + " END"
    cloud = G.contains_any(f"lower({name})", R.CLOUD_PLATFORM_NEEDLES)
    low = f"COALESCE({amount} <= 10, false)"
    reason = (f"CASE WHEN {cloud} AND {low} THEN {G.q(R.CLOUD_TRIAL_REASON)} "
              f"WHEN ({word}) IS NOT NULL THEN 'Contains ''' || ({word}) || '''' "
              f"WHEN {low} THEN 'Low amount (₹' || format('{{:.2f}}', CAST({amount} AS DOUBLE)) || ')' END")
    is_trial = f"({low} OR ({word}) IS NOT NULL)"
    stype_out = f"CASE WHEN {cloud} THEN 'cloud_platform' ELSE {stype} END"
    return is_trial, reason, stype_out


def _sid(prefix: str, name: str, amount: str, extra: str) -> str:
    clean = f"regexp_replace(lower({name}), '[^a-z0-9]', '', 'g')"
    cents = f"CAST(CAST({amount} * 100 AS BIGINT) AS VARCHAR)"
    return (f"'{prefix}_' || {clean} || '_' || left(md5({clean} || '_' || {cents} || '_' || {extra}), 8)")


_FLAG_G = _flag_groups("v_bill", RC.ATTRS)


@register("recurring_flagged", BILL + "," + _FLAG_G + """
SELECT account_id, merchant_key, CAST(amount_numeric AS DOUBLE) AS amount, transaction_count,
       first_ts, last_ts, confidence, merchant_name, category, bank, subscription_type, billing_cycle,
       service_logo, color, is_trial, subject
FROM g""")
def q_recurring_flagged(spark, d):
    g = RC.recurring_flagged(V.bill(spark, d))
    return g.select("account_id", "merchant_key", F.col("amount_numeric").cast("double").alias("amount"),
                    "transaction_count", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
                    F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "confidence",
                    *[a for a in RC.ATTRS])


@register("cycle_inference", BILL + "," + _FLAG_G + f"""
SELECT account_id, merchant_key, CAST(amount_numeric AS DOUBLE) AS amount, {_GAP} AS gap_days,
       COALESCE(NULLIF(billing_cycle, ''),
                CASE WHEN transaction_count > 1 THEN {_band(f'({_GAP}) / (transaction_count - 1)')} END,
                'monthly') AS cycle
FROM g""")
def q_cycle_inference(spark, d):
    g = RC.recurring_flagged(V.bill(spark, d))
    gap = RC.elapsed_days("first_ts", "last_ts")
    return g.select("account_id", "merchant_key", F.col("amount_numeric").cast("double").alias("amount"),
                    gap.alias("gap_days"),
                    RC.infer_cycle(F.col("transaction_count"), gap, F.col("billing_cycle")).alias("cycle"))


def _events_as_bills(spark, d):
    e = V.txn_events(spark, d)
    return e.select("*", F.lit(None).cast("string").alias("subscription_type"),
                    F.lit(None).cast("string").alias("billing_cycle"), F.lit(None).cast("string").alias("service_logo"),
                    F.lit(None).cast("string").alias("color"), F.lit(None).cast("int").alias("confidence"))


_EV_BILL = """
v_ev AS (SELECT *, CAST(NULL AS VARCHAR) AS subscription_type, CAST(NULL AS VARCHAR) AS billing_cycle,
                CAST(NULL AS VARCHAR) AS service_logo, CAST(NULL AS VARCHAR) AS color,
                CAST(NULL AS INTEGER) AS confidence FROM v_txn_events),
v_both AS (SELECT account_id, message_id, merchant_name, amount_numeric, category, bank, subject, local_ts,
                  event_ts, billing_cycle, is_subscription, subscription_type, color, service_logo, confidence,
                  is_trial FROM v_bill
           UNION ALL
           SELECT account_id + 100, message_id, merchant_name, amount_numeric, category, bank, subject, local_ts,
                  event_ts, billing_cycle, is_subscription, subscription_type, color, service_logo, confidence,
                  is_trial FROM v_ev)"""
_TI, _TR, _TT = _trial_sql("merchant_name", "subject", "amount_numeric", "subscription_type")


@register("trial_reason", V.with_ctes(V.SQL_BILL, V.SQL_TXN_EVENTS, _EV_BILL) + "," + _flag_groups(
        "v_both", RC.ATTRS) + f"""
SELECT account_id, merchant_key, CAST(amount_numeric AS DOUBLE) AS amount, {_TI} AS is_trial,
       {_TR} AS trial_reason, {_TT} AS subscription_type
FROM g""")
def q_trial_reason(spark, d):
    cols = ["account_id", "message_id", "merchant_name", "amount_numeric", "category", "bank", "subject",
            "local_ts", "event_ts", "billing_cycle", "is_subscription", "subscription_type", "color",
            "service_logo", "confidence", "is_trial"]
    ev = _events_as_bills(spark, d).withColumn("account_id", F.col("account_id") + 100).select(*cols)
    both = V.bill(spark, d).select(*cols).unionByName(ev)
    g = RC.recurring_flagged(both)
    t = recurrence_trial(F.col("merchant_name"), F.col("subject"), F.col("amount_numeric"), F.col("subscription_type"))
    return g.withColumn("_t", t).select("account_id", "merchant_key",
                                        F.col("amount_numeric").cast("double").alias("amount"),
                                        F.col("_t.is_trial").alias("is_trial"),
                                        F.col("_t.trial_reason").alias("trial_reason"),
                                        F.col("_t.subscription_type").alias("subscription_type"))


_FLAG_OUT = f"""
SELECT account_id,
       {_sid('detected', 'merchant_name', 'amount_numeric', "COALESCE(bank, '') || '_' || CAST(account_id AS VARCHAR)")}
         AS id,
       merchant_name AS service_name, CAST(amount_numeric AS DOUBLE) AS amount,
       {_sql_title(f"COALESCE(NULLIF(billing_cycle, ''), CASE WHEN transaction_count > 1 THEN {_band(f'({_GAP}) / (transaction_count - 1)')} END, 'monthly')")}
         AS billing_cycle,
       CAST(first_local AS DATE) AS start_date, CAST(last_local AS DATE) AS last_payment, category,
       transaction_count, CASE WHEN {_TI} THEN 'Trial' ELSE 'Active' END AS status, {_TR} AS trial_reason,
       confidence AS confidence_score, {_TT} AS subscription_type
FROM g"""


@register("subscription_id", BILL + "," + _FLAG_G + f"""
SELECT account_id, merchant_key, CAST(amount_numeric AS DOUBLE) AS amount,
       {_sid('detected', 'merchant_name', 'amount_numeric', "COALESCE(bank, '') || '_' || CAST(account_id AS VARCHAR)")}
         AS id
FROM g""")
def q_subscription_id(spark, d):
    g = RC.recurring_flagged(V.bill(spark, d))
    return g.select("account_id", "merchant_key", F.col("amount_numeric").cast("double").alias("amount"),
                    RC.subscription_id("detected", F.col("merchant_name"), F.col("amount_numeric"),
                                       F.concat_ws("_", F.coalesce("bank", F.lit("")),
                                                   F.col("account_id").cast("string"))).alias("id"))


def _svc_sql(desc: str) -> dict[str, str]:
    low = f"lower(trim({desc}))"
    words = f"string_split_regex(trim({desc}), '\\s+')"
    def lit(v):
        return G.q(v) if isinstance(v, str) else str(v)

    def hit(i):
        return "CASE " + " ".join(f"WHEN contains({low}, {G.q(r[0])}) THEN {lit(r[i])}"
                                  for r in R.SERVICE_RULES) + " END"
    cloud = G.contains_any(low, R.CLOUD_WORDS)
    two = f"CASE WHEN len({words}) >= 2 THEN {_sql_title(f'{words}[1] || {G.q(chr(32))} || {words}[2]')} " \
          f"ELSE {_sql_title(f'{words}[1]')} END"
    first = f"COALESCE(NULLIF({_sql_title(f'{words}[1]')}, ''), {G.q(R.UNKNOWN_SERVICE)})"
    cs, ci, cc, cconf = R.CLOUD_SERVICE
    os_, oi, oc, oconf = R.OTHER_SERVICE

    def pick(i, cloud_v, other_v):
        return f"COALESCE({hit(i)}, CASE WHEN {cloud} THEN {cloud_v} ELSE {other_v} END)"
    return {"name": pick(1, two, first), "category": pick(2, G.q(cs), G.q(os_)),
            "logo": pick(3, G.q(ci), G.q(oi)), "color": pick(4, G.q(cc), G.q(oc)),
            "confidence": f"CAST({pick(5, str(cconf), str(oconf))} AS INTEGER)"}


_S = _svc_sql("body")


@register("service_lookup", V.with_ctes(V.SQL_MSG) + f"""
SELECT message_id, {_S['name']} AS name, {_S['category']} AS category, {_S['logo']} AS logo,
       {_S['color']} AS color, {_S['confidence']} AS confidence
FROM v_msg""")
def q_service_lookup(spark, d):
    m = V.messages(spark, d).withColumn("_s", service_lookup(F.col("body")))
    return m.select("message_id", "_s.name", "_s.category", "_s.logo", "_s.color",
                    F.col("_s.confidence").cast("int").alias("confidence"))


def _enrich_sql(name: str) -> dict[str, str]:
    low = f"lower(trim({name}))"

    def pick(i):
        parts = " ".join(f"WHEN contains({low}, {G.q(r[0])}) THEN {G.q(r[i])}" for r in R.ENRICH_RULES)
        parts += " " + " ".join(f"WHEN {G.contains_any(low, r[0])} THEN {G.q(r[i])}" for r in R.ENRICH_WORD_RULES)
        return f"CASE {parts} ELSE {G.q(R.ENRICH_OTHER[i - 1])} END"
    return {"category": pick(1), "logo": pick(2), "color": pick(3)}


_E = _enrich_sql("name")


@register("service_enrich", V.with_ctes(V.SQL_MSG) + f"""
, n AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part
        UNION ALL SELECT 'm' || message_id, body FROM v_msg)
SELECT key, {_E['category']} AS category, {_E['logo']} AS logo, {_E['color']} AS color FROM n""")
def q_service_enrich(spark, d):
    p = V.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"),
                                         F.col("p_name").alias("name"))
    m = V.messages(spark, d).select(F.concat(F.lit("m"), F.col("message_id")).alias("key"),
                                    F.col("body").alias("name"))
    n = p.unionByName(m).withColumn("_e", service_enrich(F.col("name")))
    return n.select("key", "_e.category", "_e.logo", "_e.color")


_PS = _svc_sql("subject")
_PTI, _PTR, _ = _trial_sql(_PS["name"], "subject", "amount_numeric", "'other'")
_GROUPS = f"""
pg AS (SELECT account_id, lower(trim(subject)) AS k, amount_numeric, COUNT(event_ts) AS transaction_count,
              MIN(event_ts) AS first_ts, MAX(event_ts) AS last_ts,
              arg_min(local_ts, {ORD}) AS first_local, arg_max(local_ts, {ORD}) AS last_local,
              {_first('subject')}, {_first('bank')}
       FROM pat_src WHERE subject IS NOT NULL AND amount_numeric IS NOT NULL GROUP BY ALL),
pb AS (SELECT *, {_band(f'({_GAP}) / (transaction_count - 1)', True)} AS cycle FROM pg
       WHERE transaction_count >= 2 AND {_GAP} > 0)"""
_PATTERN = ("\npat_src AS (SELECT * FROM v_bill WHERE account_id NOT IN "
            "(SELECT account_id FROM v_bill WHERE is_subscription))," + _GROUPS)
_PAT_OUT = f"""
SELECT account_id, {_sid('pattern', _PS['name'], 'amount_numeric', "cycle || '_' || CAST(account_id AS VARCHAR)")} AS id,
       {_PS['name']} AS service_name, CAST(amount_numeric AS DOUBLE) AS amount, cycle AS billing_cycle,
       CAST(first_local AS DATE) AS start_date, CAST(last_local AS DATE) AS last_payment,
       {_PS['category']} AS category, transaction_count,
       CASE WHEN {_PTI} THEN 'Trial' ELSE 'Active' END AS status, {_PTR} AS trial_reason,
       CAST({_PS['confidence']} AS DOUBLE) AS confidence_score, 'pattern_detected' AS subscription_type
FROM pb WHERE cycle IS NOT NULL"""

_OUT_COLS = ["account_id", "id", "service_name", "amount", "billing_cycle", "start_date", "last_payment",
             "category", "transaction_count", "status", "trial_reason", "confidence_score", "subscription_type"]


def _out(df):
    return df.withColumn("amount", F.col("amount").cast("double")).select(*_OUT_COLS)


@register("recurring_pattern", V.with_ctes(V.SQL_BILL, "\npat_src AS (SELECT * FROM v_bill)," + _GROUPS) + _PAT_OUT)
def q_recurring_pattern(spark, d):
    return _out(RC.recurring_pattern(V.bill(spark, d)))


@register("detect_subscriptions", V.with_ctes(V.SQL_BILL, _PATTERN) + "," + _FLAG_G + _FLAG_OUT +
          "\nUNION ALL\n" + _PAT_OUT, headline=True)
def q_detect_subscriptions(spark, d):
    return _out(RC.detect_subscriptions(V.bill(spark, d)))
