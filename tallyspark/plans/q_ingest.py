"""Registered queries for ingest, search and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import export as X
from ..sources import mail as MAIL
from ..sources import search as S
from . import sqlgen as G
from . import standins as V
from .catalog import register

MS = V.with_ctes(V.SQL_MSG)
_DATE_SQL = ("CASE WHEN o_orderkey % 50 = 7 THEN 'not a date' ELSE strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S') || ' ' || "
             "CASE o_orderkey % 3 WHEN 0 THEN '+0530' WHEN 1 THEN '-0800' ELSE '+0000 (UTC)' END END")


def _parsed(spark, d):
    return MAIL.parse_messages(V.raw_messages(spark, d))


@register("ingest_messages", MS + f"""
SELECT account_id, message_id, subject, sender, {_DATE_SQL} AS date, body
FROM v_msg WHERE o_orderkey % 50 <> 13""", headline=True)
def q_ingest_messages(spark, d):
    good, _bad = MAIL.split_dead_letters(_parsed(spark, d))
    return good.select(F.col("account_id").cast("int").alias("account_id"), "message_id", "subject", "sender",
                       "date", "body")


@register("mail_body_select", MS + """
SELECT message_id, body FROM v_msg WHERE o_orderkey % 50 <> 13""")
def q_mail_body_select(spark, d):
    good, _bad = MAIL.split_dead_letters(_parsed(spark, d))
    return good.select("message_id", "body")


@register("ingest_with_deadletter", MS + """
SELECT account_id, message_id, 'missing content' AS error FROM v_msg WHERE o_orderkey % 50 = 13""")
def q_ingest_with_deadletter(spark, d):
    _good, bad = MAIL.split_dead_letters(_parsed(spark, d))
    return bad.select(F.col("account_id").cast("int").alias("account_id"), "message_id", "error")


_TERMS = ", ".join(f"({i}, {G.q(f)}, {G.q(n.lower())})" for i, (f, n) in enumerate(S.default_terms()))
N_CANDIDATES = 500


@register("candidate_messages", MS + f"""
, terms(ord, field, needle) AS (VALUES {_TERMS})
, m AS (SELECT v.account_id, v.message_id, t.ord AS term_ord FROM v_msg v JOIN terms t ON
        contains(lower(CASE t.field WHEN 'sender' THEN v.sender WHEN 'subject' THEN v.subject ELSE v.body END),
                 t.needle))
, pt AS (SELECT account_id, term_ord, COUNT(*) AS hits FROM m GROUP BY ALL)
, s AS (SELECT account_id, term_ord FROM (
          SELECT *, COALESCE(SUM(hits) OVER (PARTITION BY account_id ORDER BY term_ord
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM pt) WHERE before < {N_CANDIDATES})
, ids AS (SELECT DISTINCT m.account_id, m.message_id FROM m JOIN s USING (account_id, term_ord))
SELECT account_id, message_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY message_id DESC) AS rank FROM ids)
WHERE rank <= {N_CANDIDATES}""")
def q_candidate_messages(spark, d):
    return S.candidate_messages(V.messages(spark, d), N_CANDIDATES)


_EXPORT_SQL = V.with_ctes(V.SQL_TXN_ORDERS) + """
SELECT account_id, message_id, merchant_name, category, bank, CAST(amount_numeric AS DOUBLE) AS amount_numeric,
       local_ts, is_subscription FROM v_txn_orders"""


def _export_input(spark, d):
    return V.txn_orders(spark, d).select("account_id", "message_id", "merchant_name", "category", "bank",
                                         "amount_numeric", "local_ts", "is_subscription")


@register("export_csv", _EXPORT_SQL)
def q_export_csv(spark, d):
    back = X.export_csv_roundtrip(_export_input(spark, d))
    return back.withColumn("amount_numeric", F.col("amount_numeric").cast("double"))


@register("export_json", _EXPORT_SQL)
def q_export_json(spark, d):
    back = X.export_json_roundtrip(_export_input(spark, d))
    return back.withColumn("amount_numeric", F.col("amount_numeric").cast("double"))


_SUBS_SQL = V.with_ctes(V.SQL_SUBS) + """
SELECT account_id, id, service_name, CAST(amount AS DOUBLE) AS amount, category, billing_cycle, status, start_date,
       last_payment, is_trial, brand_color, bank FROM v_subs"""


def _subs_input(spark, d):
    return V.subs(spark, d).select("account_id", "id", "service_name", "amount", "category", "billing_cycle", "status",
                                   "start_date", "last_payment", "is_trial", "brand_color", "bank")


@register("export_subscriptions_csv", _SUBS_SQL)
def q_export_subscriptions_csv(spark, d):
    back = X.export_csv_roundtrip(_subs_input(spark, d))
    return back.withColumn("amount", F.col("amount").cast("double"))


@register("export_subscriptions_json", _SUBS_SQL)
def q_export_subscriptions_json(spark, d):
    back = X.export_json_roundtrip(_subs_input(spark, d))
    return back.withColumn("amount", F.col("amount").cast("double"))


# ----------------------------------------------------------------------------- streaming

@register("stream_transactions", V.with_ctes(V.SQL_MSG) + """
, e AS (SELECT *, CASE o_orderkey % 9 WHEN 4 THEN card WHEN 6 THEN intpart WHEN 7 THEN NULL ELSE amt END AS amount
        FROM v_msg)
SELECT account_id, message_id, CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount_numeric
FROM e WHERE amount IS NOT NULL AND o_orderkey % 50 <> 7""")
def q_stream_transactions(spark, d):
    """Messages land as files in several micro-batches, newest years first,
    and every tenth message is delivered again last; the stream turns them
    into clean transactions, each once; the sink is read back."""
    from ..session import scratch_path
    from ..streaming.mail_stream import run_available
    msgs = V.messages(spark, d).withColumn("account_id", F.col("account_id").cast("string"))
    landing = scratch_path(spark, "landing")
    cores = spark.sparkContext.defaultParallelism
    msgs.repartitionByRange(cores, F.desc("date")).write.mode("overwrite").parquet(landing + "/part=1")
    msgs.filter(F.col("message_id").cast("long") % 10 == 3).write.mode("overwrite").parquet(landing + "/part=2")
    out = run_available(spark, landing, max_files_per_trigger=cores)
    return spark.read.parquet(out).select(F.col("account_id").cast("int"), "message_id",
                                          F.col("amount_numeric").cast("double").alias("amount_numeric"))
