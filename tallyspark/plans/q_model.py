"""Registered queries for model-output handling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.model import model_analysis, model_valid, parse_model_json
from ..operators import analyze as A
from . import sqlgen as G
from . import standins as V
from .catalog import register
from .q_text import _ALL_LABELS, _EXPECT, _RULES

# Expected model results straight from the order columns (see
# ``model_output_column``): k = o_orderkey % 8.
_MODEL = """
v_model AS (
  SELECT *, o_orderkey % 8 AS k,
         o_orderkey % 8 NOT IN (5, 7) AS valid,
         CASE o_orderkey % 8 WHEN 0 THEN 'Food' WHEN 1 THEN 'Shopping' WHEN 2 THEN 'Bills' WHEN 3 THEN 'Big'
              WHEN 4 THEN 'Other Transactions' WHEN 6 THEN 'Travel' END AS m_category,
         CASE WHEN o_orderkey % 8 = 1 THEN 'V' WHEN o_orderkey % 8 NOT IN (5, 7) THEN c_name END AS m_vendor,
         CASE o_orderkey % 8 WHEN 0 THEN CAST(amt AS DECIMAL(18,2)) WHEN 1 THEN CAST(amt AS DECIMAL(18,2))
              WHEN 3 THEN CASE WHEN CAST(amt AS DECIMAL(18,2)) * 100 <= 10000000
                               THEN CAST(amt AS DECIMAL(18,2)) * 100 END
              WHEN 4 THEN CAST(amt AS DECIMAL(18,2)) WHEN 6 THEN CAST(amt AS DECIMAL(18,2)) END AS m_amount,
         CASE WHEN o_orderkey % 8 = 1 THEN 80 WHEN o_orderkey % 8 NOT IN (5, 7) THEN 50 END AS m_confidence,
         CASE WHEN o_orderkey % 8 NOT IN (5, 7) THEN o_orderkey % 8 = 1 END AS m_is_subscription,
         CASE WHEN o_orderkey % 8 NOT IN (5, 7) THEN o_orderkey % 8 = 6
              OR COALESCE(CASE o_orderkey % 8 WHEN 3 THEN CASE WHEN CAST(amt AS DECIMAL(18,2)) * 100 <= 10000000
                           THEN CAST(amt AS DECIMAL(18,2)) * 100 END
                      WHEN 2 THEN NULL ELSE CAST(amt AS DECIMAL(18,2)) END <= 10, false) END AS m_is_trial
  FROM v_rules)"""
MM = V.with_ctes(V.SQL_MSG, _EXPECT, _RULES, _MODEL)


def _mm(spark, d):
    m = V.model_messages(spark, d)
    return m.withColumn("_v", parse_model_json(F.col("model_output")))


@register("parse_model_json", MM + """
SELECT message_id, o_orderkey % 8 NOT IN (7) AS is_json_object, valid FROM v_model""")
def q_parse_model_json(spark, d):
    v = F.col("_v")
    return _mm(spark, d).select("message_id", v.isNotNull().alias("is_json_object"), model_valid(v).alias("valid"))


@register("model_defaults", MM + """
SELECT message_id, m_category AS category, m_vendor AS merchant_name, m_confidence AS confidence,
       m_is_subscription AS is_subscription FROM v_model WHERE valid""")
def q_model_defaults(spark, d):
    m = _mm(spark, d).withColumn("m", model_analysis(None, F.col("subject"), F.col("body"), v=F.col("_v")))
    return m.filter(F.col("m").isNotNull()).select(
        "message_id", "m.category", "m.merchant_name", "m.confidence", "m.is_subscription")


@register("model_amount", MM + """
SELECT message_id, CAST(m_amount AS DOUBLE) AS amount FROM v_model WHERE valid""")
def q_model_amount(spark, d):
    m = _mm(spark, d).withColumn("m", model_analysis(None, F.col("subject"), F.col("body"), v=F.col("_v")))
    return m.filter(F.col("m").isNotNull()).select("message_id", F.col("m.amount").cast("double").alias("amount"))


@register("model_trial", MM + """
SELECT message_id, m_is_trial AS is_trial FROM v_model WHERE valid""")
def q_model_trial(spark, d):
    m = _mm(spark, d).withColumn("m", model_analysis(None, F.col("subject"), F.col("body"), v=F.col("_v")))
    return m.filter(F.col("m").isNotNull()).select("message_id", "m.is_trial")


_RULE_CAT = G.title_map("COALESCE(vendor_category, label)", _ALL_LABELS)


@register("analyze_messages", MM + f"""
SELECT account_id, message_id, CASE WHEN valid THEN 'model' ELSE 'rules' END AS analysis_source,
       CASE WHEN valid THEN CAST(m_amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS amount,
       CASE WHEN valid THEN m_category ELSE {_RULE_CAT} END AS category,
       CASE WHEN valid THEN m_vendor ELSE vendor END AS merchant_name,
       CASE WHEN valid THEN m_confidence ELSE CAST(CASE WHEN score > 0 THEN score * 15 ELSE 25 END AS INTEGER) END
         AS confidence,
       CASE WHEN valid THEN m_is_trial ELSE is_trial END AS is_trial, bank
FROM v_model""", headline=True)
def q_analyze_messages(spark, d):
    t = A.analyze_messages(V.model_messages(spark, d), mode="model")
    return t.select("account_id", "message_id", "analysis_source", F.col("amount").cast("double").alias("amount"),
                    "category", "merchant_name", "confidence", "is_trial", "bank")


@register("analyze_none", V.with_ctes(V.SQL_MSG) + """
SELECT message_id, CAST(NULL AS VARCHAR) AS amount, 'Other' AS category, left(subject, 50) AS merchant_name,
       0 AS confidence, false AS is_subscription, '#6C757D' AS color FROM v_msg""")
def q_analyze_none(spark, d):
    t = A.analyze_messages(V.messages(spark, d), mode="none")
    return t.select("message_id", "amount", "category", "merchant_name", "confidence", "is_subscription", "color")


def demo_scorer(subject: pd.Series, body: pd.Series, bank: pd.Series) -> pd.Series:
    """A stand-in scorer: vendor = subject, category = bank, no amount."""
    import json
    return pd.Series([json.dumps({"category": b, "vendor": s, "confidence": 60})
                      for s, b in zip(subject.fillna(""), bank.fillna(""))])


@register("score_hook", MM + """
SELECT message_id, 'model' AS analysis_source, CAST(NULL AS DOUBLE) AS amount, bank AS category,
       subject AS merchant_name, 60 AS confidence FROM v_model""")
def q_score_hook(spark, d):
    t = A.score_hook(V.messages(spark, d), demo_scorer)
    return t.select("message_id", "analysis_source", F.col("amount").cast("double").alias("amount"),
                    "category", "merchant_name", "confidence")


def partial_scorer(subject, body, bank):
    """The demo scorer, which raises on a batch that holds an amount with 13 cents."""
    if body.fillna("").str.contains(".13", regex=False).any():
        raise RuntimeError("cannot read this amount")
    return demo_scorer(subject, body, bank)


@register("score_hook_isolated", MM + f"""
, bad AS (SELECT *, contains(body, '.13') AS failed FROM v_model)
SELECT message_id, CASE WHEN failed THEN 'rules' ELSE 'model' END AS analysis_source,
       CASE WHEN failed THEN CAST(amount AS DOUBLE) END AS amount,
       CASE WHEN failed THEN {G.title_map('COALESCE(vendor_category, label)', _ALL_LABELS)} ELSE bank END AS category,
       CASE WHEN failed THEN vendor ELSE subject END AS merchant_name,
       CASE WHEN failed THEN 'RuntimeError: cannot read this amount' END AS score_error
FROM bad""")
def q_score_hook_isolated(spark, d):
    t = A.score_hook(V.messages(spark, d), partial_scorer, errors=True)
    return t.select("message_id", "analysis_source", F.col("amount").cast("double").alias("amount"), "category", "merchant_name", "score_error")
