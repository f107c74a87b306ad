"""Stand-in inputs built from the driver tables.

The reference reads one mailbox; the driver provides TPC-H-like tables.  Each
stand-in maps those tables onto this library's inputs (transactions,
bills, subscriptions, messages, model answers) with Spark, and the same
mapping is given as a SQL common table expression for the DuckDB oracle.
Every stand-in grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amount import MONEY

AS_OF = "2025-10-15"
DEALT_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------- transactions from events

def txn_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 10).alias("account_id"),
        F.col("event_id").cast("string").alias("message_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("merchant_name"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("bank "), (F.col("user_id") % 5).cast("string")).alias("bank"),
        F.concat(F.lit("event "), F.col("event_type")).alias("subject"),
        F.col("value").cast(MONEY).alias("amount_numeric"),
        F.col("ts").cast("timestamp_ntz").alias("local_ts"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        (F.col("event_type") == "signup").alias("is_subscription"),
        (F.col("value") <= 10).alias("is_trial"),
    )


SQL_TXN_EVENTS = """
v_txn_events AS (
  SELECT user_id % 10 AS account_id, CAST(event_id AS VARCHAR) AS message_id,
         'user ' || CAST(user_id AS VARCHAR) AS merchant_name, event_type AS category,
         'bank ' || CAST(user_id % 5 AS VARCHAR) AS bank, 'event ' || event_type AS subject,
         CAST(value AS DECIMAL(18,2)) AS amount_numeric, ts AS local_ts, ts AS event_ts,
         event_type = 'signup' AS is_subscription, value <= 10 AS is_trial
  FROM events)"""


# ----------------------------------------------------------------------------- transactions from orders

def txn_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    amt = F.col("o_totalprice").cast(MONEY).cast("string")
    k = F.col("o_orderkey") % 10
    return j.select(
        F.col("c_nationkey").alias("account_id"),
        F.col("o_orderkey").cast("string").alias("message_id"),
        F.col("c_name").alias("merchant_name"),
        F.col("o_orderpriority").alias("category"),
        F.col("c_mktsegment").alias("bank"),
        F.concat(F.lit("order "), F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority")).alias("subject"),
        F.col("o_totalprice").cast(MONEY).alias("amount_numeric"),
        F.when(k == 0, F.concat(F.lit("-"), amt)).when(k == 1, F.lit(None).cast("string"))
         .when(k == 2, F.lit("abc")).when(k == 3, F.lit("1.2.3")).otherwise(amt).alias("amount"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("local_ts"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"),
        (F.col("o_orderstatus") == "F").alias("is_subscription"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 13 == 0)).alias("is_trial"),
    )


SQL_TXN_ORDERS = """
v_txn_orders AS (
  SELECT c.c_nationkey AS account_id, CAST(o.o_orderkey AS VARCHAR) AS message_id,
         c.c_name AS merchant_name, o.o_orderpriority AS category, c.c_mktsegment AS bank,
         'order ' || o.o_orderstatus || ' ' || o.o_orderpriority AS subject,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount_numeric,
         CASE o.o_orderkey % 10 WHEN 0 THEN '-' || CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
              WHEN 1 THEN NULL WHEN 2 THEN 'abc' WHEN 3 THEN '1.2.3'
              ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
         o.o_orderdate AS local_ts, o.o_orderdate AS event_ts,
         o.o_orderstatus = 'F' AS is_subscription,
         (o.o_orderstatus = 'F' AND o.o_orderkey % 13 = 0) AS is_trial
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def dealt(df: DataFrame) -> DataFrame:
    """A driver table dealt over all cores, at most DEALT_ROWS or so to a task: its
    file is a single row group, which one task would read and then work on alone.  The key passes through a
    non-deterministic projection, so that later filters stay behind the deal."""
    key = df.columns[0]
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS))
    return (df.repartition(parts)
            .withColumn(key, F.when(F.spark_partition_id() >= 0, F.col(key))))


# ----------------------------------------------------------------------------- bills (recurrence input)

def bill(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier")
    li = dealt(li)
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(
        F.col("s_nationkey").alias("account_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("message_id"),
        F.col("s_name").alias("merchant_name"),
        F.col("p_retailprice").cast(MONEY).alias("amount_numeric"),
        F.col("p_type").alias("category"),
        F.col("l_returnflag").alias("bank"),
        F.concat_ws(" ", "s_name", "p_type", "p_name", F.col("l_partkey").cast("string")).alias("subject"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("local_ts"),
        F.col("l_shipdate").cast("timestamp").alias("event_ts"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("monthly")).alias("billing_cycle"),
        (F.col("s_nationkey") % 2 == 0).alias("is_subscription"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("saas")).alias("subscription_type"),
        F.when(F.col("l_linenumber") % 3 == 1, F.lit("#336699")).alias("color"),
        F.when(F.col("l_linenumber") % 4 == 1, F.lit("☁️")).alias("service_logo"),
        F.col("l_quantity").cast("int").alias("confidence"),
        (F.col("p_type") == "PROMO").alias("is_trial"),
    )


SQL_BILL = """
v_bill AS (
  SELECT s.s_nationkey AS account_id,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' ||
         CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) || '-' ||
         strftime(l.l_shipdate, '%Y%m%d') || '-' || CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR)
           AS message_id,
         s.s_name AS merchant_name, CAST(p.p_retailprice AS DECIMAL(18,2)) AS amount_numeric,
         p.p_type AS category, l.l_returnflag AS bank,
         s.s_name || ' ' || p.p_type || ' ' || p.p_name || ' ' || CAST(l.l_partkey AS VARCHAR) AS subject,
         l.l_shipdate AS local_ts, l.l_shipdate AS event_ts,
         CASE WHEN l.l_partkey % 3 = 0 THEN 'monthly' END AS billing_cycle,
         s.s_nationkey % 2 = 0 AS is_subscription,
         CASE WHEN l.l_linenumber % 2 = 0 THEN 'saas' END AS subscription_type,
         CASE WHEN l.l_linenumber % 3 = 1 THEN '#336699' END AS color,
         CASE WHEN l.l_linenumber % 4 = 1 THEN '☁️' END AS service_logo,
         CAST(l.l_quantity AS INTEGER) AS confidence,
         p.p_type = 'PROMO' AS is_trial
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


# ----------------------------------------------------------------------------- subscription ledger

def subs(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        (F.col("p_size") % 5).alias("account_id"),
        k.cast("string").alias("id"),
        k.alias("seq"),
        F.col("p_name").alias("service_name"),
        F.col("p_size").cast(MONEY).alias("amount"),
        F.col("p_type").alias("category"),
        F.when(k % 4 == 0, "Monthly").when(k % 4 == 1, "Quarterly").when(k % 4 == 2, "Yearly")
         .otherwise("Weekly").alias("billing_cycle"),
        F.when(k % 7 == 0, F.lit("Inactive")).when(k % 7 == 1, F.lit(None).cast("string"))
         .when(F.col("p_size") <= 10, F.lit("Trial")).otherwise(F.lit("Active")).alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).alias("start_date"),
        F.when(k % 11 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("2025-01-01").cast("date"), (k % 400).cast("int"))).alias("last_payment"),
        (F.col("p_size") <= 10).alias("is_trial"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("#4285F4")).alias("brand_color"),
        F.col("p_brand").alias("bank"),
    )


SQL_SUBS = """
v_subs AS (
  SELECT p_size % 5 AS account_id, CAST(p_partkey AS VARCHAR) AS id, p_partkey AS seq,
         p_name AS service_name, CAST(p_size AS DECIMAL(18,2)) AS amount, p_type AS category,
         CASE p_partkey % 4 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'Yearly' ELSE 'Weekly' END
           AS billing_cycle,
         CASE WHEN p_partkey % 7 = 0 THEN 'Inactive' WHEN p_partkey % 7 = 1 THEN NULL
              WHEN p_size <= 10 THEN 'Trial' ELSE 'Active' END AS status,
         DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER) AS start_date,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE DATE '2025-01-01' + CAST(p_partkey % 400 AS INTEGER) END
           AS last_payment,
         p_size <= 10 AS is_trial,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '#4285F4' END AS brand_color,
         p_brand AS bank
  FROM part)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# ----------------------------------------------------------------------------- alert messages

# Message templates, chosen by o_orderkey % 9.  {amt} is the order total with
# two decimals, {seg} the customer's market segment, {card} a 4-digit number.
# Each template exercises one amount rung (or none / an out-of-range amount).
# The composed texts avoid stray "rs <digit>" and bare integers so that each
# message's expected answer follows from the order columns alone.
MSG_TEMPLATES = [
    ("Transaction alert", "Rs. {amt} debited at {seg} Store, card ending"),
    ("Payment notice", "INR {amt} paid to {seg} Mart; thank you"),
    ("Card charge", "USD {amt} charged by {seg} online"),
    ("Account update", "Amount: {amt} for {seg} services"),
    ("Debit alert", "Debited from card XX{card} today"),
    ("Purchase", "Paid {amt} now at {seg} Cafe, enjoy"),
    ("Reference", "Ref {int} ok"),
    ("Notice", "Your code 7 is ready"),
    ("Big charge", "Rs 99999999 fee then ${amt} netflix subscription monthly"),
]
# Sender addresses chosen by o_custkey % 8 (bank resolution cases).
MSG_SENDERS = [
    "alerts@hdfcbank.net",
    "HDFC Alerts <Alerts@HDFCBank.net>",
    "x@praxis.example",
    "noreply@chase.com",
    "info@kotak-securities.example",
    "DoNotReply@americanexpress.com",
    "service@statebank.example",
    None,  # 'alerts@' + lower(segment) + '.example'
]
MSG_ZONES = ["+0530", "-0800", "+0000 (UTC)"]


def _fill(template: str, amt, seg, card, integer):
    """Spark concat for one template."""
    import re
    parts = re.split(r"(\{amt\}|\{seg\}|\{card\}|\{int\})", template)
    cols = []
    for p in parts:
        if p == "{amt}":
            cols.append(amt)
        elif p == "{seg}":
            cols.append(seg)
        elif p == "{card}":
            cols.append(card)
        elif p == "{int}":
            cols.append(integer)
        elif p:
            cols.append(F.lit(p))
    return F.concat(*cols)


def _sql_fill(template: str) -> str:
    s = template.replace("'", "''")
    s = s.replace("{amt}", "' || amt || '").replace("{seg}", "' || c_mktsegment || '")
    s = s.replace("{card}", "' || card || '").replace("{int}", "' || intpart || '")
    return "'" + s + "'"


def messages(spark, sf_dir, with_model: bool = False) -> DataFrame:
    """Alert messages composed from orders and customers: one per order
    (``with_model`` adds the model answer of ``model_output_column``)."""
    o = dealt(table(spark, sf_dir, "orders"))
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    amt = F.col("o_totalprice").cast(MONEY).cast("string")
    seg = F.col("c_mktsegment")
    card = (F.lit(1000) + F.col("c_custkey") % 9000).cast("string")
    integer = F.floor(F.col("o_totalprice")).cast("bigint").cast("string")
    k9 = F.col("o_orderkey") % 9
    subj = body = None
    for i, (s, b) in enumerate(MSG_TEMPLATES):
        subj = F.when(k9 == i, F.lit(s)) if subj is None else subj.when(k9 == i, F.lit(s))
        bb = _fill(b, amt, seg, card, integer)
        body = F.when(k9 == i, bb) if body is None else body.when(k9 == i, bb)
    k8 = F.col("o_custkey") % 8
    sender = None
    for i, s in enumerate(MSG_SENDERS):
        v = F.lit(s) if s is not None else F.concat(F.lit("alerts@"), F.lower(seg), F.lit(".example"))
        sender = F.when(k8 == i, v) if sender is None else sender.when(k8 == i, v)
    k3 = F.col("o_orderkey") % 3
    zone = F.when(k3 == 0, F.lit(MSG_ZONES[0])).when(k3 == 1, F.lit(MSG_ZONES[1])).otherwise(F.lit(MSG_ZONES[2]))
    header = F.when(F.col("o_orderkey") % 50 == 7, F.lit("not a date")).otherwise(
        F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" "), zone))
    extra = [model_output_column().alias("model_output")] if with_model else []
    return j.select(
        F.col("c_nationkey").alias("account_id"),
        F.col("o_orderkey").cast("string").alias("message_id"),
        subj.alias("subject"), sender.alias("sender"), header.alias("date"), body.alias("body"), *extra,
    )


def _sql_case(expr: str, values: list[str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


SQL_MSG = (
    "\nv_msg AS (\n  SELECT c.c_nationkey AS account_id, CAST(o.o_orderkey AS VARCHAR) AS message_id,\n"
    "         o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_totalprice, c.c_mktsegment, o.amt, o.intpart, c.card,\n"
    "         c.c_name,\n"
    "         " + _sql_case("o.o_orderkey % 9", ["'" + s.replace("'", "''") + "'" for s, _ in MSG_TEMPLATES])
    + " AS subject,\n"
    "         " + _sql_case("o.o_orderkey % 9", [_sql_fill(b) for _, b in MSG_TEMPLATES]) + " AS body,\n"
    "         " + _sql_case("o.o_custkey % 8", ["'" + s + "'" if s else "'alerts@' || lower(c.c_mktsegment) || '.example'"
                                             for s in MSG_SENDERS]) + " AS sender\n"
    "  FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amt,\n"
    "               CAST(floor(o_totalprice) AS BIGINT)::VARCHAR AS intpart FROM orders) o\n"
    "  JOIN (SELECT *, CAST(1000 + c_custkey % 9000 AS VARCHAR) AS card FROM customer) c\n"
    "    ON o.o_custkey = c.c_custkey)"
)


# ----------------------------------------------------------------------------- ledger edits

def ledger_base(spark, sf_dir) -> DataFrame:
    """Ledger before edits: every subscription."""
    return subs(spark, sf_dir)


SQL_LEDGER = """
v_ledger AS (SELECT * FROM v_subs)"""


def ledger_adds(spark, sf_dir) -> DataFrame:
    """One manual add per subscription, under a name of its own."""
    s = subs(spark, sf_dir)
    k = F.col("seq")
    name = F.concat_ws(" ", "service_name", k.cast("string"))
    return s.select("account_id", k.alias("add_seq"), name.alias("service_name"), "amount", "billing_cycle",
                    F.when(k % 20 == 7, F.lit(None).cast("string")).otherwise(F.col("category")).alias("category"),
                    "start_date", "last_payment",
                    F.when(k % 3 == 0, F.lit("Inactive")).otherwise(F.lit("Active")).alias("status"), "bank",
                    F.when(k % 4 == 3, F.lit(None).cast("string")).otherwise(F.lit("*")).alias("service_logo"),
                    F.lit("#123456").alias("brand_color"))


SQL_ADDS = """
v_adds AS (
  SELECT account_id, seq AS add_seq, service_name || ' ' || CAST(seq AS VARCHAR) AS service_name, amount, billing_cycle,
         CASE WHEN seq % 20 = 7 THEN NULL ELSE category END AS category, start_date, last_payment,
         CASE WHEN seq % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS status, bank,
         CASE WHEN seq % 4 = 3 THEN NULL ELSE '*' END AS service_logo, '#123456' AS brand_color
  FROM v_subs)"""


def ledger_edits(spark, sf_dir) -> DataFrame:
    """One edit per subscription, some with no value sent; one in ten names an
    id that the ledger does not hold."""
    s = subs(spark, sf_dir)
    k = F.col("seq")
    return s.select("account_id", F.when(k % 10 == 8, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), k.alias("edit_seq"),
                    F.when(k % 3 == 0, (k % 20).cast(MONEY)).alias("amount"),
                    F.when(k % 4 == 0, F.concat(F.lit("spotify "), F.col("service_name"))).alias("service_name"),
                    F.when(k % 5 == 0, F.lit("Inactive")).alias("status"),
                    F.when(k % 7 == 3, F.lit("Edited")).alias("category"))


SQL_EDITS = """
v_edits AS (
  SELECT account_id, CASE WHEN seq % 10 = 8 THEN 'x' || id ELSE id END AS id, seq AS edit_seq,
         CASE WHEN seq % 3 = 0 THEN CAST(seq % 20 AS DECIMAL(18,2)) END AS n_amount,
         CASE WHEN seq % 4 = 0 THEN 'spotify ' || service_name END AS n_service_name,
         CASE WHEN seq % 5 = 0 THEN 'Inactive' END AS n_status,
         CASE WHEN seq % 7 = 3 THEN 'Edited' END AS n_category
  FROM v_subs)"""


def ledger_edit_log(spark, sf_dir) -> DataFrame:
    """Several edits of one subscription: one per order, on the subscription
    whose number is the customer's, in order of the order key; an edit sends one
    to four fields or none, one in eleven names an id that the ledger does not hold."""
    o = table(spark, sf_dir, "orders")
    s = subs(spark, sf_dir).select("account_id", F.col("id").alias("sub_id"), F.col("seq").alias("o_custkey"), F.col("service_name").alias("old"))
    k = F.col("o_orderkey")
    return o.join(s, "o_custkey").select(
        "account_id", F.when(k % 11 == 8, F.concat(F.lit("x"), "sub_id")).otherwise(F.col("sub_id")).alias("id"), k.alias("edit_seq"),
        F.when(k % 3 != 0, (F.floor("o_totalprice") % 21).cast(MONEY)).alias("amount"),
        F.when(k % 4 == 0, F.concat(F.lit("spotify "), F.col("old"))).when(k % 4 == 1, F.concat(F.lit("cloud "), F.lower("o_orderpriority")))
         .when(k % 8 == 2, F.col("old")).alias("service_name"),
        F.when(k % 5 == 0, F.lit("Inactive")).when(k % 5 == 1, F.lit("Active")).alias("status"),
        F.when(k % 7 == 3, F.concat(F.lit("Edited "), F.col("o_orderstatus"))).alias("category"))


SQL_EDIT_LOG = """
v_edit_log AS (
  SELECT s.account_id, CASE WHEN o_orderkey % 11 = 8 THEN 'x' || s.id ELSE s.id END AS id, o_orderkey AS edit_seq,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 21 AS DECIMAL(18,2)) END AS n_amount,
         CASE WHEN o_orderkey % 4 = 0 THEN 'spotify ' || s.service_name WHEN o_orderkey % 4 = 1 THEN 'cloud ' || lower(o_orderpriority)
              WHEN o_orderkey % 8 = 2 THEN s.service_name END AS n_service_name,
         CASE o_orderkey % 5 WHEN 0 THEN 'Inactive' WHEN 1 THEN 'Active' END AS n_status,
         CASE WHEN o_orderkey % 7 = 3 THEN 'Edited ' || o_orderstatus END AS n_category
  FROM orders JOIN v_subs s ON s.seq = o_custkey)"""


def detected_slice(spark, sf_dir) -> DataFrame:
    """Detected subscriptions to merge, one per ledger row: half the names in
    upper case (case-blind duplicates of ledger names), the others new."""
    s = subs(spark, sf_dir)
    name = F.when(F.col("seq") % 2 == 0, F.upper("service_name")).otherwise(
        F.concat(F.col("service_name"), F.lit(" plus")))
    return s.select("account_id", F.concat(F.lit("det"), F.col("id")).alias("id"), name.alias("service_name"),
                    "amount", "billing_cycle", "category", "status", "is_trial",
                    F.struct(F.lit(1).alias("path"), F.lower(name).alias("key"), F.col("amount").alias("amount"))
                    .alias("detect_order"))


SQL_DETECTED = """
v_det AS (
  SELECT account_id, 'det' || id AS id,
         CASE WHEN seq % 2 = 0 THEN upper(service_name) ELSE service_name || ' plus' END AS service_name,
         amount, billing_cycle, category, status, is_trial
  FROM v_subs)"""


# ----------------------------------------------------------------------------- model answers

def model_output_column():
    """A model answer per order, chosen by o_orderkey % 8: string amount with
    a currency mark, numeric amount, null amount, amount above the limit,
    category absent, category null, JSON inside prose, broken JSON."""
    k = F.col("o_orderkey") % 8
    amt = F.col("o_totalprice").cast(MONEY).cast("string")
    amt100 = (F.col("o_totalprice").cast(MONEY) * 100).cast("string")
    name = F.col("c_name")
    texts = [
        F.concat(F.lit('ok {"amount":"₹'), amt, F.lit('","category":"Food","vendor":"'), name, F.lit('"} bye')),
        F.concat(F.lit('{"amount":'), amt, F.lit(',"category":"Shopping","vendor":"V","confidence":80,'
                                                  '"is_subscription":true}')),
        F.concat(F.lit('{"amount":null,"category":"Bills","vendor":"'), name, F.lit('"}')),
        F.concat(F.lit('{"amount":"'), amt100, F.lit('","category":"Big","vendor":"'), name, F.lit('"}')),
        F.concat(F.lit('{"amount":"'), amt, F.lit('","vendor":"'), name, F.lit('"}')),
        F.concat(F.lit('{"amount":"'), amt, F.lit('","category":null,"vendor":"V"}')),
        F.concat(F.lit('Here you go:\n{"amount":"'), amt, F.lit('","category":"Travel","vendor":"'), name,
                 F.lit('","is_trial":true}\nThanks')),
        F.concat(F.lit('{"amount": '), amt, F.lit(', "category": "X"')),
    ]
    out = None
    for i, t in enumerate(texts):
        out = F.when(k == i, t) if out is None else out.when(k == i, t)
    return out


def model_messages(spark, sf_dir) -> DataFrame:
    return messages(spark, sf_dir, with_model=True)


# ----------------------------------------------------------------------------- raw RFC 822 messages

def raw_messages(spark, sf_dir) -> DataFrame:
    """The alert messages as RFC 822 bytes, by o_orderkey % 4: plain only;
    plain then HTML; HTML then plain; plain attachment then HTML.  One in 50
    has no content (dead letter)."""
    m = messages(spark, sf_dir)
    k = F.col("message_id").cast("long")
    hdr = F.concat(F.lit("Subject: "), F.col("subject"), F.lit("\r\nFrom: "), F.col("sender"),
                   F.lit("\r\nDate: "), F.col("date"), F.lit("\r\nMIME-Version: 1.0\r\n"))
    body = F.col("body")
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\n\r\n"), body, F.lit("\r\n"))
    html = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n<div><b>"), body, F.lit("</b></div>\r\n"))
    att = F.lit('Content-Type: text/plain; charset=utf-8\r\nContent-Disposition: attachment; filename="a.txt"'
                "\r\n\r\nATTACHED\r\n")

    def multi(*parts):
        cols = [F.lit('Content-Type: multipart/alternative; boundary="b1"\r\n\r\n')]
        for p in parts:
            cols += [F.lit("--b1\r\n"), p]
        cols.append(F.lit("--b1--\r\n"))
        return F.concat(*cols)

    k4 = k % 4
    text = F.concat(hdr, F.when(k4 == 0, F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\n\r\n"), body))
                    .when(k4 == 1, multi(plain, html)).when(k4 == 2, multi(html, plain)).otherwise(multi(att, html)))
    content = F.when(k % 50 == 13, F.lit(None).cast("binary")).otherwise(F.encode(text, "UTF-8"))
    return m.select("account_id", "message_id", content.alias("content"))
