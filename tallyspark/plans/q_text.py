"""Registered queries for text extraction and rule classification
and the flagship message pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import classify as C
from ..functions.amount import extract_amount, format_amount
from ..functions.text import HTML_ENTITIES, html_to_text, preview, title_case
from ..operators import analyze as A
from ..operators import clean as D
from ..operators import rule_table as RT
from ..operators import spend as S
from . import sqlgen as G
from . import standins as V
from .catalog import register

SEG_TITLE = "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"
# Expected answers straight from the order columns (see MSG_TEMPLATES).
_EXPECT = f"""
v_expect AS (
  SELECT *, lower(subject || ' ' || body) AS text,
         CASE o_orderkey % 9 WHEN 4 THEN card WHEN 6 THEN intpart WHEN 7 THEN NULL ELSE amt END AS amount,
         CASE o_orderkey % 9 WHEN 0 THEN {SEG_TITLE} || ' Store' WHEN 1 THEN {SEG_TITLE} || ' Mart'
              WHEN 5 THEN {SEG_TITLE} || ' Cafe' ELSE 'Unknown Vendor' END AS vendor,
         CASE o_custkey % 8 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'HDFC Bank' WHEN 2 THEN 'Axis Bank'
              WHEN 3 THEN 'Chase' WHEN 4 THEN 'Kotak Bank' WHEN 5 THEN 'American Express' WHEN 6 THEN 'SBI'
              ELSE 'Unknown Bank' END AS bank
  FROM v_msg)"""
MX = V.with_ctes(V.SQL_MSG, _EXPECT)

_SCORE, _LABEL = G.category_best("text")
_VCAT = G.ladder("lower(vendor)", [(lbl, words) for lbl, words, _ in R.VENDOR_CATEGORY_RULES], None)
_RULES = f"""
v_rules AS (
  SELECT *, {_SCORE} AS score, {_LABEL} AS label,
         CASE WHEN {_SCORE} = 0 AND vendor <> 'Unknown Vendor' THEN {_VCAT} END AS vendor_category,
         {G.contains_any('text', R.SUBSCRIPTION_INDICATORS)} AS is_subscription,
         ({G.contains_any('text', R.TRIAL_WORDS_RULES)}
           OR COALESCE(TRY_CAST(amount AS DECIMAL(18,2)) <= 10, false)) AS is_trial
  FROM v_expect)"""
_ALL_LABELS = [lbl for lbl, _, _ in R.CATEGORY_RULES] + [R.CATEGORY_NONE] + \
    [lbl for lbl, _, _ in R.VENDOR_CATEGORY_RULES]
MR = V.with_ctes(V.SQL_MSG, _EXPECT, _RULES)


def _msgs(spark, d):
    return V.messages(spark, d)


@register("extract_amount", MX + "SELECT account_id, message_id, amount FROM v_expect")
def q_extract_amount(spark, d):
    m = _msgs(spark, d)
    return m.select("account_id", "message_id",
                    extract_amount(F.concat_ws(" ", "subject", "body")).alias("amount"))


@register("extract_vendor", MX + "SELECT message_id, vendor AS merchant_name FROM v_expect")
def q_extract_vendor(spark, d):
    m = _msgs(spark, d).withColumn("_clean", html_to_text("body")).withColumn("_low", F.lower("_clean"))
    m = m.withColumn("_c", F.array(*C.vendor_candidates(F.col("_clean"), F.col("_low"))))
    return m.select("message_id", C.pick_vendor([F.col("_c")[i] for i in range(len(C.VENDOR_PATTERNS))])
                    .alias("merchant_name"))


@register("resolve_bank", MX + "SELECT message_id, sender, bank FROM v_expect")
def q_resolve_bank(spark, d):
    m = _msgs(spark, d)
    return m.select("message_id", "sender", C.resolve_bank("sender").alias("bank"))


@register("title_case", """
SELECT p_partkey, array_to_string(list_transform(
         regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '([A-Za-z]+|[^A-Za-z]+)'),
         lambda x: upper(x[1]) || lower(x[2:])), '') AS title
FROM part""")
def q_title_case(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", title_case(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("title"))


_WS = r"[\s\p{Z}\x{0B}\x{85}]"


def _decoded(sql: str) -> str:
    """Named references and the numbered apostrophe, the only numbered one in the driver's pages."""
    for ref, char in [("&#39;", "'"), *HTML_ENTITIES]:
        sql = f"replace({sql}, '{ref}', {G.q(char)})"
    return sql


_TAGLESS = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
_HTML_SQL = f"""
, s AS (SELECT page_id, {_decoded(_TAGLESS)} AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(t, '{_WS}*[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{85}}\\x{{2028}}\\x{{2029}}]{_WS}*|{_WS}{{2,}}', ' ', 'g'),
                    '^{_WS}+|{_WS}+$', '', 'g') AS text
FROM s"""


@register("html_to_text", "WITH x AS (SELECT 1)" + _HTML_SQL)
def q_html_to_text(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", html_to_text("html").alias("text"))


# Sources that blind replacement of tags gets wrong, and the text that a reader sees.
HARD_HTML = [("<p title='a>b'>x</p>", "x"), ("a < b and c > d", "a < b and c > d"), ('<a href="?q=<i>" data-x = "1 > 0">link</a>', "link"),
             ("<p class=o'x>Hello</p><p>it's here</p>", "Hello it's here"), ("<SCRIPT type='x>y'>if (a<b) { c(\"</p>\") }</SCRIPT >end", "end"),
             ("<scripture>kept</scripture><!-- <b>no</b> -->yes", "kept yes"), ("1 <2 & 3", "1 <2 & 3"), ("tail <!-- open", "tail")]
_HARD_IN = "[" + ", ".join(G.q(a) for a, _ in HARD_HTML) + "]"
_HARD_OUT = "[" + ", ".join(G.q(b) for _, b in HARD_HTML) + "]"


@register("html_to_text_hard", "WITH x AS (SELECT 1)" + _HTML_SQL.replace("SELECT page_id, regexp", ", plain AS (SELECT page_id, regexp", 1) + f""")
SELECT page_id, trim(text || ' ' || {_HARD_OUT}[page_id % {len(HARD_HTML)} + 1]) AS text FROM plain""")
def q_html_to_text_hard(spark, d):
    p = V.table(spark, d, "pages")
    hard = F.get(F.array(*[F.lit(a) for a, _ in HARD_HTML]), (F.col("page_id") % len(HARD_HTML)).cast("int"))
    return p.select("page_id", html_to_text(F.concat("html", F.lit("\n"), hard)).alias("text"))


@register("body_preview", """
SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview
FROM conversations""")
def q_body_preview(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select("conv_id", "turn", preview("text", 200).alias("preview"))


_FMT_SQL = """
, a AS (SELECT message_id, f, CAST(amount_numeric AS DOUBLE) * f AS x
        FROM v_txn_orders, (VALUES (0.01), (1.0), (10.0), (100.0)) t(f))
SELECT message_id, f AS factor, x AS amount,
       CASE WHEN x >= 1e7 THEN '₹' || format('{:.1f}', x / 1e7) || 'Cr'
            WHEN x >= 1e5 THEN '₹' || format('{:.1f}', x / 1e5) || 'L'
            WHEN x >= 1e3 THEN '₹' || format('{:.1f}', x / 1e3) || 'K'
            ELSE '₹' || format('{:,.0f}', x) END AS display
FROM a"""


@register("format_amount", V.with_ctes(V.SQL_TXN_ORDERS) + _FMT_SQL)
def q_format_amount(spark, d):
    t = V.txn_orders(spark, d)
    f = F.explode(F.array(*[F.lit(x) for x in (0.01, 1.0, 10.0, 100.0)])).alias("factor")
    a = t.select("message_id", f, "amount_numeric").withColumn(
        "amount", F.col("amount_numeric").cast("double") * F.col("factor"))
    return a.select("message_id", "factor", "amount", format_amount("amount").alias("display"))


def _docs(spark, d):
    return V.dealt(V.table(spark, d, "documents")).select("doc_id", F.lower("text").alias("text"))


_DOC = "WITH docs AS (SELECT doc_id, lower(text) AS text FROM documents)\n"


@register("flag_subscription",
          _DOC + f"SELECT doc_id, {G.contains_any('text', R.SUBSCRIPTION_INDICATORS)} AS is_subscription FROM docs")
def q_flag_subscription(spark, d):
    return _docs(spark, d).select("doc_id", C.flag_subscription("text").alias("is_subscription"))


@register("flag_trial", _DOC + f"""
SELECT doc_id, {G.contains_any('text', R.TRIAL_WORDS_RULES)} AS trial_rules,
       {G.contains_any('text', R.TRIAL_WORDS_MODEL)} AS trial_model,
       {G.contains_any('text', R.TRIAL_WORDS_RECUR)} AS trial_recur FROM docs""")
def q_flag_trial(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", C.flag_trial("text", None, R.TRIAL_WORDS_RULES).alias("trial_rules"),
                    C.flag_trial("text", None, R.TRIAL_WORDS_MODEL).alias("trial_model"),
                    C.flag_trial("text", None, R.TRIAL_WORDS_RECUR).alias("trial_recur"))


_TYPE_SQL = G.ladder("text", [(lbl, words) for lbl, words, _ in R.SUBSCRIPTION_TYPES], R.SUBSCRIPTION_TYPE_OTHER[0])
_FLAG_SQL = G.contains_any("text", R.SUBSCRIPTION_INDICATORS)


@register("subscription_type", _DOC + f"""
SELECT doc_id, CASE WHEN {_FLAG_SQL} THEN {_TYPE_SQL} END AS subscription_type FROM docs""")
def q_subscription_type(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", C.subscription_type("text", C.flag_subscription("text")).alias("subscription_type"))


@register("stated_cycle", _DOC + f"""
SELECT doc_id, CASE WHEN {_FLAG_SQL} THEN {G.ladder('text', R.CYCLE_WORDS, R.CYCLE_DEFAULT)} END AS billing_cycle
FROM docs""")
def q_stated_cycle(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", C.stated_cycle("text", C.flag_subscription("text")).alias("billing_cycle"))


_DSCORE, _DLABEL = G.category_best("text")


@register("score_category", _DOC + f"""
SELECT doc_id, CAST({_DSCORE} AS INTEGER) AS score, {_DLABEL} AS category FROM docs""")
def q_score_category(spark, d):
    t = _docs(spark, d).withColumn("best", C.category_score("text"))
    return t.select("doc_id", F.col("best.score").alias("score"), C.category_label(F.col("best")).alias("category"))


# Rule tables of any number of needles: the words of four letters or more of the benchmark items, 40 labels.
_TABLE_RULES = _DOC.rstrip() + """
, needles AS (SELECT lower(w) AS needle, min(item_id) AS ordinal, 'topic ' || CAST(min(item_id) % 40 AS VARCHAR) AS label
              FROM (SELECT item_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 4 GROUP BY 1)
, hits AS (SELECT doc_id, needle, ordinal, label FROM docs JOIN needles ON contains(docs.text, needle))
"""


def needle_table(spark, d):
    """One rule per word of the benchmark items."""
    words = V.table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(F.length("w") >= 4)
    return (words.groupBy(F.lower("w").alias("needle")).agg(F.min("item_id").alias("ordinal"))
            .withColumn("label", F.concat(F.lit("topic "), (F.col("ordinal") % 40).cast("string"))))


def _table_docs(spark, d):
    """The documents as they are read: rule tables deal the texts themselves."""
    return V.table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


@register("rule_table_resolve", _TABLE_RULES + """
SELECT d.doc_id, COALESCE(f.label, 'none') AS label FROM docs d LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, needle) AS r FROM hits) WHERE r = 1) f USING (doc_id)""")
def q_rule_table_resolve(spark, d):
    return RT.resolve_by_rules(_table_docs(spark, d), "text", needle_table(spark, d), ["doc_id"], default="none").select("doc_id", "label")


@register("rule_table_score", _TABLE_RULES + f"""
, per AS (SELECT doc_id, label, count(DISTINCT needle) AS score, min(ordinal) AS first FROM hits GROUP BY ALL)
SELECT d.doc_id, CAST(COALESCE(s.score, 0) AS INTEGER) AS score, COALESCE(s.label, {G.q(R.CATEGORY_NONE)}) AS category FROM docs d LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, label) AS r FROM per) WHERE r = 1) s USING (doc_id)""")
def q_rule_table_score(spark, d):
    return RT.score_by_rules(_table_docs(spark, d), "text", needle_table(spark, d), ["doc_id"]).select("doc_id", "score", "category")


@register("rule_confidence", _DOC + f"""
SELECT doc_id, CAST(CASE WHEN {_DSCORE} > 0 THEN {_DSCORE} * 15 ELSE 25 END AS INTEGER) AS confidence FROM docs""")
def q_rule_confidence(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", C.rule_confidence(C.category_score("text")["score"]).alias("confidence"))


@register("category_from_vendor", MR + "SELECT message_id, vendor_category FROM v_rules")
def q_category_from_vendor(spark, d):
    t = A.with_rules_analysis(_msgs(spark, d))
    return t.select("message_id", F.lower(F.col("r_category")).alias("_c"), F.col("r_confidence").alias("confidence")
                    ).select(
        "message_id", F.when((F.col("confidence") == 25) & (F.col("_c") != "other transactions"), F.col("_c"))
        .alias("vendor_category"))


@register("rules_analysis", MR + f"""
SELECT account_id, message_id, amount, {G.title_map('COALESCE(vendor_category, label)', _ALL_LABELS)} AS category,
       vendor AS merchant_name, CAST(CASE WHEN score > 0 THEN score * 15 ELSE 25 END AS INTEGER) AS confidence,
       is_subscription,
       CASE WHEN is_subscription THEN {G.ladder('text', [(lbl, w) for lbl, w, _ in R.SUBSCRIPTION_TYPES], 'other')} END
         AS subscription_type,
       CASE WHEN is_subscription THEN {G.ladder('text', R.CYCLE_WORDS, R.CYCLE_DEFAULT)} END AS billing_cycle,
       is_trial, bank
FROM v_rules""")
def q_rules_analysis(spark, d):
    t = A.analyze_messages(_msgs(spark, d), mode="rules")
    return t.select("account_id", "message_id", "amount", "category", "merchant_name", "confidence",
                    "is_subscription", "subscription_type", "billing_cycle", "is_trial", "bank")


def messages_to_clean_transactions(spark, d):
    """Flagship pipeline body: messages -> rules analysis -> D1-D4.  The analysed
    transactions are written once: cleaning filters pushed below the analysis
    would evaluate it again."""
    from ..session import scratch_path
    t = A.analyze_messages(_msgs(spark, d), mode="rules")
    path = scratch_path(spark, "transactions")
    t.write.parquet(path)
    return D.clean_transactions(spark.read.schema(t.schema).parquet(path), "amount", "date")


@register("messages_by_category", MR + f"""
, clean AS (SELECT account_id, {G.title_map('COALESCE(vendor_category, label)', _ALL_LABELS)} AS category,
                   CAST(amount AS DECIMAL(18,2)) AS amount_numeric
            FROM v_rules WHERE amount IS NOT NULL AND o_orderkey % 50 <> 7)
SELECT account_id, category, CAST(SUM(amount_numeric) AS DOUBLE) AS total_amount,
       COUNT(amount_numeric) AS txn_count,
       CAST(SUM(amount_numeric) AS DOUBLE) / CAST(COUNT(amount_numeric) AS DOUBLE) AS avg_amount
FROM clean GROUP BY account_id, category""", headline=True)
def q_messages_by_category(spark, d):
    return S.by_category(messages_to_clean_transactions(spark, d))


def _color_sql(name: str) -> str:
    preset = " ".join(f"WHEN {name} = {G.q(n)} THEN {G.q(c)}" for n, c in R.PRESET_COLORS)
    palette = ", ".join(G.q(c) for c in R.PALETTE)
    return (f"COALESCE(CASE {preset} END, "
            f"[{palette}][CAST('0x' || substr(md5({name}), 1, 7) AS BIGINT) % {len(R.PALETTE)} + 1])")


_PALETTE = "[" + ", ".join(G.q(c) for c in R.PALETTE) + "]"
_PRESET = "CASE " + " ".join(f"WHEN category_key = {G.q(n)} THEN {G.q(c)}" for n, c in R.PRESET_COLORS) + " END"


@register("category_colors", V.with_ctes(V.SQL_TXN_EVENTS, V.SQL_BILL) + f"""
, c AS (SELECT DISTINCT account_id, lower(category) AS category_key FROM
        (SELECT account_id, category FROM v_txn_events UNION ALL SELECT account_id, category FROM v_bill))
, r AS (SELECT *, {_PRESET} AS preset, CASE WHEN preset IS NULL THEN dense_rank() OVER (PARTITION BY account_id, preset IS NULL ORDER BY category_key) END AS ordinal
        FROM c WHERE category_key IS NOT NULL)
SELECT account_id, category_key, ordinal, COALESCE(preset, {_PALETTE}[(ordinal - 1) % {len(R.PALETTE)} + 1]) AS color FROM r""")
def q_category_colors(spark, d):
    u = V.txn_events(spark, d).select("account_id", "category").unionByName(
        V.bill(spark, d).select("account_id", "category"))
    return A.category_colors(u)


@register("category_colors_kept", V.with_ctes(V.SQL_TXN_EVENTS, V.SQL_BILL) + f"""
, c AS (SELECT account_id, lower(category) AS category_key, min(later) AS later FROM
        (SELECT account_id, category, false AS later FROM v_txn_events UNION ALL SELECT account_id, category, true FROM v_bill)
        WHERE category IS NOT NULL GROUP BY ALL)
, r AS (SELECT *, {_PRESET} AS preset,
               CASE WHEN preset IS NULL THEN row_number() OVER (PARTITION BY account_id, preset IS NULL ORDER BY later, category_key) END AS ordinal FROM c)
SELECT account_id, category_key, ordinal, COALESCE(preset, {_PALETTE}[(ordinal - 1) % {len(R.PALETTE)} + 1]) AS color FROM r""")
def q_category_colors_kept(spark, d):
    """The dictionary of the events' categories, then with those of the bills."""
    first = A.category_colors(V.txn_events(spark, d))
    return A.category_colors(V.bill(spark, d), first)


@register("vendor_dim", V.with_ctes(V.SQL_TXN_EVENTS) + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY account_id, lower(trim(merchant_name))
                                     ORDER BY event_ts, message_id) AS rn FROM v_txn_events)
SELECT account_id, lower(trim(merchant_name)) AS vendor_key, merchant_name AS display_name, category,
       CASE WHEN CAST(message_id AS BIGINT) % 3 = 0 THEN '#ABCDEF' ELSE {_color_sql('lower(category)')} END AS color,
       is_subscription, CASE WHEN is_subscription THEN 'type ' || bank END AS subscription_type,
       'logo ' || category AS service_logo, is_trial
FROM r WHERE rn = 1""")
def q_vendor_dim(spark, d):
    t = V.txn_events(spark, d)
    return A.vendor_dim(t.withColumns({
        "color": F.when(F.col("message_id").cast("long") % 3 == 0, F.lit("#ABCDEF")),
        "subscription_type": F.when(F.col("is_subscription"), F.concat(F.lit("type "), "bank")),
        "service_logo": F.concat(F.lit("logo "), "category")}))
