"""Batch-scoring output handling (operators C1-C4).

The reference sends each message to a remote model and reads a JSON object
from its free-text answer.  Here the answer is a column (``model_output``)
produced by any scorer; these expressions turn it into a typed analysis with
the reference's defaults, validation and fall-back rules.  Parsing uses
VARIANT so that an *absent* key (default applies) and an explicit JSON
``null`` (analysis invalid, rules path used) stay distinguishable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .amount import AMOUNT_MAX, MONEY, TRIAL_MAX
from .text import contains_any


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_text(model_output) -> Column:
    """From the first '{' to the last '}' (across lines); otherwise the
    whole trimmed text."""
    t = _c(model_output)
    m = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(m != "", m).otherwise(F.trim(t))


def parse_model_json(model_output) -> Column:
    """VARIANT of the JSON object, NULL when the text is not a JSON object."""
    v = F.try_parse_json(json_text(model_output))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _key(v: Column, k: str) -> Column:
    return F.try_variant_get(v, f"$.{k}", "variant")


def has_key(v: Column, k: str) -> Column:
    return _key(v, k).isNotNull()


def _type(v: Column, k: str) -> Column:
    return F.schema_of_variant(_key(v, k))


def _is_string(v: Column, k: str) -> Column:
    return F.coalesce(_type(v, k) == "STRING", F.lit(False))


def _text_or_default(v: Column, k: str, default: str | None) -> Column:
    s = F.try_variant_get(v, f"$.{k}", "string")
    return F.when(has_key(v, k), s).otherwise(F.lit(default))


def model_valid(v: Column) -> Column:
    """The reference's model path raises (and falls back to rules) when the
    text is no JSON object, or category/vendor is present but not a string."""
    ok_cat = ~has_key(v, "category") | _is_string(v, "category")
    ok_ven = ~has_key(v, "vendor") | _is_string(v, "vendor")
    return F.coalesce(v.isNotNull() & ok_cat & ok_ven, F.lit(False))


def model_amount(v: Column) -> Column:
    """C3 amount as DECIMAL: a JSON string keeps only digits and dots and must
    be in (0, 10 000 000]; a JSON number is taken as is (no range check);
    zero, false, empty and missing are NULL."""
    is_str = _is_string(v, "amount")
    s = F.try_variant_get(v, "$.amount", "string")
    digits = F.regexp_replace(s, r"(?U)[^\d.]", "")
    sval = digits.try_cast("DECIMAL(38,2)")
    sval = F.when((sval > 0) & (sval <= F.lit(AMOUNT_MAX).cast("DECIMAL(38,2)")), sval)
    num_type = _type(v, "amount")
    is_num = F.coalesce(num_type.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    nval = F.try_variant_get(v, "$.amount", "decimal(38,2)")
    nval = F.when(nval != 0, nval)
    return (F.when(is_str & (s != ""), sval)
            .when(is_num, nval)).try_cast("DECIMAL(38,2)")


def model_truthy_bool(v: Column, k: str) -> Column:
    """Python truthiness of a JSON value: true, non-zero number, non-empty
    string/array/object."""
    t = _type(v, k)
    b = F.try_variant_get(v, f"$.{k}", "boolean")
    n = F.try_variant_get(v, f"$.{k}", "double")
    s = F.try_variant_get(v, f"$.{k}", "string")
    return F.coalesce(
        F.when(t == "BOOLEAN", b)
        .when(t.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), n != 0)
        .when(t == "STRING", F.length(s) > 0)
        .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.lit(True))
        .otherwise(F.lit(False)), F.lit(False))


def model_analysis(model_output, subject, body, v: Column | None = None) -> Column:
    """C1-C4 as one struct; NULL when the model path is invalid.

    Fields: amount (DECIMAL), category, merchant_name, confidence (INT),
    is_subscription, subscription_type, billing_cycle, service_logo, is_trial.
    Pass ``v`` (an already parsed VARIANT column) to parse once per row.
    """
    v = parse_model_json(model_output) if v is None else v
    amount = model_amount(v)
    str_amount_trial = _is_string(v, "amount") & F.coalesce(amount <= TRIAL_MAX, F.lit(False))
    stated_trial = model_truthy_bool(v, "is_trial")
    trial0 = stated_trial | str_amount_trial
    raw = F.lower(F.concat_ws(" ", F.coalesce(_c(subject), F.lit("")), F.coalesce(_c(body), F.lit(""))))
    words = contains_any(raw, R.TRIAL_WORDS_MODEL)
    trial = trial0 | words | F.coalesce(amount <= TRIAL_MAX, F.lit(False))
    conf = F.when(has_key(v, "confidence"), F.try_variant_get(v, "$.confidence", "int")) \
        .otherwise(F.lit(R.MODEL_DEFAULT_CONFIDENCE))
    out = F.struct(
        amount.try_cast(MONEY).alias("amount"),   # a number beyond MONEY is no amount
        _text_or_default(v, "category", R.MODEL_DEFAULT_CATEGORY).alias("category"),
        _text_or_default(v, "vendor", R.UNKNOWN_VENDOR).alias("merchant_name"),
        conf.alias("confidence"),
        # only a real JSON boolean counts; the text "true" does not
        F.coalesce(F.when(_type(v, "is_subscription") == "BOOLEAN", F.try_variant_get(v, "$.is_subscription", "boolean")),
                   F.lit(False)).alias("is_subscription"),
        F.try_variant_get(v, "$.subscription_type", "string").alias("subscription_type"),
        F.try_variant_get(v, "$.billing_cycle", "string").alias("billing_cycle"),
        _text_or_default(v, "service_logo", R.DEFAULT_ICON).alias("service_logo"),
        trial.alias("is_trial"),
    )
    return F.when(model_valid(v), out)
