"""Money expressions: amount search in message text, amount cleaning, display.

Money is DECIMAL(18,2) inside the library (sums do not depend on row order);
results are cast to DOUBLE only at the very end of a query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "DECIMAL(18,2)"
WIDE = "DECIMAL(38,2)"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results): the accepted
# amount range, the trial threshold, and the ordered amount rungs.
# ---------------------------------------------------------------------------
AMOUNT_MIN = "0.01"
AMOUNT_MAX = "10000000"
TRIAL_MAX = 10

# Rungs in priority order (a later rung is tried only when an earlier one has no
# in-range match).  Two more rungs of the cascade ("Amount" + rupee mark; debit
# word + rupee mark) can never produce a result, because the rupee rung sees
# the same text first; they are omitted.
AMOUNT_RUNGS = [
    ("rupee", r"(?:Rs\.?\s*|₹\s*)(\d+(?:,\d+)*(?:\.\d{1,2})?)"),
    ("inr", r"(?:INR\s*)(\d+(?:,\d+)*(?:\.\d{1,2})?)"),
    ("dollar", r"(?:\$|USD\s*)(\d+(?:,\d+)*(?:\.\d{1,2})?)"),
    ("amount_word", r"(?:Amount\s*:?\s*)(\d+(?:,\d+)*(?:\.\d{1,2})?)"),
    ("debit_word", r"(?:Debited|Credited|Withdrawn).*?(\d+(?:,\d+)*(?:\.\d{1,2})?)"),
    ("two_decimals", r"(?:^|\s)(\d{1,8}\.\d{2})(?:\s|$)"),
    ("bare_integer", r"(?:^|\s)(\d{2,8})(?:\s|$)"),
]
# i = case-blind, U = Unicode digits and blanks (as in Python), d = '.' stops only at '\n'.
FLAGS = "(?iUd)"
# With strict=True every rung that starts with a word gets a word boundary, so
# "hours 48" no longer reads as a rupee amount.
_STRICT_PREFIX = r"(?<![\p{L}\p{N}])"


def _in_range(s: Column) -> Column:
    v = s.try_cast(WIDE)
    return v.between(F.lit(AMOUNT_MIN).cast(WIDE), F.lit(AMOUNT_MAX).cast(WIDE))


def extract_amount(text, strict: bool = False) -> Column:
    """Amount cascade (B3): the first in-range match of the first rung that
    has one, commas removed, as a STRING (the reference keeps text)."""
    t = F.col(text) if isinstance(text, str) else text
    cands = []
    for name, pat in AMOUNT_RUNGS:
        bounded = strict and name in ("rupee", "inr", "dollar", "amount_word", "debit_word")
        found = F.regexp_extract_all(t, F.lit(FLAGS + (_STRICT_PREFIX if bounded else "") + pat), 1)
        cleaned = F.transform(found, lambda m: F.replace(m, F.lit(","), F.lit("")))
        cands.append(F.get(F.filter(cleaned, lambda m: _in_range(m)), 0))
    return F.coalesce(*cands)


def clean_amount(amount_text) -> Column:
    """Transaction amount text -> number.

    Text whose characters are all digits once '.', ',' and '-' are removed is
    parsed; anything else is 0 (and later dropped by ``positive_only``).  Text
    that passes that test but is not a number (``1.2.3``, ``1,2``) made the
    reference fail; here it becomes NULL and is dropped the same way.
    """
    t = F.col(amount_text) if isinstance(amount_text, str) else amount_text
    digits_only = F.regexp_replace(t, r"[.,\-]", "").rlike(r"^\d+$")
    return (F.when(t.isNull() | (t == ""), F.lit(0).cast(MONEY))
            .when(digits_only, t.try_cast(MONEY))
            .otherwise(F.lit(0).cast(MONEY)))


def is_plain_number(amount_text) -> Column:
    """Run-log test (E13): digits once '.' and ',' are removed."""
    t = F.col(amount_text) if isinstance(amount_text, str) else amount_text
    return F.coalesce(F.regexp_replace(t, r"[.,]", "").rlike(r"^\d+$"), F.lit(False))


def format_amount(amount, symbol: str = "₹") -> Column:
    """Compact display (B17): crore, lakh, thousand, else grouped integer."""
    a = (F.col(amount) if isinstance(amount, str) else amount).cast("double")
    return (F.when(a >= 1e7, F.concat(F.lit(symbol), F.format_number(a / 1e7, 1), F.lit("Cr")))
            .when(a >= 1e5, F.concat(F.lit(symbol), F.format_number(a / 1e5, 1), F.lit("L")))
            .when(a >= 1e3, F.concat(F.lit(symbol), F.format_number(a / 1e3, 1), F.lit("K")))
            .otherwise(F.concat(F.lit(symbol), F.format_number(a, 0))))


def low_amount_reason(amount) -> Column:
    """'Low amount (₹x.xx)' text used for trial reasons."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.concat(F.lit("Low amount (₹"), F.format_string("%.2f", a.cast("double")), F.lit(")"))
