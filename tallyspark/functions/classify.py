"""Rule-based classifiers over message text (operators B4, B6-B13).

Each function is a native Column expression built from literal rule arrays
and higher-order functions (``filter``, ``exists``, ``transform``,
``array_max``): one pass per row, no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .amount import TRIAL_MAX
from .text import contains_any, count_contained, first_contained, strip_unicode, title_case


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------------------- bank

def resolve_bank(sender, senders=None, tokens=None, canonical: bool = False) -> Column:
    """Bank of a sender address: the first bank (list order) one of whose
    addresses is contained in the lower-cased sender, else the first token
    rule, else 'Unknown Bank'.  Containment, not equality (so a domain that
    merely contains a bank token resolves to that bank)."""
    senders = senders if senders is not None else R.BANK_SENDERS
    tokens = tokens if tokens is not None else R.BANK_TOKENS
    s = F.lower(_c(sender))

    def first_label(table):
        out = None
        for lbl, needles in table:
            c = contains_any(s, [n.lower() for n in needles])
            out = F.when(c, F.lit(lbl)) if out is None else out.when(c, F.lit(lbl))
        return out

    out = F.coalesce(first_label(senders), first_label(tokens), F.lit(R.UNKNOWN_BANK))
    if canonical:
        for a, b in R.CANONICAL_BANK.items():
            out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


# ----------------------------------------------------------------------------- flags

def flag_subscription(text, indicators=None) -> Column:
    """Any subscription indicator contained in the (lower-case) text."""
    return contains_any(_c(text), indicators if indicators is not None else R.SUBSCRIPTION_INDICATORS)


def flag_trial(text, amount=None, words=None) -> Column:
    """Trial word contained in the text, or amount at most 10."""
    words = words if words is not None else R.TRIAL_WORDS_RULES
    flag = contains_any(_c(text), words)
    if amount is not None:
        a = _c(amount)
        flag = flag | F.coalesce((a > 0) & (a <= TRIAL_MAX), F.lit(False))
    return flag


def subscription_type(text, flagged) -> Column:
    """Type ladder (B9), only for flagged rows; NULL otherwise."""
    t = _c(text)
    expr = None
    for label, words, _icon in R.SUBSCRIPTION_TYPES:
        cond = contains_any(t, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit(R.SUBSCRIPTION_TYPE_OTHER[0]))
    return F.when(_c(flagged), expr)


def subscription_icon(text, flagged) -> Column:
    """Icon that goes with the type ladder; generic card icon when not flagged."""
    t = _c(text)
    expr = None
    for _label, words, icon in R.SUBSCRIPTION_TYPES:
        cond = contains_any(t, words)
        expr = F.when(cond, F.lit(icon)) if expr is None else expr.when(cond, F.lit(icon))
    expr = expr.otherwise(F.lit(R.SUBSCRIPTION_TYPE_OTHER[1]))
    return F.when(_c(flagged), expr).otherwise(F.lit(R.DEFAULT_ICON))


def stated_cycle(text, flagged) -> Column:
    """Billing-cycle ladder (B10), only for flagged rows; no word -> monthly."""
    t = _c(text)
    expr = None
    for label, words in R.CYCLE_WORDS:
        cond = contains_any(t, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(_c(flagged), expr.otherwise(F.lit(R.CYCLE_DEFAULT)))


# ----------------------------------------------------------------------------- category

def category_score(text, rules=None) -> Column:
    """Best category rule for the text (B11) as a struct
    ``(score, neg_ordinal, label, color)``: the score is the number of the
    rule's keywords contained in the text; the highest score wins and ties go
    to the earlier rule (``greatest`` over structs compares score first, then
    the negated ordinal)."""
    t = _c(text)
    rules = rules if rules is not None else R.CATEGORY_RULES
    n = len(rules)
    # One integer per rule: score * base + (base - 1 - ordinal); the greatest
    # integer is the highest score with the earliest rule, and stays inside
    # generated code (no struct comparison, no lambda).
    base = 1 << 16
    keys = [count_contained(t, words).cast("long") * base + (base - 1 - i) for i, (_, words, _) in enumerate(rules)]
    best = F.greatest(*keys) if n > 1 else keys[0]
    idx = (F.lit(base - 1) - (best % base)).cast("int")
    labels = F.array(*[F.lit(lbl) for lbl, _, _ in rules])
    colors = F.array(*[F.lit(col) for _, _, col in rules])
    return F.struct((best / base).cast("int").alias("score"), (-idx).alias("neg_ordinal"),
                    F.get(labels, idx).alias("label"), F.get(colors, idx).alias("color"))


def category_label(best: Column) -> Column:
    """Label of the best rule, or 'other transactions' when nothing scored."""
    return F.when(best["score"] > 0, best["label"]).otherwise(F.lit(R.CATEGORY_NONE))


def category_from_vendor(vendor, score, rules=None) -> Column:
    """Vendor-word category (B12): only when no keyword scored and the vendor
    is known; NULL when no rung applies."""
    rules = rules if rules is not None else R.VENDOR_CATEGORY_RULES
    v = F.lower(_c(vendor))
    expr = None
    for label, words, _color in rules:
        cond = contains_any(v, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when((_c(score) == 0) & (_c(vendor) != F.lit(R.UNKNOWN_VENDOR)), expr)


def vendor_category_color(label) -> Column:
    lbl = _c(label)
    expr = None
    for name, _w, color in R.VENDOR_CATEGORY_RULES:
        expr = F.when(lbl == name, F.lit(color)) if expr is None else expr.when(lbl == name, F.lit(color))
    return expr


def rule_confidence(score) -> Column:
    """15 per matched keyword, 25 when none matched; not capped."""
    s = _c(score)
    return F.when(s > 0, s * 15).otherwise(F.lit(25)).cast("int")


# ----------------------------------------------------------------------------- vendor

# The six vendor patterns in priority order.
VENDOR_PATTERNS = [
    r"(?:at|@)\s+([A-Za-z][A-Za-z0-9\s&.-]{2,30})(?:\s|$|,|\.|;)",
    r"(?:paid to|payment to|transfer to)\s+([A-Za-z][A-Za-z0-9\s&.-]{2,30})(?:\s|$|,|\.|;)",
    r"(?:merchant|store|shop):\s*([A-Za-z][A-Za-z0-9\s&.-]{2,30})(?:\s|$|,|\.|;)",
    r"(?:purchase from|bought from)\s+([A-Za-z][A-Za-z0-9\s&.-]{2,30})(?:\s|$|,|\.|;)",
    r"([A-Z][A-Z0-9\s&.-]{3,25})\s+(?:store|shop|restaurant|cafe)",
    r"(?:^|\s)([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\s+(?:payment|transaction)",
]
VENDOR_FLAGS = "(?imU)"     # case-blind, multi-line, Unicode blanks (as in Python)


# Literal words each vendor pattern needs (lower case); a cheap substring test
# skips the regex on texts that cannot match (pattern 5 backtracks heavily).
VENDOR_PREFILTER = [
    None,
    ["paid to", "payment to", "transfer to"],
    ["merchant:", "store:", "shop:"],
    ["purchase from", "bought from"],
    ["store", "shop", "restaurant", "cafe"],
    ["payment", "transaction"],
]


def vendor_candidates(clean_body, lower_body=None) -> list[Column]:
    """First match of each vendor pattern, trimmed (NULL when the pattern
    does not match).  One regex scan per pattern, skipped when the text lacks
    the pattern's literal words."""
    b = _c(clean_body)
    low = F.lower(b) if lower_body is None else _c(lower_body)
    out = []
    for pat, need in zip(VENDOR_PATTERNS, VENDOR_PREFILTER):
        m = F.nullif(F.regexp_extract(b, VENDOR_FLAGS + pat, 1), F.lit(""))
        if need:
            m = F.when(contains_any(low, need), m)
        out.append(strip_unicode(m))
    return out


def pick_vendor(candidates: list[Column], stopwords=None) -> Column:
    """Vendor cascade decision (see ``extract_vendor``), title-cased once."""
    stop = [w.lower() for w in (stopwords if stopwords is not None else R.VENDOR_STOPWORDS)]

    def ok(v):
        return v.isNotNull() & (F.length(v) > 3) & ~F.lower(v).isin(stop)

    accepted = [F.when(ok(v), v) for v in candidates]
    return F.coalesce(title_case(F.coalesce(*accepted, *reversed(candidates))), F.lit(R.UNKNOWN_VENDOR))


def extract_vendor(clean_body, stopwords=None) -> Column:
    """Vendor cascade (B4): the first candidate longer than 3 characters that
    is not a stop word; if every candidate is rejected, the last rejected
    candidate stays (as in the reference); no candidate -> 'Unknown Vendor'.

    For wide projections prefer materialising ``vendor_candidates`` as a
    column first and calling ``pick_vendor`` on it."""
    return pick_vendor(vendor_candidates(clean_body), stopwords)


# ----------------------------------------------------------------------------- services

def service_lookup(description) -> Column:
    """Known service of a description (F8) as a struct
    ``(name, category, logo, color, confidence)``."""
    d = _c(description)
    low = strip_unicode(F.lower(d))
    arr = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(name).alias("name"), F.lit(cat).alias("category"),
                             F.lit(logo).alias("logo"), F.lit(col).alias("color"), F.lit(conf).alias("confidence"))
                    for n, name, cat, logo, col, conf in R.SERVICE_RULES])
    hit = F.get(F.filter(arr, lambda r: F.contains(low, r["needle"])), 0)
    words = F.filter(F.split(strip_unicode(d), r"(?U)\s+"), lambda w: w != "")
    two = F.when(F.size(words) >= 2, title_case(F.concat_ws(" ", F.slice(words, 1, 2)))) \
        .otherwise(title_case(F.get(words, 0)))
    cloud = contains_any(low, R.CLOUD_WORDS)
    first = F.coalesce(title_case(F.get(words, 0)), F.lit(R.UNKNOWN_SERVICE))
    cs, ci, cc, cconf = R.CLOUD_SERVICE
    os_, oi, oc, oconf = R.OTHER_SERVICE
    return (F.when(hit.isNotNull(), hit.dropFields("needle"))
            .when(cloud, F.struct(two.alias("name"), F.lit(cs).alias("category"), F.lit(ci).alias("logo"),
                                  F.lit(cc).alias("color"), F.lit(cconf).alias("confidence")))
            .otherwise(F.struct(first.alias("name"), F.lit(os_).alias("category"), F.lit(oi).alias("logo"),
                                F.lit(oc).alias("color"), F.lit(oconf).alias("confidence"))))


def service_enrich(service_name) -> Column:
    """Manual-subscription enrichment (F9): struct ``(category, logo, color)``
    from the first contained needle, else the first word rung, else other.

    The normalised name is made once per row: it is the variable of a lambda
    over a list of one, which the optimizer cannot inline into every rung."""
    return F.get(F.transform(F.array(strip_unicode(F.lower(_c(service_name)))), _enrich), F.lit(0))


def _enrich(low: Column) -> Column:
    arr = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(cat).alias("category"), F.lit(logo).alias("logo"),
                             F.lit(col).alias("color"))
                    for n, cat, logo, col in R.ENRICH_RULES])
    hit = F.get(F.filter(arr, lambda r: F.contains(low, r["needle"])), 0)
    expr = F.when(hit.isNotNull(), hit.dropFields("needle"))
    for words, cat, logo, col in R.ENRICH_WORD_RULES:
        expr = expr.when(contains_any(low, words),
                         F.struct(F.lit(cat).alias("category"), F.lit(logo).alias("logo"), F.lit(col).alias("color")))
    oc, oi, ocol = R.ENRICH_OTHER
    return expr.otherwise(F.struct(F.lit(oc).alias("category"), F.lit(oi).alias("logo"), F.lit(ocol).alias("color")))


def recurrence_trial(name, description, amount, stated_type=None) -> Column:
    """Trial and type of a detected subscription (F4) as a struct
    ``(is_trial, trial_reason, subscription_type)``.

    Reason priority: cloud vendor (at most 10) > first trial word in list
    order > low amount."""
    from .amount import low_amount_reason
    n = _c(name)
    a = _c(amount)
    text = F.lower(F.concat_ws(" ", n, F.coalesce(_c(description), F.lit(""))))
    word = first_contained(text, R.TRIAL_WORDS_RECUR)
    low_amt = F.coalesce(a <= TRIAL_MAX, F.lit(False))
    cloud = contains_any(F.lower(n), R.CLOUD_PLATFORM_NEEDLES)
    reason = (F.when(cloud & low_amt, F.lit(R.CLOUD_TRIAL_REASON))
              .when(word.isNotNull(), F.concat(F.lit("Contains '"), word, F.lit("'")))
              .when(low_amt, low_amount_reason(a)))
    is_trial = low_amt | word.isNotNull()
    stype = _c(stated_type) if stated_type is not None else F.lit("other")
    stype = F.when(cloud, F.lit("cloud_platform")).otherwise(stype)
    return F.struct(is_trial.alias("is_trial"), reason.alias("trial_reason"), stype.alias("subscription_type"))
