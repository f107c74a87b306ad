"""Candidate-message search (operator A3), distributed.

The reference runs one mailbox search per term (sender addresses, subject
words, a body phrase) in order and stops once the ids found so far -
counted with duplicates - reach N; then it de-duplicates, sorts ids
descending as byte strings and keeps N.  Here every message is tested
against the ordered term list with native expressions (no join; an inverted
index where the terms are a table), matches are
counted per (account, term), a running sum over the at most few dozen terms
of each account decides which terms were searched, and the per-account top N
runs through Spark's window group limit (partial top-N on the map side), so a
huge mailbox never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..operators.rule_table import hits_by_rules
from ..session import scratch_path

KEYS = ("account_id",)


def default_terms() -> list[tuple[str, str]]:
    """Ordered (field, needle) search terms: sender addresses, then subject
    words, then the body phrase."""
    terms = [("sender", s) for _, senders in R.BANK_SENDERS for s in senders]
    terms += [("subject", w) for w in R.SEARCH_SUBJECT_TERMS]
    terms += [("body", w) for w in R.SEARCH_BODY_TERMS]
    return terms


def term_hits(messages: DataFrame, terms=None) -> Column:
    """Array of the ordinals of all terms a message matches (case-blind
    substring, as mailbox search does)."""
    terms = terms if terms is not None else default_terms()
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in ("sender", "subject", "body")}
    hits = [F.when(F.contains(low[f], F.lit(n.lower())), F.lit(i)) for i, (f, n) in enumerate(terms)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def candidate_messages(messages: DataFrame, n: int = 50, terms=None, keys=KEYS) -> DataFrame:
    """A3: per account the ids the reference's search would return, with
    their rank (1 = greatest id).  ``terms`` is a short list of (field, needle)
    or, for many terms, a DataFrame (term_ord, field, needle).

    Messages are read and matched once: the matches are written to the shared
    scratch folder, as counting and choosing both need them."""
    if isinstance(terms, DataFrame):
        m = hits_by_rules(messages, ["sender", "subject", "body"], terms, [*keys, "message_id"])
    else:
        m = messages.select(*keys, "message_id", F.explode(term_hits(messages, terms)).alias("term_ord"))
    path = scratch_path(messages.sparkSession, "candidates")
    m.write.parquet(path)
    m = messages.sparkSession.read.schema(m.schema).parquet(path)
    per_term = m.groupBy(*keys, "term_ord").agg(F.count("*").alias("hits"))
    w = Window.partitionBy(*keys).orderBy("term_ord").rowsBetween(Window.unboundedPreceding, -1)
    searched = (per_term.withColumn("before", F.coalesce(F.sum("hits").over(w), F.lit(0)))
                .filter(F.col("before") < n).select(*keys, "term_ord"))
    ids = m.join(searched, [*keys, "term_ord"], "left_semi").select(*keys, "message_id").distinct()
    wr = Window.partitionBy(*keys).orderBy(F.col("message_id").desc())
    return ids.withColumn("rank", F.row_number().over(wr)).filter(F.col("rank") <= n)
