"""SQL text for the DuckDB oracle, generated from the same rule tables.

The oracle evaluates the rule *semantics* (substring containment, first match,
arg-max with ties to the earlier rule) in a different engine; only the rule
lists are shared.
"""

from __future__ import annotations

from .. import rules as R


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def score(text: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def category_best(text: str, rules=None) -> tuple[str, str]:
    """(score expression, label expression) of the best category rule."""
    rules = rules if rules is not None else R.CATEGORY_RULES
    scores = [score(text, words) for _, words, _ in rules]
    best = "greatest(" + ", ".join(scores) + ")"
    label = "CASE " + " ".join(f"WHEN {s} = {best} THEN {q(lbl)}" for s, (lbl, _, _) in zip(scores, rules)) + " END"
    return best, f"CASE WHEN {best} = 0 THEN {q(R.CATEGORY_NONE)} ELSE {label} END"


def ladder(text: str, rungs, default: str | None) -> str:
    parts = " ".join(f"WHEN {contains_any(text, words)} THEN {q(label)}" for label, words in rungs)
    return f"CASE {parts} ELSE {q(default) if default is not None else 'NULL'} END"


def title_map(expr: str, labels) -> str:
    """Python str.title() of a known, finite label set."""
    return "CASE " + " ".join(f"WHEN {expr} = {q(lbl)} THEN {q(lbl.title())}" for lbl in labels) + f" ELSE {expr} END"
