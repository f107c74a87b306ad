"""Rule tables against the short lists' column expressions and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark import rules as R
from tallyspark.functions import classify as C
from tallyspark.operators import rule_table as RT
from tallyspark.sources import search as S

WORDS = ["netflix", "order", "vi", "service", "prime", "cloud", "é", "über", "uber eats", "food", "zomato", "salary", "emi", "atm", "fuel", "a", "日本語x", "😀ok"]


def texts(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "order"), (n + 2, "order"), (n + 2, "food"), (None, "uber eats"), (n + 3, "vi" * 30_000)]
    return spark.createDataFrame(rows, "k long, text string").repartition(4)


def test_bank_table_equals_the_list(spark):
    low = [(lbl, [n.lower() for n in needles]) for lbl, needles in R.BANK_SENDERS]
    table = RT.rule_rows(spark, low + R.BANK_TOKENS)
    senders = [n for _, needles in low for n in needles] + ["x@praxis.example", "axis", "", "nobody@example.org", "HDFC Alerts <Alerts@HDFCBank.net>", None]
    df = spark.createDataFrame(list(enumerate(senders)), "k long, sender string").withColumn("low", F.lower("sender"))
    got = RT.resolve_by_rules(df, "low", table, ["k"], default=R.UNKNOWN_BANK).withColumn("want", C.resolve_bank("sender"))
    assert got.where(~F.col("label").eqNullSafe(F.col("want"))).collect() == [] and got.count() == len(senders)


def test_category_table_equals_the_list(spark):
    table = RT.rule_rows(spark, [(lbl, words) for lbl, words, _ in R.CATEGORY_RULES])
    df = texts(spark)
    got = RT.score_by_rules(df, "text", table, ["k"])
    best = C.category_score(F.coalesce("text", F.lit("")))
    want = df.select("k", "text", best["score"].alias("score"), C.category_label(best).alias("category"))
    key = lambda rows: sorted(map(str, rows))
    assert key(got.collect()) == key(want.collect())


def test_fifty_thousand_needles_match_brute_force_under_a_small_plan(spark):
    rng = random.Random(3)
    needles = {"".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 6))) for _ in range(70_000)}
    needles = sorted(n for n in needles if n.strip())[:50_000]
    rules = [(i % 977, f"L{i % 31}", n) for i, n in enumerate(needles)]
    rows = [(k, "".join(rng.choice("abcdeé xyz") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    table = spark.createDataFrame([*rules, (1, "none", None), (1, "all", "")], "ordinal long, label string, needle string")
    df = spark.createDataFrame(rows, "k long, text string")
    got = RT.resolve_by_rules(df, "text", table, ["k"])
    want = {k: min(((o, n, lbl) for o, lbl, n in rules if n in t), default=(0, "", None))[2] for k, t in rows}
    assert {r.k: r.label for r in got.collect()} == want and len(set(want.values())) > 3
    small = RT.resolve_by_rules(df, "text", table.limit(10), ["k"])
    size = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (got, small)]
    assert abs(size[0] - size[1]) < 0.2 * size[1]


def test_rule_tables_without_rows(spark):
    none = spark.createDataFrame([], "ordinal long, label string, needle string")
    df = texts(spark, 5)
    assert {r.label for r in RT.resolve_by_rules(df, "text", none, ["k"], default="d").collect()} == {"d"}
    assert RT.score_by_rules(df.limit(0), "text", RT.rule_rows(spark, [("x", ["order"])]), ["k"]).collect() == []


def test_candidate_search_by_a_table_of_terms(spark):
    rng = random.Random(9)
    rows = [(k % 3, f"m{k:03d}", rng.choice(["Alerts@HDFCBank.net", "noreply@chase.com", None, "x@y"]), rng.choice(["Transaction alert", "Hello", None]),
             rng.choice(["your subscription", "nothing", None])) for k in range(120)]
    df = spark.createDataFrame(rows, "account_id long, message_id string, sender string, subject string, body string")
    terms = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(S.default_terms())], "term_ord int, field string, needle string")
    for n in (5, 30, 1000):
        a, b = ({tuple(r) for r in S.candidate_messages(df, n, t).collect()} for t in (None, terms))
        assert a == b and a


def test_needles_meet_the_different_runs_and_not_the_texts(spark):
    df = texts(spark)
    table = RT.rule_rows(spark, [("a", ["order", "loud", "日本"]), ("b", ["zomato", "é"])])
    for got in (RT.resolve_by_rules(df, "text", table, ["k"]), RT.score_by_rules(df, "text", table, ["k"])):
        plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "contains(run" in plan and "contains(text" not in plan and "contains(_text" not in plan
        assert "regexp_extract_all(run" in plan and "regexp_extract_all(text" not in plan


def test_needles_of_several_runs_and_of_no_letter_match_brute_force(spark):
    rng = random.Random(17)
    cut = lambda n: "".join(rng.choice(["a", "b", "ab", " ", "  ", "-", ".", "é", "\n", "😀", "1", "_"]) for _ in range(n))
    needles = sorted({cut(rng.randint(1, 5)) for _ in range(400)})
    rules = [(i % 23, f"L{i % 7}", n) for i, n in enumerate(needles)]
    rows = [(k, cut(rng.randint(0, 25))) for k in range(80)] + [(99, None), (100, "...  --")]
    table = spark.createDataFrame(rules, "ordinal long, label string, needle string")
    df = spark.createDataFrame(rows, "k long, text string")
    hits = {k: sorted((o, n, lbl) for o, lbl, n in rules if n in (t or "")) for k, t in rows}
    got = RT.resolve_by_rules(df, "text", table, ["k"])
    assert {r.k: r.label for r in got.collect()} == {k: h[0][2] if h else None for k, h in hits.items()}

    def best(h):
        labels = {lbl: (-len({n for _, n, x in h if x == lbl}), min(o for o, _, x in h if x == lbl), lbl) for _, _, lbl in h}
        low = min(labels.values(), default=(0, 0, R.CATEGORY_NONE))
        return -low[0], low[2]

    assert {r.k: (r.score, r.category) for r in RT.score_by_rules(df, "text", table, ["k"]).collect()} == {k: best(h) for k, h in hits.items()}


def shuffles_of_runs(df) -> list[str]:
    """The shuffles of a plan by run, or by row and what was found in it."""
    return re.findall(r"Exchange hashpartitioning\((?:run#|_r1#\d+L, _r2#\d+L, [^\d]).*", df._jdf.queryExecution().executedPlan().toString())


def test_scores_by_rules_shuffle_the_texts_alone(spark):
    got = RT.score_by_rules(texts(spark), "text", RT.rule_rows(spark, [("a", ["order", "uber eats"]), ("b", ["zomato", "vi"])]), ["k"])
    assert shuffles_of_runs(got) == []


def odd_rules(rng):
    """Needles of several labels, runs and lengths; ordinals and labels may be NULL."""
    cut = lambda n: "".join(rng.choice(["a", "b", "abc", "bcde", " ", "-", "é", "\n", "😀", "1", "日本語"]) for _ in range(n))
    rules = [(rng.choice([None, *range(9)]), rng.choice([None, "x", "y", "z", "é"]), cut(rng.randint(1, 4))) for _ in range(300)]
    rows = [(k, cut(rng.randint(0, 30))) for k in range(60)] + [(90, None), (91, ""), (92, "ab" * 90 + "日本語" * 40), (93, "abc"), (93, "abc")]
    return [*rules, (1, "x", None), (1, "x", "")], rows


def least(x):
    return x is not None, x or 0


@pytest.mark.parametrize("few", [RT.FEW, -1])
def test_scores_of_broadcast_and_of_joined_rules_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(RT, "FEW", few)
    rules, rows = odd_rules(random.Random(5))

    def best(t):
        first = {}
        for o, lbl, n in rules:
            if n and n in (t or ""):
                first.setdefault(lbl, {}).setdefault(n, []).extend([] if o is None else [o])
        keyed = [(-len(x), least(min((o for os in x.values() for o in os), default=None)), (lbl is not None, lbl or ""), lbl) for lbl, x in first.items()]
        low = min(keyed, default=(0, 0, 0, None))
        return -low[0], low[3] or R.CATEGORY_NONE

    table = spark.createDataFrame(rules, "ordinal long, label string, needle string")
    got = RT.score_by_rules(spark.createDataFrame(rows, "k long, text string"), "text", table, ["k"]).collect()
    assert sorted((r.k, r.score, r.category) for r in got) == sorted((k, *best(t)) for k, t in rows)


def test_resolving_by_rules_shuffles_the_texts_alone(spark):
    got = RT.resolve_by_rules(texts(spark), "text", RT.rule_rows(spark, [("a", ["order", "uber eats"]), ("b", ["zomato", "vi"])]), ["k"])
    assert shuffles_of_runs(got) == []


@pytest.mark.parametrize("few", [RT.FEW, -1])
def test_labels_of_broadcast_and_of_joined_rules_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(RT, "FEW", few)
    rules, rows = odd_rules(random.Random(6))

    def first(t):
        hits = [(least(o), n, (lbl is not None, lbl or ""), lbl) for o, lbl, n in rules if n and n in (t or "")]
        return (min(hits)[3] if hits else None) or "none"

    table = spark.createDataFrame(rules, "ordinal long, label string, needle string")
    got = RT.resolve_by_rules(spark.createDataFrame(rows, "k long, text string"), "text", table, ["k"], default="none").collect()
    assert sorted((r.k, r.label) for r in got) == sorted((k, first(t)) for k, t in rows)


@pytest.mark.parametrize("few", [RT.FEW, -1])
def test_terms_of_broadcast_and_of_joined_tables_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(RT, "FEW", few)
    rules, rows = odd_rules(random.Random(7))
    terms = [(i, "subject" if i % 3 else "body", n) for i, (_, _, n) in enumerate(rules)]
    df = spark.createDataFrame([(k, t, t and t[::-1]) for k, t in rows], "k long, subject string, body string")
    got = RT.hits_by_rules(df, ["subject", "body"], spark.createDataFrame(terms, "term_ord int, field string, needle string"), ["k"])
    want = {(k, i) for k, t in rows for i, f, n in terms if n and n.lower() in ((t or "") if f == "subject" else (t or "")[::-1]).lower()}
    got = [tuple(r) for r in got.collect()]
    assert set(got) == want and len(got) == len(want)
