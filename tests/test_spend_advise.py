"""Spend aggregates and recommendation rules (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import advise as AD
from tallyspark.operators import clean as CL
from tallyspark.operators import spend as S

TX = "account_id long, message_id string, category string, amount_numeric decimal(18,2), local_ts timestamp_ntz"
SUBS = "account_id long, is_trial boolean"


def _tx(spark, rows):
    return spark.createDataFrame(rows, TX)


def test_month_over_month_skips_gap(spark):
    t = _tx(spark, [(1, "a", "c", Decimal("100"), dt.datetime(2025, 1, 5)),
                    (1, "b", "c", Decimal("150"), dt.datetime(2025, 3, 5))])
    r = S.month_over_month(t).first()
    assert (r["latest_amount"], r["prev_amount"], r["change_pct"]) == (150.0, 100.0, 50.0)
    assert (r["latest_month"], r["prev_month"]) == ("2025-03", "2025-01")


def test_date_range_inclusive_on_local_date(spark):
    t = _tx(spark, [(1, "a", "c", Decimal("1"), dt.datetime(2025, 1, 31, 23, 59))])
    assert CL.date_range(t, "2025-01-01", "2025-01-31").count() == 1


def _rules(spark, tx_rows, subs_rows=()):
    t = _tx(spark, tx_rows)
    s = spark.createDataFrame(list(subs_rows), SUBS)
    return sorted(r["rule_id"] for r in AD.recommendations(t, s).collect())


def test_top_share_exactly_30_does_not_fire(spark):
    # a Monday; category A = 30 %, small transactions not a majority
    day = dt.datetime(2025, 1, 6)
    rows = [(1, "1", "A", Decimal("300"), day), (1, "2", "B", Decimal("350"), day), (1, "3", "C", Decimal("350"), day)]
    assert "top_category" in _rules(spark, rows)  # B and C > 30 %
    rows = [(1, str(i), f"K{i}", Decimal("300"), day) for i in range(3)] + [(1, "9", "Z", Decimal("100"), day)]
    assert "top_category" not in _rules(spark, rows)  # 300 / 1000 = 30 % exactly


def test_balanced_when_nothing_fires_and_weekend_needs_both_sides(spark):
    day = dt.datetime(2025, 1, 6)
    rows = [(1, str(i), f"K{i}", Decimal("200"), day) for i in range(5)]
    assert _rules(spark, rows) == ["balanced"]
    # weekend only: rule I4 cannot fire
    sat = dt.datetime(2025, 1, 4)
    assert "weekend" not in _rules(spark, [(1, str(i), f"K{i}", Decimal("200"), sat) for i in range(5)])


def test_trials_and_small(spark):
    day = dt.datetime(2025, 1, 6)
    rows = [(1, str(i), f"K{i}", Decimal("20"), day) for i in range(5)]
    assert _rules(spark, rows, [(1, True), (1, False)]) == ["small_transactions", "trials"]


def test_spend_spike(spark):
    rows = [(1, f"m{d}", "c", Decimal("10") + d % 2, dt.datetime(2025, 1, d + 1)) for d in range(10)]
    rows.append((1, "big", "c", Decimal("500"), dt.datetime(2025, 1, 12)))
    out = [r["message_id"] for r in AD.spend_spikes(_tx(spark, rows)).collect()]
    assert out == ["big"]


@pytest.mark.parametrize("block_rows", [1_000_000, 7, 40])
def test_spikes_over_the_thirty_rows_before(spark, block_rows):
    """A hot category, sparse ones, one without a name, ties, against a plain loop."""
    import random
    import statistics
    rng = random.Random(1)
    rows = []
    for k in range(600):
        cat = rng.choice(["hot"] * 6 + [None, "a", "b", "c"])
        amount = None if rng.random() < 0.05 else Decimal(rng.choice([1, 2, 3, 4, 5] * 6 + [90])).quantize(Decimal("1.00"))
        rows.append((rng.randint(1, 2), f"m{k:04d}", cat, amount, dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.randint(0, 300) ** 2 // 90)))
    want = []
    for key in {(r[0], r[2]) for r in rows}:
        group = sorted((r for r in rows if (r[0], r[2]) == key), key=lambda r: (r[4], r[1]))
        for i, r in enumerate(group):
            seen = [x[3] for x in group[max(0, i - 30):i] if x[3] is not None]
            if r[3] is not None and len(seen) >= 2 and float(r[3]) > float(statistics.mean(seen)) + 3 * statistics.stdev(map(float, seen)) + 1e-9:
                want.append(r[1])
    tx = _tx(spark, rows).withColumn("event_ts", F.col("local_ts").cast("timestamp")).repartition(5)
    got = [r["message_id"] for r in AD.spend_spikes(tx, block_rows=block_rows).collect()]
    assert len(want) > 5 and sorted(got) == sorted(want)
    assert any(r[2] is None and r[1] in want for r in rows)
    assert AD.spend_spikes(tx.limit(0)).collect() == []


def test_day_spikes_of_charges_without_a_category(spark):
    rows = [(1, f"m{d}", None, Decimal("10") + d % 2, dt.datetime(2025, 1, d + 1)) for d in range(10)]
    rows.append((1, "big", None, Decimal("500"), dt.datetime(2025, 1, 12)))
    assert [r["message_id"] for r in AD.spend_spikes_by_day(_tx(spark, rows)).collect()] == ["big"]


def test_colours_are_distinct_and_stay(spark):
    from tallyspark import rules as R
    from tallyspark.operators import analyze as A
    rows = [(a, f"Cat {k % n}") for a, n in ((1, 30), (2, 10), (3, 31)) for k in range(80)] + [(1, None), (1, "NETFLIX"), (2, "Spotify")]
    tx = spark.createDataFrame(rows, "account_id int, category string")
    for block_rows in (1_000_000, 4):
        got = A.category_colors(tx, block_rows=block_rows).collect()
        for account, n in ((1, 30), (2, 10), (3, 31)):
            mine = [r for r in got if r["account_id"] == account and r["ordinal"] is not None]
            assert sorted(r["ordinal"] for r in mine) == list(range(1, n + 1))
            assert len({r["color"] for r in mine}) == min(n, len(R.PALETTE))
        assert {r["color"] for r in got if r["category_key"] == "netflix"} == {dict(R.PRESET_COLORS)["netflix"]}
    first = A.category_colors(tx)
    more = tx.unionByName(spark.createDataFrame([(2, "aaa"), (2, "Cat 3"), (4, "new")], tx.schema))
    second = A.category_colors(more, first)
    old, new = ({(r["account_id"], r["category_key"]): (r["ordinal"], r["color"]) for r in d.collect()} for d in (first, second))
    assert old.items() <= new.items() and new[2, "aaa"] == (11, R.PALETTE[10]) and new[4, "new"] == (1, R.PALETTE[0])
    assert second.count() == len(new)


def test_runs_are_appended_once(spark):
    from tallyspark.session import scratch_path
    path = scratch_path(spark, "test-runs")
    a, b = (spark.createDataFrame([(1, run, Decimal(x), 1)], "account_id int, run_id string, amount_detected decimal(18,2), n int") for run, x in (("2024-01-01", "5"), ("r2", "7")))
    for runs in (a, b, a, a):
        S.append_runs(path, runs)
    S.append_runs(path, a.withColumn("amount_detected", F.lit(6).cast("decimal(18,2)")))
    got = {r["run_id"]: float(r["amount_detected"]) for r in S.read_runs(spark, path, a.schema).collect()}
    assert got == {"2024-01-01": 6.0, "r2": 7.0}
    with pytest.raises(Exception, match="a run without an id"):
        S.append_runs(path, a.withColumn("run_id", F.lit(None).cast("string")))


def test_accounts_seen_in_no_run(spark):
    sketches = S.account_sketches(spark.createDataFrame([], "account_id string, run_id string"))
    assert S.accounts_seen(sketches).first()["total_users"] == 0
