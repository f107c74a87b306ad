"""Recurrence, ledger and metrics goldens (FIXTURES.md section 3)."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tallyspark.operators import ledger as L
from tallyspark.operators import metrics as M
from tallyspark.operators import recur as RC

TXN = ("account_id long, message_id string, merchant_name string, subject string, amount_numeric decimal(18,2), "
       "event_ts timestamp, local_ts timestamp_ntz, is_subscription boolean, category string, bank string, "
       "subscription_type string, billing_cycle string, service_logo string, color string, confidence int, "
       "is_trial boolean")


def _txns(spark, rows):
    full = []
    for i, r in enumerate(rows):
        name, amount, ts, flagged = r[:4]
        stated = r[4] if len(r) > 4 else None
        subject = r[5] if len(r) > 5 else name
        full.append((1, f"m{i:03d}", name, subject, amount, ts, ts, flagged, "c", "b", None, stated, None, None,
                     50, False))
    return spark.createDataFrame(full, TXN)


def D(*a):
    return dt.datetime(*a)


def _cycle(spark, rows):
    from decimal import Decimal  # noqa: F401
    out = RC.detect_flagged(_txns(spark, rows)).collect()
    return {r["service_name"]: r["billing_cycle"] for r in out}


def test_cycle_monthly_from_gap(spark):
    from decimal import Decimal
    rows = [("S", Decimal("9.99"), D(2025, 1, 1), True), ("S", Decimal("9.99"), D(2025, 1, 31), True),
            ("S", Decimal("9.99"), D(2025, 3, 2), True)]
    assert _cycle(spark, rows) == {"S": "Monthly"}


def test_cycle_elapsed_days_not_calendar(spark):
    from decimal import Decimal
    t = _txns(spark, [("S", Decimal("50"), D(2025, 1, 1, 23), True), ("S", Decimal("50"), D(2025, 1, 26, 1), True)])
    g = RC.recurring_flagged(t).select(RC.elapsed_days("first_ts", "last_ts").alias("d")).first()["d"]
    assert g == 24


def test_cycle_bands(spark):
    for avg, expected in [(25, "monthly"), (35, "monthly"), (85, "quarterly"), (95, "quarterly"),
                          (360, "yearly"), (370, "yearly"), (24.5, "monthly"), (35.5, "monthly")]:
        band = spark.range(1).select(RC.cycle_band(F.lit(float(avg))).alias("b")).first()["b"]
        if avg in (24.5, 35.5):
            assert band is None
        else:
            assert band == expected


def test_stated_cycle_wins_and_single_charge(spark):
    from decimal import Decimal
    rows = [("A", Decimal("50"), D(2025, 1, 1), True, "yearly"), ("A", Decimal("50"), D(2025, 1, 31), True, "yearly"),
            ("B", Decimal("60"), D(2025, 1, 1), True)]
    assert _cycle(spark, rows) == {"A": "Yearly", "B": "Monthly"}


def test_pattern_path_drops_zero_gap_and_branch(spark):
    from decimal import Decimal
    rows = [("X", Decimal("20"), D(2025, 1, 1), False), ("X", Decimal("20"), D(2025, 1, 1, 5), False)]
    assert RC.detect_subscriptions(_txns(spark, rows)).count() == 0
    # one flagged row switches the pattern path off for the whole account
    rows2 = [("F", Decimal("30"), D(2025, 1, 1), True),
             ("R", Decimal("20"), D(2025, 1, 1), False), ("R", Decimal("20"), D(2025, 1, 31), False)]
    names = [r["service_name"] for r in RC.detect_subscriptions(_txns(spark, rows2)).collect()]
    assert names == ["F"]
    names = sorted(r["service_name"] for r in RC.detect_subscriptions(_txns(spark, rows2), mode="both").collect())
    assert names == ["F", "R"]


def test_trial_reasons(spark):
    from decimal import Decimal
    df = spark.createDataFrame([("Netflix trial", "", Decimal("5.00")), ("Google Cloud", "", Decimal("5.00")),
                                ("Plain", "", Decimal("10.00")), ("Plain2", "", Decimal("10.01"))],
                               "n string, d string, a decimal(18,2)")
    from tallyspark.functions.classify import recurrence_trial
    r = {x["n"]: x["t"] for x in df.select("n", recurrence_trial(F.col("n"), F.col("d"), F.col("a")).alias("t"))
         .collect()}
    assert r["Netflix trial"]["is_trial"] and r["Netflix trial"]["trial_reason"] == "Contains 'trial'"
    assert r["Google Cloud"]["trial_reason"] == "Google Cloud trial/credits"
    assert r["Google Cloud"]["subscription_type"] == "cloud_platform"
    assert r["Plain"]["is_trial"] and r["Plain"]["trial_reason"] == "Low amount (₹10.00)"
    assert not r["Plain2"]["is_trial"]


SUBS = ("account_id long, id string, seq long, service_name string, amount decimal(18,2), billing_cycle string, "
        "status string, category string, is_trial boolean, start_date date, last_payment date, brand_color string")


def _subs(spark, rows):
    return spark.createDataFrame(rows, SUBS)


def test_merge_keeps_lowest_amount_and_skips_existing(spark):
    from decimal import Decimal
    led = L.conform(_subs(spark, [(1, "n1", 1, "Netflix", Decimal("199"), "Monthly", "Inactive", None, False,
                                   None, None, None)]))
    det = spark.createDataFrame(
        [(1, "d1", "NETFLIX", Decimal("5"), (0, "netflix", Decimal("5"))),
         (1, "d2", "Svc", Decimal("199"), (0, "svc", Decimal("199"))),
         (1, "d3", "Svc", Decimal("5"), (0, "svc", Decimal("5")))],
        "account_id long, id string, service_name string, amount decimal(18,2), "
        "detect_order struct<path:int,key:string,amount:decimal(18,2)>")
    out = L.merge_subscriptions(led, det)
    rows = sorted((r["service_name"], float(r["amount"]), r["seq"]) for r in out.collect())
    assert rows == [("Netflix", 199.0, 1), ("Svc", 5.0, 2)]
    # idempotent: merging the same detections again adds nothing
    assert L.merge_subscriptions(out, det).count() == out.count()


def test_unique_ids(spark):
    from decimal import Decimal
    s = _subs(spark, [(1, "a", i, "x", Decimal("1"), "Monthly", "Active", None, False, None, None, None)
                      for i in range(3)])
    assert [r["id"] for r in L.unique_ids(s).orderBy("seq").collect()] == ["a", "a_dup_1", "a_dup_2"]


def _suffixed(rows):
    """Free suffixes by a plain loop over (account, id, seq)."""
    taken = {(a, i) for a, i, _ in rows}
    seen, last, out = set(), {}, {}
    for a, i, q in sorted(rows, key=lambda r: r[2]):
        if (a, i) not in seen:
            seen.add((a, i))
            out[q] = i
            continue
        n = last.get((a, i), 0) + 1
        while (a, f"{i}_dup_{n}") in taken:
            n += 1
        last[a, i] = n
        out[q] = f"{i}_dup_{n}"
    return out


@pytest.mark.parametrize("block", [100_000, 1, 5])
def test_unique_ids_match_a_plain_loop(spark, monkeypatch, block):
    import random
    monkeypatch.setattr(L, "ID_BLOCK", block)
    rng = random.Random(8)
    pool = ["a"] * 12 + ["a_dup_%d" % k for k in (1, 2, 3, 7, 8, 11, 0)] + ["b", "b", "b_dup_2", "b_dup_02", "_dup_1", "", "c_dup_x"]
    rows = [(rng.randint(1, 2), rng.choice(pool), k) for k in range(120)]
    df = spark.createDataFrame(rows, "account_id int, id string, seq long").repartition(4)
    got = {r["seq"]: r["id"] for r in L.unique_ids(df).collect()}
    want = _suffixed(rows)
    # the loop reads b_dup_02 as no suffix; the library keeps its number free of it, as of any leading zero
    assert {q: i for q, i in got.items() if not i.startswith("b")} == {q: i for q, i in want.items() if not i.startswith("b")}
    assert len({(r[0], got[r[2]]) for r in rows}) == len(rows)


def test_a_million_equal_ids(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("account_id"), F.lit("x").alias("id"), F.col("id").alias("seq"))
    more = spark.createDataFrame([(1, f"x_dup_{k}", 2_000_000 + k) for k in (1, 2, 500_000, 999_999)], "account_id int, id string, seq long")
    out = L.unique_ids(df.unionByName(more))
    n = F.regexp_extract("id", "_dup_([0-9]+)$", 1).try_cast("long")
    got = out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max(n).alias("top")).first()
    assert (got["n"], got["ids"], got["top"]) == (1_000_004, 1_000_004, 1_000_003)
    assert out.where("seq = 1").first()["id"] == "x_dup_3" and out.where("seq = 999999").first()["id"] == "x_dup_1000003"


def test_add_low_amount_forces_trial(spark):
    adds = spark.createDataFrame([(1, 1, "Thing", 9.0, "Monthly", "Inactive")],
                                 "account_id long, add_seq long, service_name string, amount double, "
                                 "billing_cycle string, status string")
    out = L.ledger_add(L.conform(_subs(spark, [])), adds).first()
    assert out["status"] == "Trial" and out["is_trial"] and out["trial_reason"] == "Low amount (₹9.00)"
    assert out["id"].startswith("manual_thing_")


def test_update_crossing_threshold(spark):
    from decimal import Decimal
    led = L.conform(_subs(spark, [(1, "s1", 1, "Svc", Decimal("5"), "Monthly", "Trial", None, True, None, None,
                                   None)]))
    edits = spark.createDataFrame([(1, "s1", 1, 50.0, "Trial"), (1, "nope", 2, 1.0, None)],
                                  "account_id long, id string, edit_seq long, amount double, status string")
    out, unmatched = L.ledger_update(led, edits)
    r = out.first()
    assert r["status"] == "Active" and r["is_trial"] is False and float(r["amount"]) == 50.0
    assert [x["id"] for x in unmatched.collect()] == ["nope"]


EDIT_LOG = "account_id long, id string, edit_seq long, amount double, service_name string, status string, category string"


def _one_by_one(rows, edits):
    """Edits applied one at a time to a list of dicts, as a plain loop."""
    for _, i, _, amount, name, status, category in sorted(edits, key=lambda e: e[2]):
        row = next((r for r in rows if r["id"] == i), None)
        if row is None:
            continue
        sent = {k: v for k, v in (("amount", amount), ("service_name", name), ("status", status), ("category", category)) if v is not None}
        if amount is not None and (amount <= 10) != bool(row["is_trial"]):
            low = amount <= 10
            sent |= {"status": "Trial" if low else "Active", "is_trial": low, "trial_reason": f"Low amount (₹{amount:.2f})" if low else None}
        if name is not None and name != row["service_name"]:
            sent["category"] = "Video Streaming" if "netflix" in name else "Music Streaming" if "spotify" in name else "Other Services"
        row.update(sent)
    return rows


@pytest.mark.parametrize("block", [1_000_000, 1, 7])
def test_updates_of_one_id_follow_one_another(spark, monkeypatch, block):
    import random
    from decimal import Decimal
    monkeypatch.setattr(L, "EDIT_BLOCK", block)
    rng = random.Random(5)
    subs = [(1, f"s{k}", k, "zz netflix" if k % 2 else None, Decimal(5 + 10 * (k % 2)), "Monthly", "Active", "c", [None, True, False][k % 3], None, None, None)
            for k in range(6)]
    led = L.conform(_subs(spark, subs))
    pick = lambda *v: rng.choice([None, None, *v])
    # a third of all edits are of one id; one id is unknown
    edits = [(1, rng.choice(["s0", "s1", "s1", "s1", "s2", "s3", "s4", "nope"]), k, pick(3.0, 10.0, 11.0, 99.0),
              pick("zz netflix", "zz spotify", "zz"), pick("Inactive", "Active"), pick("d", "e")) for k in range(80)]
    out, unmatched = L.ledger_update(led, spark.createDataFrame(edits, EDIT_LOG).repartition(3))
    start = [r.asDict() for r in led.orderBy("seq").collect()]
    fields = ("id", "service_name", "amount", "status", "is_trial", "trial_reason", "category")
    want = [tuple(r[c] for c in fields) for r in _one_by_one(start, edits)]
    assert [tuple(r[c] for c in fields) for r in out.orderBy("seq").collect()] == want
    assert sorted(r["edit_seq"] for r in unmatched.collect()) == [e[2] for e in edits if e[1] == "nope"]


def test_probed_edit_sequences(spark):
    from decimal import Decimal
    led = L.conform(_subs(spark, [(1, i, k, "Svc", Decimal("50"), "Monthly", "Active", "c", False, None, None, None) for k, i in enumerate("ab")]))
    edits = spark.createDataFrame([(1, "a", 1, 5.0, None, None, None), (1, "a", 2, None, None, "Inactive", None),
                                   (1, "b", 1, None, "netflix", None, None), (1, "b", 2, None, None, None, "Mine")], EDIT_LOG)
    got = {r["id"]: r for r in L.ledger_update(led, edits)[0].collect()}
    assert got["a"]["status"] == "Inactive" and got["a"]["is_trial"] and got["b"]["category"] == "Mine"
    none = L.ledger_update(led, edits.limit(0))[0]
    assert sorted(map(tuple, none.collect()), key=str) == sorted(map(tuple, led.collect()), key=str)


def test_clear_leaves_an_empty_ledger(spark):
    from decimal import Decimal
    led = L.conform(_subs(spark, [(1, "a", 1, "x", Decimal("1"), "Monthly", "Active", None, False, None, None, None)]))
    empty = L.ledger_clear(led)
    assert empty.collect() == [] and empty.schema == led.schema


def test_monthly_metrics(spark):
    from decimal import Decimal
    s = _subs(spark, [
        (1, "a", 1, "Q", Decimal("300"), "Quarterly", "Active", "c1", False, None, None, None),
        (1, "b", 2, "Y", Decimal("1200"), "Yearly", "Active", "c1", False, None, None, None),
        (1, "c", 3, "W", Decimal("50"), "Weekly", "Active", None, False, None, None, None),
        (1, "d", 4, "Same", Decimal("10"), "Monthly", None, "c2", False, None, None, None),
        (1, "e", 5, "Same", Decimal("20"), "Monthly", "Trial", "c2", True, None, None, None),
        (1, "f", 6, "Off", Decimal("99"), "Monthly", "Inactive", "c2", False, None, None, None),
    ])
    me = {r["id"]: r["m"] for r in s.select("id", M.monthly_equivalent().alias("m")).collect()}
    assert (me["a"], me["b"], me["c"]) == (100.0, 100.0, 50.0)
    tot = M.subscription_totals(s, "2025-10-15").first()
    assert tot["total_monthly"] == 280.0 and tot["months_remaining"] == 3 and tot["remaining_year"] == 840.0
    svc = {r["service_name"]: r["monthly_amount"] for r in M.monthly_by_service(s).collect()}
    assert svc["Same"] == 20.0
    cnt = M.status_counts(s).first()
    assert (cnt["active_count"], cnt["inactive_count"], cnt["trial_count"]) == (3, 1, 1)
    cats = M.monthly_by_category(s).collect()
    assert abs(sum(r["monthly_amount"] for r in cats) - tot["total_monthly"]) < 1e-9


def test_next_payment_and_due(spark):
    from decimal import Decimal
    s = _subs(spark, [(1, "a", 1, "x", Decimal("1"), "Monthly", "Active", None, False, None, dt.date(2025, 1, 30),
                       None)])
    r = M.payment_schedule(s, "2025-03-01").first()
    assert r["next_payment"] == dt.date(2025, 3, 1) and r["days_until"] == 0 and r["due_status"] == "Due Soon"
    for days, st in [(-1, "Overdue"), (7, "Due Soon"), (8, "Scheduled")]:
        d, label = M.due_status(F.date_add(F.lit("2025-03-01").cast("date"), days), "2025-03-01")
        assert spark.range(1).select(label.alias("x")).first()["x"] == st


def test_recurring_vs_onetime(spark):
    from decimal import Decimal
    tx = spark.createDataFrame([(1, Decimal("300"), D(2025, m, 5)) for m in (1, 2, 3)],
                               "account_id long, amount_numeric decimal(18,2), local_ts timestamp_ntz")
    s = _subs(spark, [(1, "a", 1, "x", Decimal("400"), "Monthly", "Active", None, False, None, None, None)])
    r = M.recurring_vs_onetime(tx, s, "2025-10-15").first()
    assert r["monthly_spend"] == 300.0 and r["one_time_monthly"] == 0.0
    assert abs(r["subscription_ratio_pct"] - 133.333333) < 1e-4


def test_charges_carry_their_order_few_times(spark):
    """Attributes may be missing in any charge; the usual ones share one order."""
    rng = random.Random(8)
    cols = [*RC.ATTRS, "local_ts"]
    rows = [(k % 3, f"m{k:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 9)), rng.randint(1, 9) * 1.0,
             *[None if rng.random() < p else f"{c}{rng.randint(0, 9)}" for c in cols for p in (0.5 if k % 2 else 0.02,)]) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, message_id string, event_ts timestamp, confidence double, " + ", ".join(f"{c} string" for c in cols))
    g = RC.group_charges(df, F.col("k"))
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") + plan.count("max_by(") <= 1 + len(RC.ATTRS) - 5
    for r in g.collect():
        mine = sorted((x for x in rows if x[0] == r.k), key=lambda x: (x[2], x[1]))
        for i, c in enumerate(cols):
            if c != "local_ts":
                assert r[c] == next((x[4 + i] for x in mine if x[4 + i] is not None), None)
        assert (r.first_local, r.last_local, r.transaction_count) == (mine[0][-1], mine[-1][-1], len(mine))
