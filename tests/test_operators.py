"""Properties and edges of the operators that the oracles don't reach."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessaro.functions import clean
from tessaro.operators import actions, calendars, factors, membership, merging, portfolio, research, temporal

D = Decimal
day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@given(st.lists(st.integers(1, 300), min_size=1, max_size=14))
@settings(max_examples=200, deadline=None)
def test_solved_weights_fill_the_exposure_below_the_cap(percents):
    policy = portfolio.BufferPolicy()
    names = {f"S{k:02}": D(p) / 100 for k, p in enumerate(percents)}
    weight, cash = portfolio.solve_weights(names, policy)
    assert sum(weight.values()) + cash == 1 and all(0 <= w <= policy.max_single_weight for w in weight.values())
    # a plain water fill: cap what is over, share the rest again
    score = {s: 1 / max(v, policy.volatility_floor) for s, v in names.items()}
    exposure, fixed = min(D(1), len(names) * policy.max_single_weight), {}
    while True:
        rest = {s: x for s, x in score.items() if s not in fixed}
        share = {s: (exposure - len(fixed) * policy.max_single_weight) * x / sum(rest.values()) for s, x in rest.items()}
        over = [s for s, x in share.items() if x > policy.max_single_weight]
        if not over:
            break
        fixed |= dict.fromkeys(over, policy.max_single_weight)
    assert all(abs(weight[s] - (fixed | share)[s]) <= 20 * portfolio.QUANTUM for s in names)


def test_closed_form_weights_equal_solved_ones(spark):
    names = {f"S{k}": v for k, v in enumerate([0.05, 0.12, 0.2, 0.31, 0.4, 0.5, 0.9, 1.5, 2.0])}
    df = spark.createDataFrame([(1, s, v) for s, v in names.items()], "pool int, symbol string, volatility double")
    got = {r.symbol: r.weight for r in portfolio.inverse_volatility(df, ["pool"]).collect()}
    want, _ = portfolio.solve_weights({s: D(str(v)) for s, v in names.items()}, portfolio.BufferPolicy())
    assert all(abs(got[s] - float(want[s])) < 1e-9 for s in names)


def test_buffered_members_are_kept_within_the_hold_rank(spark):
    policy = portfolio.BufferPolicy(target_count=2, entry_rank=2, hold_rank=3, max_single_weight=D("0.5"))
    # values by date: A and B lead, then A falls to third (kept), then to fourth (out)
    values = [{"A": 9, "B": 8, "C": 7, "D": 6}, {"A": 7, "B": 9, "C": 8, "D": 6}, {"A": 1, "B": 9, "C": 8, "D": 6}]
    data = [(f, day(k), s, float(v), True, None, True, None, 0.2) for f in (1, 2) for k, d in enumerate(values) for s, v in d.items()]
    df = spark.createDataFrame(data, "fold_id int, signal_date date, symbol string, processed_value double, is_valid boolean, invalid_reason string, risk_is_valid boolean, risk_invalid_reason string, applied_annualized_volatility double")
    got = portfolio.buffered_targets(df, "fold_id", policy).toPandas()
    for f in (1, 2):
        own = got[got.fold_id == f]
        members = [set(own[(own.signal_date == day(k)) & (own.target_weight > 0)].symbol) for k in range(3)]
        assert members == [{"A", "B"}, {"A", "B"}, {"B", "C"}]
    last = got[(got.fold_id == 1) & (got.signal_date == day(2))].set_index("symbol")
    assert last.member_status.to_dict() == {"A": "exited", "B": "retained", "C": "entered", "D": "not_selected"}
    assert last.member_reason["A"] == "rank_below_hold_rank"


def test_band_edges(spark):
    data = [(True, 0.10, 0.12, 0, 500), (True, 0.10, 0.1199, 0, 500), (False, 0.0, 0.1, 0, 500), (False, 0.1, 0.0, 500, 0), (False, 0.1, 0.1, 500, 550), (True, 0.1, 0.2, 500, 500), (False, 0.1, 0.1, 500, 500)]
    df = spark.createDataFrame(data, "is_continuing boolean, current_weight double, target_weight double, current_quantity long, target_quantity long")
    got = [(r.order_side, r.order_quantity, r.reason) for r in portfolio.apply_band(df.coalesce(1)).collect()]
    assert got[1:] == [("", 0, "within_rebalance_band"), ("BUY", 500, "entering_position"), ("SELL", 500, "exiting_position"), ("", 0, "below_one_lot"), ("", 0, "within_rebalance_band"), ("", 0, "at_target")]
    exact = spark.sql("SELECT true is_continuing, 0.10BD current_weight, 0.12BD target_weight, 0L current_quantity, 500L target_quantity")
    assert portfolio.apply_band(exact).first().reason == "rebalance_outside_band"


@pytest.mark.parametrize("n", [*range(10, 18), 23, 50])
def test_buckets_are_those_of_pandas(spark, n):
    df = spark.createDataFrame([(1, f"S{k:03}", float(k)) for k in range(n)], "d int, symbol string, v double")
    got = [r.b for r in df.withColumn("b", factors.bucket(["d"], "v")).orderBy("v").collect()]
    assert got == (pd.qcut(range(n), 5, labels=False) + 1).tolist()


def test_later_bars_change_no_earlier_factor(spark):
    data = [("S", day(k), 10.0 + k % 7, "INFO", 200) for k in range(100)]
    schema = "symbol string, trade_date date, adjusted_close double, quality_severity string, listed_days int"
    signals = spark.createDataFrame([(day(k),) for k in (59, 60, 70, 80)], "trade_date date")
    short, long = (factors.momentum(spark.createDataFrame(data[:n], schema), signals) for n in (81, 100))
    assert rows(short) == rows(long)
    assert [r.invalid_reason for r in long.orderBy("trade_date").collect()] == ["insufficient_observations", None, None, None]


def test_asof_of_empty_tables_nulls_and_ties(spark):
    left = spark.createDataFrame([("a", day(5)), ("a", None), (None, day(5)), ("b", day(5))], "k string, t date")
    right = spark.createDataFrame([("a", day(5), 1), ("a", day(5), 2), ("a", day(9), 3), (None, day(1), 4)], "k string, u date, v int")
    assert rows(temporal.asof_join(left, right, "t", "u", ["k"], ["v"])) == sorted([("a", day(5), 2), ("a", None, None), (None, day(5), None), ("b", day(5), None)], key=str)
    assert rows(temporal.asof_join(left, right, "t", "u", ["k"], ["v"], strict=True))[0][2] is None
    assert temporal.asof_join(left, right.limit(0), "t", "u", ["k"], ["v"]).filter("v IS NOT NULL").count() == 0
    assert temporal.asof_join(left.limit(0), right, "t", "u", ["k"], ["v"]).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_a_split_asof_join_finds_the_same(spark, strict):
    import random

    rng = random.Random(4)
    left = spark.createDataFrame([("hot" if rng.random() < 0.7 else rng.choice("ab"), day(rng.randrange(900)), k) for k in range(600)] + [("a", None, -1), (None, day(3), -2)], "k string, t date, n int")
    right = spark.createDataFrame([(rng.choice(["hot", "a", "c"]), day(rng.randrange(900)), k) for k in range(120)], "k string, u date, v int")
    whole = temporal.asof_join(left, right, "t", "u", ["k"], ["v"], strict)
    for unit in ("year", "month", "day"):
        assert rows(temporal.asof_join(left, right, "t", "u", ["k"], ["v"], strict, split=unit)) == rows(whole)


def test_adjusted_series_of_a_dividend_and_a_break(spark):
    bars = spark.createDataFrame([("S", day(k), c) for k, c in enumerate([10.0, 11.0, 10.0, 12.0])], "symbol string, trade_date date, close double")
    event = lambda k, **x: ("S", day(k), day(k - 1), day(0), x.get("cash", 0.0), x.get("bonus", 0.0), 0.0, 0.0, x.get("status", "implemented"))
    schema = "symbol string, ex_date date, record_date date, announcement_date date, cash double, bonus double, capitalization double, rights double, status string"
    none = spark.createDataFrame([], "symbol string, trade_date date, reason string")
    paid = spark.createDataFrame([event(2, cash=1.0)], schema)
    got = [r.adjusted_close for r in actions.adjusted_bars(bars, paid, none).orderBy("trade_date").collect()]
    assert got == pytest.approx([10.0, 11.0, 11.0, 13.2])
    planned = spark.createDataFrame([event(2, cash=1.0, status="planned")], schema)
    breaks = actions.break_reasons(planned, None, None, bars)
    out = actions.adjusted_bars(bars, planned, breaks).orderBy("trade_date").collect()
    assert [r.adjusted_close for r in out] == pytest.approx([10.0, 11.0, 10.0, 12.0]) and out[2].invalid_reason == "corporate_action_not_implemented"


def test_strict_ledger_mode_refuses_partial_fills(spark):
    sent = spark.createDataFrame([("o1", 300), ("o2", 100)], "order_id string, quantity long")
    fills = spark.createDataFrame([("o1", 200), ("o2", 100)], "order_id string, quantity long")
    refused = spark.createDataFrame([("o1", 100)], "order_id string, rejected_quantity long")
    assert merging.ledger_faults(sent, fills, refused).count() == 0
    assert rows(merging.ledger_faults(sent, fills, refused, strict=True)) == [("o1", "filled_and_rejected")]


def test_cleaning_of_odd_values(spark):
    df = spark.createDataFrame([("sh.600000", "20200229", "1,234.5", "12.34"), ("600000.sh", "20200230", "", "12.345"), ("600000", "x", "nan", None), (None, None, None, "-1")], "c string, d string, n string, v string").coalesce(1)
    got = df.select(clean.symbol("c"), clean.trade_date("d"), clean.number("n"), clean.shares("v", 100), clean.bare_symbol("c"), clean.board_or_other(clean.symbol("c"))).collect()
    assert [r[0] for r in got] == ["600000.SH", "600000.SH", None, None]
    assert [r[1] for r in got] == [dt.date(2020, 2, 29), None, None, None]
    assert [r[2] for r in got] == [1234.5, None, None, None]
    assert [r[3] for r in got] == [1234, None, None, -100]
    assert [r[4] for r in got] == ["600000.SH", "600000.SH", "600000.SH", None] and got[0][5] == "sh_main" and got[3][5] == "other"


def test_plan_amounts_keep_their_decimals(spark):
    df = spark.createDataFrame([("10派2.5元",), ("10送3股",), (None,)], "plan string").coalesce(1)
    assert [r[0] for r in df.select(clean.plan_amount("plan", "派")).collect()] == ["2.5", None, None]


def test_next_open_day_and_ordinals_past_the_ends(spark):
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in (3, 4, 8)], "day date"))
    ask = spark.createDataFrame([(day(k),) for k in (0, 3, 4, 6, 8, 30)], "t date")
    assert [r.next_day for r in calendars.next_open_day(ask, cal, "t").orderBy("t").collect()] == [day(3), day(4), day(8), day(8), None, None]
    assert [r.o for r in calendars.ordinals_of(ask, cal, "t", "o", up=True).orderBy("t").collect()] == [1, 1, 2, 3, 3, 4]
    assert [r.o for r in calendars.ordinals_of(ask, cal, "t", "o", up=False).orderBy("t").collect()] == [0, 1, 2, 2, 3, 3]


def test_membership_gate_waits_for_the_announcement(spark):
    facts = spark.createDataFrame([("U", "A", day(0), None, day(2), True), ("U", "B", day(0), day(1), day(0), True), ("U", "C", day(0), None, day(0), False)], "universe_id string, symbol string, effective_from date, effective_to date, announced date, usable boolean")
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in range(4)], "day date"))
    assert rows(membership.members_on(facts, cal, cal.select("day"))) == [("U", "A", day(2)), ("U", "A", day(3)), ("U", "B", day(0)), ("U", "B", day(1))]


def test_preflight_takes_the_first_reason_and_skips_proven_closures(spark):
    folds = spark.createDataFrame([("f1", day(0), 800), ("f2", day(0), 100), ("f3", None, 800), ("f4", None, 100)], "fold_id string, first_trading_day date, warmup_session_count long")
    facts = spark.createDataFrame([("f1", True, True, 61, 0, False), ("f2", True, False, 0, 1, False), ("f3", True, True, 61, 0, False), ("f4", True, True, 0, 0, True)], "fold_id string, accepted boolean, universe_covered boolean, factor_history_sessions int, benchmark_missing_days int, closure_proven boolean")
    got = {r.fold_id: (r.code, r.status) for r in research.preflight(folds, facts).collect()}
    assert got == {"f1": (None, "READY"), "f2": ("WARMUP_SESSIONS_SHORT", "FAILED_PREFLIGHT"), "f3": ("CLOSURE_EVIDENCE_MISSING", "FAILED_PREFLIGHT"), "f4": (None, "SKIPPED_NOT_TRADEABLE")}


def test_stability_thresholds_are_strict_where_they_are(spark):
    make = lambda rs: research.stability(spark.createDataFrame([("s", k, r) for k, r in enumerate(rs)], "scenario string, fold_id int, fold_calendar_return double")).first()
    assert make([0.1, 0.1, 0.1, -0.05, -0.05]).conclusion == "STABLE"
    assert make([0.1, 0.1, 0.1, -0.05, -0.10]).conclusion == "UNSTABLE"
    assert make([0.1, 0.1]).conclusion == "INCONCLUSIVE"


def test_duplicates_with_nulls_and_replace_by_null_key(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(merging.collapse_duplicates(df)) == [(1, None, 2), (2, "x", 1)]
    fresh = spark.createDataFrame([(9, None)], "a int, b string")
    assert rows(merging.replace_by_key(df, fresh, ["b"])) == [(2, "x"), (9, None)]


def test_broken_factor_frames_are_found(spark):
    from tessaro.operators.quality import invalid_factor_rows

    df = spark.createDataFrame([(day(0), "A", True, None), (day(0), "A", True, None), (day(0), "B", False, None)], "trade_date date, symbol string, is_valid boolean, invalid_reason string")
    assert {r.fault for r in invalid_factor_rows(df).collect()} == {"repeated", "reason_mismatch"}
    assert F.col("x") is not None


def test_fold_outcomes(spark):
    """Each fault of a fold's equity, a broken ledger, a proven closure, and refusals before anything ran."""
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in range(0, 40, 2)], "day date"))
    names = ["good", "missing", "extra", "twice", "zero", "infinite", "null", "broken", "refused", "closed"]
    folds = spark.createDataFrame([(n, None if n == "closed" else day(4), None if n == "closed" else day(12)) for n in names], "fold_id string, first_trading_day date, last_trading_day date")
    rows = [(n, day(k), 100.0 + k) for n in names if n != "closed" for k in range(4, 14, 2) if not (n in ("missing", "broken") and k == 8)]
    rows += [("extra", day(5), 1.0), ("twice", day(6), 1.0)]
    rows = [(n, d, {"zero": 0.0, "infinite": float("inf"), "null": None}.get(n, v) if d == day(10) else v) for n, d, v in rows]
    equity = spark.createDataFrame(rows, "fold_id string, trade_date date, net_equity_after_cost double")
    faults = {r.fold_id: (r.missing_days, r.extra_days, r.repeated_days, r.bad_values) for r in research.oos_faults(folds, equity, cal).collect()}
    assert faults == {n: (int(n in ("missing", "broken")), int(n == "extra"), int(n == "twice"), int(n in ("zero", "infinite", "null"))) for n in names}
    checked = spark.createDataFrame([(n, "BENCHMARK_GAP" if n == "refused" else None, {"refused": "FAILED_PREFLIGHT", "closed": "SKIPPED_NOT_TRADEABLE"}.get(n, "READY")) for n in names], "fold_id string, code string, status string")
    ledger = spark.createDataFrame([("broken",), ("broken",), ("refused",)], "fold_id string")
    got = {r.fold_id: (r.status, r.reason_code) for r in research.outcomes(checked, ledger, research.oos_faults(folds, equity, cal)).collect()}
    oos = ("FAILED_PREFLIGHT", "OOS_INTEGRITY")
    assert got == {
        "good": ("EXECUTED", None), "missing": oos, "extra": oos, "twice": oos, "zero": oos, "infinite": oos, "null": oos, "broken": ("FAILED_PREFLIGHT", "EXECUTION_INTEGRITY"),
        "refused": ("FAILED_PREFLIGHT", "BENCHMARK_GAP"), "closed": ("SKIPPED_NOT_TRADEABLE", "MARKET_WIDE_CLOSURE"),
    }


def test_empty_books_stay_and_possible_names_are_all_targets(spark):
    signals = spark.createDataFrame([(day(0), day(1)), (day(7), day(8)), (day(14), day(15)), (day(21), None)], "signal_date date, execution_date date")
    targets = spark.createDataFrame([(day(0), "A", 100), (day(0), "B", 200), (day(14), "A", 300), (day(21), "Z", 1)], "trade_date date, symbol string, target_quantity long")
    book = portfolio.target_book(signals, targets)
    assert rows(book) == rows(spark.createDataFrame([(day(1), day(0), "A", 100), (day(1), day(0), "B", 200), (day(8), day(7), None, None), (day(15), day(14), "A", 300)], "a date, b date, c string, d long"))
    assert rows(portfolio.possible_names(book)) == [("A", day(1), 2), ("B", day(1), 1)]


def test_size_exceptions_are_hashed_and_checked(spark):
    import hashlib
    import json

    good = ("csi300", day(0), day(9), 299, 'a "quoted" reason', "v1", "0" * 64)
    bad = [("CSI300", *good[1:]), (*good[:2], day(-1), *good[3:]), (*good[:3], 0, *good[4:]), (*good[:4], " x", *good[5:]), (*good[:5], "", good[6]), (*good[:6], "F" * 64), (*good[:4], "é", *good[5:]), (None,) * 7]
    names = "universe_id string, interval_start date, interval_end date, allowed_size long, reason string, rules_version string, evidence_sha256 string"
    got = membership.size_exceptions(spark.createDataFrame([good, *bad], names)).collect()
    keys = [x.split()[0] for x in names.split(", ")]
    text = json.dumps({k: v.isoformat() if isinstance(v, dt.date) else v for k, v in zip(keys, good, strict=True)}, sort_keys=True, separators=(",", ":"))
    assert got[0].content_hash == hashlib.sha256(text.encode()).hexdigest() and got[0].faults == []
    assert [r.faults for r in got[1:]] == [["universe_id"], ["interval"], ["allowed_size"], ["reason"], ["rules_version"], ["evidence_sha256"], ["not_ascii"], ["universe_id", "interval", "allowed_size", "reason", "rules_version", "evidence_sha256"]]
    other = ("csi300", day(9), day(12), 300, "r", "v1", "1" * 64)
    clash = membership.exception_conflicts(spark.createDataFrame([good, other, ("csi300", day(13), day(14), 1, "r", "v", "2" * 64), bad[0]], names)).collect()
    assert [(r.universe_id, r.first_hash) for r in clash] == [("csi300", got[0].content_hash)]


def test_a_book_of_rules_is_broadcast_and_rows_stay_where_they_are(spark):
    """Rows of one scenario aren't brought into one task, whatever size Spark takes the book for."""
    book = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1), ("a", dt.date(2020, 2, 1), 2)], "k string, since date, rate int")
    rows = spark.range(4000, numPartitions=8).select(F.when(F.col("id") < 3999, "a").otherwise("b").alias("k"), F.date_add(F.lit("2019-12-31"), (F.col("id") % 60).cast("int")).alias("t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = temporal.effective_join(rows, book, "t", "since", ["k"])
        held = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(held) == [500] * 8
    assert {(r.k, r.rate): r["count"] for r in out.groupBy("k", "rate").count().collect()} == {("a", None): 67, ("a", 1): 2077, ("a", 2): 1855, ("b", None): 1}


def test_momentum_windows_are_running_counts(spark):
    rng = random.Random(3)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(k), 50 + rng.random(), rng.choice(["ERROR", "INFO", "INFO", "INFO", "INFO", "INFO", None]), k) for s in "ab" for k in range(60 if s == "a" else 7)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, adjusted_close double, quality_severity string, listed_days long")
    found = factors.momentum_by_bar(bars, lag=4, seasoning=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -4, currentrow$())" not in plan
    for r in found.collect():
        own = [x for x in rows if x[0] == r.symbol]
        k = (r.trade_date - dt.date(2020, 1, 1)).days
        bad = any(x[3] == "ERROR" for x in own[max(k - 4, 0) : k + 1])
        reason = "insufficient_observations" if k < 4 else "quality_error" if bad else "seasoning_below_120" if k < 9 else None
        assert (r.invalid_reason, r.raw_value) == (reason, None if reason else own[k][2] / own[k - 4][2] - 1)


def test_daily_rows_are_brought_together_once(spark):
    from tessaro.sources import layouts

    raw = spark.createDataFrame([("600000.SH", "20200102", "1", *["2"] * 5)] * 3 + [("x", "20200102", "1", *["2"] * 5)], "ts_code string, trade_date string, vol string, open string, high string, low string, close string, amount string")
    c = layouts.daily_bars(raw, "tushare", "2024-01-01")
    both = c.valid.agg(F.sum("volume").alias("n")).unionByName(c.audit.agg(F.count("*").alias("n")))
    assert sorted(r.n for r in both.collect()) == [2, 100]
    both.write.format("noop").mode("overwrite").save()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_fold_metrics_count_orders(spark):
    """Repeated ids are one order; where diffs have one row for each order, their ids aren't shuffled to find that."""
    from tessaro.operators import analytics

    equity = spark.createDataFrame([("a", day(k), 100.0 + k) for k in range(3)], "fold string, trade_date date, equity double")
    fills = spark.createDataFrame([("a", "BUY", 10, D("2.00"), D("2.00"), D("1.00"), D("0.00"))], "fold string, side string, quantity long, price decimal(18,2), reference_price decimal(18,2), commission decimal(18,2), stamp_tax decimal(18,2)")
    diffs = spark.createDataFrame([("a", "1", 10, 0, "FILLED"), ("a", "2", 10, 4, "PARTIAL"), ("a", "3", 10, 10, "REJECTED")], "fold string, order_id string, planned_quantity long, rejected_quantity long, status string")
    counted = analytics.fold_metrics(equity, fills, diffs, ["fold"], 100.0, one_row_an_order=True)
    told_apart = analytics.fold_metrics(equity, fills, diffs, ["fold"], 100.0)
    assert rows(counted) == rows(told_apart) and counted.first().submitted_order_count == 3
    assert analytics.fold_metrics(equity, fills, diffs.unionByName(diffs), ["fold"], 100.0).first().submitted_order_count == 3
    by_id = lambda df: df._jdf.queryExecution().executedPlan().toString().count("order_id")
    assert by_id(told_apart) > by_id(counted)


def test_orders_of_folds_are_not_told_apart_by_a_shuffle(spark):
    from tessaro.plans import performance

    plan = performance.fold_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "order_id" in line]
