"""The account replay against a plain day-by-day replay, and the properties that any replay must keep."""

import datetime as dt
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessaro.functions import money
from tessaro.operators import replay

D = Decimal
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(60)]
OPEN = [d for d in DAYS if d.weekday() < 5]
RATES = {"full_cost": [("2015-01-01", "0.0003", "5", "0.001", "0.001")], "zero_cost": [("2015-01-01", "0", "0", "0", "0")]}


@given(st.integers(1, 3000), st.integers(1, 50_000), st.integers(0, 5_000_000))
@settings(max_examples=300, deadline=None)
def test_affordable_is_the_largest_fitting_step(quantity, cents, cash):
    price, money_ = D(cents) / 100, D(cash) / 100
    rate, least = D("0.0003"), D("5")
    want = next((q for q in range(quantity, 0, -100) if price * q + replay.commission(price * q, rate, least) <= money_), 0)
    assert replay.affordable(quantity, 100, price, money_, rate, least) == want


def market(seed):
    rng = random.Random(seed)
    bars, names = [], [f"S{k}" for k in range(6)]
    for s in names:
        price = 10.0 + rng.random() * 20
        for d in OPEN:
            price = max(1.0, price * (1 + rng.uniform(-0.03, 0.03)))
            if rng.random() < 0.9:
                bars.append((s, d, round(price * (1 + rng.uniform(-0.01, 0.01)), 2), round(price, 2), "ERROR" if rng.random() < 0.03 else "INFO"))
    targets = [(1, s, d, rng.choice([0, 100, 300, 800, 2000])) for d in OPEN[5::5] for s in names if rng.random() < 0.7]
    actions = [(s, OPEN[20], OPEN[18], 0.35, 0.1, 0.05, "implemented", 0.0) for s in names[:2]]
    return bars, targets, actions


def plain_replay(bars, targets, actions, cost, cash):
    """Written from the rules alone: one account, one day after the other."""
    rate, least, tax_rate, slip = (D(x) for x in cost)
    cents = lambda x: x.quantize(D("0.01"), ROUND_HALF_UP)
    by_day, closes, lots, equity, fills = defaultdict(dict), {}, [], [], []
    for s, d, o, c, q in bars:
        by_day[d][s] = (D(str(o)), D(str(c)), q)
    book = defaultdict(dict)
    for _, s, d, q in targets:
        book[d][s] = q
    for k, day in enumerate(OPEN):
        for s, ex, record, per, bonus, cap, _, _ in actions:
            held = sum(x[1] for x in lots if x[0] == s)
            if ex == day and held:
                cash += cents(sum(x[1] for x in lots if x[0] == s and x[2] <= record) * D(str(per)))
                more = int((held * (D(str(bonus)) + D(str(cap)))).to_integral_value(ROUND_HALF_UP))
                if more:
                    lots.append([s, more, day, k + 1])
        orders = []
        if day in book:
            names = sorted(set(book[day]) | {x[0] for x in lots if x[1]})
            for side in ("SELL", "BUY"):
                for s in names:
                    held, free = sum(x[1] for x in lots if x[0] == s), sum(x[1] for x in lots if x[0] == s and x[3] <= k)
                    gap = book[day].get(s, 0) - held
                    q = min(-gap, free) // 100 * 100 if side == "SELL" and gap < 0 else gap // 100 * 100 if side == "BUY" and gap > 0 else 0
                    if q:
                        orders.append((side, s, q))
        for side, s, q in orders:
            bar = by_day[day].get(s)
            if bar is None or s not in closes or bar[2] == "ERROR":
                continue
            price = cents(bar[0] * (1 + slip if side == "BUY" else 1 - slip))
            upper, lower = cents(closes[s] * D("1.10")), cents(closes[s] * D("0.90"))
            if side == "BUY" and price >= upper or side == "SELL" and price <= lower:
                continue
            fee = lambda n: cents(max(price * n * rate, least))
            if side == "SELL":
                left = q
                for x in lots:
                    if x[0] == s and x[3] <= k:
                        take = min(x[1], left)
                        x[1] -= take
                        left -= take
                cash += price * q - fee(q) - cents(price * q * tax_rate)
                fills.append((day, side, s, q, price))
            else:
                while q > 0 and price * q + fee(q) > cash:
                    q -= 100
                if q > 0:
                    cash -= price * q + fee(q)
                    lots.append([s, q, day, k + 1])
                    fills.append((day, side, s, q, price))
        for s, (_, c, q) in by_day[day].items():
            if q != "ERROR":
                closes[s] = c
        equity.append((day, cash, cents(cash + sum(x[1] * closes[x[0]] for x in lots if x[1]))))
    return equity, fills


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_a_plain_one(spark, seed):
    bars, targets, actions = market(seed)
    b = spark.createDataFrame(bars, "symbol string, trade_date date, open double, close double, quality_severity string")
    b = b.withColumn("board", F.lit("sh_main")).withColumn("status", F.lit("NORMAL")).withColumn("listed_sessions", F.lit(None).cast("int"))
    priced = replay.executable_bars(b, money.rates(spark, RATES), money.limit_rules(spark), money.open_session_rules(spark))
    t = spark.createDataFrame(targets, "fold_id int, symbol string, trade_date date, target_quantity long").crossJoin(spark.createDataFrame([(s,) for s in RATES], "scenario string"))
    a = spark.createDataFrame(actions, "symbol string, ex_date date, record_date date, cash double, bonus double, capitalization double, status string, rights double")
    cal = spark.createDataFrame([(d, k + 1) for k, d in enumerate(OPEN)], "day date, ord long")
    w = spark.createDataFrame([(1, s, OPEN[0], OPEN[-1]) for s in RATES], "fold_id int, scenario string, first_day date, last_day date")
    rows = replay.replay(t, priced, a, cal, w, ["fold_id", "scenario"], D("60000.00")).collect()
    for name, steps in RATES.items():
        own = [r for r in rows if r.scenario == name]
        equity, fills = plain_replay(bars, targets, actions, steps[0][1:], D("60000.00"))
        assert [(r.trade_date, r.cash, r.total_equity) for r in sorted((r for r in own if r.ledger == "equity"), key=lambda r: r.seq)] == equity
        assert [(r.trade_date, r.side, r.symbol, r.quantity, r.price) for r in sorted((r for r in own if r.ledger == "fill"), key=lambda r: r.seq)] == fills
        orders = {r.order_id: r.quantity for r in own if r.ledger == "order"}
        done = defaultdict(int)
        for r in own:
            if r.ledger == "fill":
                done[r.order_id] += r.quantity
            if r.ledger == "rejection":
                done[r.order_id] += r.quantity - r.filled_quantity
        assert done == orders
        assert any(r.ledger == "action" for r in own)


def test_lots_of_today_cannot_be_sold():
    a = replay.Account(D("10000"), {OPEN[0]: OPEN[1]})
    a.buy("S", OPEN[0], 100, D("1000"))
    assert a.sellable("S", OPEN[0]) == 0 and a.sellable("S", OPEN[1]) == 100
    with pytest.raises(ValueError):
        a.sell("S", OPEN[0], 100, D("1000"))
    with pytest.raises(ValueError):
        a.buy("S", OPEN[1], 100, D("9000.01"))


def test_an_ex_date_conserves_equity_and_books_once():
    a = replay.Account(D("0"), {OPEN[0]: OPEN[1]})
    a.lots["S"].append(replay.Lot(OPEN[0], 1000, D("10000"), OPEN[1]))
    before = 1000 * D("11.00")
    assert a.distribute("S", OPEN[3], OPEN[2], D("0.50"), D("0.05")) == (D("500.00"), 50)
    after = a.cash + a.held("S") * (D("11.00") - D("0.50")) / D("1.05")
    assert abs(after - before) < D("0.01")
    assert a.distribute("S", OPEN[3], OPEN[2], D("0.50"), D("0.05")) is None


def test_weight_orders_follow_the_band_the_lots_and_the_day(spark):
    a = replay.Account(D("50000"), {OPEN[0]: OPEN[1], OPEN[1]: OPEN[2]})
    lot = lambda s, n, k: a.lots[s].append(replay.Lot(OPEN[k], n, D("0"), OPEN[k + 1]))
    lot("KEEP", 1000, 0)  # 10,000 of 100,000
    lot("EXIT", 2000, 0)
    lot("LOCKED", 2000, 1)  # bought today: can't be sold yet
    book = {
        "KEEP": (D("0.119"), D("10"), True),  # 0.019 off: within the band
        "EXIT": (D("0"), D("10"), False),
        "LOCKED": (D("0"), D("10"), False),
        "NEW": (D("0.15"), D("7"), False),  # 15,000 / 7 = 2,142 shares: 21 lots
        "TINY": (D("0.0005"), D("10"), False),  # 5 shares: no lot
    }
    orders, decisions = replay.plan_weights(book, a, OPEN[1], 100, D("0.02"))
    assert orders == [("SELL", "EXIT", 2000), ("BUY", "NEW", 2100)]
    assert {s: why for s, _, _, _, why in decisions} == {"KEEP": "within_rebalance_band", "EXIT": "exiting_position", "LOCKED": "exiting_position", "NEW": "entering_position", "TINY": "at_target"}
    book["KEEP"] = (D("0.12"), D("10"), True)  # exactly the band trades
    assert ("BUY", "KEEP", 200) in replay.plan_weights(book, a, OPEN[1], 100, D("0.02"))[0]


def test_a_weight_replay_moves_to_its_weights(spark):
    bars = [(s, d, 10.0, 10.0, "INFO") for s in ("A", "B") for d in OPEN[:6]]
    b = spark.createDataFrame(bars, "symbol string, trade_date date, open double, close double, quality_severity string")
    b = b.withColumn("board", F.lit("sh_main")).withColumn("status", F.lit("NORMAL")).withColumn("listed_sessions", F.lit(None).cast("int"))
    rates = {"zero_cost": RATES["zero_cost"]}
    priced = replay.executable_bars(b, money.rates(spark, rates), money.limit_rules(spark), money.open_session_rules(spark))
    rows = [(1, "zero_cost", OPEN[1], "A", D("0.6"), D("10"), False), (1, "zero_cost", OPEN[1], "B", D("0.3"), D("10"), False), (1, "zero_cost", OPEN[3], "A", D("0.3"), D("10"), True), (1, "zero_cost", OPEN[3], "B", D("0.31"), D("10"), True)]
    t = spark.createDataFrame(rows, "fold_id int, scenario string, trade_date date, symbol string, target_weight decimal(18,12), signal_price decimal(18,6), continuing boolean")
    none = spark.createDataFrame([], "symbol string, ex_date date, record_date date, cash double, bonus double, capitalization double, status string, rights double")
    cal = spark.createDataFrame([(d, k + 1) for k, d in enumerate(OPEN)], "day date, ord long")
    w = spark.createDataFrame([(1, "zero_cost", OPEN[0], OPEN[5])], "fold_id int, scenario string, first_day date, last_day date")
    got = replay.replay(t, priced, none, cal, w, ["fold_id", "scenario"], D("100000.00")).collect()
    fills = [(r.trade_date, r.side, r.symbol, r.quantity) for r in sorted((r for r in got if r.ledger == "fill"), key=lambda r: r.seq)]
    assert fills == [(OPEN[1], "BUY", "A", 6000), (OPEN[1], "BUY", "B", 3000), (OPEN[3], "SELL", "A", 3000)]
    held = {(r.trade_date, r.symbol): r.reason for r in got if r.ledger == "decision"}
    assert held[OPEN[3], "B"] == "within_rebalance_band" and held[OPEN[3], "A"] == "rebalance_outside_band"
    assert all(r.total_equity == D("100000.00") for r in got if r.ledger == "equity")
