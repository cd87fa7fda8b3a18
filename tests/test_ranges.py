"""Scans in ranges, interval bins and risk windows against plain versions."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessaro.operators import calendars, membership, merging, portfolio, ranges, temporal

day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)


def hot_rows():
    """Nine tenths of the rows have one key; one key is null."""
    rng = random.Random(4)
    keys = ["hot"] * 900 + [rng.choice(["a", "b", None]) for _ in range(100)]
    rng.shuffle(keys)
    return [(k, i, rng.choice([None, *range(-5, 6)])) for i, k in enumerate(keys)]


@pytest.mark.parametrize("n", [1, 3, 16])
def test_prefix_sums_of_a_hot_key(spark, n):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(4)
    got = {r.i: r.s for r in ranges.prefix_sums(df, ["k"], ["i"], "v", "s", n).collect()}
    sums, want = {}, {}
    for k, i, v in rows:
        if v is not None:
            sums[k] = sums.get(k, 0) + v
        want[i] = sums.get(k)
    assert got == want
    placed = ranges.in_ranges(df, ["k", "i"], n)
    largest = placed.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest <= (1000 if n == 1 else 3 * 1000 // n)


@pytest.mark.parametrize("n", [1, 7])
def test_last_values_of_a_hot_key(spark, n):
    rows = hot_rows()
    got = {r.i: r.s for r in ranges.last_so_far(spark.createDataFrame(rows, "k string, i int, v long").repartition(4), ["k"], ["i"], "v", "s", n).collect()}
    last, want = {}, {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want


def test_exact_quantiles_with_ties_and_a_hot_group(spark):
    rows = [(k, None if v is None else float(v)) for k, _, v in hot_rows()] + [("one", 7.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    asked = {"low": 0.0, "median": 0.5, "p90": 0.9, "p99": 0.99, "high": 1.0}
    got = {r.k: [r[q] for q in asked] for r in ranges.exact_quantiles(df, ["k"], "v", asked, 5).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        at = [q * (len(values) - 1) for q in asked.values()]
        want[k] = [values[int(x)] + (values[min(int(x) + 1, len(values) - 1)] - values[int(x)]) * (x - int(x)) for x in at]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    built_in = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in asked.values()])).alias("q")).collect()}
    assert all(got[k] == pytest.approx(built_in[k]) for k in want)


def test_asof_join_of_heavy_keys_gives_the_same_rows(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(60), rng.random()) for _ in range(150)]
    a = spark.createDataFrame(left, "id int, k string, t int")
    b = spark.createDataFrame(right, "k string, u int, v double")
    for strict in (False, True):
        plain = temporal.asof_join(a, b, "t", "u", ["k"], ["v"], strict=strict)
        split = temporal.asof_join(a, b, "t", "u", ["k"], ["v"], strict=strict, heavy=50)
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
        assert split.count() == len(left)


def test_cash_of_one_hot_scenario(spark):
    fills = [("s", day(k % 5), f"{k:04}", (k * 37 % 11) - 5) for k in range(500)] + [("t", day(1), "0001", 7)]
    f = spark.createDataFrame(fills, "scenario string, trade_date date, seq string, x int").withColumn("cash_delta", F.col("x").cast("decimal(18,2)"))
    a = spark.createDataFrame([("s", day(2), "d", 100)], "scenario string, ex_date date, seq string, x int").withColumn("cash_credited", F.col("x").cast("decimal(18,2)"))
    got = {(r.scenario, r.day, r.kind, r.seq): float(r.cash) for r in merging.cash_ledger(f, a, 1000.0, ["scenario"]).collect()}
    events = sorted([(s, d, 1, q, x) for s, d, q, x in fills] + [("s", day(2), 0, "d", 100)])
    cash, want = {"s": 1000.0, "t": 1000.0}, {}
    for s, d, kind, q, x in events:
        cash[s] += x
        want[s, d, kind, q] = cash[s]
    assert got == want


def test_bins_make_up_their_span(spark):
    spans = [(a, b) for a in range(1, 40) for b in range(a, 40, 3)] + [(1, 100_000), (77, 2**20)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", membership.bins_of_span(F.col("a"), F.col("b")).alias("bins")).collect()
    for r in got:
        covered = sorted((x.number << x.level, (x.number + 1) << x.level) for x in r.bins)
        assert covered[0][0] == r.a and covered[-1][1] == r.b + 1
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
        assert len(covered) <= 2 * (r.b - r.a + 1).bit_length()


def test_members_by_bins_and_by_days(spark):
    rng = random.Random(9)
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in range(0, 90, 2)], "day date"))
    facts = []
    for i in range(60):
        start = rng.randrange(-10, 90)
        facts.append((f"U{i % 2}", f"C{i % 17}", day(start), rng.choice([None, day(start + rng.randrange(-3, 40))]), day(start + rng.choice([-5, 4])), rng.random() < 0.9))
    df = spark.createDataFrame(facts, "universe_id string, symbol string, effective_from date, effective_to date, announced date, usable boolean")
    open_days = [day(k) for k in range(0, 90, 2)]
    want = {(u, s, d) for u, s, a, b, k, ok in facts for d in open_days if ok and a <= d and (b is None or d <= b) and k <= d}
    assert {tuple(r) for r in membership.members_on(df, cal, cal.select("day")).collect()} == want
    counts = {(r.universe_id, r.day): r.n_members for r in membership.member_counts(df, cal).collect()}
    assert counts == {(u, d): len({s for x, s, y in want if (x, y) == (u, d)}) for u, _, d in want}
    history = {(r.universe_id, r.symbol): (r.n_days, r.first_day, r.last_day) for r in membership.member_history(df, cal).collect()}
    by = {}
    for u, s, d in want:
        by.setdefault((u, s), []).append(d)
    assert history == {k: (len(v), min(v), max(v)) for k, v in by.items()}


def plain_risk(rows, signal, sessions=60, least=40, floor=0.10):
    """The window's days one after the other: rows by ordinal are (close, severity, reason)."""
    closes, carried, returns, previous = 0, 0, [], None
    bad = (0, 0, "untrusted_missing_observation", None)
    for k in range(max(1, signal - sessions + 1), signal + 1):
        if k not in rows:
            return bad
        close, severity, reason = rows[k]
        there = close is not None and 0 < close < float("inf")
        if reason is None:
            if severity == "ERROR" or not there:
                return bad
            if previous is not None:
                returns.append(close / previous - 1)
            previous = close
            closes += 1
        else:
            if reason != "suspended_verified" or not there or previous is None:
                return bad
            returns.append(0.0)
            carried += 1
    if closes < least or len(returns) < 2:
        return (closes, carried, "insufficient_real_close_observations", None)
    return (closes, carried, None, max(statistics.stdev(returns) * 252**0.5, floor))


def test_risk_windows(spark):
    rng = random.Random(1)
    n = 200
    price = lambda k: 100 + 8 * rng.random() + k / 50
    names = {}
    for name in ("plain", "tiny_start", "starts_suspended", "bad_carry", "unknown_gap", "errors", "gaps", "many_suspended", "late", "infinite"):
        names[name] = {k: (price(k), "INFO", None) for k in range(1, n + 1)}
    for k in range(1, 6):  # later windows don't hold these closes
        names["tiny_start"][k] = (1e-6, "INFO", None)
    for k in (30, 31, 90, 150):
        names["starts_suspended"][k] = (names["starts_suspended"][k - 1][0], "INFO", "suspended_verified")
    names["bad_carry"] |= {40: (None, "INFO", "suspended_verified"), 120: (0.0, "INFO", "suspended_verified"), 180: (float("nan"), "INFO", "suspended_verified")}
    names["unknown_gap"][50] = (100.0, "INFO", "unknown_gap")
    names["errors"] |= {33: (100.0, "ERROR", None), 170: (-1.0, "INFO", None)}
    del names["gaps"][100], names["gaps"][101]
    for k in range(70, 95):
        names["many_suspended"][k] = (names["many_suspended"][69][0], "INFO", "suspended_verified")
    names["late"] = {k: v for k, v in names["late"].items() if k > 130}
    names["infinite"][60] = (float("inf"), "INFO", None)
    bars = spark.createDataFrame([(s, day(k), *v) for s, own in names.items() for k, v in own.items()], "symbol string, trade_date date, close double, quality_severity string, missing_reason string")
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in range(1, n + 1)], "day date"))
    asked = [(s, day(k)) for s in [*names, "nowhere"] for k in (1, 2, 39, 40, 41, 59, 60, 61, 62, 89, 90, 91, 118, 119, 120, 121, 149, 150, 177, 178, 179, 180, 190, 200)]
    got = portfolio.risk_path(bars.repartition(3), cal, spark.createDataFrame(asked, "symbol string, trade_date date")).collect()
    assert len(got) == len(asked)
    for r in got:
        closes, carried, reason, vol = plain_risk(names.get(r.symbol, {}), (r.trade_date - day(0)).days)
        assert (r.real_close_observations, r.suspension_carry_days, r.risk_invalid_reason, r.risk_is_valid) == (closes, carried, reason, reason is None), (r, reason)
        assert r.applied_annualized_volatility == (None if vol is None else pytest.approx(vol, rel=1e-9)), r


def test_risk_windows_sort_names_twice(spark):
    bars = spark.createDataFrame([], "symbol string, trade_date date, close double, quality_severity string, missing_reason string")
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in range(1, 9)], "day date"))
    plan = portfolio.risk_path(bars, cal, bars.select("symbol", "trade_date"), tasks=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [symbol") == 2 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(symbol") == plan.count("REPARTITION_BY_NUM") == 2


def test_absent_days_stand_between_rows(spark):
    cal = calendars.with_ordinals(spark.createDataFrame([(day(k),) for k in (2, 3, 4, 6, 8, 9)], "day date"))
    rows = [("a", day(3), 1.0), ("a", day(5), 2.0), ("a", day(8), 3.0), ("b", day(1), 4.0), ("b", day(10), 5.0), ("c", day(4), 6.0)]
    rows = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    found = calendars.with_absent_days(rows, cal, F.col("symbol") != "c").collect()
    got = sorted((r.symbol, (r.trade_date - day(0)).days, r.close, r.absent) for r in found)
    a = [("a", 2, None, True), ("a", 3, 1.0, False), ("a", 4, 1.0, True), ("a", 5, 2.0, False), ("a", 6, 2.0, True), ("a", 8, 3.0, False), ("a", 9, 3.0, True)]
    b = [("b", 1, 4.0, False), *[("b", k, 4.0, True) for k in (2, 3, 4, 6, 8, 9)], ("b", 10, 5.0, False)]
    assert got == a + b + [("c", 4, 6.0, False)]
