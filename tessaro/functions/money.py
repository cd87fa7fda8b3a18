"""Exact money: cents rounded half up, dated cost rates, price limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.operators.temporal import effective_join

# Cost scenarios as (effective from, commission rate, least commission, stamp tax on sells, slippage).
SCENARIOS = {
    "zero_cost": [("2015-01-01", "0", "0", "0", "0")],
    "commission_tax": [("2015-01-01", "0.0003", "5", "0.001", "0"), ("2023-08-28", "0.0003", "5", "0.0005", "0")],
    "full_cost": [("2015-01-01", "0.0003", "5", "0.001", "0.001"), ("2023-08-28", "0.0003", "5", "0.0005", "0.001")],
}
RATES_SCHEMA = "scenario string, effective_from date, commission_rate decimal(9,6), minimum_commission decimal(9,2), stamp_tax_rate decimal(9,6), slippage_rate decimal(9,6)"

# Daily price limits as (boards, statuses, effective from, rate), and first sessions without a limit.
PRICE_LIMITS = [
    (("sh_main", "sz_main"), ("NORMAL",), "1996-12-16", "0.10"),
    (("sh_main", "sz_main"), ("ST", "*ST"), "1998-04-27", "0.05"),
    (("chinext",), ("NORMAL",), "2009-10-30", "0.10"),
    (("chinext",), ("NORMAL",), "2020-08-24", "0.20"),
    (("star",), ("NORMAL",), "2019-07-22", "0.20"),
]
NO_LIMIT_SESSIONS = [(("star",), "2019-07-22", 5), (("chinext",), "2020-08-24", 5), (("sh_main", "sz_main"), "2023-04-10", 5)]


def rates(spark: SparkSession, scenarios: dict | None = None, shift_from: str | None = None) -> DataFrame:
    """The dated rates of all scenarios; shift_from puts the first rate of each scenario at an earlier day."""
    import datetime as dt
    from decimal import Decimal

    rows = []
    for name, steps in (scenarios or SCENARIOS).items():
        for k, (start, *figures) in enumerate(steps):
            rows.append((name, dt.date.fromisoformat(shift_from if shift_from and k == 0 else start), *map(Decimal, figures)))
    return spark.createDataFrame(rows, RATES_SCHEMA)


def limit_rules(spark: SparkSession, rules: list | None = None) -> DataFrame:
    import datetime as dt
    from decimal import Decimal

    rows = [(b, s, dt.date.fromisoformat(day), Decimal(rate)) for boards, states, day, rate in rules or PRICE_LIMITS for b in boards for s in states]
    return spark.createDataFrame(rows, "board string, status string, effective_from date, limit_rate decimal(5,2)")


def open_session_rules(spark: SparkSession, rules: list | None = None) -> DataFrame:
    import datetime as dt

    rows = [(b, dt.date.fromisoformat(day), n) for boards, day, n in rules or NO_LIMIT_SESSIONS for b in boards]
    return spark.createDataFrame(rows, "board string, effective_from date, open_sessions int")


def cent(value: Column) -> Column:
    """Half up to the cent: round() of a decimal rounds half up, unlike round() of a double."""
    return F.round(value, 2).cast("decimal(18,2)")


def fill_price(side: Column, raw: Column, slippage: Column) -> Column:
    return cent(raw.cast("decimal(18,6)") * F.when(side == "BUY", 1 + slippage).otherwise(1 - slippage).cast("decimal(9,6)"))


def quote(orders: DataFrame, dated_rates: DataFrame, on: str = "trade_date") -> DataFrame:
    """orders (side, quantity, raw_price, scenario, day) with price, gross, commission and stamp tax of the rate in force.

    The rate in force is the latest one that began by the day; an order before all rates has null fees.
    """
    keyed = effective_join(orders, dated_rates, on, "effective_from", ["scenario"])
    price = fill_price(F.col("side"), F.col("raw_price"), F.col("slippage_rate"))
    gross = (F.col("price") * F.col("quantity").cast("decimal(12,0)")).cast("decimal(28,2)")
    fee = F.greatest((F.col("gross").cast("decimal(22,2)") * F.col("commission_rate")).cast("decimal(30,8)"), F.col("minimum_commission").cast("decimal(30,8)"))
    tax = F.when(F.col("side") == "SELL", cent(F.col("gross").cast("decimal(22,2)") * F.col("stamp_tax_rate"))).otherwise(F.lit(0).cast("decimal(18,2)"))
    return keyed.withColumn("price", price).withColumn("gross", gross).withColumn("commission", cent(fee)).withColumn("stamp_tax", tax)


def price_limits(rows: DataFrame, rules: DataFrame, open_sessions: DataFrame, on: str = "trade_date") -> DataFrame:
    """rows (board, status, day, pre_close, listed_sessions or null) with lower, upper (null in open sessions), covered.

    The rate is the latest in force for board and status; without one, covered is false and the order must be blocked.
    Within the first sessions of a listing under an open regime there is no limit. Limits round half up to the tick.
    """
    dated = effective_join(rows, rules, on, "effective_from", ["board", "status"])
    dated = effective_join(dated, open_sessions, on, "effective_from", ["board"])
    free = F.coalesce(F.col("listed_sessions") <= F.coalesce("open_sessions", F.lit(0)), F.lit(False))
    ref = F.col("pre_close").cast("decimal(18,6)")
    bound = lambda sign: F.when(~F.col("no_limit"), cent(ref * (1 + sign * F.col("limit_rate")).cast("decimal(5,2)")))
    return (
        dated.withColumn("no_limit", free)
        .withColumn("covered", free | F.col("limit_rate").isNotNull())
        .withColumn("upper", bound(1))
        .withColumn("lower", bound(-1))
        .drop("limit_rate", "open_sessions")
    )


def block_reason(side: Column, price: Column) -> Column:
    """Why an order at this (slippage-adjusted) price is refused; null where it may trade."""
    return (
        F.when(~F.col("covered"), "uncovered_rule")
        .when((side == "BUY") & (price >= F.col("upper")), "buy_at_upper_limit")
        .when((side == "SELL") & (price <= F.col("lower")), "sell_at_lower_limit")
    )
