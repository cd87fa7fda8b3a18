"""Explanatory diagnostics: information coefficients, quantile returns, concentration, beta, participation, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.analytics import fill_totals, worth
from tessaro.operators.factors import average_rank, bucket
from tessaro.operators.lineage import settled
from tessaro.operators.ranges import exact_quantiles
from tessaro.operators.temporal import asof_join

#: Rows of a symbol from which an as-of join scans it in ranges.
HEAVY = 1 << 20


def information_coefficients(scored: DataFrame, by: list[str] | None = None, least: int = 8) -> DataFrame:
    """Spearman correlation of value and forward return on each date (and further ``by`` columns): Pearson over mean ranks.

    scored: trade_date, symbol, value, forward_return. Groups with fewer than ``least`` names or without spread have a null ic.
    """
    key = ["trade_date", *(by or [])]
    r = scored.filter("value IS NOT NULL AND forward_return IS NOT NULL")
    r = r.withColumn("_a", average_rank(key, "value")).withColumn("_b", average_rank(key, "forward_return"))
    g = r.groupBy(*key).agg(F.count("*").alias("n"), F.stddev_samp("_a").alias("_sa"), F.stddev_samp("_b").alias("_sb"), F.covar_samp("_a", "_b").alias("_c"))
    ic = F.when((F.col("n") >= least) & (F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_c") / F.col("_sa") / F.col("_sb"))
    return g.select(*key, "n", ic.alias("ic"))


def ic_summary(daily: DataFrame, by: list[str], least_dates: int = 0) -> DataFrame:
    """Mean, spread and share of positive coefficients by year. A coefficient within 1e-12 of zero, which is what the rounding
    of a correlation of zero leaves, isn't positive."""
    g = daily.groupBy(F.year("trade_date").alias("year"), *by).agg(
        F.count("*").alias("n_dates"),
        F.count("ic").alias("n_ic"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        F.avg((F.round("ic", 12) > 0).cast("double")).alias("ic_positive_rate"),
    )
    return g.filter(F.col("n_ic") >= least_dates).withColumn("ic_ir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")))


def quantile_returns(scored: DataFrame, n: int = 5, least: int = 10) -> DataFrame:
    """Mean forward return of each value bucket by date, then by year, with the spread of last over first in basis points."""
    r = scored.filter("value IS NOT NULL AND forward_return IS NOT NULL")
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy("trade_date"))).filter(F.col("_n") >= least).withColumn("bucket", bucket(["trade_date"], "value", n))
    daily = r.groupBy("trade_date", "bucket").agg(F.avg("forward_return").alias("m"))
    yearly = daily.groupBy(F.year("trade_date").alias("year")).pivot("bucket", list(range(1, n + 1))).agg(F.avg("m"))
    named = yearly.select("year", *[F.col(str(k)).alias(f"q{k}") for k in range(1, n + 1)])
    return named.withColumn("long_short_bp", (F.col(f"q{n}") - F.col("q1")) * 1e4)


def concentration(positions: DataFrame) -> DataFrame:
    """By date: positions, gross weight, Herfindahl index of shares, share of the three largest, effective number.

    positions: trade_date, symbol, target_weight.
    """
    w = Window.partitionBy("trade_date").orderBy(F.col("target_weight").desc(), "symbol")
    g = positions.withColumn("_k", F.row_number().over(w)).groupBy("trade_date").agg(
        F.count("*").alias("n_positions"),
        F.sum("target_weight").alias("gross_weight"),
        F.sum(F.col("target_weight") * F.col("target_weight")).alias("_s2"),
        F.sum(F.when(F.col("_k") <= 3, F.col("target_weight"))).alias("_top"),
    )
    ok = F.col("gross_weight") > 0
    g = g.withColumn("hhi", F.when(ok, F.col("_s2") / (F.col("gross_weight") * F.col("gross_weight"))))
    return g.withColumn("top3_share", F.when(ok, F.col("_top") / F.col("gross_weight"))).withColumn("effective_n", F.when(F.col("hhi") > 0, 1 / F.col("hhi"))).drop("_s2", "_top")


def concentration_by_year(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("trade_date").alias("year")).agg(
        F.count("*").alias("n_rebalances"), F.avg("n_positions").alias("mean_n_positions"), F.avg("hhi").alias("mean_hhi"), F.max("hhi").alias("max_hhi"),
        F.avg("top3_share").alias("mean_top3_share"), F.avg("effective_n").alias("mean_effective_n"), F.avg("gross_weight").alias("mean_gross_weight"),
    )


def category_share(positions: DataFrame, category: str) -> DataFrame:
    """Mean share of each category in the gross weight, by year."""
    d = positions.groupBy("trade_date", category).agg(F.sum("target_weight").alias("w"))
    d = d.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("trade_date")))
    return d.groupBy(F.year("trade_date").alias("year"), category).agg(F.avg("share").alias("share"))


def style_tilt(positions: DataFrame, pool: DataFrame, styles: list[str]) -> DataFrame:
    """Mean percentile of the chosen names within the pool of their date, for each style, by year."""
    for s in styles:
        there = F.col(s).isNotNull()
        n = F.count(s).over(Window.partitionBy("trade_date"))
        pool = pool.withColumn(f"_{s}", there).withColumn(f"{s}_pct", F.when(there, average_rank(["trade_date", f"_{s}"], s) / n))
    j = pool.join(positions.select("trade_date", "symbol").distinct(), ["trade_date", "symbol"])
    daily = j.groupBy("trade_date").agg(*[F.avg(f"{s}_pct").alias(f"{s}_pct") for s in styles])
    return daily.groupBy(F.year("trade_date").alias("year")).agg(*[F.avg(f"{s}_pct").alias(f"{s}_pct") for s in styles])


def beta_by_year(returns: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """returns: by, trade_date, r; benchmark: trade_date, b."""
    j = returns.join(benchmark, "trade_date").filter("r IS NOT NULL AND b IS NOT NULL")
    var, sd = F.var_samp("b"), F.stddev_samp("r")
    c = F.covar_samp("r", "b")
    return j.groupBy(*by, F.year("trade_date").alias("year")).agg(
        F.count("*").alias("n"), F.when(var > 0, c / var).alias("beta"), F.when((var > 0) & (sd > 0), c / sd / F.sqrt(var)).alias("corr")
    )


def participation(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """How much of a name's daily amount the fills took, by year: exact quantiles (by running counts, not in one task a year) and
    counts over 1 and 5 percent."""
    j = fills.join(bars.select("trade_date", "symbol", "amount").filter("amount > 0"), ["trade_date", "symbol"])
    j = settled(j.select(F.year("trade_date").alias("year"), (worth().cast("double") / F.col("amount")).alias("p")))
    g = j.groupBy("year").agg(F.count("*").alias("n_fills"), F.max("p").alias("max"), F.count_if(F.col("p") > 0.01).alias("over_1pct"), F.count_if(F.col("p") > 0.05).alias("over_5pct"))
    return g.join(exact_quantiles(j, ["year"], "p", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), "year", "left").select("year", "n_fills", "p50", "p90", "p99", "max", "over_1pct", "over_5pct")


def rejection_pressure(rejections: DataFrame, bars: DataFrame, ahead: int = 5) -> DataFrame:
    """What the move of the next bars (up to ``ahead``, as far as there are any) cost the rejected orders, by year and reason."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    later = F.last("close").over(w.rowsBetween(1, ahead))
    b = bars.select("symbol", "trade_date", "close", later.alias("later")).filter("later IS NOT NULL")
    j = rejections.join(b, ["symbol", "trade_date"])
    r = F.col("later") / F.col("close") - 1
    notional = F.col("rejected_quantity") * F.col("close")
    j = j.withColumn("notional", notional).withColumn("adverse_cost", F.when(F.col("side") == "BUY", r).otherwise(-r) * notional)
    return j.groupBy(F.year("trade_date").alias("year"), "reason").agg(F.count("*").alias("n"), F.sum("notional").alias("notional"), F.sum("adverse_cost").alias("adverse_cost"))


def cost_attribution(equity: DataFrame, fills: DataFrame, scenarios: list[str]) -> DataFrame:
    """By year: the return of each scenario's curve and what fees and slippage took.

    equity: scenario, trade_date, equity; fills: trade_date, side, quantity, price, reference_price, commission, stamp_tax.
    """
    first, last = F.min_by("equity", "trade_date"), F.max_by("equity", "trade_date")
    curve = equity.groupBy(F.year("trade_date").alias("year")).pivot("scenario", scenarios).agg((last / first - 1).alias("return"), last.alias("end"), F.count("equity").alias("n_days"))
    paid = fill_totals(fills.withColumn("year", F.year("trade_date")), ["year"])
    signed = (F.col("price") - F.col("reference_price")).cast("decimal(18,2)") * F.col("quantity").cast("decimal(12,0)") * F.when(F.col("side") == "BUY", 1).otherwise(-1)
    slip = fills.groupBy(F.year("trade_date").alias("year")).agg(F.sum(signed).cast("double").alias("slippage_paid"))
    out = curve.join(paid, "year", "left").join(slip, "year", "left").na.fill(0, ["total_commission", "total_stamp_tax", "buy_notional", "sell_notional", "slippage_paid"])
    one, two = scenarios[0], scenarios[-1]
    return out.select(
        "year", *[F.col(f"{s}_return").alias(f"return_{s}") for s in scenarios], F.col(f"{one}_n_days").alias("n_days"), F.col("total_commission").alias("commission"), F.col("total_stamp_tax").alias("stamp_tax"),
        (F.col("buy_notional") + F.col("sell_notional")).alias("traded_notional"), "slippage_paid", (F.col(f"{one}_end") - F.col(f"{two}_end")).alias("equity_delta"),
    )


def execution_summary(diffs: DataFrame, fills: DataFrame, closes: DataFrame, by: list[str], heavy: int = HEAVY) -> DataFrame:
    """Planned, actual and unfilled notional at the signal day's close (or the last before it), and counts by status. A symbol with
    more than ``heavy`` orders and closes is priced in ranges.

    diffs: by, order_id, symbol, signal_date, planned_quantity, filled_quantity, status.
    """
    priced = asof_join(diffs, closes.filter("close > 0"), "signal_date", "trade_date", ["symbol"], ["close"], heavy=heavy)
    c = F.col("close").cast("decimal(18,2)")
    g = priced.groupBy(*by).agg(
        F.sum(c * F.col("planned_quantity").cast("decimal(12,0)")).cast("double").alias("planned_gross_notional"),
        F.sum(c * (F.col("planned_quantity") - F.col("filled_quantity")).cast("decimal(12,0)")).cast("double").alias("unfilled_notional"),
        F.count("*").alias("planned_order_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_order_count") for s in ("FILLED", "PARTIAL", "REJECTED")],
        F.count_if(F.col("close").isNull()).alias("unpriced_order_count"),
    )
    a = fills.groupBy(*by).agg(F.sum(worth()).cast("double").alias("actual_gross_notional"))
    out = g.join(a, by, "left").na.fill(0, ["actual_gross_notional"])
    return out.withColumn("execution_deviation_ratio", F.when(F.col("planned_gross_notional") > 0, F.round(F.col("unfilled_notional") / F.col("planned_gross_notional"), 6)).otherwise(0.0))


def order_outcomes(diffs: DataFrame, by: list[str]) -> DataFrame:
    """How many orders ended in each status, for each reason."""
    return diffs.groupBy(*by, "status", "reason").agg(F.count("*").alias("n_orders"), F.sum("planned_quantity").alias("planned"), F.sum("rejected_quantity").alias("rejected"))


def construction_summary(audit: DataFrame, by: list[str]) -> DataFrame:
    """Member statuses of a construction audit and its mean cash, a constant of each signal date."""
    cash = audit.groupBy(*by, "signal_date").agg(F.max("cash_weight").alias("cash")).groupBy(*by).agg(F.count("*").alias("n_signals"), F.avg("cash").alias("mean_cash_weight"))
    statuses = ("retained", "entered", "exited", "risk_invalid", "not_selected")
    n = audit.groupBy(*by).agg(*[F.count_if(F.col("member_status") == s).alias(f"n_{s}") for s in statuses])
    return cash.join(n, by)


def suppressed_amounts(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Weight differences that the band or the lot size left alone, in money: sum of |difference| x equity by reason."""
    held = decisions.filter(F.col("reason").isin("within_rebalance_band", "below_one_lot"))
    return held.groupBy(*by, "reason").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("target_weight") - F.col("current_weight")) * F.col("equity")).alias("suppressed_amount"))
