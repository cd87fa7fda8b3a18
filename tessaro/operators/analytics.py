"""Performance metrics over ledgers: window, fold and out-of-sample forms. Groups of any number run at once.

Two conventions live side by side on purpose: window metrics annualise over n - 1 steps and are 0 where undefined; fold and
out-of-sample metrics annualise over N observations and are null where undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252.0


def daily_returns(equity: DataFrame, by: list[str], initial: float | None = None, value: str = "equity") -> DataFrame:
    """equity over that of the day before, less one; the first day is against ``initial`` (null: against itself)."""
    w = Window.partitionBy(*by).orderBy("trade_date")
    first = F.col(value) if initial is None else F.lit(float(initial))
    return equity.withColumn("daily_return", F.col(value) / F.coalesce(F.lag(value).over(w), first) - 1)


def return_faults(equity: DataFrame, expected: DataFrame, by: list[str], value: str = "equity") -> DataFrame:
    """Each expected day must have one finite positive mark, and no other day may: what breaks that, by day."""
    have = equity.groupBy(*by, "trade_date").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    want = equity.select(*by).distinct().crossJoin(F.broadcast(expected.select("trade_date").distinct())).withColumn("wanted", F.lit(True))
    j = have.join(want, [*by, "trade_date"], "full")
    finite = (F.col("lo") > 0) & (F.col("hi") < F.lit(float("inf"))) & ~F.isnan("hi")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "repeated").when(~F.coalesce(finite, F.lit(False)), "not_positive")
    return j.select(*by, "trade_date", fault.alias("fault")).filter("fault IS NOT NULL")


def drawdowns(equity: DataFrame, by: list[str], value: str = "equity") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.max(value).over(w)
    return equity.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, F.col(value) / F.col("peak") - 1).otherwise(0.0))


def worth() -> Column:
    return F.col("price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(12,0)")


def slippage() -> Column:
    """What a fill lost against its reference price; gains count zero, and a missing reference is the price itself."""
    gap = F.col("price").cast("decimal(18,2)") - F.coalesce(F.col("reference_price"), F.col("price")).cast("decimal(18,2)")
    return F.greatest(F.when(F.col("side") == "BUY", gap).otherwise(-gap) * F.col("quantity").cast("decimal(12,0)"), F.lit(0).cast("decimal(18,2)"))


def fill_totals(fills: DataFrame, by: list[str]) -> DataFrame:
    """Notional by side, fees and slippage, summed exactly."""
    side = lambda s: F.sum(F.when(F.col("side") == s, worth()))
    money = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return fills.groupBy(*by).agg(
        F.count("*").alias("n_fills"),
        money(side("BUY")).alias("buy_notional"),
        money(side("SELL")).alias("sell_notional"),
        money(F.sum(F.col("commission").cast("decimal(18,2)"))).alias("total_commission"),
        money(F.sum(F.col("stamp_tax").cast("decimal(18,2)"))).alias("total_stamp_tax"),
        money(F.sum(slippage())).alias("slippage_estimate"),
    )


FILL_FIGURES = ("n_fills", "buy_notional", "sell_notional", "total_commission", "total_stamp_tax", "slippage_estimate")


def window_metrics(equity: DataFrame, fills: DataFrame, by: list[str], benchmark: DataFrame | None = None, primary: str | None = None) -> DataFrame:
    """equity: by, trade_date, equity, cash, stale_market_value; fills: by, side, quantity, price, reference_price, fees.

    benchmark: trade_date, symbol, close, of which the primary series, or else that with the smallest name, is used within the window.
    """
    d = drawdowns(daily_returns(equity, by), by)
    w = Window.partitionBy(*by).orderBy("trade_date")
    d = d.withColumn("_r", F.when(F.lag("equity").over(w).isNotNull(), F.col("daily_return")))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"),
        F.min_by("equity", "trade_date").alias("start_equity"), F.max_by("equity", "trade_date").alias("end_equity"),
        F.stddev_samp("_r").alias("_sd"), F.count("_r").alias("_n"), F.min("drawdown").alias("max_drawdown"), F.avg("equity").alias("turnover_denominator"),
        F.max_by("cash", "trade_date").alias("_cash"), F.max_by("stale_market_value", "trade_date").alias("_stale"),
    )
    ok = (F.col("n_days") >= 2) & (F.col("start_equity") > 0) & (F.col("end_equity") > 0)
    growth = F.col("end_equity") / F.col("start_equity")
    share = lambda c: F.when(F.col("end_equity") > 0, F.col(c) / F.col("end_equity")).otherwise(0.0)
    m = g.join(fill_totals(fills, by), by, "left").na.fill(0, list(FILL_FIGURES))
    m = (
        m.withColumn("cumulative_return", F.when(ok, growth - 1).otherwise(0.0))
        .withColumn("annualized_return", F.when(ok, F.pow(growth, F.lit(YEAR) / (F.col("n_days") - 1)) - 1).otherwise(0.0))
        .withColumn("annualized_volatility", F.when(F.col("_n") >= 2, F.col("_sd") * F.sqrt(F.lit(YEAR))).otherwise(0.0))
        .withColumn("turnover_numerator", (F.col("buy_notional") + F.col("sell_notional")) / 2)
        .withColumn("turnover", F.when(F.col("turnover_denominator") > 0, F.col("turnover_numerator") / F.col("turnover_denominator")).otherwise(0.0))
        .withColumn("cash_ratio_end", share("_cash"))
        .withColumn("stale_asset_ratio_end", share("_stale"))
        .drop("_sd", "_n", "_cash", "_stale")
    )
    if benchmark is None:
        return m
    return m.join(benchmark_returns(m.select(*by, "start_date", "end_date"), benchmark, by, primary), by, "left").withColumn(
        "benchmark_excess_return", F.when(F.col("benchmark_symbol").isNotNull(), F.col("cumulative_return") - F.col("benchmark_total_return")).otherwise(0.0)
    )


def benchmark_returns(windows: DataFrame, benchmark: DataFrame, by: list[str], primary: str | None = None) -> DataFrame:
    """Last over first close within each window, less one; 0 with fewer than two closes or a first one that isn't positive."""
    chosen = F.broadcast(benchmark.agg(F.coalesce(F.max(F.when(F.col("symbol") == primary, F.col("symbol"))) if primary else F.lit(None).cast("string"), F.min("symbol")).alias("symbol")))
    b = benchmark.join(chosen, "symbol").withColumnRenamed("symbol", "benchmark_symbol")
    dated = windows.select(*by, F.explode(F.sequence("start_date", "end_date")).alias("trade_date"))
    j = b.join(dated, "trade_date")
    first, last = F.min_by("close", "trade_date"), F.max_by("close", "trade_date")
    return j.groupBy(*by).agg(F.first("benchmark_symbol").alias("benchmark_symbol"), F.when((F.count("close") >= 2) & (first > 0), last / first - 1).otherwise(0.0).alias("benchmark_total_return"))


def sample_annualized(r: str = "daily_return") -> tuple[Column, Column]:
    """Volatility and Sharpe ratio at a zero rate; null below two observations or without spread."""
    sd = F.stddev_samp(r)
    good = (F.count(r) >= 2) & (sd > 0)
    return F.when(good, sd * F.sqrt(F.lit(YEAR))), F.when(good, F.avg(r) / sd * F.sqrt(F.lit(YEAR)))


def same_path(equity: DataFrame, fills: DataFrame, by: list[str]) -> DataFrame:
    """The equity path with explicit fees added back from the day they were paid: net and gross marks of every day."""
    fee = (F.col("commission").cast("decimal(18,2)") + F.col("stamp_tax").cast("decimal(18,2)")).alias("fee")
    paid = fills.select(*by, "trade_date", fee, F.lit(None).cast("double").alias("equity"))
    marks = equity.select(*by, "trade_date", F.lit(0).cast("decimal(19,2)").alias("fee"), "equity")
    day = paid.unionByName(marks).groupBy(*by, "trade_date").agg(F.sum("fee").alias("fee"), F.max("equity").alias("equity"))
    w = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return day.withColumn("fees_so_far", F.sum("fee").over(w).cast("double")).filter("equity IS NOT NULL").select(*by, "trade_date", "equity", "fees_so_far", (F.col("equity") + F.col("fees_so_far")).alias("gross_equity"))


def fold_metrics(equity: DataFrame, fills: DataFrame, diffs: DataFrame, by: list[str], initial: float | None = None, one_row_an_order: bool = False) -> DataFrame:
    """One row of metrics for each group (fold and scenario).

    diffs: by, order_id, planned_quantity, rejected_quantity, status. Undefined ratios are null. Where diffs are made with one row for
    each order of a group, say so: orders are then counted, and their ids needn't be brought together to be told apart.
    """
    vol, sharpe = sample_annualized()
    r = drawdowns(daily_returns(equity, by, initial), by)
    start = F.min_by("equity", "trade_date") if initial is None else F.lit(float(initial))
    e = r.groupBy(*by).agg(
        F.min("trade_date").alias("first_trading_day"), F.max("trade_date").alias("last_trading_day"), F.count("*").alias("observation_count"),
        (F.product(1 + F.col("daily_return")) - 1).alias("fold_calendar_return"), vol.alias("annualized_volatility"), sharpe.alias("sharpe_zero_rf"),
        F.min("drawdown").alias("per_fold_max_drawdown"), F.avg("equity").alias("turnover_denominator"), start.alias("initial_equity"), F.max_by("equity", "trade_date").alias("_end"),
    )
    d = diffs.groupBy(*by).agg(
        (F.count("order_id") if one_row_an_order else F.count_distinct("order_id")).alias("submitted_order_count"),
        F.count_if(F.col("rejected_quantity") > 0).alias("_rejected"),
        F.count_if(F.col("status") == "REJECTED").alias("fully_rejected_order_count"),
        F.count_if(F.col("status") == "PARTIAL").alias("partially_filled_order_count"),
        F.sum("rejected_quantity").alias("_rq"),
        F.sum("planned_quantity").alias("_pq"),
    )
    m = e.join(fill_totals(fills, by), by, "left").join(d, by, "left").na.fill(0, [*FILL_FIGURES, "submitted_order_count", "fully_rejected_order_count", "partially_filled_order_count"])
    fees = F.col("total_commission") + F.col("total_stamp_tax")
    return (
        m.withColumn("total_explicit_cost", F.round(fees, 2))
        .withColumn("net_return", F.col("_end") / F.col("initial_equity") - 1)
        .withColumn("gross_return_before_explicit_cost", (F.col("_end") + fees) / F.col("initial_equity") - 1)
        .withColumn("explicit_cost_drag", F.col("gross_return_before_explicit_cost") - F.col("net_return"))
        .withColumn("explicit_cost_ratio", F.col("total_explicit_cost") / F.col("initial_equity"))
        .withColumn("reject_rate", F.col("_rejected") / F.nullif("submitted_order_count", F.lit(0)))
        .withColumn("unfilled_quantity_rate", F.col("_rq") / F.nullif("_pq", F.lit(0)))
        .withColumn("turnover_numerator", (F.col("buy_notional") + F.col("sell_notional")) / 2)
        .withColumn("turnover", F.when(F.col("turnover_denominator") > 0, F.col("turnover_numerator") / F.col("turnover_denominator")))
        .drop("_end", "_rejected", "_rq", "_pq")
    )


def out_of_sample(returns: DataFrame, by: list[str]) -> DataFrame:
    """Daily returns of all folds as one series for each group: compound return, annualised over N, volatility, Sharpe."""
    vol, sharpe = sample_annualized()
    g = returns.groupBy(*by).agg(F.product(1 + F.col("daily_return")).alias("_p"), F.count("*").alias("oos_return_observations"), vol.alias("annualized_volatility"), sharpe.alias("sharpe_zero_rf"))
    return g.withColumn("aggregate_return", F.col("_p") - 1).withColumn("annualized_return", F.pow("_p", F.lit(YEAR) / F.col("oos_return_observations")) - 1).drop("_p")


def repeated_dates(returns: DataFrame, by: list[str]) -> DataFrame:
    """Dates that more than one fold claims: folds must not overlap."""
    return returns.groupBy(*by, "trade_date").agg(F.count("*").alias("n")).filter("n > 1")


def rebased(series: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percent change since the first day that all series have; rows before it go."""
    start = F.broadcast(series.groupBy(*by).agg(F.min("trade_date").alias("_d")).agg(F.max("_d").alias("_base")))
    w = Window.partitionBy(*by).orderBy("trade_date")
    return series.crossJoin(start).filter("trade_date >= _base").withColumn("rebased_percent", (F.col(value) / F.first(value).over(w) - 1) * 100).drop("_base")


def mean_exposure(equity: DataFrame, by: list[str]) -> DataFrame:
    return equity.filter("equity > 0").groupBy(*by).agg(F.avg(F.col("market_value") / F.col("equity")).alias("mean_invested_exposure"))
