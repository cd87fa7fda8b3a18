"""Queries of performance metrics, diagnostics and walk-forward verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.operators import analytics, diagnostics, factors, research
from tessaro.plans import market
from tessaro.plans.portfolios import quotes, scored
from tessaro.plans.registry import query, view

R8 = 8


def rounded(rows: DataFrame, columns: list[str], places: int = R8) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.round(c, places))
    return rows


view("returns", "SELECT *, CAST(year(trade_date) AS INT) AS fold_id, equity / lag(equity, 1, 1000000000.0::DOUBLE) OVER (PARTITION BY scenario ORDER BY trade_date) - 1 AS daily_return FROM equity")
START = 1_000_000_000.0


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_returns(market.equity(spark, sf_dir), ["scenario"], START).withColumn("fold_id", F.year("trade_date"))


@query("SELECT scenario, trade_date, round(daily_return, 10) AS daily_return FROM returns")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).select("scenario", "trade_date", F.round("daily_return", 10).alias("daily_return"))


@query("SELECT e.scenario, e.trade_date, 'extra' AS fault FROM equity e WHERE e.trade_date NOT IN (SELECT day FROM open_days) UNION ALL SELECT s.scenario, d.day, 'missing' FROM (SELECT DISTINCT scenario FROM equity) s CROSS JOIN open_days d WHERE NOT EXISTS (SELECT 1 FROM equity e WHERE e.scenario = s.scenario AND e.trade_date = d.day)")
def return_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.return_faults(market.equity(spark, sf_dir), market.open_days(spark, sf_dir).select(F.col("day").alias("trade_date")), ["scenario"])


view("drawdowns", "SELECT scenario, trade_date, equity, max(equity) OVER (PARTITION BY scenario ORDER BY trade_date) AS peak, equity / max(equity) OVER (PARTITION BY scenario ORDER BY trade_date) - 1 AS drawdown FROM equity")


@query("SELECT scenario, trade_date, peak, round(drawdown, 10) AS drawdown FROM drawdowns")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.drawdowns(market.equity(spark, sf_dir), ["scenario"]).select("scenario", "trade_date", "peak", F.round("drawdown", 10).alias("drawdown"))


# Fills of the quoted orders with their reference price.
view("fills", "SELECT q.*, o.reference_price FROM quotes q JOIN order_lines o USING (order_id)")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir)


view(
    "fill_totals",
    """
SELECT scenario, count(*) AS n_fills, sum(CASE WHEN side = 'BUY' THEN gross ELSE 0 END)::DOUBLE AS buy_notional, sum(CASE WHEN side = 'SELL' THEN gross ELSE 0 END)::DOUBLE AS sell_notional, sum(commission)::DOUBLE AS total_commission, sum(stamp_tax)::DOUBLE AS total_stamp_tax,
  sum(greatest(CASE WHEN side = 'BUY' THEN price - reference_price ELSE reference_price - price END * quantity, 0))::DOUBLE AS slippage_estimate FROM fills GROUP BY 1""",
)


@query(
    """
SELECT e.scenario, n_days, start_date, end_date, round(end_equity / start_equity - 1, 8) AS cumulative_return, round(pow(end_equity / start_equity, 252.0::DOUBLE / (n_days - 1)) - 1, 8) AS annualized_return, round(sd * sqrt(252), 8) AS annualized_volatility,
  round(mdd, 8) AS max_drawdown, round((buy_notional + sell_notional) / 2 / mean_equity, 8) AS turnover, total_commission, total_stamp_tax, slippage_estimate, round(cash / end_equity, 8) AS cash_ratio_end, b.symbol AS benchmark_symbol, round(b.r, 8) AS benchmark_total_return, round(end_equity / start_equity - 1 - b.r, 8) AS benchmark_excess_return
FROM (SELECT scenario, count(*) AS n_days, min(trade_date) AS start_date, max(trade_date) AS end_date, arg_min(equity, trade_date) AS start_equity, arg_max(equity, trade_date) AS end_equity, stddev_samp(r) AS sd, min(dd) AS mdd, avg(equity) AS mean_equity, arg_max(equity, trade_date) / 4 AS cash
      FROM (SELECT scenario, trade_date, equity, equity / lag(equity) OVER (PARTITION BY scenario ORDER BY trade_date) - 1 AS r, equity / max(equity) OVER (PARTITION BY scenario ORDER BY trade_date) - 1 AS dd FROM equity) GROUP BY 1) e
JOIN fill_totals f USING (scenario) JOIN LATERAL (SELECT min(symbol) AS symbol, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS r FROM bars WHERE symbol = (SELECT min(symbol) FROM bars) AND trade_date BETWEEN e.start_date AND e.end_date) b ON true"""
)
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = market.equity(spark, sf_dir).withColumn("cash", F.col("equity") / 4).withColumn("stale_market_value", F.lit(0.0))
    m = analytics.window_metrics(e, fills(spark, sf_dir), ["scenario"], market.bars(spark, sf_dir).select("symbol", "trade_date", "close"))
    figures = ["cumulative_return", "annualized_return", "annualized_volatility", "max_drawdown", "turnover", "cash_ratio_end", "benchmark_total_return", "benchmark_excess_return"]
    return rounded(m.select("scenario", "n_days", "start_date", "end_date", "total_commission", "total_stamp_tax", "slippage_estimate", "benchmark_symbol", *figures), figures)


@query(
    """
SELECT scenario, trade_date, equity, round(equity + coalesce(sum(fee) OVER (PARTITION BY scenario ORDER BY trade_date), 0)::DOUBLE, 2) AS gross_equity FROM (
  SELECT coalesce(e.scenario, f.scenario) AS scenario, coalesce(e.trade_date, f.trade_date) AS trade_date, e.equity, f.fee FROM equity e FULL JOIN (SELECT scenario, trade_date, sum(commission + stamp_tax) AS fee FROM fills GROUP BY 1, 2) f ON e.scenario = f.scenario AND e.trade_date = f.trade_date) QUALIFY equity IS NOT NULL"""
)
def same_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = analytics.same_path(market.equity(spark, sf_dir), fills(spark, sf_dir), ["scenario"])
    return p.select("scenario", "trade_date", "equity", F.round("gross_equity", 2).alias("gross_equity"))


view(
    "folds",
    """
SELECT r.*, f.n_fills, f.fees, f.notional, d.n_orders, d.n_rejected, d.n_full, d.n_partial, d.rq, d.pq FROM (
  SELECT scenario, fold_id, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day, product(1 + daily_return) - 1 AS ret, CASE WHEN stddev_samp(daily_return) > 0 THEN stddev_samp(daily_return) * sqrt(252) END AS vol, CASE WHEN stddev_samp(daily_return) > 0 THEN avg(daily_return) / stddev_samp(daily_return) * sqrt(252) END AS sharpe,
    min(dd) AS mdd, avg(equity) AS mean_equity, arg_max(equity, trade_date) AS end_equity FROM (
    SELECT *, equity / lag(equity, 1, 1000000000.0::DOUBLE) OVER (PARTITION BY scenario, fold_id ORDER BY trade_date) - 1 AS daily_return, equity / max(equity) OVER (PARTITION BY scenario, fold_id ORDER BY trade_date) - 1 AS dd FROM (SELECT scenario, trade_date, equity, CAST(year(trade_date) AS INT) AS fold_id FROM equity)) GROUP BY 1, 2) r
LEFT JOIN (SELECT scenario, CAST(year(trade_date) AS INT) AS fold_id, count(*) AS n_fills, sum(commission + stamp_tax)::DOUBLE AS fees, sum(gross)::DOUBLE AS notional FROM fills GROUP BY 1, 2) f USING (scenario, fold_id)
LEFT JOIN (SELECT s.scenario, CAST(year(o.trade_date) AS INT) AS fold_id, count(*) AS n_orders, count(*) FILTER (rejected_quantity > 0) AS n_rejected, count(*) FILTER (filled_quantity = 0) AS n_full, count(*) FILTER (filled_quantity > 0 AND rejected_quantity > 0) AS n_partial, sum(rejected_quantity)::DOUBLE AS rq, sum(planned_quantity)::DOUBLE AS pq
  FROM order_lines o CROSS JOIN (SELECT unnest(['zero_cost', 'full_cost']) AS scenario) s GROUP BY 1, 2) d USING (scenario, fold_id)""",
)


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.merging import order_status

    o = market.order_lines(spark, sf_dir).withColumn("status", order_status()).withColumn("scenario", F.explode(F.array(F.lit("zero_cost"), F.lit("full_cost"))))
    return o.withColumn("fold_id", F.year("trade_date")).withColumn("signal_date", F.col("trade_date")).withColumn("reason", F.when(F.col("status") != "FILLED", "insufficient_cash"))


def folds(spark: SparkSession, sf_dir: str, equity: DataFrame | None = None) -> DataFrame:
    """equity: the curves of market.equity, where they are at hand."""
    e = (market.equity(spark, sf_dir) if equity is None else equity).withColumn("fold_id", F.year("trade_date"))
    # order lines are grouped by what their ids are made of, and have one fold
    return analytics.fold_metrics(e, fills(spark, sf_dir).withColumn("fold_id", F.year("trade_date")), diffs(spark, sf_dir), ["scenario", "fold_id"], START, one_row_an_order=True)


@query(
    """
SELECT scenario, fold_id, n AS observation_count, first_day AS first_trading_day, last_day AS last_trading_day, round(ret, 8) AS fold_calendar_return, round(vol, 8) AS annualized_volatility, round(sharpe, 6) AS sharpe_zero_rf, round(mdd, 8) AS per_fold_max_drawdown,
  n_fills, n_orders AS submitted_order_count, n_full AS fully_rejected_order_count, n_partial AS partially_filled_order_count, round(n_rejected / n_orders, 8) AS reject_rate, round(rq / pq, 8) AS unfilled_quantity_rate, round(notional / 2 / mean_equity, 8) AS turnover,
  round(end_equity / 1e9::DOUBLE - 1, 8) AS net_return, round((end_equity + fees) / 1e9::DOUBLE - 1, 8) AS gross_return, round(fees / 1e9::DOUBLE, 10) AS explicit_cost_ratio FROM folds"""
)
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = folds(spark, sf_dir).withColumnRenamed("gross_return_before_explicit_cost", "gross_return")
    eight = ["fold_calendar_return", "annualized_volatility", "per_fold_max_drawdown", "reject_rate", "unfilled_quantity_rate", "turnover", "net_return", "gross_return"]
    m = rounded(m, eight).withColumn("sharpe_zero_rf", F.round("sharpe_zero_rf", 6)).withColumn("explicit_cost_ratio", F.round("explicit_cost_ratio", 10))
    return m.select("scenario", "fold_id", "observation_count", "first_trading_day", "last_trading_day", "n_fills", "submitted_order_count", "fully_rejected_order_count", "partially_filled_order_count", "sharpe_zero_rf", "explicit_cost_ratio", *eight)


view("oos", "SELECT scenario, count(*) AS n, product(1 + daily_return) AS p, stddev_samp(daily_return) * sqrt(252) AS vol, avg(daily_return) / stddev_samp(daily_return) * sqrt(252) AS sharpe FROM returns GROUP BY 1")


@query("SELECT scenario, n AS oos_return_observations, round(p - 1, 8) AS aggregate_return, round(pow(p, 252.0::DOUBLE / n) - 1, 8) AS annualized_return, round(vol, 8) AS annualized_volatility, round(sharpe, 6) AS sharpe_zero_rf FROM oos")
def oos_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = analytics.out_of_sample(returns(spark, sf_dir), ["scenario"])
    return rounded(m, ["aggregate_return", "annualized_return", "annualized_volatility"]).withColumn("sharpe_zero_rf", F.round("sharpe_zero_rf", 6))


@query("SELECT scenario, trade_date, count(*) AS n FROM (SELECT scenario, trade_date FROM returns UNION ALL SELECT scenario, trade_date FROM returns WHERE dayofyear(trade_date) = 40) GROUP BY 1, 2 HAVING count(*) > 1")
def oos_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir).select("scenario", "trade_date")
    return analytics.repeated_dates(r.unionByName(r.filter(F.dayofyear("trade_date") == 40)), ["scenario"])


view("curves", "SELECT symbol, trade_date, close FROM bars WHERE length(symbol) = 2")


@query("SELECT symbol, trade_date, round((close / first_value(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1) * 100, 6) AS rebased_percent FROM curves WHERE trade_date >= (SELECT max(d) FROM (SELECT min(trade_date) AS d FROM curves GROUP BY symbol))")
def rebased_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = market.bars(spark, sf_dir).filter(F.length("symbol") == 2)
    return analytics.rebased(c, ["symbol"], "close").select("symbol", "trade_date", F.round("rebased_percent", 6).alias("rebased_percent"))


@query("SELECT scenario, round(avg((equity - 1e8::DOUBLE) / equity), 8) AS mean_invested_exposure FROM equity WHERE equity > 0 GROUP BY 1")
def invested_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = market.equity(spark, sf_dir).withColumn("market_value", F.col("equity") - 1e8)
    return rounded(analytics.mean_exposure(e, ["scenario"]), ["mean_invested_exposure"])


# Momentum of each signal with the return of the next five days of the common grid.
view("grid", "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM bars)")
view("forward", "SELECT a.symbol, a.trade_date, b.close / a.close - 1 AS forward_return FROM (SELECT * FROM bars JOIN grid USING (trade_date)) a LEFT JOIN (SELECT * FROM bars JOIN grid USING (trade_date)) b ON a.symbol = b.symbol AND b.k = a.k + 5")
view("pairs", "SELECT s.trade_date, s.symbol, s.value, f.forward_return FROM scored s JOIN forward f USING (trade_date, symbol) WHERE s.reason IS NULL AND f.forward_return IS NOT NULL")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir)
    f = factors.forward_return(b, b.select("trade_date"))
    return scored(spark, sf_dir).filter("is_valid").select("trade_date", "symbol", F.col("raw_value").alias("value")).join(f, ["trade_date", "symbol"])


@query("SELECT symbol, trade_date, round(forward_return, 8) AS forward_return FROM forward")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir)
    return rounded(factors.forward_return(b, b.select("trade_date")), ["forward_return"])


@query("SELECT symbol, trade_date, round(lead(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) / close - 1, 8) AS forward_return FROM bars")
def forward_returns_by_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors.forward_return_by_bar(market.bars(spark, sf_dir)), ["forward_return"])


view(
    "ics",
    """
SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN covar_samp(a, b) / stddev_samp(a) / stddev_samp(b) END AS ic FROM (
  SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, value) - 1) / 2 AS a, rank() OVER (PARTITION BY trade_date ORDER BY forward_return) + (count(*) OVER (PARTITION BY trade_date, forward_return) - 1) / 2 AS b FROM pairs) GROUP BY 1""",
)


@query("SELECT CAST(year(trade_date) AS INT) AS year, count(*) AS n_dates, count(ic) AS n_ic, round(avg(ic), 8) AS ic_mean, round(stddev_samp(ic), 8) AS ic_std, round(avg(CAST(round(ic, 12) > 0 AS INT)), 8) AS ic_positive_rate, round(avg(ic) / CASE WHEN stddev_samp(ic) > 0 THEN stddev_samp(ic) END, 6) AS ic_ir FROM ics GROUP BY 1")
def ic_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = diagnostics.ic_summary(diagnostics.information_coefficients(pairs(spark, sf_dir), least=3), [])
    return rounded(s, ["ic_mean", "ic_std", "ic_positive_rate"]).withColumn("ic_ir", F.round("ic_ir", 6))


@query(
    """
SELECT CAST(year(trade_date) AS INT) AS year, board, count(ic) AS n_ic, round(avg(ic), 8) AS ic_mean, round(avg(CAST(round(ic, 12) > 0 AS INT)), 8) AS ic_positive_rate FROM (
  SELECT trade_date, board, CASE WHEN count(*) >= 3 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN covar_samp(a, b) / stddev_samp(a) / stddev_samp(b) END AS ic FROM (
    SELECT trade_date, board, rank() OVER (PARTITION BY trade_date, board ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, board, value) - 1) / 2 AS a, rank() OVER (PARTITION BY trade_date, board ORDER BY forward_return) + (count(*) OVER (PARTITION BY trade_date, board, forward_return) - 1) / 2 AS b
    FROM pairs JOIN master USING (symbol)) GROUP BY 1, 2) GROUP BY 1, 2 HAVING count(ic) >= 2"""
)
def ic_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).join(market.master(spark, sf_dir).select("symbol", "board"), "symbol")
    s = diagnostics.ic_summary(diagnostics.information_coefficients(p, ["board"], least=3), ["board"], least_dates=2)
    return rounded(s, ["ic_mean", "ic_positive_rate"]).select("year", "board", "n_ic", "ic_mean", "ic_positive_rate")


@query(
    """
WITH q AS (SELECT trade_date, b, avg(forward_return) AS m FROM (SELECT *, CAST(greatest(1, ceil(5 * (k - 1) / nullif(n - 1, 0))) AS INT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY value, symbol) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM pairs)) WHERE n >= 5 GROUP BY 1, 2)
SELECT CAST(year(trade_date) AS INT) AS year, round(avg(m) FILTER (b = 1), 8) AS q1, round(avg(m) FILTER (b = 2), 8) AS q2, round(avg(m) FILTER (b = 3), 8) AS q3, round(avg(m) FILTER (b = 4), 8) AS q4, round(avg(m) FILTER (b = 5), 8) AS q5, round((avg(m) FILTER (b = 5) - avg(m) FILTER (b = 1)) * 10000, 4) AS long_short_bp FROM q GROUP BY 1"""
)
def quintile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = diagnostics.quantile_returns(pairs(spark, sf_dir), least=5)
    return rounded(q, ["q1", "q2", "q3", "q4", "q5"]).withColumn("long_short_bp", F.round("long_short_bp", 4))


# Books of uneven weights: the ten best names, each by its momentum.
view("positions", "SELECT r.trade_date, r.symbol, (11 - r.rank)::DOUBLE / 60 AS target_weight, m.board FROM ranked r JOIN master m USING (symbol) WHERE r.rank <= 10")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scored(spark, sf_dir).filter("is_valid").withColumn("rank", factors.rank_desc()).filter("rank <= 10")
    return r.join(market.master(spark, sf_dir).select("symbol", "board"), "symbol").select("trade_date", "symbol", ((11 - F.col("rank")).cast("double") / 60).alias("target_weight"), "board")


@query(
    """
SELECT CAST(year(trade_date) AS INT) AS year, count(*) AS n_rebalances, round(avg(n), 8) AS mean_n_positions, round(avg(hhi), 8) AS mean_hhi, round(max(hhi), 8) AS max_hhi, round(avg(top3), 8) AS mean_top3_share, round(avg(1 / hhi), 8) AS mean_effective_n, round(avg(gross), 8) AS mean_gross_weight FROM (
  SELECT trade_date, count(*) AS n, sum(target_weight) AS gross, sum(target_weight * target_weight) / (sum(target_weight) * sum(target_weight)) AS hhi, sum(target_weight) FILTER (k <= 3) / sum(target_weight) AS top3 FROM (
    SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY target_weight DESC, symbol) AS k FROM positions) GROUP BY 1) GROUP BY 1"""
)
def concentration_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = diagnostics.concentration_by_year(diagnostics.concentration(positions(spark, sf_dir)))
    return rounded(c, ["mean_n_positions", "mean_hhi", "max_hhi", "mean_top3_share", "mean_effective_n", "mean_gross_weight"])


@query("SELECT CAST(year(trade_date) AS INT) AS year, board, round(avg(w / g), 8) AS share FROM (SELECT trade_date, board, sum(target_weight) AS w, sum(sum(target_weight)) OVER (PARTITION BY trade_date) AS g FROM positions GROUP BY 1, 2) GROUP BY 1, 2")
def board_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.category_share(positions(spark, sf_dir), "board"), ["share"])


view("pool", "SELECT s.trade_date, s.symbol, s.value AS momentum, b.amount FROM scored s LEFT JOIN bars b USING (trade_date, symbol) WHERE s.reason IS NULL")


@query(
    """
SELECT CAST(year(trade_date) AS INT) AS year, round(avg(m), 8) AS momentum_pct, round(avg(a), 8) AS amount_pct FROM (SELECT p.trade_date, avg(m) AS m, avg(a) AS a FROM (
  SELECT trade_date, symbol, (rank() OVER (PARTITION BY trade_date ORDER BY momentum) + (count(*) OVER (PARTITION BY trade_date, momentum) - 1) / 2) / count(*) OVER (PARTITION BY trade_date) AS m,
    CASE WHEN amount IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, amount IS NOT NULL ORDER BY amount) + (count(*) OVER (PARTITION BY trade_date, amount) - 1) / 2) / count(amount) OVER (PARTITION BY trade_date) END AS a FROM pool) p JOIN positions USING (trade_date, symbol) GROUP BY 1) GROUP BY 1"""
)
def style_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir).select("trade_date", "symbol", "amount")
    pool = scored(spark, sf_dir).filter("is_valid").select("trade_date", "symbol", F.col("raw_value").alias("momentum")).join(b, ["trade_date", "symbol"], "left")
    return rounded(diagnostics.style_tilt(positions(spark, sf_dir), pool, ["momentum", "amount"]), ["momentum_pct", "amount_pct"])


view(
    "rolling",
    """
SELECT symbol, trade_date, CASE WHEN count(r) OVER w60 >= 40 THEN stddev_samp(r) OVER w60 * sqrt(252) END AS vol60, CASE WHEN count(*) OVER w20 >= 10 THEN avg(amount) OVER w20 END AS amount20 FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM bars)
WINDOW w60 AS (PARTITION BY symbol ORDER BY trade_date ROWS 59 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)""",
)


@query("SELECT symbol, trade_date, round(vol60, 6) AS vol60, round(amount20, 6) AS amount20 FROM rolling")
def rolling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = market.bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    w60, w20 = w.rowsBetween(-59, 0), w.rowsBetween(-19, 0)
    vol = F.when(F.count("r").over(w60) >= 40, F.stddev_samp("r").over(w60) * F.sqrt(F.lit(252.0)))
    return b.select("symbol", "trade_date", F.round(vol, 6).alias("vol60"), F.round(F.when(F.count("*").over(w20) >= 10, F.avg("amount").over(w20)), 6).alias("amount20"))


@query(
    """
SELECT scenario, CAST(year(r.trade_date) AS INT) AS year, count(*) AS n, round(covar_samp(r.daily_return, b.b) / var_samp(b.b), 8) AS beta, round(corr(r.daily_return, b.b), 8) AS corr
FROM returns r JOIN (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS b FROM bars WHERE symbol = 'S1') b ON b.trade_date = r.trade_date AND b.b IS NOT NULL GROUP BY 1, 2"""
)
def beta_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    bench = market.bars(spark, sf_dir).filter("symbol = 'S1'").select("trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("b"))
    r = returns(spark, sf_dir).select("scenario", "trade_date", F.col("daily_return").alias("r"))
    return rounded(diagnostics.beta_by_year(r, bench, ["scenario"]), ["beta", "corr"])


@query(
    """
SELECT CAST(year(trade_date) AS INT) AS year, count(*) AS n_fills, round(quantile_cont(p, 0.5), 8) AS p50, round(quantile_cont(p, 0.9), 8) AS p90, round(quantile_cont(p, 0.99), 8) AS p99, round(max(p), 8) AS max, count(*) FILTER (p > 0.01) AS over_1pct, count(*) FILTER (p > 0.05) AS over_5pct
FROM (SELECT f.trade_date, f.gross::DOUBLE / b.amount AS p FROM fills f JOIN bars b USING (trade_date, symbol) WHERE f.scenario = 'full_cost' AND b.amount > 0) GROUP BY 1"""
)
def participation_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir).filter("scenario = 'full_cost'")
    return rounded(diagnostics.participation(f, market.bars(spark, sf_dir)), ["p50", "p90", "p99", "max"])


@query(
    """
SELECT CAST(year(o.trade_date) AS INT) AS year, CASE WHEN o.filled_quantity = 0 THEN 'full' ELSE 'part' END AS reason, count(*) AS n, round(sum(o.rejected_quantity * b.close), 2) AS notional, round(sum(CASE WHEN o.side = 'BUY' THEN 1 ELSE -1 END * (b.later / b.close - 1) * (o.rejected_quantity * b.close)), 2) AS adverse_cost
FROM order_lines o JOIN (SELECT symbol, trade_date, close, last_value(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS later FROM bars) b USING (symbol, trade_date) WHERE o.rejected_quantity > 0 AND b.later IS NOT NULL GROUP BY 1, 2"""
)
def rejection_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = market.order_lines(spark, sf_dir).filter("rejected_quantity > 0").withColumn("reason", F.when(F.col("filled_quantity") == 0, "full").otherwise("part"))
    return rounded(diagnostics.rejection_pressure(o, market.bars(spark, sf_dir)), ["notional", "adverse_cost"], 2)


@query(
    """
SELECT e.year, round(e.return_zero_cost, 8) AS return_zero_cost, round(e.return_full_cost, 8) AS return_full_cost, e.n_days, f.commission, f.stamp_tax, f.traded_notional, f.slippage_paid, round(e.equity_delta, 2) AS equity_delta
FROM (SELECT CAST(year(trade_date) AS INT) AS year, arg_max(equity, trade_date) FILTER (scenario = 'zero_cost') / arg_min(equity, trade_date) FILTER (scenario = 'zero_cost') - 1 AS return_zero_cost, arg_max(equity, trade_date) FILTER (scenario = 'full_cost') / arg_min(equity, trade_date) FILTER (scenario = 'full_cost') - 1 AS return_full_cost,
    count(*) FILTER (scenario = 'zero_cost') AS n_days, arg_max(equity, trade_date) FILTER (scenario = 'zero_cost') - arg_max(equity, trade_date) FILTER (scenario = 'full_cost') AS equity_delta FROM equity GROUP BY 1) e
JOIN (SELECT CAST(year(trade_date) AS INT) AS year, sum(commission)::DOUBLE AS commission, sum(stamp_tax)::DOUBLE AS stamp_tax, sum(gross)::DOUBLE AS traded_notional, sum((price - reference_price) * quantity * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END)::DOUBLE AS slippage_paid FROM fills WHERE scenario = 'full_cost' GROUP BY 1) f USING (year)"""
)
def cost_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = diagnostics.cost_attribution(market.equity(spark, sf_dir), fills(spark, sf_dir).filter("scenario = 'full_cost'"), ["zero_cost", "full_cost"])
    return rounded(rounded(c, ["return_zero_cost", "return_full_cost"]), ["equity_delta", "traded_notional"], 2)


@query(
    """
SELECT o.side, sum(CAST(b.close AS DECIMAL(18,2)) * CAST(o.planned_quantity AS DECIMAL(9,0)))::DOUBLE AS planned_gross_notional, sum(CAST(b.close AS DECIMAL(18,2)) * CAST(o.planned_quantity - o.filled_quantity AS DECIMAL(9,0)))::DOUBLE AS unfilled_notional, count(*) AS planned_order_count,
  count(*) FILTER (rejected_quantity = 0) AS filled_order_count, count(*) FILTER (filled_quantity > 0 AND rejected_quantity > 0) AS partial_order_count, count(*) FILTER (filled_quantity = 0) AS rejected_order_count
FROM order_lines o ASOF LEFT JOIN bars b ON b.symbol = o.symbol AND o.trade_date >= b.trade_date GROUP BY 1"""
)
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diffs(spark, sf_dir).filter("scenario = 'zero_cost'")
    f = fills(spark, sf_dir).filter("scenario = 'zero_cost'")
    s = diagnostics.execution_summary(d, f, market.bars(spark, sf_dir), ["side"])
    return s.select("side", "planned_gross_notional", "unfilled_notional", "planned_order_count", "filled_order_count", "partial_order_count", "rejected_order_count")


@query("SELECT CAST(year(trade_date) AS INT) AS fold_id, CASE WHEN filled_quantity >= planned_quantity THEN 'FILLED' WHEN filled_quantity > 0 THEN 'PARTIAL' ELSE 'REJECTED' END AS status, CASE WHEN filled_quantity < planned_quantity THEN 'insufficient_cash' END AS reason, count(*) AS n_orders, sum(planned_quantity)::BIGINT AS planned, sum(rejected_quantity)::BIGINT AS rejected FROM order_lines GROUP BY 1, 2, 3")
def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.order_outcomes(diffs(spark, sf_dir).filter("scenario = 'zero_cost'"), ["fold_id"])


@query(
    """
SELECT CASE WHEN b IS NULL THEN 'fold-' || y END AS fold_id, greatest(make_date(y, 1, 1), DATE '1996-03-01') AS calendar_start, least(make_date(y, 12, 31), DATE '2001-12-31') AS calendar_end, CASE WHEN b IS NULL THEN first_day END AS first_trading_day, CASE WHEN b IS NULL THEN last_day END AS last_trading_day,
  CASE WHEN b IS NULL THEN coalesce(n, 0) END AS oos_session_count, CASE WHEN b IS NULL THEN make_date(y - k, 1, 1) END AS warmup_start, CASE WHEN b IS NULL THEN total END AS warmup_session_count, b AS boundary_reason FROM (
  SELECT y.y, CASE WHEN make_date(y.y, 1, 1) < DATE '1996-03-01' THEN 'leading_partial_year' END AS b, s.*, coalesce((SELECT min(k) FROM back WHERE back.y = y.y AND total >= 756), 13) AS k, coalesce((SELECT min(total) FROM back WHERE back.y = y.y AND total >= 756), (SELECT max(total) FROM back WHERE back.y = y.y)) AS total
  FROM (SELECT CAST(unnest(range(1996, 2002)) AS INT) AS y) y LEFT JOIN (SELECT year(day) AS yy, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM open_days GROUP BY 1) s ON s.yy = y.y)"""
)
def fold_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.fold_schedule(market.calendar(spark, sf_dir), "1996-03-01", "2001-12-31")


view("back", "SELECT y.y, k.k, (SELECT count(*) FROM open_days WHERE year(day) BETWEEN y.y - k.k AND y.y - 1) AS total FROM (SELECT CAST(unnest(range(1996, 2002)) AS INT) AS y) y, (SELECT CAST(unnest(range(3, 14)) AS INT) AS k) k")


@query(
    """
SELECT 'fold-' || y AS fold_id, code, CASE WHEN code IS NULL THEN 'READY' ELSE 'FAILED_PREFLIGHT' END AS status FROM (
  SELECT y, CASE WHEN n = 0 THEN 'CLOSURE_EVIDENCE_MISSING' WHEN total < 756 THEN 'WARMUP_SESSIONS_SHORT' WHEN total < 61 THEN 'FACTOR_HISTORY_SHORT' WHEN n % 2 = 1 THEN 'BENCHMARK_GAP' END AS code FROM (
    SELECT y.y, (SELECT count(*) FROM open_days WHERE year(day) = y.y) AS n, coalesce((SELECT min(total) FROM back WHERE back.y = y.y AND total >= 756), (SELECT max(total) FROM back WHERE back.y = y.y)) AS total FROM (SELECT CAST(unnest(range(1997, 2002)) AS INT) AS y) y))"""
)
def fold_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = research.fold_schedule(market.calendar(spark, sf_dir), "1996-03-01", "2001-12-31").filter("fold_id IS NOT NULL")
    n = F.col("oos_session_count")
    facts = f.select("fold_id", F.lit(True).alias("accepted"), (n > 0).alias("universe_covered"), F.col("warmup_session_count").alias("factor_history_sessions"), F.when(n % 2 == 0, 0).otherwise(1).alias("benchmark_missing_days"), F.lit(False).alias("closure_proven"))
    return research.preflight(f, facts).select("fold_id", "code", "status")


# Equity of 1999 lacks some days and has one twice, some orders of 2000 don't balance, and 1998 has no proof of acceptance.
view("fold_equity", "SELECT 'fold-' || year(trade_date) AS fold_id, trade_date, equity AS e FROM equity JOIN open_days ON day = trade_date WHERE scenario = 'zero_cost' AND NOT (year(trade_date) = 1999 AND day(trade_date) = 7) UNION ALL SELECT 'fold-1999', trade_date, equity FROM equity WHERE scenario = 'zero_cost' AND trade_date = DATE '1999-05-05'")


@query(
    """
SELECT 'fold-' || y AS fold_id, CASE WHEN code IS NULL THEN 'EXECUTED' ELSE 'FAILED_PREFLIGHT' END AS status, code AS reason_code FROM (
  SELECT y, CASE WHEN y = 1998 THEN 'ACCEPTANCE_MISSING' WHEN (SELECT count(*) FROM open_days WHERE year(day) < y.y) < 756 THEN 'WARMUP_SESSIONS_SHORT'
    WHEN y = 2000 AND (SELECT count(*) FROM order_lines WHERE year(trade_date) = 2000 AND planned_quantity % 41 = 0) > 0 THEN 'EXECUTION_INTEGRITY'
    WHEN (SELECT count(*) FROM open_days d WHERE year(d.day) = y.y AND NOT EXISTS (SELECT 1 FROM fold_equity e WHERE e.trade_date = d.day)) + (SELECT count(*) FROM (SELECT trade_date FROM fold_equity WHERE fold_id = 'fold-' || y.y GROUP BY 1 HAVING count(*) > 1)) + (SELECT count(*) FROM fold_equity WHERE fold_id = 'fold-' || y.y AND e <= 0) > 0 THEN 'OOS_INTEGRITY' END AS code
  FROM (SELECT CAST(unnest(range(1997, 2002)) AS INT) AS y) y)"""
)
def fold_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each fold: refused before it ran, broken ledgers, broken equity, or executed."""
    cal = market.calendar(spark, sf_dir)
    f = research.fold_schedule(cal, "1996-03-01", "2001-12-31").filter("fold_id IS NOT NULL")
    facts = f.select("fold_id", (F.col("fold_id") != "fold-1998").alias("accepted"), F.lit(True).alias("universe_covered"), F.lit(1000).alias("factor_history_sessions"), F.lit(0).alias("benchmark_missing_days"), F.lit(False).alias("closure_proven"))
    fold, d = F.concat(F.lit("fold-"), F.year("trade_date")).alias("fold_id"), F.col("trade_date")
    e = market.equity(spark, sf_dir).filter("scenario = 'zero_cost'").select(fold, "trade_date", F.col("equity").alias("net_equity_after_cost"))
    e = e.join(cal.select(F.col("day").alias("trade_date")), "trade_date").select("fold_id", "trade_date", "net_equity_after_cost")
    e = e.filter(~((F.year(d) == 1999) & (F.dayofmonth(d) == 7))).unionByName(e.filter("trade_date = DATE'1999-05-05'"))
    o = market.order_lines(spark, sf_dir)
    off = F.when((F.year(d) == 2000) & (F.col("planned_quantity") % 41 == 0), 1).otherwise(0)
    ledger = o.select(fold, (F.col("planned_quantity") + off).alias("planned"), "filled_quantity", "rejected_quantity").filter("planned <> filled_quantity + rejected_quantity")
    return research.outcomes(research.preflight(f, facts), ledger, research.oos_faults(f, e, cal))


view("stable", "SELECT scenario, count(*) AS executed_fold_count, count(*) FILTER (ret > 0) AS positive_fold_count, count(*) FILTER (ret > 0) / count(ret) AS positive_fold_ratio, min(ret) AS worst FROM folds GROUP BY 1")


@query(
    """
SELECT scenario, executed_fold_count, positive_fold_count, round(positive_fold_ratio, 8) AS positive_fold_ratio, round(worst, 8) AS worst_fold_calendar_return, passed,
  CASE WHEN min(executed_fold_count) OVER () < 5 THEN 'INCONCLUSIVE' WHEN bool_and(passed) OVER () THEN 'STABLE' ELSE 'UNSTABLE' END AS conclusion FROM (SELECT *, positive_fold_ratio >= 0.6 AND worst > -0.10 AS passed FROM stable)"""
)
def stability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = research.stability(folds(spark, sf_dir).select("scenario", "fold_id", "fold_calendar_return"))
    return rounded(s, ["positive_fold_ratio", "worst_fold_calendar_return"])


# The challenger is the same strategy without costs.
view(
    "paired",
    """
SELECT b.fold_id, 'all' AS scenario, b.ret AS b_ret, c.ret AS c_ret, abs(b.mdd) AS b_mdd, abs(c.mdd) AS c_mdd, b.notional / 2 / b.mean_equity AS b_turnover, c.notional / 2 / c.mean_equity AS c_turnover, b.fees / 1e9::DOUBLE AS b_cost, c.fees / 1e9::DOUBLE AS c_cost, b.n_rejected / b.n_orders AS b_reject, c.n_rejected / c.n_orders AS c_reject
FROM (SELECT * FROM folds WHERE scenario = 'full_cost') b JOIN (SELECT * FROM folds WHERE scenario = 'zero_cost') c USING (fold_id)""",
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = folds(spark, sf_dir).withColumn("abs_max_drawdown", F.abs("per_fold_max_drawdown")).withColumn("invested_exposure", F.lit(0.95))
    side = lambda s: m.filter(F.col("scenario") == s).withColumn("scenario", F.lit("all"))
    p = research.paired_folds(side("full_cost"), side("zero_cost"), ["fold_calendar_return", "abs_max_drawdown", "turnover", "explicit_cost_ratio", "reject_rate", "invested_exposure"])
    oos = analytics.out_of_sample(returns(spark, sf_dir), ["scenario"])
    pick = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    agg = oos.agg(*[pick(s, c).alias(f"{who}_{name}") for who, s in (("baseline", "full_cost"), ("challenger", "zero_cost")) for c, name in (("sharpe_zero_rf", "aggregate_sharpe"), ("annualized_return", "aggregate_annualized_return"))])
    return research.challenge_cells(p, agg.withColumn("scenario", F.lit("all")))


view(
    "cells",
    """
SELECT unnest(['aggregate_sharpe_delta', 'aggregate_annualized_return_delta', 'positive_fold_ratio_delta', 'worst_fold_calendar_return_delta', 'median_abs_max_drawdown_delta', 'median_turnover_ratio', 'median_explicit_cost_ratio_delta', 'median_reject_rate_delta', 'median_invested_exposure']) AS metric,
  unnest([s1 - s0, r1 - r0, pc - pb, wc - wb, dc - db, tc / tb, cc - cb, rc - rb, 0.95::DOUBLE]) AS delta,
  unnest([s1 - s0 >= 0.1, r1 - r0 >= -0.02, pc - pb >= 0, wc - wb >= -0.02, dc - db <= 0, tc / tb <= 0.85, cc - cb <= 0, rc - rb <= 0.02, true]) AS passed
FROM (SELECT count(*) FILTER (b_ret > 0) / count(*) AS pb, count(*) FILTER (c_ret > 0) / count(*) AS pc, min(b_ret) AS wb, min(c_ret) AS wc, median(b_mdd) AS db, median(c_mdd) AS dc, median(b_turnover) AS tb, median(c_turnover) AS tc, median(b_cost) AS cb, median(c_cost) AS cc, median(b_reject) AS rb, median(c_reject) AS rc FROM paired),
 (SELECT max(sharpe) FILTER (scenario = 'full_cost') AS s0, max(sharpe) FILTER (scenario = 'zero_cost') AS s1, max(pow(p, 252.0::DOUBLE / n) - 1) FILTER (scenario = 'full_cost') AS r0, max(pow(p, 252.0::DOUBLE / n) - 1) FILTER (scenario = 'zero_cost') AS r1 FROM oos)""",
)


@query("SELECT metric, round(delta, 6) AS delta, passed FROM cells")
def paired_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("metric", F.round("delta", 6).alias("delta"), "passed")


@query("SELECT CASE WHEN (SELECT count(DISTINCT fold_id) FROM folds) < 5 OR count(*) FILTER (delta IS NULL) > 0 THEN 'INCONCLUSIVE_RESEARCH_ONLY' WHEN bool_and(passed) THEN 'PROMOTED' ELSE 'REJECTED' END AS verdict, count(*) FILTER (delta IS NULL) AS undefined, count(*) FILTER (NOT passed) AS failed_cells FROM cells")
def challenge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.challenge_verdict(cells(spark, sf_dir), 7)
