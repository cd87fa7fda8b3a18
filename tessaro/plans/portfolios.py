"""Queries of factors, ranks, target portfolios, costs, limits, and the account replay."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.functions import money
from tessaro.operators import calendars, factors, portfolio, quality, replay
from tessaro.operators.lineage import settled
from tessaro.operators.temporal import missing_from_grid
from tessaro.plans import market
from tessaro.plans.market import day, table
from tessaro.plans.point_in_time import adjusted
from tessaro.plans.registry import query, view

# Weekly signals of the whole calendar.
view("signals", "SELECT max(day) AS trade_date FROM open_days GROUP BY date_trunc('week', day)")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.week_ends(market.calendar(spark, sf_dir)).select(F.col("day").alias("trade_date"))


view("factor_bars", "SELECT a.symbol, a.trade_date, a.adjusted_close, a.quality_severity, l.listed_days FROM adjusted a JOIN listed l USING (symbol, trade_date)")


def factor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adjusted(spark, sf_dir).select("symbol", "trade_date", "adjusted_close", "quality_severity")
    return calendars.listed_days(a, market.calendar(spark, sf_dir), market.master(spark, sf_dir))


view(
    "momentum",
    """
SELECT symbol, trade_date, reason, CASE WHEN reason IS NULL THEN adjusted_close / then_close - 1 END AS value FROM (
  SELECT *, CASE WHEN n < 61 THEN 'insufficient_observations' WHEN bad THEN 'quality_error' WHEN listed_days < 120 THEN 'seasoning_below_120' END AS reason FROM (
    SELECT *, count(*) OVER w AS n, bool_or(quality_severity = 'ERROR') OVER w AS bad, lag(adjusted_close, 60) OVER (PARTITION BY symbol ORDER BY trade_date) AS then_close
    FROM factor_bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW)))""",
)
view("scored", "SELECT s.trade_date, n.symbol, m.value, m.reason FROM signals s CROSS JOIN (SELECT DISTINCT symbol FROM bars) n ASOF JOIN momentum m ON m.symbol = n.symbol AND s.trade_date >= m.trade_date")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.momentum(factor_bars(spark, sf_dir), signals(spark, sf_dir))


@query("SELECT symbol, trade_date, round(value, 8) AS value, reason FROM momentum")
def momentum_by_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.momentum_by_bar(factor_bars(spark, sf_dir)).select("symbol", "trade_date", F.round("raw_value", 8).alias("value"), F.col("invalid_reason").alias("reason"))


@query("SELECT trade_date, symbol, round(value, 8) AS value, reason FROM scored")
def momentum60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("trade_date", "symbol", F.round("raw_value", 8).alias("value"), F.col("invalid_reason").alias("reason"))


@query("SELECT 'rows' AS what, count(*) AS n FROM factor_bars UNION ALL SELECT 'error_rows', count(*) FILTER (quality_severity = 'ERROR') FROM factor_bars UNION ALL SELECT 'invalid:' || reason, count(*) FROM scored WHERE reason IS NOT NULL GROUP BY 1")
def factor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.input_audit(factor_bars(spark, sf_dir), scored(spark, sf_dir))


@query("SELECT count(*) AS n_faults FROM (SELECT trade_date, symbol FROM scored GROUP BY 1, 2 HAVING count(*) > 1)")
def factor_frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.invalid_factor_rows(scored(spark, sf_dir)).agg(F.count("*").alias("n_faults"))


@query("SELECT symbol, count(DISTINCT source) AS n_sources, count(DISTINCT adjustment) AS n_adjustments FROM dirty_bars GROUP BY 1 HAVING count(DISTINCT source) > 1 OR count(DISTINCT adjustment) > 1")
def mixed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.plans.ingest import dirty_bars

    return factors.mixed_series(dirty_bars(spark, sf_dir))


view("ranked", "SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY value DESC, symbol) AS rank FROM scored WHERE reason IS NULL")


@query("SELECT trade_date, symbol, CAST(rank AS INT) AS rank FROM ranked")
def cross_section_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("is_valid").select("trade_date", "symbol", factors.rank_desc().alias("rank"))


@query(
    """
SELECT r.trade_date, r.symbol, CAST(r.rank AS INT) AS rank, b.close AS signal_price, CAST(floor(85000000.0::DOUBLE / 10 / b.close / 100) * 100 AS BIGINT) AS target_quantity
FROM ranked r JOIN bars b USING (trade_date, symbol) WHERE r.rank <= 10 AND floor(85000000.0::DOUBLE / 10 / b.close / 100) > 0"""
)
def top_n_equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum of all names as of each week's end, the ten best, in whole lots of a tenth of 85 % of the initial cash."""
    t = portfolio.top_equal_weight(scored(spark, sf_dir), market.bars(spark, sf_dir), 85_000_000.0)
    return t.select("trade_date", "symbol", "rank", "signal_price", "target_quantity")


# Suspensions carry the last close; on some days the carried close is missing or zero, and some names begin at a tiny price.
view(
    "risk_input",
    """
SELECT symbol, trade_date, CASE WHEN missing_reason IS NULL THEN close WHEN day(trade_date) = 13 AND CAST(symbol[2:] AS BIGINT) % 2 = 0 THEN NULL WHEN day(trade_date) = 27 AND CAST(symbol[2:] AS BIGINT) % 5 = 0 THEN 0.0::DOUBLE ELSE carried END AS close, quality_severity, missing_reason FROM (
  SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date) AS carried FROM (
    SELECT symbol, trade_date, CASE WHEN CAST(symbol[2:] AS BIGINT) % 3 = 0 AND row_number() OVER (PARTITION BY symbol ORDER BY trade_date) <= 40 THEN close * 0.000000001::DOUBLE ELSE close END AS close,
      CASE WHEN volume % 400 = 7 THEN 'ERROR' ELSE 'INFO' END AS quality_severity, CAST(NULL AS VARCHAR) AS missing_reason FROM bars
    UNION ALL SELECT symbol, day, NULL, 'INFO', CASE WHEN day(day) = 30 AND CAST(symbol[2:] AS BIGINT) % 7 = 0 THEN 'unknown_gap' ELSE 'suspended_verified' END
    FROM (SELECT m.symbol, d.day FROM master m CROSS JOIN open_days d) g WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = g.symbol AND b.trade_date = g.day)))""",
)


def risk_input(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """Bars, and proven suspensions with their carried closes on the open days without one; some of each are faulty. By name."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    key, d = F.substring("symbol", 2, 20).cast("long"), F.dayofmonth("trade_date")
    tiny = F.when((key % 3 == 0) & (F.row_number().over(w) <= 40), F.col("close") * 0.000000001).otherwise(F.col("close"))
    severity = F.when(F.col("volume") % 400 == 7, "ERROR").otherwise("INFO")
    b = market.bars(spark, sf_dir).select("symbol", "trade_date", "close", severity.alias("quality_severity")).repartition(tasks, "symbol").withColumn("close", tiny)
    b = b.withColumn("carried", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    listed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.lit(True).alias("listed")).distinct()
    rows = calendars.with_absent_days(b.join(listed, "symbol", "left"), market.calendar(spark, sf_dir), F.col("listed"))
    why = F.when(F.col("absent"), F.when((d == 30) & (key % 7 == 0), "unknown_gap").otherwise("suspended_verified"))
    close = F.when(~F.col("absent"), F.col("close")).when((d == 13) & (key % 2 == 0), None).when((d == 27) & (key % 5 == 0), 0.0).otherwise(F.col("carried"))
    return rows.select("symbol", "trade_date", close.alias("close"), F.when(F.col("absent"), "INFO").otherwise(F.col("quality_severity")).alias("quality_severity"), why.alias("missing_reason"))


view("risk_asked", "SELECT r.symbol, r.trade_date, c.ord FROM ranked r JOIN calendar c ON c.day = r.trade_date")
view(
    "risk",
    """
SELECT trade_date, symbol, CASE WHEN trusted THEN n_real ELSE 0 END AS real_close_observations, CASE WHEN trusted THEN n_carry ELSE 0 END AS suspension_carry_days,
  CASE WHEN NOT trusted THEN 'untrusted_missing_observation' WHEN n_real < 40 OR n_ret < 2 THEN 'insufficient_real_close_observations' END AS risk_invalid_reason,
  CASE WHEN trusted AND n_real >= 40 AND n_ret >= 2 THEN greatest(vol, 0.1) END AS volatility FROM (
  SELECT symbol, signal_date AS trade_date, count(*) FILTER (is_real) AS n_real, count(*) FILTER (is_carry) AS n_carry, bool_and(is_real OR is_carry) AND bool_or(is_real AND ord = first_ord) AS trusted,
    count(ret) AS n_ret, stddev_samp(ret) * sqrt(252) AS vol FROM (
    SELECT *, CASE WHEN ord = first_ord THEN NULL WHEN is_real THEN mark / lag(mark) OVER w - 1 WHEN is_carry THEN 0 END AS ret FROM (
      SELECT *, last_value(CASE WHEN is_real THEN close END IGNORE NULLS) OVER w AS mark FROM (
        SELECT a.symbol, a.trade_date AS signal_date, c.ord, greatest(a.ord - 59, 1) AS first_ord, b.close, coalesce(b.missing_reason = 'suspended_verified' AND b.close > 0, false) AS is_carry,
          coalesce(b.symbol IS NOT NULL AND b.missing_reason IS NULL AND b.close > 0 AND b.quality_severity <> 'ERROR', false) AS is_real
        FROM risk_asked a JOIN calendar c ON c.ord BETWEEN greatest(a.ord - 59, 1) AND a.ord LEFT JOIN risk_input b ON b.symbol = a.symbol AND b.trade_date = c.day)
      WINDOW w AS (PARTITION BY symbol, signal_date ORDER BY ord)) WINDOW w AS (PARTITION BY symbol, signal_date ORDER BY ord)) GROUP BY 1, 2)""",
)


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = scored(spark, sf_dir).filter("is_valid").select("symbol", "trade_date")
    tasks = market.name_tasks(spark, sf_dir)
    return portfolio.risk_path(risk_input(spark, sf_dir, tasks), market.calendar(spark, sf_dir), asked, tasks=tasks)


@query("SELECT trade_date, symbol, real_close_observations, suspension_carry_days, risk_invalid_reason, CASE WHEN volatility > 100 THEN round(volatility / 1000, 3) ELSE round(volatility, 6) END AS volatility FROM risk")
def risk_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("applied_annualized_volatility")
    return risk(spark, sf_dir).select("trade_date", "symbol", "real_close_observations", "suspension_carry_days", "risk_invalid_reason", F.when(v > 100, F.round(v / 1000, 3)).otherwise(F.round(v, 6)).alias("volatility"))


# Groups of members with a volatility each: suppliers' names by nation, spread over a wide range.
view("members", "SELECT s_nationkey AS pool, concat('S', s_suppkey) AS symbol, 0.05 + (s_suppkey * 37 % 100)::DOUBLE / 50 AS volatility FROM supplier")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), F.concat(F.lit("S"), "s_suppkey").alias("symbol"), (F.lit(0.05) + (F.col("s_suppkey") * 37 % 100).cast("double") / 50).alias("volatility"))


view(
    "water",
    """
SELECT *, CASE WHEN capped THEN 0.15::DOUBLE ELSE (exposure - k * 0.15::DOUBLE) * score / rest END AS weight FROM (
  SELECT *, count(*) FILTER (capped) OVER (PARTITION BY pool) AS k, sum(CASE WHEN NOT capped THEN score END) OVER (PARTITION BY pool) AS rest FROM (
    SELECT *, (exposure - (i - 1) * 0.15::DOUBLE) * score / suffix > 0.15::DOUBLE AS capped FROM (
      SELECT *, least(1.0::DOUBLE, n * 0.15::DOUBLE) AS exposure, sum(score) OVER (PARTITION BY pool ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM (
        SELECT *, count(*) OVER (PARTITION BY pool) AS n, row_number() OVER (PARTITION BY pool ORDER BY score DESC, symbol) AS i FROM (SELECT *, 1 / greatest(volatility, 0.1::DOUBLE) AS score FROM members)))))""",
)


@query("SELECT pool, symbol, round(score, 8) AS score, round(weight, 8) AS weight, round(1 - exposure, 8) AS cash_weight FROM water")
def capped_inverse_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = portfolio.inverse_volatility(members(spark, sf_dir), ["pool"])
    return w.select("pool", "symbol", *[F.round(c, 8).alias(c) for c in ("score", "weight", "cash_weight")])


view(
    "band_rows",
    "SELECT order_id, trade_date, planned_quantity % 7 < 4 AS is_continuing, (planned_quantity % 11)::DOUBLE / 100 AS current_weight, (filled_quantity % 13)::DOUBLE / 100 AS target_weight, planned_quantity * 10 AS current_quantity, filled_quantity * 10 + CAST(planned_quantity % 3 AS BIGINT) * 60 AS target_quantity FROM order_lines",
)


def band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = F.col("planned_quantity"), F.col("filled_quantity")
    o = market.order_lines(spark, sf_dir)
    return o.select(
        "order_id", "trade_date", (p % 7 < 4).alias("is_continuing"), ((p % 11).cast("double") / 100).alias("current_weight"), ((f % 13).cast("double") / 100).alias("target_weight"), (p * 10).alias("current_quantity"), (f * 10 + p % 3 * 60).alias("target_quantity")
    )


view(
    "decisions",
    """
SELECT *, CASE WHEN reason IN ('rebalance_outside_band', 'entering_position', 'exiting_position') THEN CASE WHEN dq > 0 THEN 'BUY' ELSE 'SELL' END ELSE '' END AS order_side,
  CASE WHEN reason IN ('rebalance_outside_band', 'entering_position', 'exiting_position') THEN abs(dq) ELSE 0 END AS order_quantity FROM (
  SELECT *, CASE WHEN is_continuing AND abs(target_weight - current_weight) < 0.02::DOUBLE THEN 'within_rebalance_band' WHEN dq = 0 AND is_continuing THEN 'within_rebalance_band' WHEN dq = 0 THEN 'at_target' WHEN abs(dq) < 100 THEN 'below_one_lot'
    WHEN is_continuing THEN 'rebalance_outside_band' WHEN dq > 0 THEN 'entering_position' ELSE 'exiting_position' END AS reason FROM (SELECT *, target_quantity - current_quantity AS dq FROM band_rows))""",
)


@query("SELECT order_id, is_continuing, reason, order_side, order_quantity FROM decisions")
def rebalance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.apply_band(band_rows(spark, sf_dir)).select("order_id", "is_continuing", "reason", "order_side", "order_quantity")


@query("SELECT CAST(year(trade_date) AS INT) AS year, reason, count(*) AS n, round(sum(abs(target_weight - current_weight) * 1e6::DOUBLE), 2) AS suppressed_amount FROM decisions WHERE reason IN ('within_rebalance_band', 'below_one_lot') GROUP BY 1, 2")
def suppressed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.diagnostics import suppressed_amounts as amounts

    d = portfolio.apply_band(band_rows(spark, sf_dir)).withColumn("equity", F.lit(1e6)).withColumn("year", F.year("trade_date"))
    return amounts(d, ["year"]).withColumn("suppressed_amount", F.round("suppressed_amount", 2))


# Rates in force by day, as a small dated book; order days run from 1995.
view(
    "rates",
    """
SELECT * FROM (VALUES ('zero_cost', DATE '1990-01-01', 0::DECIMAL(9,6), 0::DECIMAL(9,2), 0::DECIMAL(9,6), 0::DECIMAL(9,6)), ('full_cost', DATE '1990-01-01', 0.0003, 5, 0.001, 0.001), ('full_cost', DATE '1998-06-15', 0.0003, 5, 0.0005, 0.001)) t(scenario, since, commission_rate, minimum_commission, stamp_tax_rate, slippage_rate)""",
)
RATES = {"zero_cost": [("1990-01-01", "0", "0", "0", "0")], "full_cost": [("1990-01-01", "0.0003", "5", "0.001", "0.001"), ("1998-06-15", "0.0003", "5", "0.0005", "0.001")]}


@query("SELECT o.order_id, r.scenario, r.stamp_tax_rate::DOUBLE AS stamp_tax_rate FROM order_lines o JOIN (SELECT *, lead(since) OVER (PARTITION BY scenario ORDER BY since) AS until FROM rates) r ON o.trade_date >= r.since AND (r.until IS NULL OR o.trade_date < r.until)")
def effective_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.temporal import effective_join

    rates = money.rates(spark, RATES)
    o = market.order_lines(spark, sf_dir).crossJoin(F.broadcast(rates.select("scenario").distinct()))
    return effective_join(o, rates, "trade_date", "effective_from", ["scenario"]).select("order_id", "scenario", F.col("stamp_tax_rate").cast("double").alias("stamp_tax_rate"))


view(
    "quotes",
    """
SELECT order_id, symbol, side, scenario, trade_date, quantity, px AS price, px * quantity AS gross, round(greatest((px * quantity) * commission_rate, minimum_commission), 2) AS commission, CASE WHEN side = 'SELL' THEN round((px * quantity) * stamp_tax_rate, 2) ELSE 0 END AS stamp_tax
FROM (SELECT o.*, CAST(o.filled_quantity AS DECIMAL(9,0)) AS quantity, r.scenario, r.commission_rate, r.minimum_commission, r.stamp_tax_rate, CAST(round(CAST(o.price AS DECIMAL(12,2)) * CAST(CASE WHEN o.side = 'BUY' THEN 1 + r.slippage_rate ELSE 1 - r.slippage_rate END AS DECIMAL(9,6)), 2) AS DECIMAL(12,2)) AS px
  FROM order_lines o JOIN (SELECT *, lead(since) OVER (PARTITION BY scenario ORDER BY since) AS until FROM rates) r ON o.trade_date >= r.since AND (r.until IS NULL OR o.trade_date < r.until) WHERE o.filled_quantity > 0)""",
)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = money.rates(spark, RATES)
    o = market.order_lines(spark, sf_dir).filter("filled_quantity > 0").select("order_id", "symbol", "side", "trade_date", F.col("filled_quantity").alias("quantity"), F.col("price").alias("raw_price"), "reference_price")
    return money.quote(o.crossJoin(F.broadcast(rates.select("scenario").distinct())), rates)


@query("SELECT order_id, scenario, price::DOUBLE AS price, gross::DOUBLE AS gross, commission::DOUBLE AS commission, stamp_tax::DOUBLE AS stamp_tax FROM quotes")
def cost_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).select("order_id", "scenario", *[F.col(c).cast("double").alias(c) for c in ("price", "gross", "commission", "stamp_tax")])


view(
    "limit_rows",
    """
SELECT b.symbol, b.trade_date, m.board, CASE WHEN b.volume % 9 = 0 THEN 'ST' ELSE 'NORMAL' END AS status, CAST(lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.trade_date) AS DECIMAL(12,2)) AS pre_close, CAST(b.open AS DECIMAL(12,2)) AS price, CASE WHEN b.volume % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  row_number() OVER (PARTITION BY b.symbol ORDER BY b.trade_date) AS listed_sessions FROM bars b JOIN master m USING (symbol)""",
)
view("limit_book", "SELECT * FROM (VALUES ('sh_main', 'NORMAL', DATE '1990-01-01', 0.10), ('sh_main', 'ST', DATE '1990-01-01', 0.05), ('sz_main', 'NORMAL', DATE '1990-01-01', 0.10), ('chinext', 'NORMAL', DATE '1990-01-01', 0.10), ('chinext', 'NORMAL', DATE '1998-08-24', 0.20), ('star', 'NORMAL', DATE '1997-07-22', 0.20)) t(board, status, since, rate)")
LIMITS = [(("sh_main", "sz_main"), ("NORMAL",), "1990-01-01", "0.10"), (("sh_main",), ("ST",), "1990-01-01", "0.05"), (("chinext",), ("NORMAL",), "1990-01-01", "0.10"), (("chinext",), ("NORMAL",), "1998-08-24", "0.20"), (("star",), ("NORMAL",), "1997-07-22", "0.20")]
OPEN_SESSIONS = [(("star", "chinext"), "1990-01-01", 5)]


@query(
    """
SELECT symbol, trade_date, side, lower::DOUBLE AS lower, upper::DOUBLE AS upper, CASE WHEN NOT covered THEN 'uncovered_rule' WHEN side = 'BUY' AND price >= upper THEN 'buy_at_upper_limit' WHEN side = 'SELL' AND price <= lower THEN 'sell_at_lower_limit' END AS reason FROM (
  SELECT *, is_open OR rate IS NOT NULL AS covered, CASE WHEN NOT is_open THEN round(pre_close * (1 + rate), 2) END AS upper, CASE WHEN NOT is_open THEN round(pre_close * (1 - rate), 2) END AS lower FROM (
    SELECT l.*, r.rate::DECIMAL(5,2) AS rate, l.board IN ('star', 'chinext') AND l.listed_sessions <= 5 AS is_open FROM limit_rows l LEFT JOIN (SELECT *, lead(since) OVER (PARTITION BY board, status ORDER BY since) AS until FROM limit_book) r
      ON l.board = r.board AND l.status = r.status AND l.trade_date >= r.since AND (r.until IS NULL OR l.trade_date < r.until)))"""
)
def limit_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = market.bars(spark, sf_dir).withColumn("pre_close", F.lag("close").over(w)).withColumn("listed_sessions", F.row_number().over(w)).join(market.master(spark, sf_dir).select("symbol", "board"), "symbol")
    b = b.withColumn("status", F.when(F.col("volume") % 9 == 0, "ST").otherwise("NORMAL")).withColumn("side", F.when(F.col("volume") % 2 == 0, "BUY").otherwise("SELL"))
    p = money.price_limits(b, money.limit_rules(spark, LIMITS), money.open_session_rules(spark, OPEN_SESSIONS))
    reason = money.block_reason(F.col("side"), F.col("open").cast("decimal(12,2)"))
    return p.select("symbol", "trade_date", "side", F.col("lower").cast("double").alias("lower"), F.col("upper").cast("double").alias("upper"), reason.alias("reason"))


def fold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum and risk of all names at every signal, with the year as the fold."""
    s, r = scored(spark, sf_dir), risk(spark, sf_dir)
    j = s.join(r.select("trade_date", "symbol", "risk_is_valid", "risk_invalid_reason", "applied_annualized_volatility"), ["trade_date", "symbol"], "left")
    return j.select(F.year("trade_date").alias("fold_id"), F.col("trade_date").alias("signal_date"), "symbol", "processed_value", "is_valid", "invalid_reason", "risk_is_valid", "risk_invalid_reason", "applied_annualized_volatility")


@query()
def buffered_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.buffered_targets(fold_candidates(spark, sf_dir), "fold_id")


@query()
def construction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.diagnostics import construction_summary as summary

    return summary(portfolio.buffered_targets(fold_candidates(spark, sf_dir), "fold_id"), ["fold_id"])


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of the calendar, each under every scenario."""
    y = market.open_days(spark, sf_dir).select(F.year("day").alias("fold_id")).distinct()
    scenario = F.explode(F.array(*map(F.lit, RATES))).alias("scenario")
    return y.select("fold_id", scenario, F.make_date("fold_id", F.lit(1), F.lit(1)).alias("first_day"), F.make_date("fold_id", F.lit(12), F.lit(31)).alias("last_day"))


def trading_bars(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    b = market.bars(spark, sf_dir).join(market.master(spark, sf_dir).select("symbol", "board"), "symbol")
    b = b.withColumn("quality_severity", F.lit("INFO")).withColumn("status", F.lit("NORMAL")).withColumn("listed_sessions", F.lit(None).cast("int"))
    limits = [(("sh_main", "sz_main", "chinext", "star"), ("NORMAL",), "1990-01-01", "0.90")]
    return replay.executable_bars(b, money.rates(spark, RATES), money.limit_rules(spark, limits), money.open_session_rules(spark, OPEN_SESSIONS), names)


def quantity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-weight books, executed on the next open day; a signal whose book is empty stays, with a null symbol."""
    t = portfolio.top_equal_weight(scored(spark, sf_dir), market.bars(spark, sf_dir), 85_000_000.0)
    t = signals(spark, sf_dir).join(t, "trade_date", "left")
    t = calendars.next_open_day(t.withColumnRenamed("trade_date", "signal_date"), market.calendar(spark, sf_dir), "signal_date", "trade_date").filter("trade_date IS NOT NULL")
    return t.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in RATES], "scenario string"))).select(F.year("trade_date").alias("fold_id"), "scenario", "trade_date", "symbol", "target_quantity")


view("equal_weight_book", "SELECT s.trade_date AS signal_date, (SELECT min(day) FROM open_days WHERE day > s.trade_date) AS execution_date, t.symbol, t.target_quantity FROM signals s LEFT JOIN (SELECT r.trade_date, r.symbol, CAST(floor(85000000.0::DOUBLE / 10 / b.close / 100) * 100 AS BIGINT) AS target_quantity FROM ranked r JOIN bars b USING (trade_date, symbol) WHERE r.rank <= 10 AND floor(85000000.0::DOUBLE / 10 / b.close / 100) > 0) t USING (trade_date)")


def equal_weight_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = portfolio.top_equal_weight(scored(spark, sf_dir), market.bars(spark, sf_dir), 85_000_000.0)
    s = calendars.next_open_day(signals(spark, sf_dir).withColumnRenamed("trade_date", "signal_date"), market.calendar(spark, sf_dir), "signal_date", "execution_date")
    return portfolio.target_book(s, t)


@query("SELECT execution_date, signal_date, symbol, target_quantity FROM equal_weight_book WHERE execution_date IS NOT NULL")
def target_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's book on the day after its signal; the weeks before there is a signal for any name are empty books."""
    return equal_weight_book(spark, sf_dir)


@query("SELECT CAST(year(execution_date) AS INT) AS fold_id, symbol, min(execution_date) AS first_day, count(*) AS n_periods FROM equal_weight_book WHERE execution_date IS NOT NULL AND symbol IS NOT NULL GROUP BY 1, 2")
def possible_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that each year's books may hold."""
    return portfolio.possible_names(equal_weight_book(spark, sf_dir).withColumn("fold_id", F.year("execution_date")), ["fold_id"])


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = market.actions(spark, sf_dir).filter("status = 'implemented' AND rights = 0").groupBy("symbol", "ex_date").agg(
        F.min("record_date").alias("record_date"), F.sum("cash").alias("cash"), F.sum("bonus").alias("bonus"), F.sum("capitalization").alias("capitalization"), F.lit("implemented").alias("status"), F.lit(0.0).alias("rights")
    )
    targets = quantity_targets(spark, sf_dir)
    return replay.replay(targets, trading_bars(spark, sf_dir, targets), events, market.calendar(spark, sf_dir), windows(spark, sf_dir), ["fold_id", "scenario"], Decimal("100000000.00"))


@query()
def account_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir)


@query()
def weight_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffered books as weight targets: priced at signal closes, kept within the rebalance band."""
    audit = portfolio.buffered_targets(fold_candidates(spark, sf_dir), "fold_id")
    kept = settled(audit.select("fold_id", F.col("signal_date"), "symbol", F.when(F.col("target_weight") > 0, F.col("target_weight")).otherwise(F.lit(0).cast("decimal(18,12)")).alias("target_weight"), (F.col("previous_target_member") & (F.col("target_weight") > 0)).alias("continuing")))
    from tessaro.operators.temporal import asof_join

    # every name that a fold may hold has a price at each of its signals
    ever = kept.filter("target_weight > 0").select("fold_id", "symbol").distinct()
    grid = kept.select("fold_id", "signal_date").distinct().join(ever, "fold_id").join(kept, ["fold_id", "signal_date", "symbol"], "left").na.fill({"continuing": False})
    grid = grid.withColumn("target_weight", F.coalesce("target_weight", F.lit(0).cast("decimal(18,12)")))
    priced = asof_join(grid, market.bars(spark, sf_dir).withColumn("signal_price", F.col("close")), "signal_date", "trade_date", ["symbol"], ["signal_price"]).filter("signal_price IS NOT NULL")
    t = calendars.next_open_day(priced, market.calendar(spark, sf_dir), "signal_date", "trade_date").filter("year(trade_date) = fold_id")
    t = settled(t)
    t = t.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in RATES], "scenario string"))).select("fold_id", "scenario", "trade_date", "symbol", "target_weight", "signal_price", "continuing")
    none = spark.createDataFrame([], "symbol string, ex_date date, record_date date, cash double, bonus double, capitalization double, status string, rights double")
    return replay.replay(t, trading_bars(spark, sf_dir, t), none, market.calendar(spark, sf_dir), windows(spark, sf_dir), ["fold_id", "scenario"], Decimal("100000000.00"))


@query("SELECT count(*) FILTER (b.symbol IS NULL) AS no_bar, count(*) FILTER (b.symbol IS NOT NULL AND b.prior IS NULL) AS no_prior_close FROM (SELECT DISTINCT concat('S', o_custkey % 10) AS symbol, CAST(o_orderdate AS DATE) AS trade_date FROM orders) p LEFT JOIN (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prior FROM bars) b USING (symbol, trade_date)")
def replay_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 10).alias("symbol"), day("o_orderdate").alias("trade_date"))
    days = market.open_days(spark, sf_dir).select(F.col("day").alias("trade_date"))
    f = replay.readiness_faults(plan, market.bars(spark, sf_dir).withColumn("quality_severity", F.lit("INFO")), days, days)
    return f.agg(F.count_if(F.col("fault") == "no_bar").alias("no_bar"), F.count_if(F.col("fault") == "no_prior_close").alias("no_prior_close"))


@query("SELECT o.order_id, o.planned_quantity, o.filled_quantity, o.rejected_quantity, CASE WHEN o.filled_quantity >= o.planned_quantity THEN 'FILLED' WHEN o.filled_quantity > 0 THEN 'PARTIAL' ELSE 'REJECTED' END AS status, o.filled_quantity + o.rejected_quantity = o.planned_quantity AS balanced FROM order_lines o")
def order_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.merging import reconcile_orders

    line = table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("order_id"), F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag")
    plan = line.groupBy("order_id").agg(F.sum("quantity").alias("planned_quantity"))
    refused = line.filter("l_returnflag = 'N'").select("order_id", F.col("quantity").alias("rejected_quantity"), F.lit("insufficient_cash").alias("reason"))
    out = reconcile_orders(plan, line.filter("l_returnflag <> 'N'"), refused)
    return out.select("order_id", "planned_quantity", "filled_quantity", "rejected_quantity", "status", "balanced")


@query("SELECT order_id, CASE WHEN n > 1 THEN 'repeated_order' WHEN k > 1 THEN 'repeated_rejection' WHEN filled > 0 AND rejected > 0 THEN 'filled_and_rejected' END AS fault FROM (SELECT concat(l_orderkey, '-', l_linenumber) AS order_id, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS k, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS filled, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS rejected FROM lineitem GROUP BY 1) WHERE n > 1")
def ledger_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.merging import ledger_faults

    line = table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("order_id"), F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag")
    refused = line.filter("l_returnflag = 'N'").select("order_id", F.col("quantity").alias("rejected_quantity"))
    return ledger_faults(line, line.filter("l_returnflag <> 'N'"), refused, strict=True)


@query("SELECT coalesce(a.order_id, b.order_id) AS order_id, CASE WHEN b.order_id IS NULL THEN 'not_submitted' WHEN a.order_id IS NULL THEN 'not_planned' WHEN a.side <> b.side THEN 'side' WHEN a.planned_quantity <> b.q THEN 'planned_quantity' END AS difference FROM order_lines a FULL JOIN (SELECT CASE WHEN planned_quantity % 41 = 0 THEN order_id || 'x' ELSE order_id END AS order_id, side, planned_quantity + CASE WHEN filled_quantity % 37 = 1 THEN 1 ELSE 0 END AS q FROM order_lines) b ON a.order_id = b.order_id WHERE a.order_id IS NULL OR b.order_id IS NULL OR a.planned_quantity <> b.q")
def plan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.merging import plan_differences

    o = market.order_lines(spark, sf_dir)
    p = F.col("planned_quantity")
    sent = o.select(F.when(p % 41 == 0, F.concat("order_id", F.lit("x"))).otherwise(F.col("order_id")).alias("order_id"), "side", (p + F.when(F.col("filled_quantity") % 37 == 1, 1).otherwise(0)).alias("planned_quantity"))
    return plan_differences(o.select("order_id", "side", "planned_quantity"), sent, ["side", "planned_quantity"])


@query("SELECT scenario, order_id, trade_date, CAST(1000000000 + sum(delta) OVER (PARTITION BY scenario ORDER BY trade_date, order_id) AS DOUBLE) AS cash FROM (SELECT scenario, order_id, trade_date, CASE WHEN side = 'SELL' THEN gross - commission - stamp_tax ELSE -gross - commission END AS delta FROM quotes)")
def cash_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.operators.merging import cash_ledger as ledger

    q = quotes(spark, sf_dir)
    delta = F.when(F.col("side") == "SELL", F.col("gross") - F.col("commission") - F.col("stamp_tax")).otherwise(-F.col("gross") - F.col("commission"))
    none = spark.createDataFrame([], "scenario string, ex_date date, seq string, cash_credited decimal(18,2)")
    out = ledger(q.select("scenario", "trade_date", F.col("order_id").alias("seq"), delta.alias("cash_delta")), none, 1_000_000_000.0, ["scenario"])
    return out.select("scenario", F.col("seq").alias("order_id"), F.col("day").alias("trade_date"), F.col("cash").cast("double").alias("cash"))
