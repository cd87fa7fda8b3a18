"""Point-in-time factors: momentum, forward returns, ranks, buckets. A factor is a function from bars to a factor frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.temporal import asof_join

FACTORS: dict[str, Callable[..., DataFrame]] = {}


def factor(name: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FACTORS[name] = f
        return f

    return register


def momentum_by_bar(bars: DataFrame, lag: int = 60, seasoning: int = 120) -> DataFrame:
    """At every bar (symbol, trade_date, adjusted_close, quality_severity, listed_days): close over the close ``lag``
    observations before, less one, or why it can't be used: too few observations, an ERROR among them, too short a listing."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    # running counts and what they were before the window: a frame of lag rows would be read again for every row
    errors = F.count_if(F.col("quality_severity") == "ERROR").over(w.rowsBetween(Window.unboundedPreceding, 0))
    j = bars.withColumns({"_n": F.row_number().over(w), "_errors": errors, "_then": F.lag("adjusted_close", lag).over(w)})
    j = j.withColumn("_bad", F.col("_errors") > F.coalesce(F.lag("_errors", lag + 1).over(w), F.lit(0)))
    reason = F.when(F.col("_n") <= lag, "insufficient_observations").when(F.col("_bad"), "quality_error").when(F.col("listed_days") < seasoning, "seasoning_below_120")
    value = F.when(reason.isNull(), F.col("adjusted_close") / F.col("_then") - 1)
    return j.select("symbol", "trade_date", value.alias("raw_value"), reason.alias("invalid_reason"))


@factor("momentum_60d")
def momentum(bars: DataFrame, signals: DataFrame, symbols: DataFrame | None = None, lag: int = 60, seasoning: int = 120) -> DataFrame:
    """Momentum as of each signal day: a name without a bar on that day has the value of its last bar before it.

    signals: trade_date. Names without any bar by then give no row. Later bars never change a value.
    """
    by_bar = momentum_by_bar(bars, lag, seasoning)
    names = symbols if symbols is not None else bars.select("symbol").distinct()
    asked = names.crossJoin(F.broadcast(signals.select("trade_date").distinct()))
    found = asof_join(asked, by_bar.withColumn("_seen", F.lit(True)), "trade_date", "trade_date", ["symbol"], ["_seen", "raw_value", "invalid_reason"])
    return found.filter("_seen").select(
        "trade_date", "symbol", F.lit("momentum_60d").alias("factor_name"), F.lit("1").alias("factor_version"), "raw_value", F.col("raw_value").alias("processed_value"), F.col("invalid_reason").isNull().alias("is_valid"), "invalid_reason"
    )


def mixed_series(bars: DataFrame) -> DataFrame:
    """Names with bars of more than one source family or adjustment: they must not be put in one series."""
    return bars.groupBy("symbol").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("adjustment").alias("n_adjustments")).filter("n_sources > 1 OR n_adjustments > 1")


def forward_return(bars: DataFrame, days: DataFrame, ahead: int = 5) -> DataFrame:
    """close ``ahead`` days of the common grid later over today's, less one; null where the name has no bar on that day.

    days: trade_date of the grid; numbering it turns the shift into an equi-join, whatever gaps a name has.
    """
    at = days.select("trade_date").distinct().withColumn("_ord", F.row_number().over(Window.orderBy("trade_date")))
    b = bars.select("symbol", "trade_date", "close").join(F.broadcast(at), "trade_date")
    later = b.select("symbol", (F.col("_ord") - ahead).alias("_ord"), F.col("close").alias("_later"))
    return b.join(later, ["symbol", "_ord"], "left").select("symbol", "trade_date", (F.col("_later") / F.col("close") - 1).alias("forward_return"))


def forward_return_by_bar(bars: DataFrame, ahead: int = 5) -> DataFrame:
    """close ``ahead`` of the name's own bars later over today's, less one."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return bars.select("symbol", "trade_date", (F.lead("close", ahead).over(w) / F.col("close") - 1).alias("forward_return"))


def rank_desc(by: str = "trade_date", value: str = "processed_value") -> Column:
    """Position from 1, greatest value first, names in order of the alphabet where values tie."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), "symbol"))


def average_rank(by: list[str], value: str) -> Column:
    """Ascending rank from 1; ties share the mean of their places."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return first + (ties - 1) / 2


def bucket(by: list[str], value: str, n: int = 5) -> Column:
    """Quantile bucket from 1 of a row's position, as cutting positions 0..m-1 at their own quantiles does (not ntile)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value, "symbol")) - 1
    last = F.count("*").over(Window.partitionBy(*by)) - 1
    return F.greatest(F.lit(1), F.ceil(F.lit(n) * place / F.nullif(last, F.lit(0)))).cast("int")


def input_audit(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows, ERROR rows and a histogram of invalid reasons."""
    n = bars.agg(F.count("*").alias("n"), F.count_if(F.col("quality_severity") == "ERROR").alias("bad"))
    rows = n.select(F.explode(F.array(F.struct(F.lit("rows").alias("what"), F.col("n")), F.struct(F.lit("error_rows").alias("what"), F.col("bad").alias("n")))).alias("x")).select("x.*")
    reasons = factors.filter("NOT is_valid").groupBy(F.concat(F.lit("invalid:"), "invalid_reason").alias("what")).agg(F.count("*").alias("n"))
    return rows.unionByName(reasons)
