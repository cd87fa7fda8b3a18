"""Data-quality queries: rows in, issues (severity, code, symbol, trade_date, details JSON) out, and the publication gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessaro.functions.clean import first_reason, no_nan
from tessaro.operators.temporal import missing_from_grid

PRICES = ("open", "high", "low", "close")
# Sources and adjustments that a published bar may carry, and codes that block a publication.
KNOWN_SOURCES = ("tushare", "akshare", "baostock", "tushare_suspend")
KNOWN_ADJUSTMENTS = ("unadjusted",)
BLOCKING = (
    "schema_mismatch",
    "duplicate_conflict",
    "invalid_ohlc",
    "nonpositive_price",
    "negative_volume",
    "negative_amount",
    "unknown_source",
    "unknown_adjustment",
    "quarantine_missing_reason",
    "report_generation_failed",
    "adjusted_bar_missing_raw",
    "adjusted_bar_raw_close_mismatch",
    "adjusted_bar_wrong_basis",
    "adjusted_bar_unknown_action",
    "unexplained_primary_gap",
)
SEVERITIES = ("INFO", "WARNING", "ERROR", "FATAL")


def issue(severity: str | Column, code: str | Column, **details: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    told = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit("{}")
    return F.struct(lit(severity).alias("severity"), lit(code).alias("code"), told.alias("details"))


def issues_of(rows: DataFrame, *cases: tuple[Column, Column]) -> DataFrame:
    """One output row for each (row, case that holds): a row may have several issues; null conditions don't hold."""
    found = F.array_compact(F.array(*[F.when(c, i) for c, i in cases]))
    return rows.select("symbol", "trade_date", F.explode(found).alias("i")).select("i.severity", "i.code", "symbol", "trade_date", "i.details")


def value_issues(bars: DataFrame) -> DataFrame:
    """Non-positive prices, negative volume or amount, prices out of order. A missing or NaN price is out of order, not negative."""
    p = {c: no_nan(F.col(c).cast("double")) for c in (*PRICES, "volume", "amount")}
    low, high = p["low"], p["high"]
    ordered = (low <= p["open"]) & (p["open"] <= high) & (low <= p["close"]) & (p["close"] <= high)
    some = lambda cs: reduce(lambda a, b: a | b, cs)
    return issues_of(
        bars,
        (some([F.coalesce(p[c] <= 0, F.lit(False)) for c in PRICES]), issue("ERROR", "nonpositive_price", **{c: F.when(p[c] <= 0, p[c]) for c in PRICES})),
        (p["volume"] < 0, issue("ERROR", "negative_volume", value=p["volume"])),
        (p["amount"] < 0, issue("ERROR", "negative_amount", value=p["amount"])),
        (~F.coalesce(ordered, F.lit(False)), issue("ERROR", "invalid_ohlc", **{c: p[c] for c in PRICES})),
    )


def provenance_issues(bars: DataFrame) -> DataFrame:
    unknown = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    return issues_of(
        bars,
        (unknown("source", KNOWN_SOURCES), issue("ERROR", "unknown_source", value=F.col("source"))),
        (unknown("adjustment", KNOWN_ADJUSTMENTS), issue("ERROR", "unknown_adjustment", value=F.col("adjustment"))),
    )


def key_issues(rows: DataFrame, key: list[str]) -> DataFrame:
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    pick = lambda c: F.col(c) if c in key else F.lit(None).cast("string" if c == "symbol" else "date").alias(c)
    return twice.select(F.lit("ERROR").alias("severity"), F.lit("duplicate_conflict").alias("code"), pick("symbol"), pick("trade_date"), F.to_json(F.struct("n")).alias("details"))


def quarantine_issues(rows: DataFrame) -> DataFrame:
    """Quarantined rows need a reason."""
    return issues_of(rows.withColumnRenamed("ex_date", "trade_date"), (F.coalesce(F.trim("reason"), F.lit("")) == "", issue("ERROR", "quarantine_missing_reason")))


def schema_faults(rows: DataFrame, wanted: StructType) -> list[str]:
    """How the columns differ from the wanted ones, order included; empty if they don't."""
    have, want = [(f.name, f.dataType.simpleString()) for f in rows.schema], [(f.name, f.dataType.simpleString()) for f in wanted]
    return [] if have == want else [f"columns are {have}; wanted {want}"]


def missing_code() -> Column:
    """Why a bar of (name, day) is asked for: trade_date, list_date, delist_date, is_trading_day, in_primary, in_validation. The first
    reason that holds; a null flag of a source is no bar, a null is_trading_day an open day."""
    yes = lambda c, default=False: F.coalesce(c, F.lit(default))
    return (
        F.when(F.col("trade_date") < F.col("list_date"), "not_listed")
        .when(F.col("trade_date") > F.col("delist_date"), "delisted")
        .when(~yes("is_trading_day", True), "non_trading_day")
        .when(~yes("in_primary") & ~yes("in_validation"), "unknown_or_suspended")
        .when(~yes("in_primary"), "primary_source_missing")
        .otherwise("unexplained")
    )


def classify_asked(asked: DataFrame, listing: DataFrame, days: DataFrame, primary: DataFrame, validation: DataFrame) -> DataFrame:
    """Each asked (symbol, trade_date) with its missing_code, whether a source has it or not: one row for each row of asked.
    A name without a listing has no boundaries."""
    has = lambda rows, flag: rows.select("symbol", "trade_date").distinct().withColumn(flag, F.lit(True))
    open_ = days.select(F.col("day").alias("trade_date"), F.lit(True).alias("_open")).distinct()
    j = asked.select("symbol", "trade_date").join(listing.select("symbol", "list_date", "delist_date"), "symbol", "left").join(open_, "trade_date", "left")
    j = j.join(has(primary, "in_primary"), ["symbol", "trade_date"], "left").join(has(validation, "in_validation"), ["symbol", "trade_date"], "left")
    return j.withColumn("is_trading_day", F.col("_open").isNotNull()).select("symbol", "trade_date", missing_code().alias("code"))


def missing_rows(listing: DataFrame, calendar: DataFrame, primary: DataFrame, validation: DataFrame, start, end) -> DataFrame:
    """Each (name, open day) of the window without a primary bar, classified. Names listed after the window's first open day
    or delisted before its last one are left out, as the source's scan does."""
    days = calendar.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("day")
    first, last = days.agg(F.min("day")).scalar(), days.agg(F.max("day")).scalar()
    names = listing.filter((F.col("list_date").isNull() | (F.col("list_date") <= first)) & (F.col("delist_date").isNull() | (F.col("delist_date") >= last))).select("symbol", "list_date", "delist_date")
    absent = missing_from_grid(names, days, primary, ["symbol"], "trade_date").join(names, "symbol")
    seen = validation.select("symbol", "trade_date").distinct().withColumn("in_validation", F.lit(True))
    return absent.join(seen, ["symbol", "trade_date"], "left").withColumns({"is_trading_day": F.lit(True), "in_primary": F.lit(False)}).select("symbol", "trade_date", missing_code().alias("code"))


# What a bar without the column says of its adjustment and units.
BASIS = {"adjustment": "unadjusted", "volume_unit": "share", "amount_unit": "yuan"}


def compare_sources(left: DataFrame, right: DataFrame, absolute: float = 0.01, relative: float = 0.0005, close_error: float = 0.002) -> DataFrame:
    """Price differences of two suppliers' bars by (symbol, trade_date): a wide close is an ERROR, a price over both
    tolerances a WARNING, other differences INFO; equal or missing prices give none.

    Bars on another adjustment, or else in other units, aren't compared: they give one WARNING without a field. A table without
    one of these columns has the default of BASIS.
    """
    a, b = left.alias("a"), right.alias("b")
    j = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.trade_date") == F.col("b.trade_date")))
    said = lambda rows, side, c: F.col(f"{side}.{c}") if c in rows.columns else F.lit(BASIS[c])
    other = lambda c: ~said(left, "a", c).eqNullSafe(said(right, "b", c))
    basis = first_reason((other("adjustment"), "adjustment_basis_mismatch"), (other("volume_unit") | other("amount_unit"), "unit_mismatch"))
    prices = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("double").alias("left"), F.col(f"b.{c}").cast("double").alias("right")) for c in PRICES])
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("left"), F.lit(None).cast("double").alias("right")))
    d = j.select(F.col("a.symbol").alias("symbol"), F.col("a.trade_date").alias("trade_date"), basis.alias("_basis"), F.explode(F.when(basis.isNotNull(), none).otherwise(prices)).alias("p"))
    d = d.select("symbol", "trade_date", "_basis", "p.*").filter("_basis IS NOT NULL OR left <> right")
    gap = F.abs(F.col("left") - F.col("right"))
    d = d.withColumn("absolute_difference", gap).withColumn("relative_difference", F.when(F.col("left") != 0, gap / F.abs("left")).when(F.col("left") == 0, F.lit(float("inf"))))
    wide = (F.col("field") == "close") & (F.col("relative_difference") > close_error)
    some = (F.col("absolute_difference") > absolute) & (F.col("relative_difference") > relative)
    severity = F.when(F.col("_basis").isNotNull(), "WARNING").when(wide, "ERROR").when(some, "WARNING").otherwise("INFO")
    code = F.when(F.col("_basis").isNotNull(), F.col("_basis")).when(wide, "close_difference").when(some, "price_difference").otherwise("within_tolerance")
    return d.withColumns({"severity": severity, "code": code}).drop("_basis")


def first_two_sources(bars: DataFrame) -> DataFrame:
    """The bars of several suppliers paired by (symbol, trade_date): the first two in the alphabet."""
    each = bars.groupBy("symbol", "trade_date").agg(F.sort_array(F.collect_list(F.struct("source", *PRICES))).alias("s")).filter(F.size("s") > 1)
    return each.select("symbol", "trade_date", F.col("s")[0].alias("left"), F.col("s")[1].alias("right"))


def boundary_issues(bars: DataFrame, listing: DataFrame) -> DataFrame:
    """Bars outside their name's listing."""
    j = bars.select("symbol", "trade_date").join(listing.select("symbol", "list_date", "delist_date"), "symbol")
    where = first_reason((F.col("trade_date") < F.col("list_date"), "before_list_date"), (F.col("trade_date") > F.col("delist_date"), "after_delist_date"))
    return j.withColumn("boundary", where).filter("boundary IS NOT NULL")


def counts(issues: DataFrame) -> DataFrame:
    """How many issues there are by severity; severities without one count zero."""
    domain = issues.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = issues.groupBy("severity").agg(F.count("*").alias("n"))
    return domain.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def blocking(issues: DataFrame) -> DataFrame:
    """The codes that block a publication, whatever their severity; none means it may go out."""
    return issues.filter(F.col("code").isin(*BLOCKING)).groupBy("code").agg(F.count("*").alias("n"))


def invalid_factor_rows(factors: DataFrame) -> DataFrame:
    """Factor rows that break the frame's rules: a reason exactly where invalid, one row for each (trade_date, symbol)."""
    wrong = factors.filter(F.col("is_valid") == F.col("invalid_reason").isNotNull()).select("trade_date", "symbol", F.lit("reason_mismatch").alias("fault"))
    twice = factors.groupBy("trade_date", "symbol").agg(F.count("*").alias("n")).filter("n > 1").select("trade_date", "symbol", F.lit("repeated").alias("fault"))
    return wrong.unionByName(twice)


def portfolio_frame_faults(targets: DataFrame) -> DataFrame:
    """Rules that target rows (trade_date, symbol, rank, signal_price, target_weight, target_quantity, selection_reason) break: one
    row for each (row, fault). Each date is a frame of its own: names and ranks stand once in it. Numbers that are null or not
    finite break their rule, as do ranks and quantities that aren't positive integers, weights outside (0, 1] and blank reasons."""
    number = lambda c: no_nan(F.col(c).cast("double"))
    finite = lambda x: F.abs(x) < float("inf")
    whole = lambda x: finite(x) & (x >= 1) & (x == F.floor(x))
    once = lambda *by: F.count("*").over(Window.partitionBy(*by)) > 1
    weight, price = number("target_weight"), number("signal_price")
    rules = {
        "rank_not_positive_integer": ~F.coalesce(whole(number("rank")), F.lit(False)),
        "quantity_not_positive_integer": ~F.coalesce(whole(number("target_quantity")), F.lit(False)),
        "price_not_positive": ~F.coalesce(finite(price) & (price > 0), F.lit(False)),
        "weight_outside_unit": ~F.coalesce((weight > 0) & (weight <= 1), F.lit(False)),
        "reason_blank": F.coalesce(F.trim("selection_reason"), F.lit("")) == "",
        "symbol_repeated": F.col("_symbol_again"),
        "rank_repeated": F.col("_rank_again"),
    }
    marked = targets.withColumns({"_symbol_again": once("trade_date", "symbol"), "_rank_again": once("trade_date", "rank")})
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))
    return marked.select("trade_date", "symbol", F.explode(found).alias("fault"))
