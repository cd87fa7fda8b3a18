"""Native layouts of suppliers' frames, brought to the library's columns. A frame of another layout is refused before any row is read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.functions import clean

# Native columns of dividend frames by field, of the two layouts that carry amounts; a field takes the first there is.
DIVIDENDS = {
    "code": ("证券代码", "代码"),
    "announced": ("公告日期", "最新公告日期"),
    "recorded": ("股权登记日",),
    "ex": ("除权除息日",),
    "cash": ("派息(税前)(元/10股)", "现金分红-现金分红比例"),
    "bonus": ("送股(股/10股)", "送转股份-送股比例"),
    "capital": ("转增(股/10股)", "送转股份-转股比例"),
    "progress": ("进度", "方案进度"),
    "plan": ("方案", "方案说明"),
}
# Columns of responses that hold implemented events only, and neither a code nor a progress.
IMPLEMENTED = {"announced": "实施方案公告日期", "recorded": "股权登记日", "ex": "除权日", "cash": "派息比例", "bonus": "送股比例", "capital": "转增比例", "plan": "实施方案分红说明"}
# Columns of responses whose amounts stand in a plan text, and the marks before them.
PLANNED = {"announced": "实施公告日", "recorded": "A股股权登记日", "ex": "A股除权除息日", "progress": "方案进度", "plan": "分红方案说明"}
PLAN_MARKS = {"cash": "派", "bonus": "送", "capital": "转"}
# Columns of index histories, and what their volume counts in shares.
INDEX = [
    ({"day": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "volume": "成交量", "amount": "成交额"}, 100),
    ({"day": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "amount": "amount"}, 1),
]
# Native names of daily bars.
DAILY = {"symbol": ("code", "ts_code", "symbol"), "trade_date": ("date", "trade_date"), "volume": ("volume", "vol")}
DAILY_NUMBERS = ("open", "high", "low", "close", "amount")


class Cleaned(NamedTuple):
    """Rows of daily_bar, native rows with a reason, and an audit of rows that were collapsed."""

    valid: DataFrame
    rejected: DataFrame
    audit: DataFrame


def column(name: str):
    return F.col(f"`{name}`")


def refuse(missing: list[str], what: str) -> None:
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")


def dividends(frame: DataFrame, symbol=None) -> DataFrame:
    """code, announced, recorded, ex, cash, bonus, capital, progress, plan as texts, from any of the three layouts.

    symbol: a column or code of the request, for layouts without one. Implemented-only layouts get the mark of implemented plans. A
    response without columns is one without events.
    """
    if not frame.columns:
        return frame.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in DIVIDENDS))
    have = set(frame.columns)
    own = F.lit(symbol) if isinstance(symbol, str) else symbol
    bare = F.split_part(own, F.lit("."), F.lit(1)) if own is not None else F.lit(None).cast("string")
    if PLANNED["plan"] in have:
        refuse(sorted(set(PLANNED.values()) - have), "a dividend frame of plan texts")
        plan = F.coalesce(column(PLANNED["plan"]), F.lit(""))
        found = {k: column(v) for k, v in PLANNED.items()} | {k: clean.plan_amount(plan, mark) for k, mark in PLAN_MARKS.items()} | {"code": bare, "plan": plan}
    elif not {"证券代码", "公告日期"} <= have and IMPLEMENTED["announced"] in have:
        refuse(sorted(set(IMPLEMENTED.values()) - have), "a dividend frame of implemented events")
        found = {k: column(v) for k, v in IMPLEMENTED.items()} | {"code": bare, "progress": F.lit(clean.IMPLEMENTED_MARK)}
    else:
        first = {k: next((v for v in names if v in have), None) for k, names in DIVIDENDS.items()}
        refuse([k for k, v in first.items() if v is None and k not in ("plan", "code")] + ["code"] * (first["code"] is None and own is None), "a dividend frame")
        found = {k: column(v) if v else bare if k == "code" else F.lit("") for k, v in first.items()}
    return frame.select(*[found[k].cast("string").alias(k) for k in DIVIDENDS])


def index_columns(frame: DataFrame, symbol, source: str) -> list:
    """The columns of a bar from an index history in Chinese or English columns; what can't be read is null."""
    have = set(frame.columns)
    names, factor = INDEX[1] if "date" in have else INDEX[0]
    refuse([v for k, v in names.items() if k != "amount" and v not in have], "an index history")
    number = lambda k: clean.number(column(names[k]))
    amount = number("amount") if names["amount"] in have else F.lit(0.0)
    return [
        clean.trade_date(column(names["day"])).alias("trade_date"), (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), *[number(k).alias(k) for k in ("open", "high", "low", "close")],
        (number("volume") * factor).alias("volume"), amount.alias("amount"), F.lit("unadjusted").alias("adjustment"), F.lit(source).alias("source"),
    ]


def index_history(frame: DataFrame, symbol, source: str = "akshare") -> DataFrame:
    """Bars of an index from a history in Chinese or English columns; without an amount it is 0. symbol: a column or a code."""
    return frame.select(*index_columns(frame, symbol, source))


def index_bars(frame: DataFrame, symbol, ingested_at, source: str = "akshare") -> tuple[DataFrame, DataFrame]:
    """An index history as bars with the time of their ingestion, and native rows with a reason: invalid_trade_date, or invalid_number
    (a price, a volume or, if there is one, an amount that can't be read)."""
    at = F.lit(ingested_at).cast("timestamp") if isinstance(ingested_at, str) else ingested_at
    # row and bar are a column each, so that their names don't meet
    both = frame.select(F.struct(*[column(c) for c in frame.columns]).alias("native"), F.struct(*index_columns(frame, symbol, source), at.alias("ingested_at")).alias("bar"))
    bad = F.lit(False)
    for c in ("open", "high", "low", "close", "volume", "amount"):
        bad = bad | F.col(f"bar.{c}").isNull()
    typed = both.withColumn("reason", clean.first_reason((F.col("bar.trade_date").isNull(), "invalid_trade_date"), (bad, "invalid_number")))
    return typed.filter("reason IS NULL").select("bar.*"), typed.filter("reason IS NOT NULL").select("native.*", "reason")


def daily_bars(frame: DataFrame, source: str, ingested_at) -> Cleaned:
    """A supplier's daily frame as valid, rejected and audit rows.

    Reasons, the first that holds: invalid_symbol, invalid_trade_date, invalid_number, invalid_volume (also a fraction of a share
    after exact scaling). Rows that are the same in every column are one; each that was dropped gives an audit row.
    """
    if source not in clean.UNIT_FACTORS:
        raise ValueError(f"no documented daily layout for {source!r}")
    have = set(frame.columns)
    first = {k: next((v for v in names if v in have), None) for k, names in DAILY.items()}
    refuse([k for k, v in first.items() if v is None] + [c for c in DAILY_NUMBERS if c not in have], f"a daily frame of {source}")
    shares, money = clean.UNIT_FACTORS[source]
    numbers = {c: clean.number(column(c)) for c in DAILY_NUMBERS}
    typed = frame.withColumns(
        {"__symbol": clean.symbol(column(first["symbol"])), "__day": clean.trade_date(column(first["trade_date"])), "__volume": clean.shares(column(first["volume"]), shares), **{f"__{c}": x for c, x in numbers.items()}}
    )
    bad = F.lit(False)
    for c in DAILY_NUMBERS:
        bad = bad | F.col(f"__{c}").isNull()
    reason = clean.first_reason((F.col("__symbol").isNull(), "invalid_symbol"), (F.col("__day").isNull(), "invalid_trade_date"), (bad, "invalid_number"), (F.col("__volume").isNull(), "invalid_volume"))
    # a filter isn't pushed below an explode: pushed, it would read every text anew for each place that the reason names it
    typed = typed.withColumn("reason", F.explode(F.array(reason)))
    rejected = typed.filter("reason IS NOT NULL").select(*[column(c) for c in frame.columns], "reason")
    at = F.lit(ingested_at).cast("timestamp") if isinstance(ingested_at, str) else ingested_at
    good = typed.filter("reason IS NULL").select(
        F.col("__day").alias("trade_date"), F.col("__symbol").alias("symbol"), *[F.col(f"__{c}").alias(c) for c in ("open", "high", "low", "close")], F.col("__volume").alias("volume"),
        (F.col("__amount") * money).alias("amount"), F.lit("unadjusted").alias("adjustment"), F.lit(source).alias("source"), at.alias("ingested_at"),
    )
    counted = good.groupBy(*good.columns).agg(F.count("*").alias("__n"))
    audit = counted.filter("__n > 1").select("source", "symbol", "trade_date", F.lit("duplicate_row_collapse").alias("rule"), F.lit("collapsed").alias("action"), F.lit("").alias("old_value"), F.to_json(F.struct(*good.columns)).alias("new_value"), "ingested_at", F.explode(F.sequence(F.lit(2), F.col("__n").cast("int"))).alias("__k")).drop("__k")
    # both readers of the counts ask for them, so that Spark brings equal rows together once
    return Cleaned(counted.filter("__n > 0").drop("__n"), rejected, audit)
