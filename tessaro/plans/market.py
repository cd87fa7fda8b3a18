"""Market tables derived from the star-schema test tables, as DataFrames and as SQL views of the same rows.

Suppliers play the listed names, shipped lines their trades, order dates the trading calendar, customers the members of
universes, urgent orders the corporate actions, and lines by return flag the fills and rejections of an order book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.plans.registry import view

#: How many names the corporate actions are spread over.
ACTION_NAMES = 100
#: Names of a task where a name has up to a row for every open day: a task's rows grow with the calendar, not with the names.
NAMES_PER_TASK = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the listed names are dealt to."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "supplier").count() // NAMES_PER_TASK))


def day(column: str):
    return F.to_date(column)


def money(column) -> F.Column:
    """A double as an exact decimal of cents, so that sums don't depend on the order of the rows."""
    return F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")


def cents(value: F.Column) -> F.Column:
    """Rounded down to the cent: unlike rounding of a double, the same in every engine."""
    return (F.floor(100 * value).cast("double") / 100).cast("decimal(18,2)")


view(
    "bars",
    """
SELECT concat('S', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
       first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open,
       max(l_extendedprice) AS high, min(l_extendedprice) AS low,
       last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem GROUP BY 1, 2""",
)


def bars(spark: SparkSession, sf_dir: str, lot: F.Column | None = None) -> DataFrame:
    """lot: an expression of symbol, a first column more. Each lot's rows are then in one task, sorted by symbol and day: lines are
    shuffled once, and sorted once."""
    place = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumns({"symbol": F.concat(F.lit("S"), "l_suppkey"), "trade_date": day("l_shipdate")})
    if lot is not None:
        lines = lines.withColumn("lot", lot).repartition("lot")
    return (
        lines.groupBy(*(() if lot is None else ("lot",)), "symbol", "trade_date")
        .agg(
            F.min_by("l_extendedprice", place).alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.max_by("l_extendedprice", place).alias("close"),
            F.sum(F.col("l_quantity").cast("long")).alias("volume"),
            F.sum(money("l_extendedprice")).cast("double").alias("amount"),
        )
    )


view("open_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")
view("calendar", "SELECT day, CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS ord FROM open_days")


def open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(day("o_orderdate").alias("day")).distinct()


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per open day with its ordinal from 1; a calendar has some hundred rows a year, whatever the data."""
    return open_days(spark, sf_dir).select("day", F.row_number().over(Window.orderBy("day")).cast("long").alias("ord"))


view(
    "master",
    """
SELECT concat('S', s_suppkey) AS symbol, s_name AS name,
       CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'sh_main' WHEN 1 THEN 'sz_main' WHEN 2 THEN 'chinext' ELSE 'star' END AS board,
       min(CAST(l_shipdate AS DATE)) AS list_date,
       CASE WHEN s_suppkey % 10 = 0 THEN max(CAST(l_shipdate AS DATE)) END AS delist_date
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name""",
)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(day("l_shipdate")).alias("list_date"), F.max(day("l_shipdate")).alias("last"))
    key = F.col("s_suppkey")
    board = F.element_at(F.array(*map(F.lit, ("sh_main", "sz_main", "chinext", "star"))), (key % 4 + 1).cast("int"))
    return (
        table(spark, sf_dir, "supplier")
        .join(ship, key == F.col("l_suppkey"))
        .select(
            F.concat(F.lit("S"), key).alias("symbol"),
            F.col("s_name").alias("name"),
            board.alias("board"),
            "list_date",
            F.when(key % 10 == 0, F.col("last")).alias("delist_date"),
        )
    )


view(
    "memberships",
    """
SELECT concat('U', o_custkey % 5) AS universe_id, concat('C', o_custkey) AS symbol,
       min(CAST(o_orderdate AS DATE)) AS raw_from,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE max(CAST(o_orderdate AS DATE)) END AS raw_to,
       min(CAST(o_orderdate AS DATE)) + CAST(CASE WHEN o_custkey % 11 = 0 THEN 10 ELSE -3 END AS INT) AS announced
FROM orders GROUP BY o_custkey""",
)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(key)
        .agg(F.min(day("o_orderdate")).alias("raw_from"), F.max(day("o_orderdate")).alias("last"))
        .select(
            F.concat(F.lit("U"), key % 5).alias("universe_id"),
            F.concat(F.lit("C"), key).alias("symbol"),
            "raw_from",
            F.when(key % 7 != 0, F.col("last")).alias("raw_to"),
            F.date_add("raw_from", F.when(key % 11 == 0, 10).otherwise(-3)).alias("announced"),
        )
    )


view(
    "actions",
    f"""
SELECT concat('S', o_custkey % {ACTION_NAMES}) AS symbol, CAST(o_orderdate AS DATE) AS ex_date,
       CAST(o_orderdate AS DATE) - CAST(1 + o_orderkey % 3 AS INT) AS record_date,
       CAST(o_orderdate AS DATE) - CAST(CASE WHEN o_orderkey % 29 = 0 THEN -2 ELSE 20 END AS INT) AS announcement_date,
       floor(o_totalprice / 10) / 10000 AS cash,
       CASE o_orderstatus WHEN 'F' THEN 0.1 ELSE 0.0 END::DOUBLE AS bonus,
       CASE o_orderstatus WHEN 'P' THEN 0.05 ELSE 0.0 END::DOUBLE AS capitalization,
       CASE WHEN o_orderkey % 23 = 0 THEN 0.3 ELSE 0.0 END::DOUBLE AS rights,
       CASE WHEN o_orderkey % 17 = 0 THEN 'planned' ELSE 'implemented' END AS status,
       o_orderkey AS event_key
FROM orders WHERE o_orderpriority = '1-URGENT'""",
)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), day("o_orderdate")
    part = lambda status, share: F.when(F.col("o_orderstatus") == status, F.lit(share)).otherwise(F.lit(0.0))
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderpriority = '1-URGENT'")
        .select(
            F.concat(F.lit("S"), F.col("o_custkey") % ACTION_NAMES).alias("symbol"),
            date.alias("ex_date"),
            F.date_sub(date, (1 + key % 3).cast("int")).alias("record_date"),
            F.date_sub(date, F.when(key % 29 == 0, -2).otherwise(20)).alias("announcement_date"),
            (F.floor(F.col("o_totalprice") / 10).cast("double") / 10000).alias("cash"),
            part("F", 0.1).alias("bonus"),
            part("P", 0.05).alias("capitalization"),
            F.when(key % 23 == 0, F.lit(0.3)).otherwise(F.lit(0.0)).alias("rights"),
            F.when(key % 17 == 0, "planned").otherwise("implemented").alias("status"),
            key.alias("event_key"),
        )
    )


view(
    "order_lines",
    """
SELECT concat(l_orderkey, '-', l_linenumber) AS order_id, concat('S', min(l_suppkey)) AS symbol,
       CASE WHEN l_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
       min(CAST(l_shipdate AS DATE)) AS trade_date,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS planned_quantity,
       CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS filled_quantity,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS rejected_quantity,
       CAST(floor(100 * (sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE)) / 100 AS DECIMAL(18,2)) AS price,
       CAST(floor(100 * (sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE * (1 - min(l_discount)))) / 100 AS DECIMAL(18,2)) AS reference_price,
       CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE * 0.03::DOUBLE) / 100 AS DECIMAL(18,2)) AS commission
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned, filled and rejected quantities of every order with its price, reference price and fee."""
    q = F.col("l_quantity").cast("long")
    total = F.sum(money("l_extendedprice")).cast("double")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.concat(F.lit("S"), F.min("l_suppkey")).alias("symbol"),
            F.min(day("l_shipdate")).alias("trade_date"),
            F.sum(q).alias("planned_quantity"),
            F.sum(F.when(F.col("l_returnflag") != "N", q).otherwise(0)).alias("filled_quantity"),
            F.sum(F.when(F.col("l_returnflag") == "N", q).otherwise(0)).alias("rejected_quantity"),
            total.alias("total"),
            F.min("l_discount").alias("discount"),
        )
        .select(
            F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("order_id"),
            "symbol",
            F.when(F.col("l_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
            "trade_date",
            "planned_quantity",
            "filled_quantity",
            "rejected_quantity",
            cents(F.col("total") / F.col("planned_quantity")).alias("price"),
            cents(F.col("total") / F.col("planned_quantity") * (1 - F.col("discount"))).alias("reference_price"),
            (F.floor(F.col("total") * F.lit(0.03)).cast("double") / 100).cast("decimal(18,2)").alias("commission"),
        )
    )


view(
    "equity",
    """
SELECT scenario, trade_date, CAST(1000000000 + sum(gain) OVER (PARTITION BY scenario ORDER BY trade_date) AS DOUBLE) AS equity
FROM (
  SELECT s.scenario, o.trade_date,
         sum(CASE WHEN o.side = 'SELL' THEN 1 ELSE -1 END * CAST(o.price AS DECIMAL(12,2)) * CAST(o.filled_quantity AS DECIMAL(9,0))
             - CASE s.scenario WHEN 'full_cost' THEN o.commission ELSE 0 END) AS gain
  FROM order_lines o CROSS JOIN (SELECT unnest(['zero_cost', 'full_cost']) AS scenario) s
  GROUP BY 1, 2)""",
)


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily equity curve of two cost scenarios: a start amount plus the signed amounts so far, summed exactly."""
    worth = F.col("price").cast("decimal(12,2)") * F.col("filled_quantity").cast("decimal(9,0)")
    fee = F.when(F.col("scenario") == "full_cost", F.col("commission")).otherwise(F.lit(0).cast("decimal(18,2)"))
    by_day = (
        order_lines(spark, sf_dir)
        .withColumn("scenario", F.explode(F.array(F.lit("zero_cost"), F.lit("full_cost"))))
        .groupBy("scenario", "trade_date")
        .agg(F.sum(F.when(F.col("side") == "SELL", worth).otherwise(-worth) - fee).alias("gain"))
    )
    w = Window.partitionBy("scenario").orderBy("trade_date")
    return by_day.select("scenario", "trade_date", (1_000_000_000 + F.sum("gain").over(w)).cast("double").alias("equity"))
