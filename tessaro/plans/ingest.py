"""Queries of scans, cleaning, quality checks and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.functions import clean
from tessaro.operators import actions as act
from tessaro.operators import merging, quality
from tessaro.plans import market
from tessaro.plans.market import day, table
from tessaro.plans.registry import query, view
from tessaro.sources import layouts
from tessaro.sources.raw_store import request_key_column, response_issues

START, END = "1996-01-01", "1996-12-31"


def shifted(rows: DataFrame) -> DataFrame:
    """A second supplier's bars: some prices off by little or much."""
    n = F.length("symbol") + F.dayofyear("trade_date")
    return rows.withColumn("close", F.when(n % 5 == 0, F.col("close") * 1.005).when(n % 5 == 1, F.col("close") + 0.005).otherwise(F.col("close"))).withColumn(
        "open", F.when(n % 7 == 0, F.col("open") * 1.001).otherwise(F.col("open"))
    )


view(
    "bars2",
    """
SELECT symbol, trade_date,
       CASE WHEN (length(symbol) + dayofyear(trade_date)) % 7 = 0 THEN open * 1.001::DOUBLE ELSE open END AS open, high, low,
       CASE (length(symbol) + dayofyear(trade_date)) % 5 WHEN 0 THEN close * 1.005::DOUBLE WHEN 1 THEN close + 0.005::DOUBLE ELSE close END AS close, volume, amount
FROM bars WHERE dayofyear(trade_date) % 3 <> 0""",
)


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shifted(market.bars(spark, sf_dir).filter(F.dayofyear("trade_date") % 3 != 0))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_suppkey IN (1, 3, 7) AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'")
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey").isin(1, 3, 7) & (F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1997-01-01"))
    return rows.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS BIGINT))::BIGINT AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-06-01' GROUP BY 1, 2")
def q1_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= "2001-06-01")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"),
        F.sum(market.money("l_extendedprice")).cast("double").alias("sum_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


@query("SELECT symbol, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day FROM bars WHERE symbol = 'S5' GROUP BY 1")
def parameterised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = market.bars(spark, sf_dir)
    return spark.sql("SELECT symbol, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day FROM {bars} WHERE symbol = :s GROUP BY 1", args={"s": "S5"}, bars=bars)


# Supplier rows as text: codes with prefix or suffix, dates of two forms or none, prices with commas, volumes in lots.
view(
    "raw_lines",
    """
SELECT l_orderkey, l_linenumber,
  CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN lpad(CAST(l_suppkey AS VARCHAR), 6, '6') || '.sh' WHEN 1 THEN 'SZ.' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0')
    WHEN 2 THEN ' ' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SZ ' ELSE CASE WHEN l_suppkey % 5 = 0 THEN 'X' ELSE '688' END || lpad(CAST(l_suppkey AS VARCHAR), 3, '0') || '.SH' END AS code,
  CASE WHEN l_orderkey % 25 = 4 THEN 'n/a' WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y%m%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_text,
  CASE WHEN l_orderkey % 40 = 7 THEN '--' WHEN l_extendedprice >= 1000 THEN
    CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS price_text,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || CASE CAST(l_orderkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN '.25' ELSE '.255' END AS lots_text
FROM lineitem""",
)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, key, supp = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey").cast("string")
    floor = F.floor("l_extendedprice").cast("long")
    code = (
        F.when(line % 4 == 0, F.concat(F.lpad(supp, 6, "6"), F.lit(".sh")))
        .when(line % 4 == 1, F.concat(F.lit("SZ."), F.lpad(supp, 6, "0")))
        .when(line % 4 == 2, F.concat(F.lit(" "), F.lpad(supp, 6, "0"), F.lit(".SZ ")))
        .otherwise(F.concat(F.when(F.col("l_suppkey") % 5 == 0, "X").otherwise("688"), F.lpad(supp, 3, "0"), F.lit(".SH")))
    )
    date = F.when(key % 25 == 4, "n/a").when(key % 2 == 0, F.date_format("l_shipdate", "yyyyMMdd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    price = (
        F.when(key % 40 == 7, "--")
        .when(F.col("l_extendedprice") >= 1000, F.concat(F.floor(F.col("l_extendedprice") / 1000).cast("string"), F.lit(","), F.lpad((floor % 1000).cast("string"), 3, "0")))
        .otherwise(floor.cast("string"))
    )
    lots = F.concat(F.col("l_quantity").cast("long").cast("string"), F.when(key % 3 == 0, "").when(key % 3 == 1, ".25").otherwise(".255"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"), date.alias("date_text"), price.alias("price_text"), lots.alias("lots_text"))


view(
    "clean_lines",
    r"""
SELECT *, CASE WHEN symbol IS NULL THEN 'invalid_symbol' WHEN trade_date IS NULL THEN 'invalid_trade_date' WHEN price IS NULL THEN 'invalid_number' WHEN volume IS NULL THEN 'invalid_volume' END AS reason
FROM (SELECT l_orderkey, l_linenumber,
  CASE WHEN regexp_full_match(trim(code), '[0-9]{6}\.(SH|SZ|BJ)', 'i') THEN upper(trim(code)) WHEN regexp_full_match(trim(code), '(SH|SZ|BJ)\.[0-9]{6}', 'i') THEN substr(trim(code), 4, 6) || '.' || upper(substr(trim(code), 1, 2)) END AS symbol,
  CASE WHEN regexp_full_match(date_text, '[0-9]{8}') THEN CAST(try_strptime(date_text, '%Y%m%d') AS DATE) ELSE try_cast(date_text AS DATE) END AS trade_date,
  try_cast(replace(price_text, ',', '') AS DOUBLE) AS price,
  CASE WHEN try_cast(lots_text AS DECIMAL(28,6)) * 100 = floor(try_cast(lots_text AS DECIMAL(28,6)) * 100) THEN CAST(try_cast(lots_text AS DECIMAL(28,6)) * 100 AS BIGINT) END AS volume
FROM raw_lines)""",
)


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume_factor, _ = clean.UNIT_FACTORS["tushare"]
    rows = raw_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", clean.symbol("code").alias("symbol"), clean.trade_date("date_text").alias("trade_date"), clean.number("price_text").alias("price"), clean.shares("lots_text", volume_factor).alias("volume")
    )
    missing = [("symbol", "invalid_symbol"), ("trade_date", "invalid_trade_date"), ("price", "invalid_number"), ("volume", "invalid_volume")]
    return rows.withColumn("reason", clean.first_reason(*[(F.col(c).isNull(), r) for c, r in missing]))


@query("SELECT symbol, trade_date, count(*) AS n, sum(volume)::BIGINT AS volume, sum(CAST(price AS BIGINT))::BIGINT AS price FROM clean_lines WHERE reason IS NULL GROUP BY 1, 2")
def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = clean_lines(spark, sf_dir).filter("reason IS NULL")
    return good.groupBy("symbol", "trade_date").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.sum(F.col("price").cast("long")).alias("price"))


@query("SELECT coalesce(reason, 'valid') AS verdict, count(*) AS n FROM clean_lines GROUP BY 1")
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("valid")).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    """
SELECT DISTINCT code, CASE WHEN regexp_full_match(bare, '[0-9]{6}') THEN CASE WHEN bare[1] = '6' THEN bare || '.SH' WHEN bare[1] IN ('0', '3') THEN bare || '.SZ' WHEN bare[1] IN ('4', '8') OR bare[1:2] = '92' THEN bare || '.BJ' END END AS bare_symbol,
  CASE WHEN regexp_full_match(cons, '(SH|SZ|BJ)[0-9]{6}') THEN cons[3:8] || '.' || cons[1:2] END AS constituent,
  CASE WHEN regexp_full_match(full_code, '(600|601|603|605)[0-9]{3}\\.SH') THEN 'sh_main' WHEN regexp_full_match(full_code, '688[0-9]{3}\\.SH') THEN 'star'
       WHEN regexp_full_match(full_code, '(000|001|002|003)[0-9]{3}\\.SZ') THEN 'sz_main' WHEN regexp_full_match(full_code, '(300|301)[0-9]{3}\\.SZ') THEN 'chinext' WHEN regexp_full_match(full_code, '[0-9]{6}\\.BJ') THEN 'bj' END AS board,
  CASE WHEN regexp_full_match(full_code, '(600|601|603|605)[0-9]{3}\\.SH') THEN 'sh_main' WHEN regexp_full_match(full_code, '688[0-9]{3}\\.SH') THEN 'star'
       WHEN regexp_full_match(full_code, '(000|001|002|003)[0-9]{3}\\.SZ') THEN 'sz_main' WHEN regexp_full_match(full_code, '(300|301|302)[0-9]{3}\\.SZ') THEN 'chinext' WHEN regexp_full_match(full_code, '[0-9]{6}\\.BJ') THEN 'bj' ELSE 'other' END AS loose_board
FROM (SELECT code, code AS bare, ex || code AS cons, code || '.' || ex AS full_code FROM (
  SELECT pre || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code, ex FROM part, (SELECT unnest(['600', '688', '000', '300', '302', '830', '920', '777']) AS pre), (SELECT unnest(['SH', 'SZ', 'BJ', 'HK']) AS ex)))
""".replace("\\\\", "\\")
)
def symbol_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = F.explode(F.array(*map(F.lit, ("600", "688", "000", "300", "302", "830", "920", "777"))))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 1000).alias("n")).distinct().select("n", pre.alias("pre"))
    rows = rows.select(F.concat("pre", F.lpad(F.col("n").cast("string"), 3, "0")).alias("code"), F.explode(F.array(*map(F.lit, ("SH", "SZ", "BJ", "HK")))).alias("ex"))
    full = F.concat("code", F.lit("."), "ex")
    return rows.select("code", clean.bare_symbol("code").alias("bare_symbol"), clean.constituent_symbol(F.concat("ex", "code")).alias("constituent"), clean.board(full).alias("board"), clean.board_or_other(full).alias("loose_board")).distinct()


@query(
    """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, count(*) AS copies, CASE WHEN count(*) > 1 THEN 'collapsed' ELSE 'kept' END AS action
FROM (SELECT l_orderkey % 50 AS l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem) GROUP BY 1, 2, 3, 4"""
)
def dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("l_orderkey"), "l_linenumber", "l_suppkey", "l_quantity")
    return merging.collapse_duplicates(rows).withColumn("action", F.when(F.col("copies") > 1, "collapsed").otherwise("kept"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS n_distinct FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return merging.key_conflicts(rows, ["l_orderkey", "l_linenumber"])


# Bars with faults put in by rule.
view(
    "dirty_bars",
    """
SELECT symbol, trade_date, CASE WHEN k % 97 = 0 THEN -open WHEN k % 89 = 0 THEN NULL ELSE open END AS open, CASE WHEN k % 83 = 0 THEN low ELSE high END AS high, low,
       CASE WHEN k % 101 = 0 THEN 'nan'::DOUBLE ELSE close END AS close, CASE WHEN k % 79 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN k % 73 = 0 THEN -amount ELSE amount END AS amount,
       CASE CAST(k % 11 AS INT) WHEN 0 THEN 'elsewhere' WHEN 1 THEN NULL WHEN 2 THEN 'baostock' ELSE 'tushare' END AS source, CASE WHEN k % 13 = 0 THEN 'forward' ELSE 'unadjusted' END AS adjustment
FROM (SELECT *, volume + day(trade_date) AS k FROM bars)""",
)


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("volume") + F.dayofmonth("trade_date")
    b = market.bars(spark, sf_dir).withColumn("k", k)
    k = F.col("k")
    return b.select(
        "symbol", "trade_date", F.when(k % 97 == 0, -F.col("open")).when(k % 89 == 0, None).otherwise(F.col("open")).alias("open"), F.when(k % 83 == 0, F.col("low")).otherwise(F.col("high")).alias("high"), "low",
        F.when(k % 101 == 0, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"), F.when(k % 79 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.when(k % 73 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
        F.when(k % 11 == 0, "elsewhere").when(k % 11 == 1, None).when(k % 11 == 2, "baostock").otherwise("tushare").alias("source"), F.when(k % 13 == 0, "forward").otherwise("unadjusted").alias("adjustment"),
    )


view(
    "value_issues",
    """
SELECT 'ERROR' AS severity, code, symbol, trade_date FROM (
  SELECT symbol, trade_date, unnest([CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR (close <= 0 AND NOT isnan(close)) THEN 'nonpositive_price' END, CASE WHEN volume < 0 THEN 'negative_volume' END, CASE WHEN amount < 0 THEN 'negative_amount' END,
    CASE WHEN NOT coalesce(low <= open AND open <= high AND low <= close AND close <= high AND NOT isnan(close), false) THEN 'invalid_ohlc' END]) AS code FROM dirty_bars)
WHERE code IS NOT NULL""",
)


@query("SELECT * FROM value_issues")
def ohlc_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_issues(dirty_bars(spark, sf_dir)).drop("details")


view(
    "provenance_issues",
    """
SELECT 'ERROR' AS severity, code, symbol, trade_date FROM (
  SELECT symbol, trade_date, unnest([CASE WHEN source IS NULL OR source NOT IN ('tushare', 'akshare', 'baostock', 'tushare_suspend') THEN 'unknown_source' END, CASE WHEN adjustment IS NULL OR adjustment <> 'unadjusted' THEN 'unknown_adjustment' END]) AS code FROM dirty_bars)
WHERE code IS NOT NULL""",
)


@query("SELECT * FROM provenance_issues")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.provenance_issues(dirty_bars(spark, sf_dir)).drop("details")


@query("SELECT code, count(*) AS n FROM (SELECT code FROM value_issues UNION ALL SELECT code FROM provenance_issues) GROUP BY 1")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = dirty_bars(spark, sf_dir)
    return quality.blocking(quality.value_issues(b).unionByName(quality.provenance_issues(b)))


@query("SELECT s AS severity, count(i.severity) AS n FROM (SELECT unnest(['INFO', 'WARNING', 'ERROR', 'FATAL']) AS s) d LEFT JOIN value_issues i ON i.severity = s GROUP BY 1")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(quality.value_issues(dirty_bars(spark, sf_dir)))


@query(
    f"""
SELECT g.symbol, g.day AS trade_date, CASE WHEN g.day < g.list_date THEN 'not_listed' WHEN g.day > g.delist_date THEN 'delisted' WHEN v.symbol IS NULL THEN 'unknown_or_suspended' ELSE 'primary_source_missing' END AS code
FROM (SELECT m.symbol, m.list_date, m.delist_date, d.day FROM master m, open_days d, (SELECT min(day) AS a, max(day) AS b FROM open_days WHERE day BETWEEN DATE '{START}' AND DATE '{END}') e
      WHERE d.day BETWEEN DATE '{START}' AND DATE '{END}' AND (m.list_date IS NULL OR m.list_date <= e.a) AND (m.delist_date IS NULL OR m.delist_date >= e.b)) g
LEFT JOIN (SELECT * FROM bars WHERE dayofyear(trade_date) % 4 <> 0) p ON p.symbol = g.symbol AND p.trade_date = g.day
LEFT JOIN bars2 v ON v.symbol = g.symbol AND v.trade_date = g.day
WHERE p.symbol IS NULL"""
)
def missing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = market.bars(spark, sf_dir).filter(F.dayofyear("trade_date") % 4 != 0)
    return quality.missing_rows(market.master(spark, sf_dir), market.calendar(spark, sf_dir), primary, second_source(spark, sf_dir), START, END)


@query(
    """
SELECT symbol, trade_date, field, round(absolute, 6) AS absolute_difference, severity FROM (
  SELECT *, CASE WHEN field = 'close' AND absolute / abs(l) > 0.002 THEN 'ERROR' WHEN absolute > 0.01 AND absolute / abs(l) > 0.0005 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (
    SELECT symbol, trade_date, field, l, r, abs(l - r) AS absolute FROM (
      SELECT a.symbol, a.trade_date, unnest(['open', 'high', 'low', 'close']) AS field, unnest([a.open, a.high, a.low, a.close]) AS l, unnest([b.open, b.high, b.low, b.close]) AS r
      FROM bars a JOIN bars2 b ON a.symbol = b.symbol AND a.trade_date = b.trade_date) WHERE l <> r))"""
)
def cross_source_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.compare_sources(market.bars(spark, sf_dir), second_source(spark, sf_dir))
    return d.select("symbol", "trade_date", "field", F.round("absolute_difference", 6).alias("absolute_difference"), "severity")


@query(
    """
SELECT severity, code, count(*) AS n FROM (SELECT CASE WHEN field = 'close' AND x / abs(l) > 0.002 THEN 'ERROR' WHEN x > 0.01 AND x / abs(l) > 0.0005 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN field = 'close' AND x / abs(l) > 0.002 THEN 'close_difference' WHEN x > 0.01 AND x / abs(l) > 0.0005 THEN 'price_difference' ELSE 'within_tolerance' END AS code
  FROM (SELECT unnest(['open', 'high', 'low', 'close']) AS field, unnest([a.open, a.high, a.low, a.close]) AS l, abs(unnest([a.open, a.high, a.low, a.close]) - unnest([b.open, b.high, b.low, b.close])) AS x
        FROM bars a JOIN bars2 b ON a.symbol = b.symbol AND a.trade_date = b.trade_date) WHERE x <> 0) GROUP BY 1, 2"""
)
def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = market.bars(spark, sf_dir).withColumn("source", F.lit("akshare")).unionByName(second_source(spark, sf_dir).withColumn("source", F.lit("baostock")))
    pairs = quality.first_two_sources(both)
    one = lambda s: pairs.select("symbol", "trade_date", *[F.col(f"{s}.{c}").alias(c) for c in quality.PRICES])
    return quality.compare_sources(one("left"), one("right")).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query(
    """
SELECT b.symbol, b.trade_date, CASE WHEN b.trade_date < m.lo THEN 'before_list_date' ELSE 'after_delist_date' END AS boundary
FROM bars b JOIN (SELECT symbol, list_date + 30 AS lo, delist_date - 30 AS hi FROM master) m ON b.symbol = m.symbol WHERE b.trade_date < m.lo OR b.trade_date > m.hi"""
)
def bar_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = market.master(spark, sf_dir).withColumn("list_date", F.date_add("list_date", 30)).withColumn("delist_date", F.date_sub("delist_date", 30))
    return quality.boundary_issues(market.bars(spark, sf_dir), listing).select("symbol", "trade_date", "boundary")


@query(
    """
SELECT a.symbol FROM master a LEFT JOIN (SELECT symbol, list_date, CASE WHEN length(symbol) % 2 = 0 THEN delist_date END AS delist_date FROM master WHERE board <> 'star') c ON a.symbol = c.symbol
WHERE c.symbol IS NULL OR a.list_date IS DISTINCT FROM c.list_date OR a.delist_date IS DISTINCT FROM c.delist_date"""
)
def master_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market.master(spark, sf_dir)
    c = m.filter("board <> 'star'").withColumn("delist_date", F.when(F.length("symbol") % 2 == 0, F.col("delist_date")))
    same = m.alias("a").join(c.alias("c"), (F.col("a.symbol") == F.col("c.symbol")) & F.col("a.list_date").eqNullSafe(F.col("c.list_date")) & F.col("a.delist_date").eqNullSafe(F.col("c.delist_date")), "left_anti")
    return same.select("symbol")


view(
    "supplier_events",
    """
SELECT lpad(CAST(o_custkey % 1000 AS VARCHAR), 6, CASE WHEN o_custkey % 2 = 0 THEN '6' ELSE '0' END) AS code, strftime(o_orderdate - INTERVAL 20 DAY, '%Y%m%d') AS announced,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') END AS recorded, strftime(o_orderdate, '%Y-%m-%d') AS ex,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS VARCHAR) || '.5' END AS cash, CASE o_orderstatus WHEN 'F' THEN '1' END AS bonus, CASE o_orderstatus WHEN 'P' THEN '2' END AS capital,
  CASE WHEN o_orderkey % 17 = 0 THEN '预案' ELSE '实施完成' END AS progress, CASE WHEN o_orderkey % 23 = 0 THEN '10配股3' ELSE '10派' || CAST(o_orderkey % 9 AS VARCHAR) || '.5元' END AS plan, o_orderkey AS event_key
FROM orders WHERE o_orderpriority = '1-URGENT'""",
)


def supplier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust, date = F.col("o_orderkey"), F.col("o_custkey"), day("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderpriority = '1-URGENT'")
        .select(
            F.when(cust % 2 == 0, F.lpad((cust % 1000).cast("string"), 6, "6")).otherwise(F.lpad((cust % 1000).cast("string"), 6, "0")).alias("code"),
            F.date_format(F.date_sub(date, 20), "yyyyMMdd").alias("announced"),
            F.when(key % 31 == 0, "").otherwise(F.date_format(F.date_sub(date, 1), "yyyy-MM-dd")).alias("recorded"),
            F.date_format(date, "yyyy-MM-dd").alias("ex"),
            F.when(key % 7 != 0, F.concat((key % 9).cast("string"), F.lit(".5"))).alias("cash"),
            F.when(F.col("o_orderstatus") == "F", "1").alias("bonus"),
            F.when(F.col("o_orderstatus") == "P", "2").alias("capital"),
            F.when(key % 17 == 0, "预案").otherwise("实施完成").alias("progress"),
            F.when(key % 23 == 0, "10配股3").otherwise(F.concat(F.lit("10派"), (key % 9).cast("string"), F.lit(".5元"))).alias("plan"),
            key.alias("event_key"),
        )
    )


view(
    "parsed_events",
    """
SELECT *, CASE WHEN unsupported THEN 'unsupported_corporate_action' WHEN status <> 'implemented' THEN 'not_implemented' WHEN announcement_date IS NULL OR record_date IS NULL OR ex_date IS NULL
    OR NOT (coalesce(cash, 0) <> 0 OR coalesce(bonus, 0) <> 0 OR coalesce(capitalization, 0) <> 0) THEN 'incomplete' END AS reason
FROM (SELECT code || CASE WHEN code[1] = '6' THEN '.SH' ELSE '.SZ' END AS symbol, CAST(strptime(announced, '%Y%m%d') AS DATE) AS announcement_date, try_cast(recorded AS DATE) AS record_date, CAST(ex AS DATE) AS ex_date,
  CAST(cash AS DOUBLE) / 10 AS cash, CAST(bonus AS DOUBLE) / 10 AS bonus, CAST(capital AS DOUBLE) / 10 AS capitalization,
  CASE WHEN contains(progress, '实施') THEN 'implemented' ELSE 'not_implemented' END AS status, regexp_matches(plan || ' ' || progress, '配股|换股|合并|吸收') AS unsupported, CAST(regexp_extract(plan, '派([0-9]+(\\.[0-9]+)?)', 1) AS VARCHAR) AS plan_cash, event_key
FROM supplier_events)""".replace("\\\\", "\\"),
)


@query("SELECT symbol, announcement_date, record_date, ex_date, round(cash, 6) AS cash, round(bonus, 6) AS bonus, round(capitalization, 6) AS capitalization, status, reason FROM parsed_events")
def corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = act.parse_events(supplier_events(spark, sf_dir), "cninfo")
    figures = [F.round(F.col(c).cast("double"), 6).alias(c) for c in ("cash", "bonus", "capitalization")]
    return e.select("symbol", "announcement_date", "record_date", "ex_date", *figures, "status", "reason")


@query("SELECT event_key, nullif(plan_cash, '') AS plan_cash FROM parsed_events")
def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_events(spark, sf_dir).select("event_key", clean.plan_amount("plan", "派").alias("plan_cash"))


@query(f"SELECT symbol, ex_date, status, count(*) AS n FROM parsed_events WHERE ex_date BETWEEN DATE '{START}' AND DATE '{END}' OR (ex_date IS NULL AND status = 'implemented') GROUP BY 1, 2, 3")
def events_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = act.in_window(act.parse_events(supplier_events(spark, sf_dir), "cninfo"), START, END)
    return e.groupBy("symbol", "ex_date", "status").agg(F.count("*").alias("n"))


@query(
    """
SELECT symbol, ex_date, min(announcement_date) AS announcement_date, round(sum(coalesce(cash, 0)), 6) AS cash, round(sum(coalesce(bonus, 0)), 6) AS bonus, count(*) AS n_events, count(DISTINCT record_date) > 1 AS ambiguous
FROM parsed_events WHERE reason IS NULL GROUP BY 1, 2"""
)
def same_day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = act.combine_same_day(act.parse_events(supplier_events(spark, sf_dir), "cninfo").filter("reason IS NULL"))
    return e.select("symbol", "ex_date", "announcement_date", F.round(F.col("cash").cast("double"), 6).alias("cash"), F.round(F.col("bonus").cast("double"), 6).alias("bonus"), "n_events", "ambiguous")


# Two suppliers of the same events: the second lacks some, has some more, and differs in the cash of others.
view(
    "one_source",
    "SELECT symbol, ex_date, min(record_date) AS record_date, sum(CAST(cash AS DECIMAL(18,4))) AS cash, sum(CAST(bonus AS DECIMAL(18,4))) AS bonus FROM actions WHERE event_key % 5 <> 0 GROUP BY 1, 2",
)
view(
    "other_source",
    "SELECT symbol, ex_date, min(record_date) AS record_date, sum(CAST(cash AS DECIMAL(18,4)) + CASE WHEN event_key % 11 = 0 THEN 0.01 ELSE 0 END) AS cash, sum(CAST(bonus AS DECIMAL(18,4))) AS bonus FROM actions WHERE event_key % 7 <> 0 GROUP BY 1, 2",
)


def two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, key = market.actions(spark, sf_dir), F.col("event_key")
    exact = lambda c: F.col(c).cast("decimal(18,4)")
    bump = F.when(key % 11 == 0, F.lit(0.01)).otherwise(F.lit(0.0)).cast("decimal(18,4)")

    def side(rows: DataFrame, cash) -> DataFrame:
        g = rows.groupBy("symbol", "ex_date").agg(F.min("announcement_date").alias("announcement_date"), F.min("record_date").alias("record_date"), F.sum(cash).alias("cash"), F.sum(exact("bonus")).alias("bonus"))
        return g.withColumn("capitalization", F.lit(0).cast("decimal(18,4)"))

    return side(a.filter(key % 5 != 0), exact("cash")), side(a.filter(key % 7 != 0), exact("cash") + bump)


@query(
    """
SELECT symbol, ex_date, confirmed_by, reason, CAST(cash AS DOUBLE) AS cash FROM (
  SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ex_date, b.ex_date) AS ex_date, unnest(
    CASE WHEN a.symbol IS NULL THEN [{'confirmed_by': 'eastmoney', 'reason': NULL, 'cash': b.cash}] WHEN b.symbol IS NULL THEN [{'confirmed_by': 'cninfo', 'reason': NULL, 'cash': a.cash}]
         WHEN a.record_date IS NOT DISTINCT FROM b.record_date AND a.cash = b.cash AND a.bonus = b.bonus THEN [{'confirmed_by': 'cninfo+eastmoney', 'reason': NULL, 'cash': a.cash}]
         ELSE [{'confirmed_by': 'cninfo', 'reason': 'cross_source_conflict', 'cash': a.cash}, {'confirmed_by': 'eastmoney', 'reason': 'cross_source_conflict', 'cash': b.cash}] END, recursive := true)
  FROM one_source a FULL JOIN other_source b ON a.symbol = b.symbol AND a.ex_date = b.ex_date)"""
)
def full_outer_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = two_sources(spark, sf_dir)
    return act.reconcile_sources(one, other, ("cninfo", "eastmoney")).select("symbol", "ex_date", "confirmed_by", "reason", F.col("cash").cast("double").alias("cash"))


@query("SELECT symbol, ex_date, CAST(cash AS DOUBLE) AS cash FROM one_source WHERE (symbol, ex_date) NOT IN (SELECT (symbol, ex_date) FROM other_source) UNION ALL SELECT symbol, ex_date, CAST(cash AS DOUBLE) FROM other_source")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = two_sources(spark, sf_dir)
    return merging.replace_by_key(one, other, ["symbol", "ex_date"]).select("symbol", "ex_date", F.col("cash").cast("double").alias("cash"))


@query(
    f"""
WITH fresh AS (SELECT symbol, trade_date, open, close FROM bars2 WHERE length(symbol) <= 2 AND trade_date BETWEEN DATE '{START}' AND DATE '{END}')
SELECT symbol, trade_date, open, close FROM bars WHERE NOT (trade_date BETWEEN DATE '{START}' AND DATE '{END}' AND symbol IN (SELECT symbol FROM fresh)) UNION ALL SELECT * FROM fresh"""
)
def window_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["symbol", "trade_date", "open", "close"]
    fresh = second_source(spark, sf_dir).filter((F.length("symbol") <= 2) & F.col("trade_date").between(F.lit(START).cast("date"), F.lit(END).cast("date"))).select(*columns)
    return merging.replace_window(market.bars(spark, sf_dir).select(*columns), fresh, fresh, START, END)


@query("SELECT DISTINCT day FROM (SELECT day FROM open_days WHERE year(day) < 1999 UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate >= DATE '1998-06-01')")
def union_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    carried = market.open_days(spark, sf_dir).filter(F.year("day") < 1999)
    fresh = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= "1998-06-01").select(day("l_shipdate").alias("day"))
    return carried.union(fresh).distinct()


@query("SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem INTERSECT SELECT day FROM open_days")
def common_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day")).intersect(market.open_days(spark, sf_dir))


@query("SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem EXCEPT SELECT day FROM open_days")
def days_outside_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day")).subtract(market.open_days(spark, sf_dir))


@query(
    """
SELECT user_id, to_json(list_sort(list(DISTINCT event_type))) AS types, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1"""
)
def json_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_set("event_type"))).alias("types"), F.sum("k").alias("k"))


@query(
    """
SELECT s_suppkey, sha256('{"endpoint":"daily","symbol":"S' || s_suppkey || '","start":"1996-01-01","end":"1996-12-31"}') AS request_key FROM supplier"""
)
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.concat(F.lit("S"), "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", request_key_column(F.lit("daily"), symbol, F.lit(START), F.lit(END)).alias("request_key"))


@query(
    """
SELECT part, fault FROM (
  SELECT part, unnest([CASE WHEN n >= 900 THEN 'truncated' END, CASE WHEN other > 0 THEN 'other_symbols' END, CASE WHEN own < 10 THEN 'missing_symbols' END, CASE WHEN undated > 0 THEN 'undated' END, CASE WHEN outside > 0 THEN 'outside_window' END]) AS fault FROM (
    SELECT l_orderkey % 40 AS part, count(*) AS n, count(DISTINCT l_suppkey % 11) FILTER (l_suppkey % 11 = 10) AS other, count(DISTINCT l_suppkey % 11) FILTER (l_suppkey % 11 < 10) AS own,
      count(*) FILTER (l_orderkey % 1999 = 7) AS undated, count(*) FILTER (l_orderkey % 1999 <> 7 AND l_shipdate NOT BETWEEN DATE '1995-03-01' AND DATE '1998-06-30') AS outside
    FROM lineitem WHERE l_orderkey % 7 <> 0 OR l_suppkey % 11 < 10 AND l_shipdate BETWEEN DATE '1995-03-01' AND DATE '1998-06-30' GROUP BY 1)) WHERE fault IS NOT NULL"""
)
def response_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses, a part of the lines each, against what was asked: ten names in a window, with a row limit."""
    key, name, shipped = F.col("l_orderkey"), F.col("l_suppkey") % 11, day("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").filter((key % 7 != 0) | (name < 10) & shipped.between("1995-03-01", "1998-06-30"))
    rows = lines.select((key % 40).alias("part"), F.concat(F.lit("N"), name).alias("symbol"), F.when(key % 1999 != 7, shipped).alias("trade_date"))
    return response_issues(rows, ["part"], [f"N{k}" for k in range(10)], "1995-03-01", "1998-06-30", limit=900)


@query(
    """
SELECT symbol, CASE WHEN failed THEN 'UNTRUSTED' WHEN n = 0 THEN 'VERIFIED_EMPTY' WHEN q > 0 THEN 'UNTRUSTED' WHEN a > 0 THEN 'VERIFIED' ELSE 'UNTRUSTED' END AS status,
  CASE WHEN failed THEN 'SOURCE_FETCH_FAILED' WHEN n = 0 THEN NULL WHEN conflict > 0 THEN 'SOURCE_CONFLICT' WHEN unsupported > 0 THEN 'UNSUPPORTED_ACTION' WHEN q > 0 THEN 'FACTS_INCOMPLETE' WHEN a > 0 THEN NULL ELSE 'FACTS_INCOMPLETE' END AS reason
FROM (SELECT concat('C', o_custkey) AS symbol, bool_or(o_orderkey % 97 = 0) AS failed, sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a,
  count(*) FILTER (o_orderkey % 37 < 3) AS q, count(*) FILTER (o_orderkey % 37 = 0) AS conflict, count(*) FILTER (o_orderkey % 37 = 1) AS unsupported FROM orders GROUP BY o_custkey)"""
)
def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    held = F.when(key % 37 == 0, "cross_source_conflict").when(key % 37 == 1, "unsupported_corporate_action").when(key % 37 == 2, "not_implemented")
    endpoints = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("symbol"), (key % 97 == 0).alias("failed"), (status != "O").cast("int").alias("n_rows"), (status == "F").cast("int").alias("n_accepted"), held.alias("quarantine_reason")
    )
    return act.coverage_verdict(endpoints)


@query(
    """
SELECT layout, symbol, ex_date, round(cash, 6) AS cash, round(bonus, 6) AS bonus, round(capitalization, 6) AS capitalization, CASE WHEN unsupported THEN 'unsupported_corporate_action' WHEN status <> 'implemented' THEN 'not_implemented'
    WHEN announcement_date IS NULL OR record_date IS NULL OR ex_date IS NULL OR NOT (coalesce(cash, 0) <> 0 OR coalesce(bonus, 0) <> 0 OR coalesce(capitalization, 0) <> 0) THEN 'incomplete' END AS reason, count(*) AS n
FROM (SELECT symbol, announcement_date, record_date, ex_date, event_key,
    CASE event_key % 3 WHEN 0 THEN 'implemented' WHEN 1 THEN 'amounts' ELSE 'plans' END AS layout,
    CASE WHEN event_key % 3 = 0 THEN 'implemented' ELSE status END AS status,
    CASE WHEN event_key % 3 = 0 THEN plan_of LIKE '%配股%' ELSE unsupported END AS unsupported,
    CASE WHEN event_key % 3 = 2 THEN try_cast(nullif(plan_cash, '') AS DOUBLE) / 10 ELSE cash END AS cash, CASE WHEN event_key % 3 <> 2 THEN bonus END AS bonus, CASE WHEN event_key % 3 <> 2 THEN capitalization END AS capitalization
  FROM (SELECT p.*, CASE WHEN event_key % 23 = 0 THEN '10配股3' ELSE '' END AS plan_of FROM parsed_events p)) GROUP BY ALL"""
)
def dividend_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in the three native layouts of dividend responses, brought to one and parsed."""
    e = supplier_events(spark, sf_dir)
    code, key = F.col("code"), F.col("event_key")
    own = lambda names, drop=(): [F.col(k).alias(v) for k, v in names.items() if k not in drop]
    done = layouts.dividends(e.filter(key % 3 == 0).select(*own(layouts.IMPLEMENTED), code), code)
    amounts = layouts.dividends(e.filter(key % 3 == 1).select(*[F.col(k).alias(v[1] if len(v) > 1 else v[0]) for k, v in layouts.DIVIDENDS.items()]))
    plans = layouts.dividends(e.filter(key % 3 == 2).select(*own(layouts.PLANNED), code), F.concat(code, F.lit(".SH")))
    found = [act.parse_events(x, name).withColumn("layout", F.lit(name)) for name, x in (("implemented", done), ("amounts", amounts), ("plans", plans))]
    figures = [F.round(F.col(c).cast("double"), 6).alias(c) for c in ("cash", "bonus", "capitalization")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("layout", "symbol", "ex_date", *figures, "reason").groupBy("layout", "symbol", "ex_date", "cash", "bonus", "capitalization", "reason").agg(F.count("*").alias("n"))


@query(
    """
SELECT trade_date, symbol, open, close, CASE WHEN symbol = 'CN' THEN volume * 100 ELSE volume END::DOUBLE AS volume, CASE WHEN symbol = 'CN' THEN amount ELSE 0 END AS amount FROM (
  SELECT trade_date, CASE WHEN length(symbol) % 2 = 0 THEN 'CN' ELSE 'EN' END AS symbol, min(open) AS open, max(close) AS close, sum(volume) AS volume, max(amount) AS amount FROM bars GROUP BY 1, 2)"""
)
def index_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two index histories, one with Chinese columns and volume in lots, one with English columns and no amount."""
    kind = F.when(F.length("symbol") % 2 == 0, "CN").otherwise("EN")
    b = market.bars(spark, sf_dir).groupBy("trade_date", kind.alias("symbol")).agg(F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), F.sum("volume").alias("volume"), F.max("amount").alias("amount"))
    (cn, _), (en, _) = layouts.INDEX
    named = lambda names, drop=(): [F.col("trade_date" if k == "day" else k).cast("string").alias(v) for k, v in names.items() if k not in drop]
    one = layouts.index_history(b.filter("symbol = 'CN'").select(*named(cn)), "CN")
    two = layouts.index_history(b.filter("symbol = 'EN'").select(*named(en, ("amount",))), "EN")
    return one.unionByName(two).select("trade_date", "symbol", "open", "close", "volume", "amount")


@query(
    """
SELECT symbol, coalesce(reason, 'valid') AS what, count(*) AS n, round(sum(CASE WHEN reason IS NULL THEN volume * factor END), 2) AS volume, min(CASE WHEN reason IS NULL THEN TIMESTAMP '2024-01-01 00:00:00' END) AS ingested_at FROM (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'CN' ELSE 'EN' END AS symbol, CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE 1 END AS factor, l_quantity AS volume,
    CASE WHEN l_orderkey % 25 = 4 THEN 'invalid_trade_date' WHEN l_orderkey % 40 = 7 OR l_orderkey % 40 = 12 THEN 'invalid_number' END AS reason FROM lineitem) GROUP BY ALL"""
)
def index_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as two index histories, with dates and numbers that can't be read: bars as ingested, and native rows by reason."""
    key, price = F.col("l_orderkey"), F.when((F.col("l_orderkey") % 40).isin(7, 12), "--").otherwise(F.col("l_extendedprice").cast("string"))
    date = F.when(key % 25 == 4, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", *[c.alias(k) for k, c in (("day", date), ("open", price), ("high", price), ("low", price), ("close", price), ("volume", F.col("l_quantity").cast("string")), ("amount", price))])  # noqa: E741
    (cn, _), (en, _) = layouts.INDEX
    own = lambda names, drop=(): [F.col(k).alias(v) for k, v in names.items() if k not in drop]
    out = []
    for name, frame in (("CN", l.filter(key % 2 == 0).select(*own(cn))), ("EN", l.filter(key % 2 == 1).select(*own(en, ("amount",))))):
        bars, rejected = layouts.index_bars(frame, name, "2024-01-01")
        out.append(bars.agg(F.lit(name).alias("symbol"), F.lit("valid").alias("what"), F.count("*").alias("n"), F.round(F.sum("volume"), 2).alias("volume"), F.min("ingested_at").alias("ingested_at")))
        none = [F.lit(None).cast("double").alias("volume"), F.lit(None).cast("timestamp").alias("ingested_at")]
        out.append(rejected.groupBy(F.lit(name).alias("symbol"), F.col("reason").alias("what")).agg(F.count("*").alias("n")).select("symbol", "what", "n", *none))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    """
SELECT 'rejected:' || reason AS what, count(*) AS n, CAST(NULL AS BIGINT) AS volume FROM clean_lines WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'valid', count(*), sum(volume)::BIGINT FROM (SELECT DISTINCT symbol, trade_date, price, volume FROM clean_lines WHERE reason IS NULL)
UNION ALL SELECT 'collapsed', count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, trade_date, price, volume FROM clean_lines WHERE reason IS NULL)), NULL FROM clean_lines WHERE reason IS NULL"""
)
def normalize_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as a supplier's native daily frame: valid rows, rejects by reason, collapsed copies."""
    raw = raw_lines(spark, sf_dir).select(F.col("code").alias("ts_code"), F.col("date_text").alias("trade_date"), F.col("lots_text").alias("vol"), *[F.col("price_text").alias(c) for c in layouts.DAILY_NUMBERS])
    c = layouts.daily_bars(raw, "tushare", "2024-01-01")
    none = F.lit(None).cast("long").alias("volume")
    rejected = c.rejected.groupBy(F.concat(F.lit("rejected:"), "reason").alias("what")).agg(F.count("*").alias("n")).select("what", "n", none)
    valid = c.valid.agg(F.lit("valid").alias("what"), F.count("*").alias("n"), F.sum("volume").alias("volume"))
    return rejected.unionByName(valid).unionByName(c.audit.agg(F.lit("collapsed").alias("what"), F.count("*").alias("n")).select("what", "n", none))
