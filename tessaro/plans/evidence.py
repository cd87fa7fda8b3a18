"""Queries of acceptance evidence and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.operators import acceptance, quality
from tessaro.plans import market
from tessaro.plans.ingest import dirty_bars
from tessaro.plans.market import day, table
from tessaro.plans.registry import query, view

START, END = "1996-01-02", "1996-06-28"

view("half_year", f"SELECT day FROM open_days WHERE day BETWEEN DATE '{START}' AND DATE '{END}'")


def half_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.open_days(spark, sf_dir).filter(F.col("day").between(F.lit(START).cast("date"), F.lit(END).cast("date")))


@query("SELECT symbol, trade_date, close FROM bars WHERE trade_date IN ((SELECT min(day) FROM half_year), (SELECT max(day) FROM half_year))")
def edge_day_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.edge_day_sample(market.bars(spark, sf_dir), half_year(spark, sf_dir)).select("symbol", "trade_date", "close")


@query(
    """
SELECT s.symbol, count(b.symbol) AS n_rows, min(b.trade_date) AS first_day, max(b.trade_date) AS last_day, (SELECT count(*) FROM half_year) AS open_days, (SELECT count(*) FROM half_year) - count(h.day) AS missing_open_days
FROM (SELECT unnest(['S1', 'S2', 'none']) AS symbol) s LEFT JOIN bars b ON b.symbol = s.symbol LEFT JOIN half_year h ON h.day = b.trade_date GROUP BY 1"""
)
def benchmark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("S1",), ("S2",), ("none",)], "symbol string")
    return acceptance.benchmark_coverage(market.bars(spark, sf_dir), names, half_year(spark, sf_dir))


# A supplier's listing snapshot: later list dates, an unknown state for some names.
view("listing_snapshot", "SELECT concat('S', s_suppkey) AS symbol, CASE WHEN s_suppkey % 13 <> 5 THEN CAST(DATE '1990-01-01' + CAST(s_suppkey % 100 AS INT) AS DATE) END AS list_date, CAST(NULL AS DATE) AS delist_date, CASE WHEN s_suppkey % 17 = 4 THEN 'X' ELSE 'L' END AS list_status FROM supplier")


def refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("s_suppkey")
    snapshot = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), key).alias("symbol"), F.when(key % 13 != 5, F.date_add(F.lit("1990-01-01").cast("date"), (key % 100).cast("int"))).alias("list_date"), F.lit(None).cast("date").alias("delist_date"), F.when(key % 17 == 4, "X").otherwise("L").alias("list_status")
    )
    return acceptance.refresh_master(market.master(spark, sf_dir).withColumn("list_status", F.lit("P")), snapshot)


@query("SELECT m.symbol, m.name, m.board, s.list_date, s.delist_date, s.list_status FROM master m JOIN listing_snapshot s USING (symbol) WHERE s.list_date IS NOT NULL AND s.list_status <> 'X'")
def master_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refreshed(spark, sf_dir)[0].select("symbol", "name", "board", "list_date", "delist_date", "list_status")


@query("SELECT m.symbol FROM master m JOIN listing_snapshot s USING (symbol) WHERE s.list_date IS NULL OR s.list_status = 'X'")
def master_unaccounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refreshed(spark, sf_dir)[1]


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS created FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("created"))
    return acceptance.latest_run(o, ["o_custkey"], "created", "o_orderkey")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'")
def flagged_open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(day("o_orderdate").alias("day"), F.when(status == "F", 1).when(status == "O", 0).alias("is_open"))
    return acceptance.open_days_of(rows)


@query("SELECT m.symbol, count(*) - count(b.symbol) AS n_missing FROM master m JOIN half_year h ON h.day >= m.list_date AND (m.delist_date IS NULL OR h.day <= m.delist_date) LEFT JOIN bars b ON b.symbol = m.symbol AND b.trade_date = h.day GROUP BY 1 HAVING count(*) > count(b.symbol)")
def unexplained_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.unexplained_gaps(market.bars(spark, sf_dir), market.master(spark, sf_dir), half_year(spark, sf_dir))


@query(
    f"""
SELECT code, n_failures, n_failures = 0 AS passed FROM (
  SELECT 'dataset_manifest_integrity' AS code, 1 AS n_failures UNION ALL SELECT 'quality_report_integrity', (SELECT count(DISTINCT code) FROM value_issues) UNION ALL SELECT 'required_table_coverage', 5
  UNION ALL SELECT 'date_window_completeness', (SELECT count(*) FROM (SELECT min(day) AS a, max(day) AS b, max(CASE WHEN day = DATE '{END}' THEN 1 ELSE 0 END) AS c FROM open_days) WHERE DATE '{START}' < a OR DATE '{END}' > b OR c = 0)
    + (SELECT count(*) FROM (SELECT 'S1' AS s) x WHERE (SELECT count(*) FROM half_year) > (SELECT count(*) FROM half_year h JOIN bars b ON b.trade_date = h.day AND b.symbol = 'S1'))
    + (SELECT count(*) FROM (SELECT m.symbol FROM master m JOIN half_year h ON h.day >= m.list_date AND (m.delist_date IS NULL OR h.day <= m.delist_date) LEFT JOIN bars b ON b.symbol = m.symbol AND b.trade_date = h.day GROUP BY 1 HAVING count(*) > count(b.symbol)))
  UNION ALL SELECT 'security_master_evidence', (SELECT count(*) FROM master WHERE board = 'star') UNION ALL SELECT 'corporate_action_evidence', (SELECT count(*) FROM master WHERE board IN ('star', 'chinext'))
  UNION ALL SELECT 'raw_snapshot_traceability', 0 UNION ALL SELECT 'calendar_coverage_evidence', 1 UNION ALL SELECT 'source_role_health', (SELECT count(*) FROM (SELECT DISTINCT source FROM dirty_bars WHERE source IS NULL OR source = 'elsewhere')))"""
)
def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine checks over tables with known faults: a tampered table, missing coverage, a calendar with a hole."""
    return checks(spark, sf_dir, {}).select("code", "n_failures", "passed")


@query(
    """
SELECT * FROM (VALUES ('dataset_manifest_integrity', 1, false, NULL), ('quality_report_integrity', -1, false, NULL), ('required_table_coverage', 6, false, NULL), ('date_window_completeness', NULL, false, 'KeyError'), ('security_master_evidence', NULL, false, 'KeyError'),
  ('corporate_action_evidence', NULL, false, 'KeyError'), ('raw_snapshot_traceability', 0, true, NULL), ('calendar_coverage_evidence', 1, false, NULL), ('source_role_health', NULL, false, 'AnalysisException')) t(code, n_failures, passed, error) WHERE n_failures IS DISTINCT FROM -1
UNION ALL SELECT 'quality_report_integrity', (SELECT count(DISTINCT code) FROM value_issues), (SELECT count(*) = 0 FROM value_issues), NULL"""
)
def acceptance_checks_of_broken_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No master at all, and bars without a source: what can't be checked has failed, all else is as before."""
    return checks(spark, sf_dir, {"security_master": None, "daily_bar": dirty_bars(spark, sf_dir).drop("source")})


def checks(spark: SparkSession, sf_dir: str, instead: dict[str, DataFrame | None]) -> DataFrame:
    m, b = market.master(spark, sf_dir), dirty_bars(spark, sf_dir)
    date = lambda x: F.lit(x).cast("date")
    coverage = m.filter("board <> 'star'").select("symbol", date(START).alias("window_start"), date(END).alias("window_end"), F.when(F.col("board") == "chinext", "UNTRUSTED").otherwise("VERIFIED").alias("status"))
    spans = spark.createDataFrame([("1995-01-01", "1996-03-31"), ("1996-04-02", "1997-01-01")], "start string, end string").select(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    tables = {"daily_bar": b, "security_master": m, "security_master_coverage": m.filter("board <> 'star'").select("symbol"), "corporate_action_coverage": coverage}
    tables = {k: v for k, v in (tables | instead).items() if v is not None}
    benchmark = spark.createDataFrame([("S1",)], "symbol string")
    return acceptance.run_checks(tables, quality.value_issues(b), market.open_days(spark, sf_dir), benchmark, START, END, spans, tampered=["daily_bar"])

