"""Queries of gates: whole runs, membership evidence, target frames, outside excerpts, samples for review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.functions import clean
from tessaro.operators import gates, quality
from tessaro.plans import market
from tessaro.plans.evidence import refreshed
from tessaro.plans.ingest import second_source
from tessaro.plans.market import day, table
from tessaro.plans.portfolios import scored
from tessaro.plans.registry import query
from tessaro.sources.catalog import content_hash
from tessaro.sources.membership_file import FACT_COLUMNS


@query(
    """
SELECT trade_date, symbol, fault FROM (
  SELECT trade_date, symbol, unnest([CASE WHEN k % 7 = 0 THEN 'rank_not_positive_integer' END, CASE WHEN k % 11 = 0 THEN 'quantity_not_positive_integer' END, CASE WHEN k % 13 = 0 THEN 'price_not_positive' END,
    CASE WHEN weight <= 0 THEN 'weight_outside_unit' END, CASE WHEN k % 5 = 0 THEN 'reason_blank' END, CASE WHEN count(*) OVER (PARTITION BY trade_date, symbol) > 1 THEN 'symbol_repeated' END,
    CASE WHEN count(*) OVER (PARTITION BY trade_date, rank) > 1 THEN 'rank_repeated' END]) AS fault
  FROM (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS trade_date, concat('S', l_suppkey) AS symbol, l_discount AS weight, l_linenumber + CASE WHEN l_orderkey % 7 = 0 THEN 0.5 ELSE 0.0 END AS rank FROM lineitem)) WHERE fault IS NOT NULL"""
)
def portfolio_frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    targets = table(spark, sf_dir, "lineitem").select(
        day("l_shipdate").alias("trade_date"),
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        (F.col("l_linenumber") + F.when(k % 7 == 0, 0.5).otherwise(0.0)).alias("rank"),
        F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("signal_price"),
        F.col("l_discount").alias("target_weight"),
        F.when(k % 11 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("target_quantity"),
        F.when(k % 10 == 0, " ").when(k % 5 != 0, "top").alias("selection_reason"),
    )
    return quality.portfolio_frame_faults(targets)


@query(
    """
SELECT a.symbol, a.trade_date, CASE WHEN a.trade_date < m.list_date THEN 'not_listed' WHEN a.trade_date > m.delist_date THEN 'delisted' WHEN d.day IS NULL THEN 'non_trading_day'
  WHEN p.symbol IS NULL AND v.symbol IS NULL THEN 'unknown_or_suspended' WHEN p.symbol IS NULL THEN 'primary_source_missing' ELSE 'unexplained' END AS code
FROM (SELECT symbol, CAST(trade_date + CAST(list_extract([0, 1, -900, 900, 0], CAST(dayofyear(trade_date) % 5 + 1 AS INT)) AS INT) AS DATE) AS trade_date FROM bars) a
LEFT JOIN master m USING (symbol) LEFT JOIN open_days d ON d.day = a.trade_date
LEFT JOIN (SELECT symbol, trade_date FROM bars WHERE dayofyear(trade_date) % 4 <> 0) p ON p.symbol = a.symbol AND p.trade_date = a.trade_date LEFT JOIN bars2 v ON v.symbol = a.symbol AND v.trade_date = a.trade_date"""
)
def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six codes: days asked for on, beside and far from those that have bars."""
    bars, n = market.bars(spark, sf_dir), F.dayofyear("trade_date") % 5
    asked = bars.select("symbol", F.date_add("trade_date", F.when(n == 1, 1).when(n == 2, -900).when(n == 3, 900).otherwise(0)).alias("trade_date"))
    return quality.classify_asked(asked, market.master(spark, sf_dir), market.open_days(spark, sf_dir), bars.filter(F.dayofyear("trade_date") % 4 != 0), second_source(spark, sf_dir))


@query(
    """
SELECT severity, code, count(*) AS n FROM (
  SELECT 'WARNING' AS severity, CASE WHEN b.volume % 50 = 0 THEN 'adjustment_basis_mismatch' ELSE 'unit_mismatch' END AS code FROM bars a JOIN bars2 b USING (symbol, trade_date) WHERE b.volume % 50 = 0 OR b.volume % 30 = 1
  UNION ALL SELECT CASE WHEN field = 'close' AND x / abs(l) > 0.002 THEN 'ERROR' WHEN x > 0.01 AND x / abs(l) > 0.0005 THEN 'WARNING' ELSE 'INFO' END, CASE WHEN field = 'close' AND x / abs(l) > 0.002 THEN 'close_difference' WHEN x > 0.01 AND x / abs(l) > 0.0005 THEN 'price_difference' ELSE 'within_tolerance' END
  FROM (SELECT field, l, r, abs(l - r) AS x FROM (SELECT unnest(['open', 'high', 'low', 'close']) AS field, unnest([a.open, a.high, a.low, a.close]) AS l, unnest([b.open, b.high, b.low, b.close]) AS r
    FROM bars a JOIN bars2 b USING (symbol, trade_date) WHERE NOT (b.volume % 50 = 0 OR b.volume % 30 = 1)) WHERE l <> r)) GROUP BY 1, 2"""
)
def source_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, some bars of the second adjusted or in lots."""
    v = F.col("volume")
    other = second_source(spark, sf_dir).withColumns({"adjustment": F.when(v % 50 == 0, "forward").otherwise("unadjusted"), "volume_unit": F.when(v % 30 == 1, "lot").otherwise("share")})
    return quality.compare_sources(market.bars(spark, sf_dir), other).groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("SELECT 'ERROR' AS severity, 'duplicate_conflict' AS code, CAST(l_shipdate AS DATE) AS trade_date, concat('S', l_suppkey) AS symbol FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_conflict_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), day("l_shipdate").alias("trade_date"))
    return quality.key_issues(rows, ["symbol", "trade_date"]).drop("details")


@query("SELECT 'ERROR' AS severity, 'quarantine_missing_reason' AS code, symbol, ex_date AS trade_date FROM actions WHERE event_key % 4 < 2")
def quarantine_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_key") % 4
    rows = market.actions(spark, sf_dir).withColumn("reason", F.when(k == 0, "  ").when(k > 1, "planned"))
    return quality.quarantine_issues(rows).drop("details")


@query(
    """
SELECT CASE WHEN code IN ('optional_source_failure', 'master_bar_boundary') THEN 'WARNING' ELSE 'FATAL' END AS severity, code, count(*) AS n FROM (
  SELECT CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 'required_source_disabled' WHEN k % 3 = 0 AND k % 5 = 0 THEN 'source_fetch_failed' WHEN k % 4 <> 0 AND k % 5 = 0 THEN 'optional_source_failure' END AS code FROM (SELECT s_suppkey AS k FROM supplier)
  UNION ALL SELECT unnest(['no_current_dataset', 'universe_definition_invalid', 'adjusted_bar_missing_from_dataset', 'calendar_empty_requires_explicit_end'])
  UNION ALL SELECT 'universe_master_mismatch' FROM (SELECT symbol FROM master WHERE board = 'sh_main' UNION ALL SELECT 'X1')
  UNION ALL SELECT 'master_snapshot_incomplete' FROM master m JOIN listing_snapshot s USING (symbol) WHERE s.list_date IS NULL OR s.list_status = 'X'
  UNION ALL SELECT 'master_coverage_mismatch' FROM master WHERE board IN ('star', 'chinext')
  UNION ALL SELECT 'master_bar_boundary' FROM (SELECT DISTINCT b.symbol FROM bars b JOIN master m USING (symbol) WHERE b.trade_date + 30 > m.delist_date)) WHERE code IS NOT NULL GROUP BY code"""
)
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which everything goes wrong for some source or name."""
    k = F.col("s_suppkey")
    fetches = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), (k % 3 == 0).alias("required"), (k % 4 != 0).alias("enabled"), (k % 5 != 0).alias("ok"))
    master, days = market.master(spark, sf_dir).withColumn("list_status", F.lit("L")), market.open_days(spark, sf_dir)
    universe = master.filter("board <> 'sh_main'").select("symbol").unionByName(spark.createDataFrame([("X1",)], "symbol string"))
    coverage = master.filter("board <> 'star'").withColumn("list_date", F.when(F.col("board") != "chinext", F.col("list_date")))
    bars = market.bars(spark, sf_dir).select("symbol", F.date_add("trade_date", 30).alias("trade_date"))
    return gates.run_verdict(
        gates.source_issues(fetches),
        gates.state_issues(days.filter("day IS NULL"), False, None, False, ["daily_bar"]),
        gates.state_issues(days, True, None, True, ["daily_bar", "adjusted_bar"]),
        gates.master_issues(master, universe, coverage, refreshed(spark, sf_dir)[1], bars),
    )


@query(
    """
SELECT "case", passed, codes, CASE WHEN "case" = 'absent' THEN 0 ELSE n END AS n_facts, CASE WHEN "case" = 'absent' THEN 0 ELSE n END AS n_symbols
FROM (VALUES ('absent', false, 'UNIVERSE_MEMBERSHIP_TABLE_MISSING'), ('sound', true, ''), ('tampered', false, 'UNIVERSE_DEFINITION_HASH_MISMATCH'), ('short', false, 'UNIVERSE_MEMBER_COUNT_MISMATCH'),
  ('faulty', false, 'UNIVERSE_ANNOUNCEMENT_AFTER_USE,UNIVERSE_INTERVAL_CONFLICT')) t("case", passed, codes), (SELECT count(DISTINCT o_custkey) AS n FROM orders)"""
)
def membership_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that are absent, sound, not those of the definition, of a wrong number, and with faults."""
    key, text = F.col("o_custkey"), lambda x: F.lit(x).cast("string")
    given = {
        "universe_id": text("U0"), "symbol": F.concat(F.lpad(key.cast("string"), 6, "0"), F.lit(".SH")), "raw_effective_from": text("1994-12-01"), "raw_effective_to": text(None), "announcement_date": text("1994-11-01"), "status": text("active"),
        "reason": text("initial_constituent"), "source": text("s"), "source_url": text("http://x"), "snapshot_sha256": text("0" * 64), "source_document_sha256": text("0" * 64),
    }
    sound = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(*[given[c].alias(c) for c in FACT_COLUMNS])
    sizes = sound.groupBy("universe_id").agg(F.count("*").alias("expected"))
    pinned, calendar = content_hash(sound), market.calendar(spark, sf_dir)
    other = F.col("symbol").endswith("1.SH")
    faulty = sound.withColumns({"announcement_date": F.when(other, "1995-01-05").otherwise(F.col("announcement_date")), "reason": F.when(other, "delisting").otherwise(F.col("reason"))})
    cases = {
        "absent": gates.membership_gate(sound.filter("symbol IS NULL"), pinned),
        "sound": gates.membership_gate(sound, pinned, calendar=calendar, expected=sizes),
        "tampered": gates.membership_gate(sound.withColumn("source", F.lit("t")), pinned, calendar=calendar, expected=sizes),
        "short": gates.membership_gate(sound, pinned, calendar=calendar, expected=sizes.withColumn("expected", F.col("expected") + 1)),
        "faulty": gates.membership_gate(faulty, pinned),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("case"), "passed", F.array_join("codes", ",").alias("codes"), "n_facts", "n_symbols") for name, rows in cases.items()])


@query(
    """
SELECT d.day, 'dataset_open_official_absent' AS difference FROM open_days d WHERE d.day NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate IS NOT NULL)
UNION ALL SELECT DISTINCT CAST(l_shipdate AS DATE), 'official_open_dataset_absent' FROM lineitem WHERE day(l_shipdate) <> 9 AND CAST(l_shipdate AS DATE) NOT IN (SELECT day FROM open_days)
UNION ALL SELECT DISTINCT CAST(l_shipdate AS DATE), 'official_closed_dataset_open' FROM lineitem WHERE day(l_shipdate) = 9 AND CAST(l_shipdate AS DATE) IN (SELECT day FROM open_days)"""
)
def calendar_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    excerpt = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day")).distinct().withColumn("is_open", F.dayofmonth("day") != 9)
    return gates.calendar_excerpt_differences(market.open_days(spark, sf_dir), excerpt)


@query(
    """
SELECT n_name AS board, 'NORMAL' AS status, CAST(DATE '1990-01-01' + CAST(n_nationkey AS INT) AS DATE) AS effective_from, CASE WHEN n_nationkey % 7 = 0 THEN 'uncovered' WHEN n_nationkey % 5 = 0 THEN 'unclaimed' ELSE 'conflicting' END AS difference
FROM nation WHERE (n_nationkey % 5 <> 0 AND n_nationkey % 7 = 0) OR (n_nationkey % 5 = 0 AND n_nationkey % 7 <> 0) OR (n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AND n_nationkey % 4 = 0)"""
)
def rule_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and official limits: some on one side only, some with another rate, the others written with other digits."""
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(n, F.col("n_name").alias("board"), F.lit("NORMAL").alias("status"), F.date_add(F.lit("1990-01-01").cast("date"), n.cast("int")).alias("effective_from"))
    declared = rows.filter(n % 5 != 0).withColumn("rate", F.lit("0.10"))
    official = rows.filter(n % 7 != 0).withColumn("rate", F.when(n % 4 == 0, "0.11").otherwise("0.1000"))
    return gates.rule_differences(declared, official)


@query("SELECT symbol, list_date, delist_date FROM master ORDER BY symbol LIMIT 30")
def master_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer reads of the master: a fixed number of rows is the feature."""
    return gates.evidence_sample(market.master(spark, sf_dir), ["symbol", "list_date", "delist_date", "status", "source"], ["symbol"], 30)


@query("SELECT symbol, ex_date, record_date, cash, bonus, capitalization, status FROM actions ORDER BY symbol, ex_date, record_date, cash, bonus, capitalization, status LIMIT 20")
def action_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.evidence_sample(market.actions(spark, sf_dir), ["symbol", "ex_date", "record_date", "cash", "bonus", "capitalization", "source", "status"], ["symbol", "ex_date"], 20)


@query("SELECT s.trade_date, s.symbol, CAST(r.rank AS INT) AS rank, CAST(row_number() OVER (PARTITION BY s.trade_date ORDER BY r.rank NULLS LAST, s.symbol) AS INT) AS position FROM scored s LEFT JOIN ranked r USING (trade_date, symbol)")
def audit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of a signal in the order of its audit: ranked ones first, the others by symbol."""
    place = F.row_number().over(Window.partitionBy("trade_date", "is_valid").orderBy(F.col("raw_value").desc(), "symbol"))
    rows = scored(spark, sf_dir).withColumn("rank", F.when(F.col("is_valid"), place))
    return gates.audit_positions(rows, "rank", ["trade_date"]).select("trade_date", "symbol", "rank", "position")


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') AS date_text FROM lineitem WHERE strftime(l_shipdate, '%Y%m%d') BETWEEN '19960301' AND '19960430'")
def client_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd").alias("date_text"))
    return rows.filter(clean.in_range("date_text", "19960301", "19960430"))
