"""Queries of calendars, as-of and interval joins, membership, adjusted series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.operators import actions as act
from tessaro.operators import calendars, membership, temporal
from tessaro.plans import market
from tessaro.plans.market import day, table
from tessaro.plans.registry import query, view

START, END = "1996-01-01", "1996-12-31"


@query("SELECT CAST(date_trunc('week', day) AS DATE) AS week, max(day) AS day FROM open_days GROUP BY 1")
def week_end_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.week_ends(market.calendar(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, (SELECT min(day) FROM open_days WHERE day > CAST(l_shipdate AS DATE)) AS next_day FROM lineitem")
def next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", day("l_shipdate").alias("ship"))
    return calendars.next_open_day(rows, market.calendar(spark, sf_dir), "ship").drop("ship")


view(
    "listed",
    """
SELECT b.symbol, b.trade_date, CAST(CASE WHEN c.ord IS NULL OR f.first_ord IS NULL OR c.ord < f.first_ord THEN 0 ELSE c.ord - f.first_ord + 1 END AS BIGINT) AS listed_days
FROM bars b LEFT JOIN calendar c ON c.day = b.trade_date LEFT JOIN (SELECT m.symbol, min(c.ord) AS first_ord FROM master m JOIN calendar c ON c.day >= m.list_date GROUP BY 1) f ON f.symbol = b.symbol""",
)


@query("SELECT * FROM listed")
def listed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir).select("symbol", "trade_date")
    return calendars.listed_days(b, market.calendar(spark, sf_dir), market.master(spark, sf_dir))


view("probes", "SELECT o_orderkey, concat('S', o_custkey % 100) AS symbol, CAST(o_orderdate AS DATE) AS signal_date, o_totalprice FROM orders")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("S"), F.col("o_custkey") % 100).alias("symbol"), day("o_orderdate").alias("signal_date"), "o_totalprice")


@query("SELECT p.o_orderkey, p.symbol, b.trade_date AS price_date, b.close FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.signal_date >= b.trade_date")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir).withColumn("price_date", F.col("trade_date"))
    return temporal.asof_join(probes(spark, sf_dir), b, "signal_date", "trade_date", ["symbol"], ["price_date", "close"]).select("o_orderkey", "symbol", "price_date", "close")


@query("SELECT p.o_orderkey, p.symbol, b.trade_date AS price_date, b.close FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN symbol ELSE 'S1' END AS symbol, signal_date FROM probes) p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.signal_date >= b.trade_date")
def asof_hot_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the orders ask for one symbol, which is found by counting and scanned in ranges of days."""
    b = market.bars(spark, sf_dir).withColumn("price_date", F.col("trade_date"))
    p = probes(spark, sf_dir).withColumn("symbol", F.when(F.col("o_orderkey") % 3 == 0, F.col("symbol")).otherwise("S1"))
    return temporal.asof_join(p, b, "signal_date", "trade_date", ["symbol"], ["price_date", "close"], heavy=4_000).select("o_orderkey", "symbol", "price_date", "close")


@query("SELECT p.o_orderkey, p.symbol, b.trade_date AS price_date, b.close FROM probes p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.signal_date > b.trade_date")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir).withColumn("price_date", F.col("trade_date"))
    return temporal.asof_join(probes(spark, sf_dir), b, "signal_date", "trade_date", ["symbol"], ["price_date", "close"], strict=True).select("o_orderkey", "symbol", "price_date", "close")


@query(
    """
SELECT symbol, trade_date, last_value(CASE WHEN dayofyear(trade_date) % 4 <> 0 THEN close END IGNORE NULLS) OVER w AS mark, CAST(row_number() OVER w - max(CASE WHEN dayofyear(trade_date) % 4 <> 0 THEN k END) OVER w AS BIGINT) AS stale_days
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS k FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"""
)
def carried_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("trade_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.dayofyear("trade_date") % 4 != 0
    k = F.row_number().over(w)
    b = market.bars(spark, sf_dir).withColumn("k", k)
    return b.select("symbol", "trade_date", F.last(F.when(there, F.col("close")), ignorenulls=True).over(so_far).alias("mark"), (F.col("k") - F.max(F.when(there, F.col("k"))).over(so_far)).cast("long").alias("stale_days"))


@query(
    """
SELECT universe_id, symbol, effective_from, effective_to, adjustment, usable FROM resolved"""
)
def membership_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("universe_id", "symbol", "effective_from", "effective_to", "adjustment", "usable")


view(
    "resolved",
    """
SELECT universe_id, symbol, greatest(raw_from, list_date) AS effective_from, least(raw_to, delist_date) AS effective_to, announced,
  nullif(concat_ws(',', CASE WHEN list_date > raw_from THEN 'before_listing' END, CASE WHEN delist_date IS NOT NULL AND (raw_to IS NULL OR delist_date < raw_to) THEN 'after_delisting' END), '') AS adjustment,
  coalesce(greatest(raw_from, list_date) <= least(raw_to, delist_date), true) AS usable
FROM (SELECT *, CASE WHEN CAST(symbol[2:] AS BIGINT) % 4 = 0 THEN raw_from + 40 END AS list_date, CASE WHEN CAST(symbol[2:] AS BIGINT) % 9 = 0 THEN raw_from + 20 END AS delist_date FROM memberships)""",
)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = market.memberships(spark, sf_dir)
    key = F.substring("symbol", 2, 20).cast("long")
    listing = facts.select("symbol", F.when(key % 4 == 0, F.date_add("raw_from", 40)).alias("list_date"), F.when(key % 9 == 0, F.date_add("raw_from", 20)).alias("delist_date"))
    return membership.resolve(facts, listing)


view("member_days", "SELECT r.universe_id, r.symbol, d.day FROM resolved r JOIN open_days d ON r.usable AND d.day >= r.effective_from AND (r.effective_to IS NULL OR d.day <= r.effective_to) AND r.announced <= d.day")


@query("SELECT universe_id, symbol, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM member_days GROUP BY 1, 2")
def interval_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many of all open days each name is a member, and from when to when."""
    return membership.member_history(resolved(spark, sf_dir), market.calendar(spark, sf_dir))


@query("SELECT universe_id, day, count(*) AS n_members FROM member_days GROUP BY 1, 2")
def member_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.member_counts(resolved(spark, sf_dir), market.calendar(spark, sf_dir))


@query("SELECT universe_id, symbol, day FROM member_days WHERE day IN (SELECT max(day) FROM open_days GROUP BY date_trunc('month', day))")
def members_at_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members on the last open day of each month, through bins of their intervals."""
    cal = market.calendar(spark, sf_dir)
    asked = cal.groupBy(F.date_trunc("month", "day")).agg(F.max("day").alias("day"))
    return membership.members_on(resolved(spark, sf_dir), cal, asked)


# Members leave U0 for some months, U9 has no facts, and sizes are excepted for two windows of U1 that overlap and one of U2.
view("sized", "SELECT universe_id, symbol, raw_from, CASE WHEN universe_id = 'U0' AND raw_from < DATE '1996-03-01' THEN least(coalesce(raw_to, DATE '1996-03-31'), DATE '1996-03-31') ELSE raw_to END AS raw_to FROM memberships WHERE universe_id <> 'U0' OR raw_from < DATE '1996-03-01' OR raw_from > DATE '1996-06-30'")
view("size_exceptions", "SELECT * FROM (VALUES ('U1', DATE '1996-02-01', DATE '1996-04-30', 12), ('U1', DATE '1996-04-15', DATE '1996-08-31', 20), ('U2', DATE '1997-01-01', DATE '1997-03-31', 30)) t(universe_id, s, e, size)")


@query(
    """
SELECT CASE WHEN actual = 0 THEN 'UNIVERSE_COVERAGE_GAP' ELSE 'UNIVERSE_MEMBER_COUNT_MISMATCH' END AS code, universe_id, expected, actual, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM (
  SELECT *, ord - row_number() OVER (PARTITION BY universe_id, expected, actual ORDER BY ord) AS island FROM (
    SELECT g.universe_id, g.day, g.ord, CAST(coalesce((SELECT arg_min(x.size, x.s) FROM size_exceptions x WHERE x.universe_id = g.universe_id AND g.day BETWEEN x.s AND x.e), 30) AS BIGINT) AS expected, count(m.symbol) AS actual
    FROM (SELECT u.universe_id, c.day, c.ord FROM (SELECT universe_id, min(raw_from) AS s FROM sized GROUP BY 1) u JOIN calendar c ON c.day >= u.s) g
    LEFT JOIN sized m ON m.universe_id = g.universe_id AND m.raw_from <= g.day AND (m.raw_to IS NULL OR g.day <= m.raw_to) GROUP BY ALL) WHERE actual <> expected)
GROUP BY universe_id, expected, actual, island
UNION ALL SELECT 'UNIVERSE_COVERAGE_GAP', 'U9', 30, NULL, NULL, NULL, NULL
UNION ALL SELECT 'UNIVERSE_EXCEPTION_CONFLICT', 'U1', NULL, NULL, NULL, DATE '1996-04-15', DATE '1996-04-30'"""
)
def size_mismatch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: F.lit(x).cast("date")
    early = F.col("raw_from") < d("1996-03-01")
    m = market.memberships(spark, sf_dir).filter((F.col("universe_id") != "U0") | early | (F.col("raw_from") > d("1996-06-30")))
    facts = m.withColumn("raw_to", F.when((F.col("universe_id") == "U0") & early, F.least("raw_to", d("1996-03-31"))).otherwise(F.col("raw_to")))
    expected = spark.createDataFrame([(f"U{k}", 30) for k in (0, 1, 2, 3, 4, 9)], "universe_id string, expected long")
    exceptions = spark.createDataFrame([("U1", "1996-02-01", "1996-04-30", 12), ("U1", "1996-04-15", "1996-08-31", 20), ("U2", "1997-01-01", "1997-03-31", 30)], "universe_id string, start string, end string, size long")
    exceptions = exceptions.withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date")})
    return membership.size_issues(facts, market.calendar(spark, sf_dir), expected, exceptions)


# Each membership is the record of an exception, some with faults.
view(
    "exception_records",
    """
SELECT CASE WHEN k % 31 = 4 THEN 'U' ELSE 'custom_u' END || k % 5 AS universe_id, raw_from AS interval_start, CAST(CASE WHEN k % 29 = 3 THEN raw_from - 1 ELSE raw_from + CAST(k % 3 AS INT) END AS DATE) AS interval_end, k % 40 AS allowed_size,
  CASE WHEN k % 23 = 2 THEN ' adjusted' ELSE 'adjusted "' || k || '"' END AS reason, CASE WHEN k % 19 = 1 THEN NULL ELSE 'rules-' || k % 7 END AS rules_version, CASE WHEN k % 37 = 5 THEN 'x' ELSE sha256(symbol) END AS evidence_sha256
FROM (SELECT *, CAST(symbol[2:] AS BIGINT) AS k FROM memberships)""",
)
view(
    "hashed_records",
    """
SELECT *, sha256('{"allowed_size":' || allowed_size || ',"evidence_sha256":"' || evidence_sha256 || '","interval_end":"' || interval_end || '","interval_start":"' || interval_start || '","reason":"' || replace(reason, '"', chr(92) || '"') || '","rules_version":' || coalesce('"' || rules_version || '"', 'null') || ',"universe_id":"' || universe_id || '"}') AS content_hash,
  concat_ws(',', CASE WHEN universe_id[1] = 'U' THEN 'universe_id' END, CASE WHEN interval_end < interval_start THEN 'interval' END, CASE WHEN allowed_size = 0 THEN 'allowed_size' END, CASE WHEN reason[1] = ' ' THEN 'reason' END, CASE WHEN rules_version IS NULL THEN 'rules_version' END, CASE WHEN evidence_sha256 = 'x' THEN 'evidence_sha256' END) AS faults
FROM exception_records""",
)


def exception_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("symbol", 2, 20).cast("long")
    m = market.memberships(spark, sf_dir).withColumn("k", k)
    k = F.col("k")
    return m.select(
        F.concat(F.when(k % 31 == 4, "U").otherwise("custom_u"), k % 5).alias("universe_id"), F.col("raw_from").alias("interval_start"), F.when(k % 29 == 3, F.date_sub("raw_from", 1)).otherwise(F.date_add("raw_from", (k % 3).cast("int"))).alias("interval_end"),
        (k % 40).alias("allowed_size"), F.when(k % 23 == 2, " adjusted").otherwise(F.concat(F.lit('adjusted "'), k, F.lit('"'))).alias("reason"), F.when(k % 19 != 1, F.concat(F.lit("rules-"), k % 7)).alias("rules_version"),
        F.when(k % 37 == 5, "x").otherwise(F.sha2("symbol", 256)).alias("evidence_sha256"),
    )


@query("SELECT universe_id, interval_start, interval_end, allowed_size, content_hash, faults FROM hashed_records")
def size_exception_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = membership.size_exceptions(exception_records(spark, sf_dir))
    return r.select("universe_id", "interval_start", "interval_end", "allowed_size", "content_hash", F.concat_ws(",", "faults").alias("faults"))


@query("SELECT universe_id, first_hash, content_hash AS second_hash FROM (SELECT *, lag(content_hash) OVER w AS first_hash, lag(interval_end) OVER w AS before FROM hashed_records WHERE faults = '' WINDOW w AS (PARTITION BY universe_id ORDER BY interval_start, interval_end, content_hash)) WHERE before >= interval_start")
def size_exception_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.exception_conflicts(exception_records(spark, sf_dir))


# Each order opens a stay of some days, so that a customer's stays overlap, touch or leave gaps.
view("stays", "SELECT concat('U', o_custkey % 5) AS universe_id, concat('C', o_custkey) AS symbol, CAST(o_orderdate AS DATE) AS raw_from, CASE WHEN o_orderkey % 50 <> 3 THEN CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 90 AS INT) END AS raw_to, o_orderkey FROM orders")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, d = F.col("o_orderkey"), day("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("U"), F.col("o_custkey") % 5).alias("universe_id"), F.concat(F.lit("C"), "o_custkey").alias("symbol"), d.alias("raw_from"), F.when(key % 50 != 3, F.date_add(d, (30 + key % 90).cast("int"))).alias("raw_to"), "o_orderkey"
    )


@query(
    """
SELECT universe_id, symbol, raw_from, raw_to, previous_end FROM (
  SELECT *, max(coalesce(raw_to, DATE '9999-12-31')) OVER (PARTITION BY universe_id, symbol ORDER BY raw_from, raw_to NULLS LAST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end FROM stays) WHERE raw_from <= previous_end"""
)
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.overlaps(stays(spark, sf_dir)).select("universe_id", "symbol", "raw_from", "raw_to", "previous_end")


view(
    "stated",
    """
SELECT universe_id, CASE WHEN o_orderkey % 23 = 0 THEN symbol WHEN o_orderkey % 23 = 1 THEN NULL ELSE lpad(symbol[2:], 6, '0') || '.SH' END AS symbol,
  CASE WHEN o_orderkey % 41 <> 0 THEN CASE WHEN o_orderkey % 29 = 0 THEN raw_from + 400 ELSE raw_from END END AS s, raw_to IS NOT NULL OR o_orderkey % 43 = 0 AS ended, raw_to AS e,
  CASE WHEN o_orderkey % 31 <> 0 THEN CASE WHEN o_orderkey % 37 = 0 THEN raw_from + 9 ELSE raw_from - 3 END END AS announced,
  CASE o_orderkey % 47 WHEN 0 THEN 'unknown' WHEN 1 THEN CASE WHEN raw_to IS NULL THEN 'removed' ELSE 'active' END ELSE CASE WHEN raw_to IS NULL THEN 'active' ELSE 'removed' END END AS status,
  CASE o_orderkey % 9 WHEN 0 THEN 'initial_constituent' WHEN 1 THEN 'delisting' WHEN 2 THEN 'merger_or_reorganization' WHEN 3 THEN 'temporary_adjustment' WHEN 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'no reason' END ELSE 'regular_rebalance' END AS reason,
  o_orderkey % 19 = 0 AS no_url, o_orderkey % 17 = 0 AS bad_digest
FROM stays""",
)
view("boundaries", "SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '.SH' AS symbol, CASE WHEN o_custkey % 3 = 0 THEN min(CAST(o_orderdate AS DATE)) + 100 END AS list_date, CASE WHEN o_custkey % 5 = 0 THEN max(CAST(o_orderdate AS DATE)) - 100 END AS delist_date FROM orders WHERE o_custkey % 8 <> 0 GROUP BY o_custkey")
@query(
    """
SELECT code, problem, count(*) AS n FROM (
  SELECT i, i[1] AS code, i[2] AS problem FROM (SELECT unnest([
    CASE WHEN bad_digest THEN ['UNIVERSE_EVIDENCE_MISSING', 'snapshot_sha256'] END, CASE WHEN no_url THEN ['UNIVERSE_EVIDENCE_MISSING', 'source_url'] END,
    CASE WHEN NOT canonical THEN ['UNIVERSE_UNKNOWN_SYMBOL', 'non_canonical_symbol'] WHEN NOT known THEN ['UNIVERSE_UNKNOWN_SYMBOL', 'absent_from_security_master'] END,
    CASE WHEN s IS NULL THEN ['UNIVERSE_INTERVAL_CONFLICT', 'raw_effective_from_missing'] END, CASE WHEN announced IS NULL THEN ['UNIVERSE_INTERVAL_CONFLICT', 'announcement_date_missing'] END,
    CASE WHEN ended AND e IS NULL THEN ['UNIVERSE_INTERVAL_CONFLICT', 'raw_effective_to_unparsable'] END,
    CASE WHEN status = 'unknown' THEN ['UNIVERSE_INTERVAL_CONFLICT', 'unknown_status'] WHEN status = 'active' AND ended THEN ['UNIVERSE_INTERVAL_CONFLICT', 'active_fact_cannot_end'] WHEN status = 'removed' AND NOT ended THEN ['UNIVERSE_INTERVAL_CONFLICT', 'removed_fact_requires_end'] END,
    CASE WHEN reason IS NULL OR reason = 'no reason' THEN ['UNIVERSE_INTERVAL_CONFLICT', 'unknown_reason'] WHEN final AND status <> 'removed' THEN ['UNIVERSE_INTERVAL_CONFLICT', 'termination_reason_requires_removed_status'] WHEN reason = 'initial_constituent' AND status <> 'active' THEN ['UNIVERSE_INTERVAL_CONFLICT', 'initial_constituent_requires_active_status'] END,
    CASE WHEN e < s THEN ['UNIVERSE_INTERVAL_CONFLICT', 'end_precedes_start'] END,
    CASE WHEN ps IS NOT NULL AND s IS NOT NULL AND (pe IS NULL OR pe >= s) THEN ['UNIVERSE_INTERVAL_OVERLAP', 'begins_before_the_one_before_has_ended'] END,
    CASE WHEN announced > s THEN ['UNIVERSE_ANNOUNCEMENT_AFTER_USE', 'announced_after_start'] END,
    CASE WHEN s IS NULL OR NOT canonical OR NOT known THEN NULL WHEN final AND status = 'removed' AND delist_date IS NULL THEN ['UNIVERSE_DELISTING_ENDPOINT_UNPROVEN', 'delisting_without_last_tradable_day']
      WHEN greatest(s, list_date) > least(e, delist_date) THEN ['UNIVERSE_MASTER_INTERSECTION_EMPTY', 'no_day_between_listing_and_delisting'] END]) AS i
  FROM (SELECT t.*, l.symbol IS NOT NULL AS known, coalesce(regexp_full_match(t.symbol, '[0-9]{6}[.](SH|SZ|BJ)'), false) AS canonical, coalesce(reason IN ('delisting', 'merger_or_reorganization'), false) AS final, l.list_date, l.delist_date,
      lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM stated t LEFT JOIN boundaries l USING (symbol) WINDOW w AS (PARTITION BY t.universe_id, t.symbol ORDER BY s NULLS FIRST, e NULLS LAST))))
WHERE i IS NOT NULL GROUP BY 1, 2"""
)
def membership_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with faults put in by rule: every fault of every check, counted by code and problem."""
    from tessaro.sources.membership_file import fact_issues

    key, n = F.col("o_orderkey"), F.lpad(F.substring("symbol", 2, 20), 6, "0")
    open_ = F.col("raw_to").isNull()
    status = F.when(key % 47 == 0, "unknown").when(F.when(key % 47 == 1, ~open_).otherwise(open_), "active").otherwise("removed")
    reason = F.element_at(F.array(*map(F.lit, ("initial_constituent", "delisting", "merger_or_reorganization", "temporary_adjustment", "", "regular_rebalance"))), F.least(key % 9 + 1, F.lit(6)).cast("int"))
    facts = stays(spark, sf_dir).select(
        "universe_id",
        F.when(key % 23 == 0, F.col("symbol")).when(key % 23 != 1, F.concat(n, F.lit(".SH"))).alias("symbol"),
        F.when(key % 41 != 0, F.when(key % 29 == 0, F.date_add("raw_from", 400)).otherwise(F.col("raw_from"))).cast("string").alias("raw_effective_from"),
        F.coalesce(F.col("raw_to").cast("string"), F.when(key % 43 == 0, "soon")).alias("raw_effective_to"),
        F.when(key % 31 != 0, F.when(key % 37 == 0, F.date_add("raw_from", 9)).otherwise(F.date_sub("raw_from", 3))).alias("announcement_date"),
        status.alias("status"),
        F.when((key % 9 == 4) & (key % 5 == 0), "no reason").otherwise(reason).alias("reason"),
        F.lit("s").alias("source"),
        F.when(key % 19 == 0, " ").otherwise("http://x").alias("source_url"),
        F.when(key % 17 == 0, "0" * 63).otherwise("0" * 64).alias("snapshot_sha256"),
        F.lit("0" * 64).alias("source_document_sha256"),
    )
    d = day("o_orderdate")
    own = table(spark, sf_dir, "orders").filter("o_custkey % 8 <> 0").groupBy("o_custkey").agg(F.date_add(F.min(d), 100).alias("a"), F.date_sub(F.max(d), 100).alias("b"))
    master = own.select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".SH")).alias("symbol"), F.when(F.col("o_custkey") % 3 == 0, F.col("a")).alias("list_date"), F.when(F.col("o_custkey") % 5 == 0, F.col("b")).alias("delist_date"))
    return fact_issues(facts, master).select("code", F.explode("problems").alias("problem")).groupBy("code", "problem").agg(F.count("*").alias("n"))


view(
    "merged_stays",
    """
SELECT symbol, min(raw_from) AS raw_from, max(raw_to) AS raw_to, count(*) AS n_spans FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR raw_from > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY raw_from, raw_to ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, max(raw_to) OVER (PARTITION BY symbol ORDER BY raw_from, raw_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stays WHERE raw_to IS NOT NULL))
GROUP BY symbol, run""",
)


@query("SELECT * FROM merged_stays")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.merge_spans(stays(spark, sf_dir).filter("raw_to IS NOT NULL"), ["symbol"], "raw_from", "raw_to")


@query(
    """
SELECT symbol, min(raw_from) AS raw_from, nullif(max(t), DATE '9999-12-31') AS raw_to FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR raw_from > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY raw_from, t ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT symbol, raw_from, t, CASE WHEN r < DATE '9999-12-30' THEN r WHEN r IS NOT NULL THEN DATE '9999-12-30' END AS reach FROM (
      SELECT *, coalesce(raw_to, DATE '9999-12-31') AS t, max(coalesce(raw_to, DATE '9999-12-31')) OVER (PARTITION BY symbol ORDER BY raw_from, coalesce(raw_to, DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM stays)))
GROUP BY symbol, run"""
)
def membership_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.merge_adjacent(stays(spark, sf_dir)).select("symbol", "raw_from", "raw_to")


@query(
    f"""
WITH a AS (SELECT symbol, DATE '{START}' AS s, DATE '{END}' AS e FROM (SELECT DISTINCT symbol FROM stays)),
m AS (SELECT a.symbol, s, e, raw_from, raw_to FROM a LEFT JOIN merged_stays x ON a.symbol = x.symbol AND x.raw_to >= s AND x.raw_from <= e),
g AS (SELECT symbol, coalesce(lag(raw_to) OVER (PARTITION BY symbol ORDER BY raw_from) + 1, s) AS gap_start, coalesce(raw_from - 1, e) AS gap_end FROM m
      UNION ALL SELECT symbol, max(raw_to) + 1, max(e) FROM m WHERE raw_to IS NOT NULL GROUP BY 1)
SELECT symbol, CAST(gap_start AS DATE) AS gap_start, CAST(gap_end AS DATE) AS gap_end FROM g WHERE gap_start <= gap_end"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = stays(spark, sf_dir).filter("raw_to IS NOT NULL").select("symbol", "raw_from", "raw_to")
    asked = stays(spark, sf_dir).select("symbol", F.lit(START).cast("date").alias("raw_from"), F.lit(END).cast("date").alias("raw_to")).distinct()
    return calendars.uncovered_days(asked, spans, ["symbol"], "raw_from", "raw_to").select("symbol", "gap_start", "gap_end")


@query(
    """
SELECT symbol, raw_from, raw_to, CASE WHEN raw_from <= p THEN 'overlap' ELSE 'gap' END AS fault FROM (
  SELECT *, lag(raw_to) OVER (PARTITION BY symbol ORDER BY raw_from, raw_to) AS p FROM (SELECT symbol, raw_from, max(raw_to) AS raw_to FROM stays WHERE raw_to IS NOT NULL GROUP BY 1, 2)) WHERE raw_from <= p OR raw_from > p + 1"""
)
def span_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = stays(spark, sf_dir).filter("raw_to IS NOT NULL").groupBy("symbol", "raw_from").agg(F.max("raw_to").alias("raw_to"))
    return calendars.span_faults(spans, ["symbol"], "raw_from", "raw_to").select("symbol", "raw_from", "raw_to", "fault")


@query(
    f"""
SELECT symbol, raw_from, raw_to FROM merged_stays WHERE raw_to < DATE '{START}' OR raw_from > DATE '{END}'
UNION ALL SELECT symbol, raw_from, CAST(DATE '{START}' - 1 AS DATE) FROM merged_stays WHERE raw_to >= DATE '{START}' AND raw_from < DATE '{START}'
UNION ALL SELECT symbol, CAST(DATE '{END}' + 1 AS DATE), raw_to FROM merged_stays WHERE raw_from <= DATE '{END}' AND raw_to > DATE '{END}'
UNION ALL SELECT DISTINCT symbol, DATE '{START}', DATE '{END}' FROM merged_stays WHERE length(symbol) = 3"""
)
def span_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = calendars.merge_spans(stays(spark, sf_dir).filter("raw_to IS NOT NULL"), ["symbol"], "raw_from", "raw_to").drop("n_spans")
    fresh = spans.filter(F.length("symbol") == 3).select("symbol", F.lit(START).cast("date").alias("raw_from"), F.lit(END).cast("date").alias("raw_to")).distinct()
    return calendars.replace_in_spans(spans, START, END, fresh, ["symbol"], "raw_from", "raw_to")


view("snapshots", "SELECT DISTINCT concat('U', o_custkey % 5) AS universe_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot, concat('C', o_custkey % 40) AS symbol FROM orders WHERE o_orderkey % 3 <> 0")


@query(
    """
SELECT universe_id, symbol, s AS raw_from, CAST(n - 1 AS DATE) AS raw_to, CASE WHEN n IS NULL AND row_number() OVER (PARTITION BY universe_id, symbol ORDER BY s) = 1 THEN 'initial_constituent' ELSE 'regular_rebalance' END AS reason
FROM (SELECT universe_id, symbol, min(snapshot) AS s, arg_max(nxt, snapshot) FILTER (last_of_run) AS n FROM (
  SELECT universe_id, symbol, snapshot, nxt, island, snapshot = max(snapshot) OVER (PARTITION BY universe_id, symbol, island) AS last_of_run FROM (
    SELECT s.*, d.nxt, d.ord - row_number() OVER (PARTITION BY s.universe_id, s.symbol ORDER BY d.ord) AS island FROM snapshots s JOIN (
      SELECT universe_id, snapshot, row_number() OVER w AS ord, lead(snapshot) OVER w AS nxt FROM (SELECT DISTINCT universe_id, snapshot FROM snapshots) WINDOW w AS (PARTITION BY universe_id ORDER BY snapshot)) d USING (universe_id, snapshot)))
  GROUP BY universe_id, symbol, island)"""
)
def snapshot_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0")
    s = s.select(F.concat(F.lit("U"), F.col("o_custkey") % 5).alias("universe_id"), F.date_trunc("month", "o_orderdate").cast("date").alias("snapshot"), F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("symbol"))
    return membership.from_snapshots(s)


@query("SELECT universe_id, symbol, raw_from, CAST(raw_to - 1 AS DATE) AS raw_to, CASE WHEN raw_to IS NULL AND raw_from = (SELECT min(raw_from) FROM memberships) THEN 'initial_constituent' ELSE 'regular_rebalance' END AS reason FROM memberships")
def half_open_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market.memberships(spark, sf_dir)
    return membership.half_open_to_inclusive(m.withColumnRenamed("raw_from", "opt_in").withColumnRenamed("raw_to", "opt_out"), m.agg(F.min("raw_from")).scalar())


@query(
    """
SELECT symbol, CASE WHEN n % 13 = 1 AND raw_to IS NULL THEN DATE '2001-12-31' WHEN n % 13 = 4 AND raw_to IS NULL THEN DATE '2002-12-31' WHEN n % 13 = 5 THEN NULL ELSE raw_to END AS raw_to
FROM (SELECT *, CAST(symbol[2:] AS BIGINT) AS n FROM memberships) WHERE n % 13 <> 2 OR raw_to IS NOT NULL
UNION ALL SELECT symbol || 'X', CAST(NULL AS DATE) FROM memberships WHERE CAST(symbol[2:] AS BIGINT) % 13 = 3"""
)
def membership_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends set where they are open (1), drops of open facts, stale where a fact has ended (2), new facts (3), two repairs of one
    field in a row (4), and ends taken back (5)."""
    m = market.memberships(spark, sf_dir).select("universe_id", "symbol", "raw_from", "raw_to")
    n = F.substring("symbol", 2, 20).cast("long") % 13
    row = F.create_map(F.lit("raw_from"), F.col("raw_from").cast("string"), F.lit("raw_to"), F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    step = lambda seq, action, old, new: F.struct(F.lit(seq).alias("seq"), F.lit(action).alias("action"), old.alias("old_value"), new.alias("new_value"))
    steps = (
        F.when(n == 1, F.array(step(1, "set_field", none, F.lit("2001-12-31"))))
        .when(n == 2, F.array(step(1, "drop_row", none, none)))
        .when(n == 3, F.array(step(1, "insert_row", none, none)))
        .when(n == 4, F.array(step(1, "set_field", none, F.lit("2001-12-31")), step(2, "set_field", F.lit("2001-12-31"), F.lit("2002-12-31"))))
        .when(n == 5, F.array(step(1, "set_field", F.col("raw_to").cast("string"), none)))
    )
    repairs = m.select("universe_id", F.when(n == 3, F.concat("symbol", F.lit("X"))).otherwise(F.col("symbol")).alias("symbol"), F.lit("raw_to").alias("field"), row.alias("row"), F.explode(steps).alias("s")).select("universe_id", "symbol", "field", "row", "s.*")
    return membership.apply_repairs(m, repairs, ["universe_id", "symbol"]).select("symbol", "raw_to")


@query("SELECT 'U9' AS universe_id, symbol, raw_from FROM memberships WHERE symbol IN (SELECT concat('C', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    return membership.trim(market.memberships(spark, sf_dir), keep, "U9").select("universe_id", "symbol", "raw_from")


@query("SELECT board, count(*) AS n FROM master GROUP BY 1")
def universe_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.master(spark, sf_dir).groupBy("board").agg(F.count("*").alias("n"))


@query("SELECT day, pretrade_date, actual_previous FROM (SELECT day, lag(day) OVER (ORDER BY day) AS actual_previous, CASE WHEN ord % 50 = 0 THEN CAST(day - 9 AS DATE) WHEN ord % 50 <> 1 THEN lag(day) OVER (ORDER BY day) END AS pretrade_date FROM calendar) WHERE actual_previous IS NOT NULL AND actual_previous IS DISTINCT FROM pretrade_date")
def pretrade_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar whose every fiftieth day names a wrong day before, and the next one none."""
    w = Window.orderBy("day")
    stated = F.when(F.col("ord") % 50 == 0, F.date_sub("day", 9)).when(F.col("ord") % 50 != 1, F.lag("day").over(w))
    return calendars.pretrade_faults(market.calendar(spark, sf_dir).select("day", stated.alias("pretrade_date")))


@query(
    f"""
SELECT d.day, count(o.day) AS n, CASE WHEN count(o.day) = 0 THEN 'missing' ELSE 'repeated' END AS fault FROM (SELECT CAST(unnest(generate_series(DATE '{START}' - INTERVAL 1 DAY, DATE '{END}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT day FROM open_days UNION ALL SELECT day FROM open_days WHERE day(day) = 3) o ON o.day = d.day GROUP BY 1 HAVING count(o.day) <> 1"""
)
def calendar_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = market.open_days(spark, sf_dir)
    return calendars.halo_faults(d.unionByName(d.filter(F.dayofmonth("day") == 3)), START, END)


@query(
    """
SELECT coalesce(a.day, b.day) AS day, CASE WHEN a.day IS NULL OR b.day IS NULL THEN 'presence' WHEN a.is_open <> b.is_open THEN 'is_open' END AS field
FROM (SELECT day, true AS is_open FROM open_days) a FULL JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, day(l_shipdate) <> 9 AS is_open FROM lineitem) b ON a.day = b.day
WHERE a.day IS NULL OR b.day IS NULL OR a.is_open <> b.is_open"""
)
def calendar_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("date").alias("pretrade_date")
    a = market.open_days(spark, sf_dir).select("day", F.lit(True).alias("is_open"), none)
    b = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day")).distinct().select("day", (F.dayofmonth("day") != 9).alias("is_open"), none)
    return calendars.calendar_disagreements(a, b)


view(
    "faulty",
    """
SELECT *, CASE WHEN status <> 'implemented' THEN 'corporate_action_not_implemented' WHEN announcement_date > ex_date THEN 'corporate_action_not_point_in_time' WHEN rights > 0 THEN 'unsupported_corporate_action' END AS fault FROM actions""",
)
view(
    "breaks",
    """
SELECT symbol, trade_date, coalesce(q, own, cov) AS reason FROM (
  SELECT b.symbol, b.trade_date, CASE WHEN f.quarantined THEN 'cross_source_conflict' END AS q, f.own, CASE WHEN b.trade_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-10' AND length(b.symbol) = 2 THEN 'corporate_action_coverage_untrusted' END AS cov
  FROM bars b LEFT JOIN (SELECT symbol, ex_date, min(fault) AS own, bool_or(event_key % 31 = 0) AS quarantined FROM faulty GROUP BY 1, 2) f ON f.symbol = b.symbol AND f.ex_date = b.trade_date)
WHERE coalesce(q, own, cov) IS NOT NULL""",
)


def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, b = market.actions(spark, sf_dir), market.bars(spark, sf_dir)
    quarantined = events.filter("event_key % 31 = 0").select("symbol", "ex_date", F.lit("cross_source_conflict").alias("reason"))
    coverage = b.select("symbol").distinct().filter(F.length("symbol") == 2).select("symbol", F.lit("1997-03-01").cast("date").alias("window_start"), F.lit("1997-03-10").cast("date").alias("window_end"), F.lit("UNTRUSTED").alias("status"))
    return act.break_reasons(events, quarantined, coverage, b)


@query("SELECT * FROM breaks")
def break_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks(spark, sf_dir)


view(
    "adjusted",
    """
SELECT symbol, trade_date, close, first_value(close) OVER run * product(step) OVER run AS adjusted_close, CASE WHEN reason IS NULL THEN 'INFO' ELSE 'ERROR' END AS quality_severity, coalesce(reason, '') AS invalid_reason,
  CASE WHEN step_action THEN '["' || symbol || '#' || trade_date || '"]' ELSE '[]' END AS applied_action_ids
FROM (SELECT *, sum(CASE WHEN anchor THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY trade_date) AS run_no, NOT anchor AND cash IS NOT NULL AS step_action,
        CASE WHEN anchor THEN 1.0::DOUBLE ELSE (close * (1 + coalesce(share, 0)) + coalesce(cash, 0)) / prev END AS step
  FROM (SELECT b.symbol, b.trade_date, b.close, a.cash, a.share, k.reason, lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.trade_date) AS prev, lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.trade_date) IS NULL OR k.reason IS NOT NULL AS anchor
    FROM bars b LEFT JOIN (SELECT symbol, ex_date, sum(CAST(cash AS DECIMAL(18,6)))::DOUBLE AS cash, sum(CAST(bonus + capitalization AS DECIMAL(18,6)))::DOUBLE AS share FROM faulty WHERE fault IS NULL GROUP BY 1, 2) a ON a.symbol = b.symbol AND a.ex_date = b.trade_date
    LEFT JOIN breaks k ON k.symbol = b.symbol AND k.trade_date = b.trade_date))
WINDOW run AS (PARTITION BY symbol, run_no ORDER BY trade_date)""",
)


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.adjusted_bars(market.bars(spark, sf_dir), market.actions(spark, sf_dir), breaks(spark, sf_dir))


@query("SELECT symbol, trade_date, round(adjusted_close, 4) AS adjusted_close, round(adjusted_close / close, 8) AS adjustment_factor, quality_severity, invalid_reason, applied_action_ids FROM adjusted")
def adjusted_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adjusted(spark, sf_dir)
    return a.select("symbol", "trade_date", F.round("adjusted_close", 4).alias("adjusted_close"), F.round("adjustment_factor", 8).alias("adjustment_factor"), "quality_severity", "invalid_reason", "applied_action_ids")


@query("SELECT f.symbol, f.ex_date, count(*) AS n FROM faulty f LEFT JOIN bars b ON b.symbol = f.symbol AND b.trade_date = f.ex_date WHERE f.fault IS NULL AND b.symbol IS NULL GROUP BY 1, 2")
def unapplied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.unapplied_events(market.bars(spark, sf_dir), market.actions(spark, sf_dir)).groupBy("symbol", "ex_date").agg(F.count("*").alias("n"))


@query(
    """
SELECT code, count(*) AS n FROM (
  SELECT CASE WHEN dayofyear(trade_date) % 10 = 0 THEN 'adjusted_bar_missing_raw' WHEN dayofyear(trade_date) % 10 = 1 THEN 'adjusted_bar_raw_close_mismatch' END AS code FROM adjusted
  UNION ALL SELECT 'adjusted_bar_unknown_action' FROM adjusted a WHERE applied_action_ids <> '[]' AND NOT EXISTS (SELECT 1 FROM actions e WHERE e.symbol = a.symbol AND e.ex_date = a.trade_date AND e.event_key % 3 <> 0)) WHERE code IS NOT NULL GROUP BY 1"""
)
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market.bars(spark, sf_dir).filter(F.dayofyear("trade_date") % 10 != 0)
    b = b.withColumn("close", F.when(F.dayofyear("trade_date") % 10 == 1, F.col("close") + 1).otherwise(F.col("close")))
    faults = act.lineage_faults(adjusted(spark, sf_dir), b, market.actions(spark, sf_dir).filter("event_key % 3 <> 0"))
    return faults.groupBy("code").agg(F.count("*").alias("n"))


view(
    "chain",
    """
SELECT symbol, trade_date, close, CASE WHEN volume % 20 = 0 THEN NULL WHEN volume % 3 = 0 THEN lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) + 1 ELSE lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) END AS pre_close FROM bars""",
)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    return market.bars(spark, sf_dir).select("symbol", "trade_date", "close", F.when(F.col("volume") % 20 == 0, None).when(F.col("volume") % 3 == 0, before + 1).otherwise(before).alias("pre_close"))


view(
    "runs",
    """
SELECT r.symbol, r.first_day, r.last_day, r.n_days, r.previous_close, r.next_pre_close, e.first_ex_date,
  CASE WHEN previous_close IS NULL OR next_pre_close IS NULL THEN 'suspension_run_unverified' WHEN first_ex_date IS NOT NULL OR abs(next_pre_close - previous_close) <= 0.005 THEN 'suspension_row' ELSE 'unexplained_primary_gap' END AS code
FROM (SELECT g.*, p.close AS previous_close, n.pre_close AS next_pre_close FROM (
    SELECT symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM (
      SELECT x.*, ord - row_number() OVER (PARTITION BY symbol ORDER BY ord) AS island FROM (
        SELECT m.symbol, c.day, c.ord FROM master m JOIN calendar c ON c.day >= m.list_date AND (m.delist_date IS NULL OR c.day <= m.delist_date)
        WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = m.symbol AND b.trade_date = c.day)) x) GROUP BY symbol, island) g
  ASOF LEFT JOIN chain p ON p.symbol = g.symbol AND g.first_day > p.trade_date ASOF LEFT JOIN chain n ON n.symbol = g.symbol AND g.last_day < n.trade_date) r
LEFT JOIN LATERAL (SELECT min(ex_date) AS first_ex_date FROM actions a WHERE a.symbol = r.symbol AND a.status = 'implemented' AND a.ex_date BETWEEN r.first_day AND r.last_day) e ON true""",
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.suspension_runs(chain(spark, sf_dir), market.calendar(spark, sf_dir), market.master(spark, sf_dir), market.actions(spark, sf_dir), tasks=market.name_tasks(spark, sf_dir))


@query("SELECT symbol, first_day, last_day, n_days, previous_close, next_pre_close, first_ex_date, code FROM runs")
def suspension_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("symbol", "first_day", "last_day", "n_days", "previous_close", "next_pre_close", "first_ex_date", "code")


@query("SELECT r.symbol, c.day AS trade_date, CASE WHEN c.day < r.first_ex_date THEN r.previous_close ELSE r.next_pre_close END AS close FROM runs r JOIN calendar c ON c.day BETWEEN r.first_day AND r.last_day WHERE r.code = 'suspension_row'")
def suspension_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.suspension_bars(runs(spark, sf_dir), market.calendar(spark, sf_dir)).select("symbol", "trade_date", "close")


