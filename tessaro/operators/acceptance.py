"""Acceptance of a published version: evidence tables, samples and checks, each check a query that counts its failures."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.operators.calendars import uncovered_days
from tessaro.operators.quality import KNOWN_SOURCES, blocking
from tessaro.schemas import TABLES

#: The automated checks, in their order.
CHECKS = (
    "dataset_manifest_integrity",
    "quality_report_integrity",
    "required_table_coverage",
    "date_window_completeness",
    "security_master_evidence",
    "corporate_action_evidence",
    "raw_snapshot_traceability",
    "calendar_coverage_evidence",
    "source_role_health",
)
LIST_STATES = ("L", "D", "P")


def open_days_of(rows: DataFrame, day: str = "day", flag: str = "is_open") -> DataFrame:
    """The open days of a supplier's calendar; without a flag column every day is open, and a null flag isn't."""
    kept = rows.filter(F.coalesce(F.col(flag).cast("int") == 1, F.lit(False))) if flag in rows.columns else rows
    return kept.select(F.col(day).alias("day")).distinct()


def edge_day_sample(bars: DataFrame, days: DataFrame) -> DataFrame:
    """All bars of the first and the last of the days: a sample of two rows a name, whatever the window's length."""
    edges = days.agg(F.array_distinct(F.array(F.min("day"), F.max("day"))).alias("d")).select(F.explode("d").alias("trade_date"))
    return bars.join(F.broadcast(edges), "trade_date", "left_semi")


def benchmark_coverage(bars: DataFrame, benchmarks: DataFrame, days: DataFrame) -> DataFrame:
    """Rows, first and last day of each benchmark, and how many of the days it lacks; one without bars counts too."""
    b = bars.select("symbol", "trade_date").join(benchmarks.select("symbol").distinct(), "symbol", "left_semi")
    g = b.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    seen = b.distinct().join(F.broadcast(days.select(F.col("day").alias("trade_date")).distinct()), "trade_date").groupBy("symbol").agg(F.count("*").alias("_seen"))
    n = days.agg(F.count_distinct("day")).scalar()
    out = benchmarks.select("symbol").distinct().join(g, "symbol", "left").join(seen, "symbol", "left").withColumn("open_days", n)
    return out.select("symbol", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "first_day", "last_day", "open_days", (F.col("open_days") - F.coalesce("_seen", F.lit(0))).alias("missing_open_days"))


def refresh_master(master: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing facts of a supplier's snapshot over the master, whose labels stay; and the symbols that the snapshot doesn't
    account for. If there are any, the refresh must not be used: that is fatal, not partial.

    snapshot: symbol, list_date, delist_date, list_status. Rows without a list date or with another state don't count.
    """
    good = snapshot.filter(F.col("list_date").isNotNull() & F.col("list_status").isin(*LIST_STATES))
    facts = good.groupBy("symbol").agg(F.max_by(F.struct("list_date", "delist_date", "list_status"), F.struct("list_date", "list_status")).alias("f"))
    names = [c for c in master.columns if c not in ("list_date", "delist_date", "list_status")]
    j = master.select(*names).join(facts, "symbol", "left")
    refreshed = j.filter("f IS NOT NULL").select(*names, "f.list_date", "f.delist_date", "f.list_status")
    return refreshed, j.filter("f IS NULL").select("symbol")


def latest_run(manifests: DataFrame, by: list[str], created: str = "created_at", name: str = "run_id") -> DataFrame:
    """The newest manifest of each group; of equal times the greatest name."""
    return manifests.groupBy(*by).agg(F.max_by(F.struct("*"), F.struct(created, name)).alias("r")).select("r.*")


def unexplained_gaps(bars: DataFrame, listing: DataFrame, days: DataFrame) -> DataFrame:
    """How many open days of its listing each name has without a bar; names without a gap don't appear.

    Counted from what is there: open days listed less open days with a bar, no grid of names and days.
    """
    d = days.select("day").distinct()
    all_days = d.agg(F.sort_array(F.collect_list("day"))).scalar()
    inside = F.size(F.filter("_days", lambda x: (F.col("list_date").isNull() | (x >= F.col("list_date"))) & (F.col("delist_date").isNull() | (x <= F.col("delist_date")))))
    due = listing.select("symbol", "list_date", "delist_date").withColumn("_days", all_days).select("symbol", "list_date", "delist_date", inside.cast("long").alias("_due"))
    have = bars.select("symbol", F.col("trade_date").alias("day")).distinct().join(F.broadcast(d), "day").join(listing.select("symbol", "list_date", "delist_date"), "symbol")
    have = have.filter((F.col("list_date").isNull() | (F.col("day") >= F.col("list_date"))) & (F.col("delist_date").isNull() | (F.col("day") <= F.col("delist_date")))).groupBy("symbol").agg(F.count("*").alias("_have"))
    return due.join(have, "symbol", "left").select("symbol", (F.col("_due") - F.coalesce("_have", F.lit(0))).alias("n_missing")).filter("n_missing > 0")


def run_checks(
    tables: dict[str, DataFrame], issues: DataFrame, days: DataFrame, benchmarks: DataFrame, start: str, end: str, calendar_spans: DataFrame, tampered: list[str] = (), untraceable: list[str] = ()
) -> DataFrame:
    """The nine automated checks of a version in their order: code, n_failures, passed, error.

    Each check is planned and run by itself. One that can't be run, as where a table is absent, unreadable or has another schema,
    has failed: no count of failures, and the kind of error (never its message, which may hold paths or secrets). The other checks
    aren't touched by that. Only counts reach the driver.

    tables by name; issues of the quality queries; open days; benchmark symbols; calendar_spans (start, end) with provenance;
    tampered: tables whose content hash differs (``Dataset.verify``); untraceable: snapshots that fail ``raw_store.verify``.
    """
    spark = days.sparkSession
    named = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")

    def windows() -> list[DataFrame]:
        window = days.filter(F.col("day").between(lo, hi)).select("day").distinct()
        ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.max((F.col("day") == hi).cast("int")).alias("c"))
        lacking = benchmark_coverage(tables["daily_bar"], benchmarks, window).filter("missing_open_days > 0")
        return [ends.filter((lo < F.col("a")) | (hi > F.col("b")) | (F.coalesce("c", F.lit(0)) == 0)), lacking, unexplained_gaps(tables["daily_bar"], tables["security_master"], window)]

    def unproven_actions() -> list[DataFrame]:
        asked = tables["security_master"].select("symbol", lo.alias("window_start"), hi.alias("window_end"))
        trusted = tables["corporate_action_coverage"].filter("status <> 'UNTRUSTED'").select("symbol", "window_start", "window_end")
        return [uncovered_days(asked, trusted, ["symbol"], "window_start", "window_end").select("symbol").distinct()]

    def uncovered_calendar() -> list[DataFrame]:
        whole = spark.range(1).select(F.lit("calendar").alias("key"), lo.alias("start"), hi.alias("end"))
        return [uncovered_days(whole, calendar_spans.select(F.lit("calendar").alias("key"), "start", "end"), ["key"], "start", "end")]

    failures: dict[str, Callable[[], list[DataFrame]]] = {
        "dataset_manifest_integrity": lambda: [named(tampered)],
        "quality_report_integrity": lambda: [blocking(issues)],
        "required_table_coverage": lambda: [named(sorted(set(TABLES) - set(tables)))],
        "date_window_completeness": windows,
        "security_master_evidence": lambda: [tables["security_master"].select("symbol").join(tables["security_master_coverage"].select("symbol").distinct(), "symbol", "left_anti")],
        "corporate_action_evidence": unproven_actions,
        "raw_snapshot_traceability": lambda: [named(untraceable)],
        "calendar_coverage_evidence": uncovered_calendar,
        "source_role_health": lambda: [tables["daily_bar"].filter(~F.coalesce(F.col("source").isin(*KNOWN_SOURCES), F.lit(False))).select("source").distinct()],
    }
    return spark.createDataFrame([checked(code, failures[code]) for code in CHECKS], "code string, n_failures long, passed boolean, error string")


def checked(code: str, failures: Callable[[], list[DataFrame]]) -> tuple[str, int | None, bool, str | None]:
    """A check's row: the failures counted, or the kind of error that kept them from being counted."""
    try:
        n = sum(f.count() for f in failures())
    except (KeyError, OSError, ValueError, PySparkException, Py4JJavaError) as error:
        return code, None, False, type(error).__name__
    return code, n, n == 0, None
