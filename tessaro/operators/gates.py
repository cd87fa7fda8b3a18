"""Gates of a run and of its evidence: what stops a version, and how it compares with outside excerpts an operator signs over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.membership import size_issues
from tessaro.operators.quality import boundary_issues
from tessaro.sources.catalog import content_hash
from tessaro.sources.membership_file import FACT_COLUMNS, fact_issues

# Codes of a whole run and their severity.
RUN_CODES = {
    "required_source_disabled": "FATAL",
    "source_fetch_failed": "FATAL",
    "optional_source_failure": "WARNING",
    "no_current_dataset": "FATAL",
    "calendar_empty_requires_explicit_end": "FATAL",
    "universe_definition_invalid": "FATAL",
    "adjusted_bar_missing_from_dataset": "FATAL",
    "universe_master_mismatch": "FATAL",
    "master_snapshot_incomplete": "FATAL",
    "master_coverage_mismatch": "FATAL",
    "master_bar_boundary": "WARNING",
}
LISTING = ("list_date", "delist_date", "list_status")


def source_issues(fetches: DataFrame) -> DataFrame:
    """code, subject of each source that a run lacked. fetches: source, required, enabled, ok. A disabled optional source is no
    fault, and a null flag counts as false."""
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    code = (
        F.when(is_("required") & ~is_("enabled"), "required_source_disabled")
        .when(is_("required") & ~is_("ok"), "source_fetch_failed")
        .when(is_("enabled") & ~is_("ok"), "optional_source_failure")
    )
    return fetches.select(code.alias("code"), F.col("source").alias("subject")).filter("code IS NOT NULL")


def state_issues(days: DataFrame, has_current: bool, end: str | None, definition_valid: bool, tables: list[str]) -> DataFrame:
    """Faults of what a run starts from: no version, no open day and no end given, a bad universe, a version without adjusted bars."""
    empty = days.limit(1).agg((F.count("*") == 0).alias("e"))
    holds = {
        "no_current_dataset": F.lit(not has_current),
        "calendar_empty_requires_explicit_end": F.col("e") & F.lit(end is None),
        "universe_definition_invalid": F.lit(not definition_valid),
        "adjusted_bar_missing_from_dataset": F.lit("adjusted_bar" not in tables),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in holds.items()]))
    return empty.select(F.explode(found).alias("code"), F.lit(None).cast("string").alias("subject"))


def master_issues(master: DataFrame, universe: DataFrame, coverage: DataFrame, unaccounted: DataFrame, bars: DataFrame) -> DataFrame:
    """code, subject for each symbol: in the universe or the master alone, not accounted for by a refresh, without coverage or with
    other listing facts there, and with bars outside its listing."""
    named = lambda rows, code: rows.select(F.lit(code).alias("code"), F.col("symbol").alias("subject")).distinct()
    a, b = master.select("symbol").distinct().withColumn("_m", F.lit(1)), universe.select("symbol").distinct().withColumn("_u", F.lit(1))
    alone = a.join(b, "symbol", "full").filter("_m IS NULL OR _u IS NULL")
    facts = coverage.groupBy("symbol").agg(F.max(F.struct(*LISTING)).alias("_f"))
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_f.{c}")) for c in LISTING])
    drifted = master.join(facts, "symbol", "left").filter(F.col("_f").isNull() | differs)
    parts = {"universe_master_mismatch": alone, "master_snapshot_incomplete": unaccounted, "master_coverage_mismatch": drifted, "master_bar_boundary": boundary_issues(bars, master)}
    return reduce(DataFrame.unionByName, [named(rows, code) for code, rows in parts.items()])


def run_verdict(*issues: DataFrame) -> DataFrame:
    """severity, code, n of the given issues (code, subject); a FATAL one means that the run must not publish."""
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in RUN_CODES.items() for x in kv]), F.col("code"))
    return reduce(DataFrame.unionByName, issues).groupBy("code").agg(F.count("*").alias("n")).select(severity.alias("severity"), "code", "n")


def membership_gate(facts: DataFrame | None, pinned: str, master: DataFrame | None = None, calendar: DataFrame | None = None, expected: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """One row: passed, codes (sorted, distinct), n_facts, n_symbols. The first of these that fails: there are facts; none has a
    fault; with calendar and expected sizes, counts are right on all days; their content has the pinned hash."""
    spark = (facts if facts is not None else master).sparkSession
    row = lambda codes, n=0, names=0: spark.createDataFrame([(not codes, codes, n, names)], "passed boolean, codes array<string>, n_facts long, n_symbols long")
    if facts is None or facts.isEmpty():
        return row(["UNIVERSE_MEMBERSHIP_TABLE_MISSING"])
    found = fact_issues(facts, master).select("code")
    well_formed = tuple(facts.columns) == FACT_COLUMNS
    if expected is not None and well_formed:
        dated = facts.select("universe_id", "symbol", F.to_date("raw_effective_from").alias("raw_from"), F.to_date("raw_effective_to").alias("raw_to"))
        found = found.unionByName(size_issues(dated, calendar, expected, exceptions).select("code"))
    codes = sorted(r.code for r in found.distinct().collect())  # at most one row for each known code
    n = facts.agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("names")).first() if well_formed else None
    if not codes and content_hash(facts) != pinned:
        codes = ["UNIVERSE_DEFINITION_HASH_MISMATCH"]
    return row(codes, *n) if n is not None else row(codes)


def calendar_excerpt_differences(days: DataFrame, excerpt: DataFrame) -> DataFrame:
    """day, difference between a version's open days and an official excerpt (day, is_open), both ways; closed days that the
    version lacks agree. A day listed as open and as closed has both differences where both apply."""
    ours = days.select("day").distinct().withColumn("_ours", F.lit(True))
    listed = excerpt.groupBy("day").agg(F.bool_or("is_open").alias("_open"), F.bool_or(~F.col("is_open")).alias("_closed")).withColumn("_listed", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(yes("_ours") & ~yes("_listed"), "dataset_open_official_absent"),
            F.when(~yes("_ours") & yes("_open"), "official_open_dataset_absent"),
            F.when(yes("_ours") & yes("_closed"), "official_closed_dataset_open"),
        )
    )
    return ours.join(listed, "day", "full").select("day", F.explode(kinds).alias("difference"))


def rule_differences(declared: DataFrame, official: DataFrame) -> DataFrame:
    """board, status, effective_from, difference between declared price limits and an official excerpt (rate as text or number):
    uncovered (only declared), conflicting (another rate, compared as decimals), unclaimed (only official)."""
    key = ["board", "status", "effective_from"]
    rates = lambda rows, name: rows.groupBy(*key).agg(F.max(F.col("rate").cast("decimal(18,9)")).alias(name), F.lit(True).alias(f"{name}_there"))
    j = rates(declared, "_ours").join(rates(official, "_theirs"), key, "full")
    kind = F.when(F.col("_theirs_there").isNull(), "uncovered").when(F.col("_ours_there").isNull(), "unclaimed").when(~F.col("_ours").eqNullSafe(F.col("_theirs")), "conflicting")
    return j.select(*key, kind.alias("difference")).filter("difference IS NOT NULL")


def evidence_sample(rows: DataFrame, columns: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows in a stated order, of the wanted columns that there are: what a reviewer reads, not what is checked. Ties go by
    all columns, so that the sample doesn't change with the partitions."""
    have = [c for c in columns if c in rows.columns]
    return rows.select(*have).orderBy(*order, *[c for c in have if c not in order]).limit(limit)


def audit_positions(rows: DataFrame, rank: str, by: list[str], position: str = "position") -> DataFrame:
    """rows with their place from 1 in the audit order of each group: by rank, rows without one last, then by symbol."""
    return rows.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(rank).asc_nulls_last(), "symbol")))
