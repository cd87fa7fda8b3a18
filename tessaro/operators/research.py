"""Walk-forward research: fold schedules, preflight, stability and challenge verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.calendars import on_ordinals


@dataclass(frozen=True)
class SchedulePolicy:
    warmup_years: int = 3
    min_warmup_sessions: int = 756
    max_extension_years: int = 10


@dataclass(frozen=True)
class StabilityPolicy:
    minimum_executed_folds: int = 5
    minimum_positive_fold_ratio: float = 0.60
    worst_fold_floor: float = -0.10


#: Fixed values: (metric, direction, threshold) of the nine cells of a challenge.
CHALLENGE = (
    ("aggregate_sharpe_delta", ">=", 0.10),
    ("aggregate_annualized_return_delta", ">=", -0.02),
    ("positive_fold_ratio_delta", ">=", 0.0),
    ("worst_fold_calendar_return_delta", ">=", -0.02),
    ("median_abs_max_drawdown_delta", "<=", 0.0),
    ("median_turnover_ratio", "<=", 0.85),
    ("median_explicit_cost_ratio_delta", "<=", 0.0),
    ("median_reject_rate_delta", "<=", 0.02),
    ("median_invested_exposure", ">=", 0.90),
)


def fold_schedule(calendar: DataFrame, start: str, end: str, policy: SchedulePolicy = SchedulePolicy()) -> DataFrame:
    """Calendar years wholly inside [start, end] as folds, with their sessions and the shortest warm-up of at least
    ``warmup_years`` whole years that has enough sessions (the longest allowed one where none has). Years cut by the request
    are boundary windows, not folds. A year without an open day keeps its fold with null trading days."""
    spark = calendar.sparkSession
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    years = spark.range(1).select(F.explode(F.sequence(F.year(lo), F.year(hi))).alias("year"))
    years = years.withColumn("calendar_start", F.make_date("year", F.lit(1), F.lit(1))).withColumn("calendar_end", F.make_date("year", F.lit(12), F.lit(31)))
    leading, trailing = F.col("calendar_start") < lo, F.col("calendar_end") > hi
    years = years.withColumn("boundary_reason", F.when(leading & trailing, "partial_year_not_evaluated").when(leading, "leading_partial_year").when(trailing, "trailing_partial_year"))
    sessions = calendar.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"), F.min("day").alias("first_trading_day"), F.max("day").alias("last_trading_day"))
    longest = policy.warmup_years + policy.max_extension_years
    back = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")).join(sessions.select((F.col("year")).alias("_y"), "n"), F.col("year") - F.col("k") == F.col("_y"), "left")
    w = Window.partitionBy("year").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = back.withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(w)).filter(F.col("k") >= policy.warmup_years)
    pick = back.groupBy("year").agg(F.min(F.when(F.col("total") >= policy.min_warmup_sessions, F.struct("k", "total"))).alias("a"), F.max(F.struct("k", "total")).alias("b"))
    warm = pick.select("year", F.coalesce("a", "b").alias("w")).select("year", F.col("w.k").alias("warmup_years"), F.col("w.total").alias("warmup_session_count"))
    fold = F.col("boundary_reason").isNull()
    j = years.join(sessions, "year", "left").join(warm, "year")
    keep = lambda c: F.when(fold, c)
    return j.select(
        F.when(fold, F.concat(F.lit("fold-"), "year")).alias("fold_id"), F.greatest("calendar_start", lo).alias("calendar_start"), F.least("calendar_end", hi).alias("calendar_end"),
        keep(F.col("first_trading_day")).alias("first_trading_day"), keep(F.col("last_trading_day")).alias("last_trading_day"), keep(F.coalesce("n", F.lit(0))).cast("long").alias("oos_session_count"),
        keep(F.make_date(F.col("year") - F.col("warmup_years"), F.lit(1), F.lit(1))).alias("warmup_start"), keep(F.col("warmup_session_count")).alias("warmup_session_count"), "boundary_reason",
    )


def preflight(folds: DataFrame, facts: DataFrame, policy: SchedulePolicy = SchedulePolicy()) -> DataFrame:
    """The first reason for which a fold can't run, or null.

    facts: fold_id, accepted, universe_covered, factor_history_sessions, benchmark_missing_days, closure_proven. A year without
    an open day is skipped lawfully if its closure is proven, before any history is looked at.
    """
    j = folds.join(facts, "fold_id", "left")
    closed = F.col("first_trading_day").isNull()
    false = F.lit(False)
    code = (
        F.when(~F.coalesce("accepted", false), "ACCEPTANCE_MISSING")
        .when(closed & ~F.coalesce("closure_proven", false), "CLOSURE_EVIDENCE_MISSING")
        .when(closed, F.lit(None).cast("string"))
        .when(F.col("warmup_session_count") < policy.min_warmup_sessions, "WARMUP_SESSIONS_SHORT")
        .when(~F.coalesce("universe_covered", false), "UNIVERSE_COVERAGE")
        .when(F.coalesce("factor_history_sessions", F.lit(0)) < 61, "FACTOR_HISTORY_SHORT")
        .when(F.coalesce("benchmark_missing_days", F.lit(1)) > 0, "BENCHMARK_GAP")
    )
    status = F.when(F.col("code").isNotNull(), "FAILED_PREFLIGHT").when(closed, "SKIPPED_NOT_TRADEABLE").otherwise("READY")
    return j.withColumn("code", code).withColumn("status", status)


def oos_faults(folds: DataFrame, equity: DataFrame, calendar: DataFrame) -> DataFrame:
    """fold_id, missing_days, extra_days, repeated_days, bad_values of each fold's equity against the open days from its first to its last
    trading day; equity must be finite and positive.

    equity: fold_id, trade_date, net_equity_after_cost. Folds without a trading day expect no equity.
    """
    due = on_ordinals(folds.select("fold_id", "first_trading_day", "last_trading_day").filter("first_trading_day IS NOT NULL"), calendar, "first_trading_day", "last_trading_day")
    value = F.col("net_equity_after_cost").cast("double")
    bad = ~F.coalesce((value > 0) & (value < float("inf")), F.lit(False))
    have = equity.groupBy("fold_id", F.col("trade_date").alias("day")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    j = due.select("fold_id", "day", F.lit(True).alias("due")).join(have, ["fold_id", "day"], "full")
    found = j.groupBy("fold_id").agg(F.count_if(F.col("n").isNull()).alias("missing_days"), F.count_if(F.col("due").isNull()).alias("extra_days"), F.count_if(F.col("n") > 1).alias("repeated_days"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_values"))
    return folds.select("fold_id").join(found, "fold_id", "left").na.fill(0)


def outcomes(checked: DataFrame, execution_faults: DataFrame, oos: DataFrame) -> DataFrame:
    """fold_id, status, reason_code of each fold once it has run: what preflight found, then EXECUTION_INTEGRITY where its ledgers have
    faults, then OOS_INTEGRITY where its equity has. A year that was closed by proof is skipped.

    checked: of preflight; execution_faults: fold_id and a row for each fault; oos: of oos_faults.
    """
    broken = execution_faults.groupBy("fold_id").agg(F.count("*").alias("n_faults"))
    unsound = oos.select("fold_id", (F.col("missing_days") + F.col("extra_days") + F.col("repeated_days") + F.col("bad_values") > 0).alias("unsound"))
    j = checked.join(broken, "fold_id", "left").join(unsound, "fold_id", "left")
    ready = F.col("status") == "READY"
    reason = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("status") == "SKIPPED_NOT_TRADEABLE", "MARKET_WIDE_CLOSURE")
        .when(ready & (F.coalesce("n_faults", F.lit(0)) > 0), "EXECUTION_INTEGRITY")
        .when(ready & F.coalesce("unsound", F.lit(False)), "OOS_INTEGRITY")
    )
    status = F.when(~ready, F.col("status")).when(F.col("reason_code").isNull(), "EXECUTED").otherwise("FAILED_PREFLIGHT")
    return j.withColumn("reason_code", reason).select("fold_id", status.alias("status"), "reason_code")


def stability(metrics: DataFrame, policy: StabilityPolicy = StabilityPolicy(), incomplete: bool = False, skipped: int = 0) -> DataFrame:
    """metrics: scenario, fold_id, fold_calendar_return -> a row for each scenario with its figures and the common verdict."""
    r = F.col("fold_calendar_return")
    g = metrics.groupBy("scenario").agg(
        F.count("*").alias("executed_fold_count"),
        F.count_if(r > 0).alias("positive_fold_count"),
        (F.count_if(r > 0) / F.nullif(F.count(r), F.lit(0))).alias("positive_fold_ratio"),
        F.min(r).alias("worst_fold_calendar_return"),
    )
    passed = F.coalesce((F.col("positive_fold_ratio") >= policy.minimum_positive_fold_ratio) & (F.col("worst_fold_calendar_return") > policy.worst_fold_floor), F.lit(False))
    g = g.withColumn("passed", passed)
    everyone = F.broadcast(g.agg(F.bool_and("passed").alias("_all"), F.min("executed_fold_count").alias("_n")))
    verdict = (
        F.when(F.lit(incomplete), "FAILED")
        .when((F.col("_n") < policy.minimum_executed_folds) | F.lit(skipped > 0), "INCONCLUSIVE")
        .when(F.col("_all"), "STABLE")
        .otherwise("UNSTABLE")
    )
    return g.crossJoin(everyone).withColumn("conclusion", verdict).drop("_all", "_n")


def paired_folds(baseline: DataFrame, challenger: DataFrame, fields: list[str]) -> DataFrame:
    """Baseline and challenger metrics side by side by (fold_id, scenario); ``unpaired`` marks rows of one side only."""
    b, c = baseline.alias("b"), challenger.alias("c")
    on = (F.col("b.fold_id") == F.col("c.fold_id")) & (F.col("b.scenario") == F.col("c.scenario"))
    figures = [F.col(f"{t}.{f}").alias(f"{who}_{f}") for f in fields for t, who in (("b", "baseline"), ("c", "challenger"))]
    unpaired = F.col("b.fold_id").isNull() | F.col("c.fold_id").isNull()
    return b.join(c, on, "full").select(F.coalesce("b.fold_id", "c.fold_id").alias("fold_id"), F.coalesce("b.scenario", "c.scenario").alias("scenario"), *figures, unpaired.alias("unpaired"))


def challenge_cells(pairs: DataFrame, aggregates: DataFrame) -> DataFrame:
    """The nine threshold cells of every scenario in long form: metric, baseline, challenger, delta, passed; undefined fails.

    pairs: of ``paired_folds`` over fold_calendar_return, abs_max_drawdown, turnover, explicit_cost_ratio, reject_rate,
    invested_exposure. aggregates: scenario, baseline_/challenger_ aggregate_sharpe and aggregate_annualized_return.
    """
    stat = []
    for who in ("baseline", "challenger"):
        r = F.col(f"{who}_fold_calendar_return")
        stat += [(F.count_if(r > 0) / F.nullif(F.count(r), F.lit(0))).alias(f"{who}_positive_fold_ratio"), F.min(r).alias(f"{who}_worst")]
        stat += [F.median(f"{who}_{m}").alias(f"{who}_{m}") for m in ("abs_max_drawdown", "turnover", "explicit_cost_ratio", "reject_rate", "invested_exposure")]
    g = pairs.groupBy("scenario").agg(*stat).join(aggregates, "scenario", "left")
    source = ("aggregate_sharpe", "aggregate_annualized_return", "positive_fold_ratio", "worst", "abs_max_drawdown", "turnover", "explicit_cost_ratio", "reject_rate", "invested_exposure")
    cells = []
    for (metric, direction, threshold), s in zip(CHALLENGE, source, strict=True):
        b, c = F.col(f"baseline_{s}").cast("double"), F.col(f"challenger_{s}").cast("double")
        if metric == "median_turnover_ratio":
            delta = c / F.nullif(b, F.lit(0.0))
        elif metric == "median_invested_exposure":
            b, delta = F.lit(None).cast("double"), c
        else:
            delta = c - b
        passed = F.coalesce(delta >= threshold if direction == ">=" else delta <= threshold, F.lit(False))
        cells.append(F.struct(F.lit(metric).alias("metric"), b.alias("baseline"), c.alias("challenger"), delta.alias("delta"), F.lit(f"{direction} {threshold}").alias("threshold"), passed.alias("passed")))
    return g.select("scenario", F.explode(F.array(*cells)).alias("x")).select("scenario", "x.*")


def challenge_verdict(cells: DataFrame, executed_folds: int, failed: bool = False, least: int = 5) -> DataFrame:
    """FAILED before INCONCLUSIVE_RESEARCH_ONLY (too few folds or an undefined cell) before PROMOTED or REJECTED."""
    g = cells.agg(F.bool_and("passed").alias("passed"), F.count_if(F.col("delta").isNull()).alias("undefined"), F.count_if(~F.col("passed")).alias("failed_cells"))
    verdict = F.when(F.lit(failed), "FAILED").when((F.lit(executed_folds) < least) | (F.col("undefined") > 0), "INCONCLUSIVE_RESEARCH_ONLY").when(F.col("passed"), "PROMOTED").otherwise("REJECTED")
    return g.select(verdict.alias("verdict"), "undefined", "failed_cells")
