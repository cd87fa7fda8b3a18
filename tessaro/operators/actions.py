"""Corporate actions: parsing, two-source reconciliation, total-return series, lineage, proven suspensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.functions import clean
from tessaro.operators.calendars import ordinals_of


def zeroed(c: Column | str) -> Column:
    return F.coalesce(clean.no_nan(c), F.lit(0.0))


def parse_events(raw: DataFrame, source: str) -> DataFrame:
    """Supplier rows (code, announced, recorded, ex, cash, bonus, capital per ten shares, progress, plan) as typed events.

    ``reason`` says why an event can't be booked: unsupported, then not implemented, then incomplete; null where it can.
    """
    e = raw.select(
        clean.bare_symbol("code").alias("symbol"),
        clean.trade_date("announced").alias("announcement_date"),
        clean.trade_date("recorded").alias("record_date"),
        clean.trade_date("ex").alias("ex_date"),
        clean.per_share("cash").alias("cash"),
        clean.per_share("bonus").alias("bonus"),
        clean.per_share("capital").alias("capitalization"),
        F.when(clean.implemented("progress"), "implemented").otherwise("not_implemented").alias("status"),
        clean.mentions_unsupported("plan", "progress").alias("unsupported"),
        F.lit(source).alias("source"),
    )
    some = F.lit(False)
    for c in ("cash", "bonus", "capitalization"):
        some = some | F.coalesce(F.col(c) != 0, F.lit(False))
    dated = F.col("announcement_date").isNotNull() & F.col("record_date").isNotNull() & F.col("ex_date").isNotNull()
    reason = clean.first_reason((F.col("unsupported"), "unsupported_corporate_action"), (F.col("status") != "implemented", "not_implemented"), (~dated | ~some, "incomplete"))
    return e.withColumn("reason", reason)


def in_window(events: DataFrame, start, end, ex: str = "ex_date") -> DataFrame:
    """Events within the window, and implemented ones without an ex-date, which are a defect to be reported."""
    inside = F.col(ex).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return events.filter(F.coalesce(inside, F.lit(False)) | (F.col(ex).isNull() & (F.col("status") == "implemented")))


def combine_same_day(events: DataFrame) -> DataFrame:
    """Distributions of a name on one ex-date as one, summed; ``ambiguous`` where their record dates differ."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return events.groupBy("symbol", "ex_date").agg(
        F.min("announcement_date").alias("announcement_date"),
        F.min("record_date").alias("record_date"),
        total("cash"),
        total("bonus"),
        total("capitalization"),
        F.count("*").alias("n_events"),
        (F.count_distinct("record_date") > 1).alias("ambiguous"),
    )


def reconcile_sources(one: DataFrame, other: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two suppliers' events by (symbol, ex_date): equal facts confirm each other, unequal ones go to quarantine from both
    sides, and an event of one side alone is accepted. Returns the rows of both kinds with confirmed_by and reason."""
    fields = ["announcement_date", "record_date", "cash", "bonus", "capitalization"]
    a, b = one.alias("a"), other.alias("b")
    key = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.ex_date") == F.col("b.ex_date"))
    same = F.col("a.record_date").eqNullSafe(F.col("b.record_date"))
    for c in ("cash", "bonus", "capitalization"):
        same = same & (F.coalesce(F.col(f"a.{c}"), F.lit(0)) == F.coalesce(F.col(f"b.{c}"), F.lit(0)))
    side = lambda t, who, reason: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in fields], who.alias("confirmed_by"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    conflict = F.lit("cross_source_conflict")
    only_a, only_b = F.col("b.symbol").isNull(), F.col("a.symbol").isNull()
    rows = (
        F.when(only_b, F.array(side("b", F.lit(names[1]), none)))
        .when(only_a, F.array(side("a", F.lit(names[0]), none)))
        .when(same, F.array(side("a", F.lit("+".join(names)), none)))
        .otherwise(F.array(side("a", F.lit(names[0]), conflict), side("b", F.lit(names[1]), conflict)))
    )
    j = a.join(b, key, "full").select(F.coalesce("a.symbol", "b.symbol").alias("symbol"), F.coalesce("a.ex_date", "b.ex_date").alias("ex_date"), F.explode(rows).alias("r"))
    return j.select("symbol", "ex_date", "r.*")


def break_reasons(events: DataFrame, quarantined: DataFrame | None, coverage: DataFrame | None, bars: DataFrame) -> DataFrame:
    """Days on which a name's series can't be trusted, with the reason: quarantine over the event's own over coverage.

    Several quarantine rows of a day: the smallest reason. coverage: symbol, window_start, window_end (null: open), status.
    """
    own = events.select("symbol", F.col("ex_date").alias("trade_date"), action_fault().alias("own")).filter("own IS NOT NULL AND trade_date IS NOT NULL")
    own = own.groupBy("symbol", "trade_date").agg(F.min("own").alias("own"))
    days = bars.select("symbol", "trade_date").distinct()
    out = days.join(own, ["symbol", "trade_date"], "left")
    if quarantined is not None:
        q = quarantined.filter("ex_date IS NOT NULL").groupBy("symbol", F.col("ex_date").alias("trade_date")).agg(F.min(F.coalesce("reason", F.lit("corporate_action_untrusted"))).alias("q"))
        out = out.join(q, ["symbol", "trade_date"], "left")
    else:
        out = out.withColumn("q", F.lit(None).cast("string"))
    if coverage is not None:
        c = coverage.filter("status = 'UNTRUSTED'").select("symbol", "window_start", "window_end")
        inside = (F.col("window_start").isNull() | (F.col("trade_date") >= F.col("window_start"))) & (F.col("window_end").isNull() | (F.col("trade_date") <= F.col("window_end")))
        hit = days.join(c, "symbol").filter(inside).select("symbol", "trade_date").distinct().withColumn("cov", F.lit("corporate_action_coverage_untrusted"))
        out = out.join(hit, ["symbol", "trade_date"], "left")
    else:
        out = out.withColumn("cov", F.lit(None).cast("string"))
    return out.select("symbol", "trade_date", F.coalesce("q", "own", "cov").alias("reason")).filter("reason IS NOT NULL")


def action_fault() -> Column:
    """Why an event breaks the series: not implemented, not known by its ex-date, or a rights issue."""
    return clean.first_reason(
        (~F.col("status").eqNullSafe("implemented"), "corporate_action_not_implemented"),
        (F.col("announcement_date").isNull() | (F.col("announcement_date") > F.col("ex_date")), "corporate_action_not_point_in_time"),
        (zeroed("rights") > 0, "unsupported_corporate_action"),
    )


def adjusted_bars(bars: DataFrame, events: DataFrame, breaks: DataFrame) -> DataFrame:
    """Total-return closes: TR = TR before x (close (1 + shares) + cash) / close before, anchored anew at the raw close on a
    name's first day and on break days. The recursion is a product within each run between anchors: no per-row loop.

    bars: symbol, trade_date, close. events: accepted and broken alike; only those without a fault are applied, and none on
    a break day. An ex-date that is no bar day of the name is not applied (see ``unapplied_events``).
    """
    good = events.filter(action_fault().isNull())
    sums = good.groupBy("symbol", F.col("ex_date").alias("trade_date")).agg(
        F.sum(zeroed("cash").cast("decimal(18,6)")).cast("double").alias("_cash"), F.sum((zeroed("bonus") + zeroed("capitalization")).cast("decimal(18,6)")).cast("double").alias("_share")
    )
    w = Window.partitionBy("symbol").orderBy("trade_date")
    j = bars.select("symbol", "trade_date", "close").join(sums, ["symbol", "trade_date"], "left").join(breaks, ["symbol", "trade_date"], "left")
    j = j.withColumn("_prev", F.lag("close").over(w))
    anchor = F.col("_prev").isNull() | F.col("reason").isNotNull()
    j = j.withColumn("_anchor", anchor).withColumn("_run", F.sum(F.when(F.col("_anchor"), 1).otherwise(0)).over(w))
    step = F.when(F.col("_anchor"), F.lit(1.0)).otherwise((F.col("close") * (1 + F.coalesce("_share", F.lit(0.0))) + F.coalesce("_cash", F.lit(0.0))) / F.col("_prev"))
    run = Window.partitionBy("symbol", "_run").orderBy("trade_date")
    j = j.withColumn("_step", step)
    j = j.withColumn("adjusted_close", F.first("close").over(run) * F.product("_step").over(run))
    ids = F.when(~F.col("_anchor") & F.col("_cash").isNotNull(), F.to_json(F.array(F.concat_ws("#", "symbol", "trade_date")))).otherwise("[]")
    return j.select(
        "symbol",
        "trade_date",
        F.col("close").alias("raw_close"),
        "adjusted_close",
        (F.col("adjusted_close") / F.col("close")).alias("adjustment_factor"),
        F.when(F.col("reason").isNotNull(), "ERROR").otherwise("INFO").alias("quality_severity"),
        F.coalesce("reason", F.lit("")).alias("invalid_reason"),
        ids.alias("applied_action_ids"),
    )


def unapplied_events(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bookable events whose ex-date is no bar day of the name."""
    good = events.filter(action_fault().isNull())
    return good.join(bars.select("symbol", F.col("trade_date").alias("ex_date")).distinct(), ["symbol", "ex_date"], "left_anti")


def lineage_faults(adjusted: DataFrame, bars: DataFrame, events: DataFrame, basis: str = "total_return") -> DataFrame:
    """Adjusted rows without a raw bar, with another raw close, of another basis, or with ids of unknown actions."""
    raw = bars.select("symbol", "trade_date", F.col("close").alias("_close"))
    j = adjusted.join(raw, ["symbol", "trade_date"], "left")
    known = events.select("symbol", F.col("ex_date").alias("trade_date")).distinct().withColumn("_known", F.lit(True))
    used = adjusted.select("symbol", "trade_date", F.explode(F.from_json("applied_action_ids", "array<string>")).alias("id"))
    parts = F.split("id", "#")
    unknown = used.select("symbol", "trade_date", parts[0].alias("_s"), parts[1].cast("date").alias("_d")).join(known.select(F.col("symbol").alias("_s"), F.col("trade_date").alias("_d")), ["_s", "_d"], "left_anti")
    faults = clean.first_reason(
        (F.col("_close").isNull(), "adjusted_bar_missing_raw"),
        (F.col("_close") != F.col("raw_close"), "adjusted_bar_raw_close_mismatch"),
    )
    if "adjustment" in adjusted.columns:
        faults = F.coalesce(faults, F.when(F.col("adjustment") != basis, "adjusted_bar_wrong_basis"))
    return j.select("symbol", "trade_date", faults.alias("code")).filter("code IS NOT NULL").unionByName(unknown.select("symbol", "trade_date", F.lit("adjusted_bar_unknown_action").alias("code")).distinct())


def suspension_runs(chain: DataFrame, calendar: DataFrame, listing: DataFrame, events: DataFrame, tolerance: float = 0.005, tasks: int | None = None) -> DataFrame:
    """Runs of absent open days within the listing, each with what proves or fails to prove a suspension.

    chain: symbol, trade_date, close, pre_close. A run between two bars is a suspension if the next stated previous close
    equals the close before it within the tolerance, or an implemented action has its ex-date in the run. Runs at either end,
    or before a bar without a stated previous close, stay unverified. tasks: over how many tasks the names are dealt, where the caller
    knows how many rows there are.
    """
    by_name = lambda rows: rows.repartition(tasks, "symbol") if tasks else rows
    names = listing.select("symbol", "list_date", "delist_date").join(chain.select("symbol").distinct(), "symbol", "left_semi")
    names = ordinals_of(ordinals_of(names, calendar, "list_date", "_lo", up=True), calendar, "delist_date", "_hi", up=False)
    names = names.select("symbol", F.coalesce("_lo", F.lit(1)).cast("long").alias("lo"), F.coalesce("_hi", calendar.agg(F.max("ord")).scalar()).cast("long").alias("hi"))
    # absent runs are the gaps between a name's open-day bars, within its listing: no grid of names and days
    w = Window.partitionBy("symbol").orderBy("ord")
    bars_at = chain.select("symbol", F.col("trade_date").alias("day")).distinct().join(F.broadcast(calendar), "day").select("symbol", "ord")
    bars_at = by_name(bars_at.unionByName(names.select("symbol", (F.col("hi") + 1).alias("ord")))).distinct()
    gaps = bars_at.withColumn("a", F.coalesce(F.lag("ord").over(w), F.lit(0)) + 1).withColumn("b", F.col("ord") - 1).join(names, "symbol")
    gaps = gaps.select("symbol", F.greatest("a", "lo").alias("first_ord"), F.least("b", "hi").alias("last_ord")).filter("first_ord <= last_ord")
    at = lambda c, d: F.broadcast(calendar.select(F.col("ord").alias(c), F.col("day").alias(d)))
    runs = gaps.join(at("first_ord", "first_day"), "first_ord").join(at("last_ord", "last_day"), "last_ord").withColumn("n_days", F.col("last_ord") - F.col("first_ord") + 1)
    # what stands around a run: bars, ex-dates and both ends of the runs of a name are sorted together once. Looking ahead is
    # looking back in descending order: frames that end at the current row are running values, those that begin there aren't
    run = F.struct("first_day", "last_day", "first_ord", "last_ord", "n_days").alias("run")
    bar = chain.select("symbol", F.col("trade_date").alias("_t"), F.lit(1).alias("_o"), F.struct("pre_close", "close").alias("_bar"))
    ex = events.filter("status = 'implemented'").select("symbol", F.col("ex_date").alias("_t"), F.lit(1).alias("_o"), F.col("ex_date").alias("_ex")).distinct()
    ends = runs.select("symbol", run, F.lit(0).alias("_o"), F.explode(F.array("first_day", "last_day")).alias("_t"))
    both = by_name(bar.unionByName(ends, allowMissingColumns=True).unionByName(ex, allowMissingColumns=True))
    back = Window.partitionBy("symbol").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("symbol").orderBy(F.desc("_t"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_b", F.last("_bar", ignorenulls=True).over(back)).withColumn("_a", F.last("_bar", ignorenulls=True).over(ahead)).withColumn("_x", F.last("_ex", ignorenulls=True).over(ahead))
    both = both.filter("run IS NOT NULL")
    first, last = F.col("_t") == F.col("run.first_day"), F.col("_t") == F.col("run.last_day")
    r = both.groupBy("symbol", "run").agg(
        F.max(F.when(first, F.col("_b.close"))).alias("previous_close"),
        F.max(F.when(last & F.col("_a.close").isNotNull(), F.col("_a.pre_close"))).alias("next_pre_close"),
        F.max(F.when(first & (F.col("_x") <= F.col("run.last_day")), F.col("_x"))).alias("first_ex_date"),
    )
    r = r.select("symbol", "run.*", "previous_close", "next_pre_close", "first_ex_date")
    near = F.abs(F.col("next_pre_close") - F.col("previous_close")) <= tolerance
    verdict = (
        F.when(F.col("previous_close").isNull() | F.col("next_pre_close").isNull(), "suspension_run_unverified")
        .when(F.col("first_ex_date").isNotNull() | near, "suspension_row")
        .otherwise("unexplained_primary_gap")
    )
    return r.withColumn("code", verdict)


def suspension_bars(runs: DataFrame, calendar: DataFrame) -> DataFrame:
    """The bars that proven runs owe: the close before the run up to the first ex-date, the next stated previous close from it."""
    proven = runs.filter("code = 'suspension_row'")
    j = proven.withColumn("ord", F.explode(F.sequence("first_ord", "last_ord"))).join(F.broadcast(calendar), "ord")
    price = F.when(F.col("first_ex_date").isNotNull() & (F.col("day") < F.col("first_ex_date")), F.col("previous_close")).otherwise(F.col("next_pre_close"))
    return j.select("symbol", F.col("day").alias("trade_date"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("volume"), F.lit(0.0).alias("amount"))


def coverage_verdict(endpoints: DataFrame) -> DataFrame:
    """endpoints: symbol, failed, n_rows, n_accepted, quarantine_reason (null: nothing quarantined) -> symbol, status, reason.

    A failed endpoint comes first; then a window without any event is VERIFIED_EMPTY; then anything quarantined makes it UNTRUSTED,
    a conflict of sources before an unsupported action before all else; an accepted event is VERIFIED. Verified ones have no reason.
    """
    q = F.col("quarantine_reason")
    g = endpoints.groupBy("symbol").agg(
        F.bool_or("failed").alias("failed"), F.sum("n_rows").alias("rows"), F.sum("n_accepted").alias("accepted"), F.count(q).alias("held"),
        F.bool_or(F.coalesce(q == "cross_source_conflict", F.lit(False))).alias("conflict"), F.bool_or(F.coalesce(q == "unsupported_corporate_action", F.lit(False))).alias("unsupported"),
    )
    cases = [
        (F.col("failed"), "UNTRUSTED", "SOURCE_FETCH_FAILED"),
        (F.col("rows") == 0, "VERIFIED_EMPTY", None),
        (F.col("conflict"), "UNTRUSTED", "SOURCE_CONFLICT"),
        (F.col("unsupported"), "UNTRUSTED", "UNSUPPORTED_ACTION"),
        (F.col("held") > 0, "UNTRUSTED", "FACTS_INCOMPLETE"),
        (F.col("accepted") > 0, "VERIFIED", None),
        (F.lit(True), "UNTRUSTED", "FACTS_INCOMPLETE"),
    ]
    choose = lambda i: F.coalesce(*[F.when(c[0], F.struct(F.lit(c[i]).cast("string").alias("v"))) for c in cases])["v"]
    return g.select("symbol", choose(1).alias("status"), choose(2).alias("reason"))
