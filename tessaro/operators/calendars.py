"""Trading calendars: ordinals, week ends, next days, provenance spans. A calendar grows with time, not with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.temporal import sessions


def with_ordinals(days: DataFrame, day: str = "day") -> DataFrame:
    """Distinct open days with ordinals from 1."""
    return days.select(F.col(day).alias("day")).distinct().select("day", F.row_number().over(Window.orderBy("day")).cast("long").alias("ord"))


def week_ends(calendar: DataFrame) -> DataFrame:
    """The last open day of each ISO week (weeks start on Monday)."""
    return calendar.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.max("day").alias("day"))


def date_grid(calendar: DataFrame) -> DataFrame:
    """Every date from a day before the first open day to the last one: date, floor_ord (open days so far), next_day (the first
    open day after it). Looking dates up here is an equi-join on the date; before the grid lies nothing, after it the end."""
    ends = calendar.agg(F.date_sub(F.min("day"), 1).alias("lo"), F.max("day").alias("hi"))
    dates = ends.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    w = Window.orderBy("date")
    j = dates.join(calendar.withColumnRenamed("day", "date").withColumn("_open", F.col("date")), "date", "left")
    return j.select(
        "date",
        F.coalesce(F.last("ord", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long").alias("floor_ord"),
        F.last("_open", ignorenulls=True).over(Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)).alias("next_day"),
    )


def next_open_day(rows: DataFrame, calendar: DataFrame, on: str, name: str = "next_day") -> DataFrame:
    """The first open day strictly after the row's day; null past the calendar's end."""
    first = calendar.agg(F.min("day")).scalar()
    j = rows.join(F.broadcast(date_grid(calendar).select(F.col("date").alias(on), F.col("next_day").alias("_next"))), on, "left")
    return j.withColumn(name, F.when(F.col(on) < first, first).otherwise(F.col("_next"))).select(*rows.columns, name)


def ordinals_of(rows: DataFrame, calendar: DataFrame, on: str, name: str, up: bool) -> DataFrame:
    """The ordinal of the first open day at or after the row's date (up), or of the last at or before it.

    Past the calendar's end an upward ordinal is one more than the last; before its start a downward one is 0. Null stays null.
    """
    of = lambda x: calendar.agg(x).scalar()
    grid = date_grid(calendar).select(F.col("date").alias("_date"), F.col("floor_ord").alias("_floor"))
    shifted = F.date_sub(on, 1) if up else F.col(on)
    j = rows.withColumn("_date", shifted).join(F.broadcast(grid), "_date", "left")
    floor = F.when(F.col("_date") < of(F.min("day")), 0).when(F.col("_date") >= of(F.max("day")), of(F.count("*"))).otherwise(F.col("_floor"))
    return j.withColumn(name, (floor + (1 if up else 0)).cast("long")).select(*rows.columns, name)


def with_absent_days(rows: DataFrame, calendar: DataFrame, filled: Column, on: str = "trade_date") -> DataFrame:
    """rows, and a row for each open day that a name where ``filled`` holds has none for, with ``absent`` true: what the name's row
    before says, null before its first. The days stand between neighbouring rows, so that no grid of names and days is brought together."""
    w = Window.partitionBy("symbol").orderBy(on)
    j = ordinals_of(ordinals_of(rows, calendar, on, "_up", up=True), calendar, on, "_down", up=False)
    j = j.withColumns({"_next": F.coalesce(F.lead("_up").over(w), calendar.agg(F.max("ord")).scalar() + 1), "_first": F.row_number().over(w) == 1})
    span = lambda a, b: F.when(filled & (a < b), F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    # 0 is the row itself, as ordinals count from 1
    ords = F.concat(F.when(F.col("_first"), span(F.lit(1).cast("long"), F.col("_up"))).otherwise(none), F.array(F.lit(0).cast("long")), span(F.col("_down") + 1, F.col("_next")))
    j = j.withColumn("_ord", F.explode(ords)).join(F.broadcast(calendar.select(F.col("ord").alias("_ord"), F.col("day").alias("_day"))), "_ord", "left")
    known = (F.col("_ord") == 0) | (F.col("_ord") > F.col("_down"))
    return j.select(*[F.when(known, F.col(c)).alias(c) for c in rows.columns if c not in ("symbol", on)], "symbol", F.coalesce("_day", on).alias(on), (F.col("_ord") > 0).alias("absent"))


def on_ordinals(intervals: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals [start, end] (null end: open) as rows for each day of the calendar in them: day, ord.

    Both ends move inwards to days of the calendar, whose numbers between are exploded: equality joins only. Intervals that hold
    no day of the calendar, and those without a start, vanish.
    """
    days = calendar.select("day", "ord").withColumn("_k", F.row_number().over(Window.orderBy("day")).cast("long"))
    numbered = days.select("day", F.col("_k").alias("ord"))
    j = ordinals_of(ordinals_of(intervals, numbered, start, "_a", up=True), numbered, end, "_b", up=False)
    j = j.withColumn("_b", F.when(F.col(end).isNull(), numbered.agg(F.count("*")).scalar()).otherwise(F.col("_b"))).filter("_a <= _b")
    return j.withColumn("_k", F.explode(F.sequence("_a", "_b"))).join(F.broadcast(days), "_k").drop("_k", "_a", "_b")


def listed_days(rows: DataFrame, calendar: DataFrame, listing: DataFrame, on: str = "trade_date") -> DataFrame:
    """How many open days a name has been listed on a row's day, the first one counting 1.

    0 where the listing is unknown or the day is no open day. listing: symbol, list_date.
    """
    asked = ordinals_of(listing.select("symbol", "list_date"), calendar, "list_date", "_first", up=True).drop("list_date")
    at = F.broadcast(calendar.select(F.col("day").alias(on), F.col("ord").alias("_ord")))
    n = F.col("_ord") - F.col("_first") + 1
    return rows.join(at, on, "left").join(asked, "symbol", "left").select(*rows.columns, F.when(n > 0, n).otherwise(0).cast("long").alias("listed_days"))


def span_faults(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans that must tile: a row for each reversed span, overlap with the span before, or gap after it."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.lag(end).over(w)
    fault = F.when(F.col(start) > F.col(end), "reversed").when(F.col(start) <= before, "overlap").when(F.col(start) > F.date_add(before, 1), "gap")
    return spans.withColumn("previous_end", before).withColumn("fault", fault).filter("fault IS NOT NULL")


def merge_spans(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Touching or overlapping spans of a key become one."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(w)
    joined = sessions(spans.withColumn("_reach", reach), by, [start, end], F.col("_reach").isNull() | (F.col(start) > F.date_add("_reach", 1)), "_run")
    return joined.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_run")


def replace_in_spans(spans: DataFrame, window_start, window_end, fresh: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Take [window_start, window_end] out of spans, keeping what is left on either side, and put fresh spans in."""
    lo, hi = F.lit(window_start).cast("date"), F.lit(window_end).cast("date")
    outside = spans.filter((F.col(end) < lo) | (F.col(start) > hi))
    touched = spans.filter((F.col(end) >= lo) & (F.col(start) <= hi))
    left = touched.withColumn(end, F.date_sub(lo, 1)).filter(F.col(start) <= F.col(end))
    right = touched.withColumn(start, F.date_add(hi, 1)).filter(F.col(start) <= F.col(end))
    return outside.unionByName(left).unionByName(right).unionByName(fresh.select(*spans.columns))


def uncovered_days(asked: DataFrame, spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Parts of [start, end] of ``asked`` that no span of the key covers: the gaps between spans merged and clipped."""
    merged = merge_spans(spans, by, start, end).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    inside = asked.join(merged, by, "left").filter(F.col("_s").isNull() | ((F.col("_e") >= F.col(start)) & (F.col("_s") <= F.col(end))))
    kept = asked.join(inside.select(*by, start, end, "_s", "_e"), [*by, start, end], "left")
    w = Window.partitionBy(*by, start, end).orderBy("_s")
    gap_from = F.coalesce(F.date_add(F.lag("_e").over(w), 1), F.col(start))
    head = kept.withColumn("gap_start", gap_from).withColumn("gap_end", F.coalesce(F.date_sub("_s", 1), F.col(end)))
    tail = kept.filter("_e IS NOT NULL").groupBy(*by, start, end).agg(F.max("_e").alias("_e")).withColumn("gap_start", F.date_add("_e", 1)).withColumn("gap_end", F.col(end))
    columns = [*by, start, end, "gap_start", "gap_end"]
    return head.select(*columns).unionByName(tail.select(*columns)).filter("gap_start <= gap_end")


def pretrade_faults(facts: DataFrame, day: str = "day", previous: str = "pretrade_date") -> DataFrame:
    """Open days whose stated previous open day isn't the one before them."""
    actual = F.lag(day).over(Window.orderBy(day))
    return facts.withColumn("actual_previous", actual).filter("actual_previous IS NOT NULL").filter(~F.col("actual_previous").eqNullSafe(F.col(previous)))


def halo_faults(days: DataFrame, start, end) -> DataFrame:
    """Every day of [start - 1, end + 1] must stand exactly once: missing and repeated days."""
    lo, hi = F.date_sub(F.lit(start).cast("date"), 1), F.date_add(F.lit(end).cast("date"), 1)
    wanted = days.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("day"))
    have = days.groupBy("day").agg(F.count("*").alias("n"))
    joined = wanted.join(have, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.filter("n <> 1").withColumn("fault", F.when(F.col("n") == 0, "missing").otherwise("repeated"))


def calendar_disagreements(one: DataFrame, other: DataFrame) -> DataFrame:
    """Days on which two calendars (day, is_open, pretrade_date) differ, with the first field that does."""
    a, b = one.alias("a"), other.alias("b")
    differs = F.when(F.col("a.day").isNull() | F.col("b.day").isNull(), "presence")
    for c in ("is_open", "pretrade_date"):
        differs = differs.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c)
    return a.join(b, F.col("a.day") == F.col("b.day"), "full").select(F.coalesce("a.day", "b.day").alias("day"), differs.alias("field")).filter("field IS NOT NULL")
