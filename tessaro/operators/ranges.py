"""Scans over rows in order without a task for each key: prefix sums, last values so far, exact quantiles.

Rows are range-partitioned by key and order and settled with the number of their range, so that a key with very many rows lies in
several ranges. What a scan needs from earlier ranges is one row for each range and key, scanned by itself; within a range the scan
is a window. No task holds more than a range, however the rows are spread over keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.lineage import settled

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def in_ranges(rows: DataFrame, order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """rows with _range, the number of the range that they lie in; settled, as another run may cut at other places."""
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return settled(dealt.withColumn("_range", F.spark_partition_id()))


def with_earlier(placed: DataFrame, by: list[str], own: DataFrame, carry: Column, name: str) -> DataFrame:
    """placed with name: what own (a row for each by and _range) adds up to over the key's ranges before the row's own."""
    earlier = own.select(*by, "_range", carry.over(Window.partitionBy(*by).orderBy("_range").rowsBetween(*BEFORE)).alias(name))
    a, b = placed.alias("a"), earlier.alias("b")
    same = F.col("a._range") == F.col("b._range")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select("a.*", f"b.{name}")


def running_sums(placed: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """prefix_sums over rows that are in ranges already."""
    own = placed.groupBy(*by, "_range").agg(F.sum(value).alias("_total"))
    within = F.sum(value).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(*SO_FAR))
    summed = with_earlier(placed, by, own, F.sum("_total"), "_before").withColumn(name, within)
    zero = F.lit(0).cast(summed.schema[name].dataType)
    total = F.when(F.col(name).isNotNull() | F.col("_before").isNotNull(), F.coalesce(F.col(name), zero) + F.coalesce(F.col("_before"), zero))
    return summed.withColumn(name, total.cast(summed.schema[name].dataType)).drop("_before", "_range")


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the running sum of value within by, in order, which must tell the rows of a key apart."""
    return running_sums(in_ranges(rows, [*by, *order], ranges), by, order, value, name)


def last_so_far(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the last value that isn't null up to each row of a key, in order."""
    placed = in_ranges(rows, [*by, *order], ranges)
    own = placed.filter(F.col(value).isNotNull()).groupBy(*by, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # ranges without a value of a key must stand too, to be told what was before
    there = placed.groupBy(*by, "_range").agg(F.lit(1).alias("_one"))
    all_ranges = there.alias("a").join(own.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]], "left").select("a.*", "b._last")
    within = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(*SO_FAR))
    found = with_earlier(placed, by, all_ranges, F.last("_last", ignorenulls=True), "_before").withColumn(name, within)
    return found.withColumn(name, F.coalesce(name, "_before")).drop("_before", "_range")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], ranges: int | None = None) -> DataFrame:
    """by and a column for each quantile, interpolated between the two values next to its place, as exact percentiles are.

    Equal values are counted first; running counts over (by, value) tell which values stand at the ranks asked for. Only those
    reach the last aggregation: two for each key and quantile. Nulls are left out.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = in_ranges(counted, [*by, "_v"], ranges)
    running = running_sums(placed, by, ["_v"], "_n", "_upto")
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))
    asked = F.array(*[F.struct(F.lit(k).alias("q"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for k, q in quantiles.items()])
    places = totals.select(*by, F.explode(asked).alias("_a")).select(*by, F.col("_a.q").alias("_q"), F.col("_a.at").alias("_at"), F.floor("_a.at").alias("_low"))
    a, b = running.alias("a"), places.alias("b")
    same = (F.col("a._upto") > F.col("b._low")) & (F.col("a._upto") - F.col("a._n") <= F.col("b._low") + 1)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    near = a.join(b, same).select(*[F.col(f"a.{c}") for c in by], "_q", "_at", "_low", "_v")
    ends = near.groupBy(*by, "_q").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first(F.col("_at") - F.col("_low")).alias("_share"))
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == k, value_at)).alias(k) for k in quantiles])


def heavy_keys(rows: DataFrame, by: list[str], above: int) -> DataFrame:
    """Keys with more than ``above`` rows; there are fewer than rows / above of them."""
    return settled(rows.groupBy(*by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > above).select(*by))
