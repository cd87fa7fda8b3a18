"""Merging fresh rows into carried tables, duplicates, order reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.operators.ranges import prefix_sums


def replace_by_key(carried: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Carried rows whose key isn't in fresh, and all fresh rows. Null keys equal each other."""
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}"))
    kept = carried.alias("c").join(fresh.select(*key).distinct().alias("f"), same, "left_anti")
    return kept.unionByName(fresh.select(*carried.columns))


def replace_window(carried: DataFrame, fresh: DataFrame, refreshed: DataFrame, start, end, day: str = "trade_date") -> DataFrame:
    """Drop carried rows of refreshed symbols within [start, end], late corrections included, and add the fresh ones."""
    marks = refreshed.select("symbol").distinct().withColumn("_hit", F.lit(True))
    kept = carried.join(marks, "symbol", "left").filter(~(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.coalesce("_hit", F.lit(False))))
    return kept.select(*carried.columns).unionByName(fresh.select(*carried.columns))


def collapse_duplicates(rows: DataFrame) -> DataFrame:
    """Exact duplicates as one row with ``copies``; what is over one is the audit's count."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def key_conflicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one distinct row."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*rest)).alias("n_distinct")).filter("n_rows > 1")


def reconcile_orders(planned: DataFrame, fills: DataFrame, rejections: DataFrame) -> DataFrame:
    """Plan, summed fills and rejection of each order: status, and whether filled + rejected = planned.

    planned: order_id, planned_quantity and more; fills: order_id, quantity; rejections: order_id, rejected_quantity, reason.
    """
    filled = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled_quantity"), F.count("*").alias("n_fills"))
    refused = rejections.groupBy("order_id").agg(F.sum("rejected_quantity").alias("rejected_quantity"), F.count("*").alias("n_rejections"), F.max("reason").alias("reason"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = planned.join(filled, "order_id", "left").join(refused, "order_id", "left")
    out = joined.select(*planned.columns, zero("filled_quantity"), zero("rejected_quantity"), zero("n_fills"), zero("n_rejections"), "reason")
    return out.withColumn("status", order_status()).withColumn("balanced", F.col("filled_quantity") + F.col("rejected_quantity") == F.col("planned_quantity"))


def order_status() -> Column:
    return F.when(F.col("filled_quantity") >= F.col("planned_quantity"), "FILLED").when(F.col("filled_quantity") > 0, "PARTIAL").otherwise("REJECTED")


def ledger_faults(submitted: DataFrame, fills: DataFrame, rejections: DataFrame, strict: bool = False) -> DataFrame:
    """Order ids that break the ledger's rules: repeated submission, two rejections, unbalanced, unknown order.

    strict also refuses an order with both fills and a rejection; otherwise a partial fill may have both.
    """
    n = submitted.groupBy("order_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("submitted"))
    f = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"))
    r = rejections.groupBy("order_id").agg(F.sum("rejected_quantity").alias("rejected"), F.count("*").alias("k"))
    j = n.join(f, "order_id", "full").join(r, "order_id", "full").na.fill(0, ["n", "submitted", "filled", "rejected", "k"])
    fault = F.when(F.col("n") == 0, "unknown_order").when(F.col("n") > 1, "repeated_order").when(F.col("k") > 1, "repeated_rejection")
    if strict:
        fault = fault.when((F.col("filled") > 0) & (F.col("rejected") > 0), "filled_and_rejected")
    fault = fault.when(F.col("filled") + F.col("rejected") != F.col("submitted"), "unbalanced")
    return j.select("order_id", fault.alias("fault")).filter("fault IS NOT NULL")


def plan_differences(plan: DataFrame, submitted: DataFrame, fields: list[str]) -> DataFrame:
    """Orders missing on one side or with differing fields."""
    p, s = plan.alias("p"), submitted.alias("s")
    differs = F.when(F.col("s.order_id").isNull(), "not_submitted").when(F.col("p.order_id").isNull(), "not_planned")
    for c in fields:
        differs = differs.when(~F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")), c)
    return p.join(s, F.col("p.order_id") == F.col("s.order_id"), "full").select(F.coalesce("p.order_id", "s.order_id").alias("order_id"), differs.alias("difference")).filter("difference IS NOT NULL")


def cash_ledger(fills: DataFrame, actions: DataFrame, initial: float, by: list[str]) -> DataFrame:
    """Cash after each event, rebuilt from fills and corporate actions in order of day, kind (actions first) and sequence.

    A scenario's events are summed in ranges of days and sequences, each over what the ranges before it come to. fills: by, trade_date, seq, cash_delta decimal; actions: by, ex_date, seq, cash_credited decimal.
    """
    a = actions.select(*by, F.col("ex_date").alias("day"), F.lit(0).alias("kind"), "seq", F.col("cash_credited").cast("decimal(18,2)").alias("delta"))
    f = fills.select(*by, F.col("trade_date").alias("day"), F.lit(1).alias("kind"), "seq", F.col("cash_delta").cast("decimal(18,2)").alias("delta"))
    summed = prefix_sums(a.unionByName(f), by, ["day", "kind", "seq"], "delta", "cash")
    return summed.withColumn("cash", F.lit(initial).cast("decimal(18,2)") + F.col("cash"))
