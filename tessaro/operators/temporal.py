"""Joins and windows over time: as-of, effective-dated, interval, islands, grids.

An as-of join is a union and one window: facts and questions of a key are sorted together once, and the last fact before a
question is carried to it. No range join, no broadcast; a key's rows share a partition, so the work is one shuffle by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.ranges import heavy_keys, last_so_far


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], columns: list[str], strict: bool = False, split: str | None = None, heavy: int | None = None) -> DataFrame:
    """Each row of left with ``columns`` of the last row of right of the same key at or before left_on (before it: strict).

    right has one row for a key and moment; where it has several, the greatest ``columns`` win. Rows without a match get nulls.
    Null keys or moments match nothing. A key with very many rows may be ``split`` by a calendar unit (year, month, week, day):
    each unit of a key is a window of its own, and what the units before it end with, one row each, is carried in by a join.
    Where ``heavy`` is given, keys with more rows than that on both sides together are found by counting, and only those are
    scanned in ranges of moments, so that no task holds a whole heavy key.
    """
    fact = F.struct(*[F.col(c) for c in columns])
    facts = right.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*by, right_on])).groupBy(*by, F.col(right_on).alias("_t")).agg(F.max(fact).alias("_fact"))
    asked = left.select(*by, F.col(left_on).alias("_t"), F.struct("*").alias("_row"))
    both = facts.select(*by, "_t", "_fact", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.lit(1 if strict else 0).alias("_o")).unionByName(
        asked.select(*by, "_t", F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"), "_row", F.lit(0 if strict else 1).alias("_o"))
    )
    if heavy is not None:
        many = heavy_keys(both.select(*by), by, heavy)
        scanned = last_so_far(both.join(many, by, "left_semi").withColumn("_n", F.monotonically_increasing_id()), by, ["_t", "_o", "_n"], "_fact", "_found").drop("_n")
        few = both.join(many, by, "left_anti")
        light = few.withColumn("_found", F.last("_fact", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        matched = light.unionByName(scanned).filter("_row IS NOT NULL")
        no = F.col("_t").isNull()
        for c in by:
            no = no | F.col(c).isNull()
        return matched.select("_row.*", *[F.when(~no, F.col(f"_found.{c}")).alias(c) for c in columns])
    key = list(by)
    if split is not None:
        unit = F.date_trunc(split, F.col("_t")).alias("_unit")
        both, key = both.select("*", unit), [*by, "_unit"]
    w = Window.partitionBy(*key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.lit(True)
    for c in [*by, "_t"]:
        known = known & F.col(c).isNotNull()
    found = F.last("_fact", ignorenulls=True).over(w)
    if split is not None:
        ends = facts.groupBy(*by, F.date_trunc(split, F.col("_t")).alias("_unit")).agg(F.max_by("_fact", "_t").alias("_end"))
        units = asked.select(*by, F.date_trunc(split, F.col("_t")).alias("_unit")).distinct().join(ends, key, "full")
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1))
        both = both.withColumn("_own", found).filter("_row IS NOT NULL").join(units.select(*key, before.alias("_before")), key, "left")
        carried = both.withColumn("_found", F.when(known, F.coalesce("_own", "_before")))
    else:
        carried = both.withColumn("_found", F.when(known, found)).filter("_row IS NOT NULL")
    return carried.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def effective_join(rows: DataFrame, dated: DataFrame, on: str, starts: str, by: list[str]) -> DataFrame:
    """rows with the columns of the entry of ``dated`` in force: the latest that starts by the row's day.

    dated is a small book of rules; it becomes intervals [starts, next start) and is broadcast, as a shuffle on ``by`` would put all
    rows of a scenario in one task. Rows without an entry get nulls.
    """
    w = Window.partitionBy(*by).orderBy(starts)
    book = dated.withColumn("_until", F.lead(starts).over(w)).withColumnRenamed(starts, "_since")
    extra = [c for c in dated.columns if c not in by and c != starts]
    r, b = rows.alias("r"), book.alias("b")
    condition = (F.col(f"r.{on}") >= F.col("b._since")) & (F.col("b._until").isNull() | (F.col(f"r.{on}") < F.col("b._until")))
    for c in by:
        condition = condition & (F.col(f"r.{c}") == F.col(f"b.{c}"))
    return r.join(F.broadcast(b), condition, "left").select("r.*", *[F.col(f"b.{c}") for c in extra])


def islands(rows: DataFrame, by: list[str], ordinal: str, name: str = "island") -> DataFrame:
    """Runs of consecutive ordinals of a key get one number: the ordinal less its rank is constant in a run."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    return rows.withColumn(name, (F.col(ordinal) - F.row_number().over(w)).cast("long"))


def sessions(rows: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "session") -> DataFrame:
    """Number the runs between rows where ``breaks`` holds (true or null starts a run)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_break", breaks).withColumn(name, F.sum(F.when(~F.coalesce("_break", F.lit(True)), 0).otherwise(1)).over(w).cast("long")).drop("_break")


def absent_ordinals(keys: DataFrame, present: DataFrame, by: list[str], last, ordinal: str = "ord", first: int = 1) -> DataFrame:
    """(by, ordinal) of first to last that a key of keys has no row for in present: the gaps between its neighbouring ordinals.

    One shuffle by key; neither a grid of keys and ordinals nor an anti-join. last: a number or a column.
    """
    k = keys.select(*by).distinct()
    ends = k.select(*by, F.explode(F.array(F.lit(first - 1).cast("long"), (F.lit(last) + 1).cast("long"))).alias("_o"))
    own = present.join(k, by, "left_semi").select(*by, F.col(ordinal).cast("long").alias("_o")).filter(F.col("_o").between(F.lit(first), F.lit(last)))
    marks = ends.unionByName(own)
    after = F.lead("_o").over(Window.partitionBy(*by).orderBy("_o"))
    return marks.withColumn("_next", after).filter("_next > _o + 1").select(*by, F.explode(F.sequence(F.col("_o") + 1, F.col("_next") - 1)).alias(ordinal))


def missing_from_grid(keys: DataFrame, calendar: DataFrame, present: DataFrame, by: list[str], day: str) -> DataFrame:
    """(key, day) of all days of the calendar for which a key has no row in present."""
    days = calendar.select(F.col("day").alias(day)).distinct().withColumn("_ord", F.row_number().over(Window.orderBy(day)).cast("long"))
    there = present.select(*by, day).join(F.broadcast(days), day)
    gaps = absent_ordinals(keys, there, by, days.agg(F.max("_ord")).scalar(), "_ord")
    return gaps.join(F.broadcast(days), "_ord").select(*by, day)


def latest(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The row with the greatest order of each key, by a pre-aggregated maximum rather than a window."""
    top = rows.groupBy(*by).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row"))
    return top.select("_row.*")
