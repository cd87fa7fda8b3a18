"""Operator files of universe membership: CSV or Parquet, every value as text until it is parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.functions import clean
from tessaro.operators.lineage import settled
from tessaro.sources.catalog import content_hash


#: The line of a CSV file that has more or fewer fields than the header, or quotes that don't end; null for good lines.
CORRUPT = "_corrupt_record"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV (all columns as strings, nothing inferred) or Parquet, by the path's ending. Lines of a CSV that don't fit its header
    are kept in a column of their own, and nothing of them in the others."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        plain = spark.read.option("header", True).option("inferSchema", False)
        names = [f"`{c}`" for c in plain.csv(path).columns]
        kept = ", ".join(f"{c} string" for c in [*names, CORRUPT])
        rows = plain.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).csv(path)
        good = F.col(CORRUPT).isNull()
        return rows.select(*[F.when(good, F.col(c)).alias(c.strip("`")) for c in names], CORRUPT)
    raise ValueError(f"{path} is neither .csv nor .parquet")


def write_rows(rows: DataFrame, path: str) -> None:
    """CSV with a header or Parquet, by the path's ending."""
    if path.endswith(".parquet"):
        rows.write.parquet(path)
    elif path.endswith(".csv"):
        rows.write.option("header", True).csv(path)
    else:
        raise ValueError(f"{path} is neither .csv nor .parquet")


def facts(rows: DataFrame, universe_id: str | Column, source: str, url: str, digest: str, document: str | None = None, effective_date: str | None = None, announcement_date: str | None = None, reason: str | None = None) -> DataFrame:
    """Membership facts with their evidence. Rows: symbol and, each if it is there, raw_effective_from or effective_from, raw_effective_to
    or effective_to, announcement_date, reason; where a row lacks the start, the announcement or the reason, the one given holds."""
    there = set(rows.columns)
    text = lambda *names: clean.blank_to_null(next((c for c in names if c in there), None)) if there & set(names) else F.lit(None).cast("string")
    # a text that is no date stays one: only a blank falls back
    dated = lambda given, *names: F.when(text(*names).isNull(), F.lit(given).cast("date")).otherwise(clean.trade_date(next((c for c in names if c in there), "symbol")))
    end = text("raw_effective_to", "effective_to")
    return rows.select(
        (F.lit(universe_id) if isinstance(universe_id, str) else universe_id).alias("universe_id"), clean.symbol("symbol").alias("symbol"), dated(effective_date, "raw_effective_from", "effective_from").alias("raw_effective_from"),
        dated(None, "raw_effective_to", "effective_to").alias("raw_effective_to"), dated(announcement_date, "announcement_date").alias("announcement_date"), F.when(end.isNull(), "active").otherwise("removed").alias("status"),
        F.coalesce(text("reason"), F.lit(reason)).alias("reason"), F.lit(source).alias("source"), F.lit(url).alias("source_url"), F.lit(digest).alias("snapshot_sha256"), F.lit(document or digest).alias("source_document_sha256"),
    )


def split_import(rows: DataFrame, universe_id: str | Column, **evidence) -> tuple[DataFrame, DataFrame]:
    """Rows as read -> facts without a fault of their own, and rejected rows (universe_id, symbol, problems): corrupt lines, and facts
    for which fact_issues finds anything but an overlap."""
    if CORRUPT in rows.columns:
        rows = settled(rows)  # Spark refuses to look at this column alone in a file
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in rows.columns else F.lit(False)
    numbered = settled(facts(rows.filter(~corrupt), universe_id, **evidence).withColumn("_n", F.monotonically_increasing_id()))
    issues = fact_issues(numbered.withColumn("universe_id", F.concat_ws("|", "universe_id", F.col("_n").cast("string"))).drop("_n"))
    # each row a universe of its own here: faults are of the row alone
    faults = issues.withColumn("_n", F.element_at(F.split("universe_id", r"\|"), -1).cast("long")).groupBy("_n").agg(F.array_sort(F.flatten(F.collect_list("problems"))).alias("problems"))
    judged = numbered.join(faults, "_n", "left")
    good = judged.filter("problems IS NULL").select(*FACT_COLUMNS)
    bad = judged.filter("problems IS NOT NULL").select("universe_id", "symbol", "problems")
    lines = rows.filter(corrupt).select((F.lit(universe_id) if isinstance(universe_id, str) else F.lit(None).cast("string")).alias("universe_id"), F.lit(None).cast("string").alias("symbol"), F.array(F.lit("corrupt_record")).alias("problems"))
    return good, bad.unionByName(lines)


class ImportRejected(ValueError):
    """A membership file has rows that are no facts: nothing was written."""


def import_file(spark: SparkSession, path: str, output: str, universe_id: str, **evidence) -> tuple[DataFrame, str]:
    """Read a file, check every row, and only if all are facts without a fault write them in order to output; the facts as written, and
    their content's hash."""
    good, rejected = split_import(read_rows(spark, path), universe_id, **evidence)
    n = rejected.count() + fact_issues(good).count()
    if n:
        raise ImportRejected(f"{n} rows of the file have faults")
    write_rows(good.repartitionByRange("universe_id", "symbol", "raw_effective_from").sortWithinPartitions("universe_id", "symbol", "raw_effective_from"), output)
    kept = read_rows(spark, output)
    written = facts(kept, F.col("universe_id"), **evidence) if output.endswith(".csv") else kept
    return written, content_hash(written)


# What a membership fact may say, and why memberships end for good.
STATUSES = ("active", "removed")
REASONS = ("initial_constituent", "regular_rebalance", "temporary_adjustment", "delisting", "merger_or_reorganization")
TERMINATIONS = ("delisting", "merger_or_reorganization")
#: Columns of a table of facts, in order.
FACT_COLUMNS = ("universe_id", "symbol", "raw_effective_from", "raw_effective_to", "announcement_date", "status", "reason", "source", "source_url", "snapshot_sha256", "source_document_sha256")


def fact_issues(rows: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Every fault of membership facts, all FATAL: code, universe_id, symbol, problems (an array of what is wrong).

    Checked in this order, each by itself: schema, evidence, symbols, intervals with status and reason, overlaps of a (universe,
    symbol), announcements after use, and with a master (symbol, list_date, delist_date) delistings without a proven last day and
    facts that the listing leaves no day of. Dates may be texts.
    """
    if tuple(rows.columns) != FACT_COLUMNS:
        one = rows.sparkSession.range(1)
        return one.select(F.lit("UNIVERSE_SCHEMA_MISMATCH").alias("code"), F.lit(None).cast("string").alias("universe_id"), F.lit(None).cast("string").alias("symbol"), F.array(*map(F.lit, rows.columns)).alias("problems"))
    text = lambda c: clean.blank_to_null(c)
    r = rows.select("universe_id", text("symbol").alias("symbol"), clean.trade_date("raw_effective_from").alias("start"), text("raw_effective_to").isNotNull().alias("ended"), clean.trade_date("raw_effective_to").alias("end"), clean.trade_date("announcement_date").alias("announced"), *[text(c).alias(c) for c in FACT_COLUMNS[5:]])
    w = Window.partitionBy("universe_id", "symbol").orderBy("start", F.col("end").asc_nulls_last())
    r = r.withColumns({"_end": F.lag(F.struct("end")).over(w), "_start": F.lag("start").over(w)})
    canonical = F.coalesce(F.col("symbol").rlike(r"^[0-9]{6}\.(SH|SZ|BJ)$"), F.lit(False))
    if master is not None:
        r = r.join(master.select(F.col("symbol").alias("_symbol"), "list_date", "delist_date"), F.col("symbol") == F.col("_symbol"), "left")
    said = lambda *cases: F.array_compact(F.array(*[F.when(c, p) for c, p in cases]))
    status, reason, dated = F.col("status"), F.col("reason"), F.col("start").isNotNull()
    known = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    digest = lambda c: F.coalesce(~F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(True))
    checks = [
        ("UNIVERSE_EVIDENCE_MISSING", said(*[(digest(c), c) for c in ("snapshot_sha256", "source_document_sha256")], *[(F.col(c).isNull(), c) for c in ("source", "source_url")])),
        ("UNIVERSE_UNKNOWN_SYMBOL", said((~canonical, "non_canonical_symbol"), *([(canonical & F.col("_symbol").isNull(), "absent_from_security_master")] if master is not None else []))),
        (
            "UNIVERSE_INTERVAL_CONFLICT",
            said(
                (~dated, "raw_effective_from_missing"),
                (F.col("announced").isNull(), "announcement_date_missing"),
                (F.col("ended") & F.col("end").isNull(), "raw_effective_to_unparsable"),
                (~known(status, STATUSES), "unknown_status"),
                ((status == "active") & F.col("ended"), "active_fact_cannot_end"),
                ((status == "removed") & ~F.col("ended"), "removed_fact_requires_end"),
                (~known(reason, REASONS), "unknown_reason"),
                (known(reason, TERMINATIONS) & ~status.eqNullSafe(F.lit("removed")), "termination_reason_requires_removed_status"),
                ((reason == "initial_constituent") & ~status.eqNullSafe(F.lit("active")), "initial_constituent_requires_active_status"),
                (F.col("end") < F.col("start"), "end_precedes_start"),
            ),
        ),
        ("UNIVERSE_INTERVAL_OVERLAP", said((F.col("_start").isNotNull() & (F.col("_end.end").isNull() | (F.col("_end.end") >= F.col("start"))), "begins_before_the_one_before_has_ended"))),
        ("UNIVERSE_ANNOUNCEMENT_AFTER_USE", said((F.col("announced") > F.col("start"), "announced_after_start"))),
    ]
    if master is not None:
        listed = dated & canonical & F.col("_symbol").isNotNull()
        unproven = listed & known(reason, TERMINATIONS) & (status == "removed") & F.col("delist_date").isNull()
        empty = F.greatest("start", "list_date") > F.least("end", "delist_date")
        checks += [
            ("UNIVERSE_DELISTING_ENDPOINT_UNPROVEN", said((unproven, "delisting_without_last_tradable_day"))),
            ("UNIVERSE_MASTER_INTERSECTION_EMPTY", said((listed & ~F.coalesce(unproven, F.lit(False)) & empty, "no_day_between_listing_and_delisting"))),
        ]
    found = F.filter(F.array(*[F.struct(F.lit(code).alias("code"), problems.alias("problems")) for code, problems in checks]), lambda i: F.size(i["problems"]) > 0)
    return r.select("universe_id", "symbol", F.explode(found).alias("i")).select("i.code", "universe_id", "symbol", "i.problems")
