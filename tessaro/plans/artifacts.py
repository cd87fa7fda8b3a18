"""Queries over what runs leave behind: seeds, manifests and their index, identities, reports, and reads that fail at first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.operators import quality
from tessaro.operators.lineage import settled
from tessaro.plans import market, performance, streams
from tessaro.plans.registry import query
from tessaro.schemas import TABLES, schema
from tessaro.sources import catalog, identity, raw_store, report, supplier

EMPTY = [t for t in TABLES if t not in ("trading_calendar", "security_master")]


@query("SELECT 'trading_calendar' AS name, count(*) AS n FROM open_days UNION ALL SELECT 'security_master', count(*) FROM master UNION ALL SELECT unnest([" + ", ".join(f"'{t}'" for t in EMPTY) + "]), 0")
def bootstrap_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first version from a calendar and a master, read back: all other tables are there, and empty."""
    root = streams.work_folder(spark, "seed")
    days = market.open_days(spark, sf_dir).select(F.col("day").alias("calendar_date"), F.lit(True).alias("is_trading_day"))
    m = market.master(spark, sf_dir).select("symbol", "name", F.upper(F.substring("board", 1, 2)).alias("exchange"), "board", "list_date", "delist_date", F.when(F.col("delist_date").isNull(), "L").otherwise("D").alias("list_status"))
    version = catalog.Dataset(spark, root, catalog.bootstrap(spark, root, days, m))
    if version.verify():
        raise ValueError("the seed isn't what was written")
    counts = [version.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in version.manifest["tables"]]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT CAST(year(trade_date) AS BIGINT) AS fold, scenario, count(*) AS n_days, round(arg_max(equity, trade_date), 2) AS last_equity FROM equity GROUP BY 1, 2")
def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each fold and scenario, written once each beside its ledger, and the index over all of them."""
    root = streams.work_folder(spark, "runs")
    e = market.equity(spark, sf_dir).withColumn("fold", F.year("trade_date").cast("long"))
    e.write.partitionBy("fold", "scenario").parquet(f"{root}/ledgers")
    kept = spark.read.parquet(f"{root}/ledgers").groupBy("fold", "scenario").agg(F.count("*").alias("n_days"), F.round(F.max_by("equity", "trade_date"), 2).alias("last_equity"))
    for r in kept.collect():  # two rows a year
        at, value = f"{root}/runs/{r.fold}-{r.scenario}/manifest.json", r.asDict()
        if raw_store.write_once(spark, at, value) != raw_store.write_once(spark, at, dict(reversed(value.items()))):
            raise ValueError("the same content has two hashes")
        try:
            raw_store.write_once(spark, at, value | {"n_days": -1})
        except FileExistsError:
            continue
        raise ValueError("a manifest was replaced by another")
    return raw_store.registry_index(spark, f"{root}/runs", ["fold", "scenario"]).select("fold", "scenario", "n_days", "last_equity")


@query("SELECT unnest(['same tables', 'a price', 'a calendar day', 'a policy', 'a parameter']) AS changed, unnest([true, false, false, false, false]) AS same_id")
def experiment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of an experiment over published bars: the same for the same rows in any order, another where anything it read differs."""
    root = streams.work_folder(spark, "identity")
    bars = settled(streams.daily_bar(spark, sf_dir))
    days = market.open_days(spark, sf_dir).select(F.col("day").alias("calendar_date"), F.lit(True).alias("is_trading_day"))
    top = bars.agg(F.max(F.struct("close", "symbol", "trade_date")).alias("t")).select("t.*")
    moved = bars.join(F.broadcast(top.select("symbol", "trade_date", F.lit(1).alias("hit"))), ["symbol", "trade_date"], "left").withColumn("close", F.when(F.col("hit") == 1, F.col("close") + 0.01).otherwise(F.col("close"))).select(*bars.columns)
    last = days.agg(F.max("calendar_date")).scalar()

    def of(bars: DataFrame, days: DataFrame, band: str = "0.02", top: int = 10) -> str:
        version = catalog.Dataset(spark, root, catalog.publish(spark, root, {"daily_bar": bars, "trading_calendar": days}))
        spec = {"dataset_version": "v", "universe_version": "u", "data_acceptance_id": "a", "top": top}
        return identity.experiment_id(spec, identity.snapshots(version, {"name": "momentum"}, {"band": band}))

    first = of(bars, days)
    others = {"same tables": of(bars.repartition(5, "trade_date"), days), "a price": of(moved, days), "a calendar day": of(bars, days.filter(F.col("calendar_date") < last)), "a policy": of(bars, days, "0.03"), "a parameter": of(bars, days, top=11)}
    return spark.createDataFrame([(k, v == first) for k, v in others.items()], "changed string, same_id boolean")


@query("SELECT unnest(['as wanted', 'two columns changed places', 'a column missing', 'a column more', 'another type']) AS variant, unnest([0, 1, 1, 1, 1]) AS n_faults")
def schema_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars' schema against the published one; order counts."""
    b = streams.daily_bar(spark, sf_dir).withColumn("trade_date", F.col("trade_date"))
    names = b.columns
    variants = {
        "as wanted": b, "two columns changed places": b.select(names[1], names[0], *names[2:]), "a column missing": b.drop("amount"), "a column more": b.withColumn("x", F.lit(1)), "another type": b.withColumn("volume", F.col("volume").cast("double")),
    }
    return spark.createDataFrame([(k, len(quality.schema_faults(v, schema("daily_bar")))) for k, v in variants.items()], "variant string, n_faults int")


_ASKED: set[tuple] = set()


def landed_at_last(folder: str, symbol: str, start, end):
    """An endpoint that fails at first for each request of a worker, and has the rows when it is asked again."""
    if (symbol, start) not in _ASKED:
        _ASKED.add((symbol, start))
        raise supplier.TransientError(symbol)
    return streams.landed_first(folder, symbol, start, end)


@query("SELECT symbol, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day, sum(volume)::BIGINT AS volume FROM bars WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND CAST(symbol[2:] AS BIGINT) % 3 <> 0 GROUP BY 1")
def supplier_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from an endpoint whose first answer to every request is a fault that passes."""
    supplier.register(spark)
    options = streams.supplier_options(*streams.landing(spark, sf_dir, ("first",))) | {"connector": "tessaro.plans.artifacts:landed_at_last", "attempts": "2", "wait": "0"}
    b = spark.read.format("supplier").options(**options).load()
    return b.groupBy("symbol").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.sum("volume").alias("volume"))


@query(
    """
SELECT 'curves' AS section, (SELECT count(DISTINCT scenario) FROM equity) AS n, false AS refused UNION ALL SELECT 'points', (SELECT count(*) FROM (SELECT DISTINCT scenario, date_trunc('week', trade_date) FROM equity)), false
UNION ALL SELECT 'metrics', (SELECT count(*) FROM folds), false UNION ALL SELECT 'daily rows', NULL, true"""
)
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of fold metrics and weekly curves, written and read back; a table above its bound is refused, not cut."""
    equity = settled(market.equity(spark, sf_dir))  # two rows a day, read by all parts
    metrics = performance.folds(spark, sf_dir, equity)
    weekly = equity.groupBy("scenario", F.date_trunc("week", "trade_date").cast("date").alias("week")).agg(F.max_by("equity", "trade_date").alias("equity"))
    page = report.experiment("Equal weight, two scenarios", metrics, weekly, {"tables": ["equity", "order_lines"]})
    files, at = catalog.Files(spark, streams.work_folder(spark, "report")), f"{streams.work_folder(spark, 'report')}/experiment.html"
    files.write(at, page)
    back = files.read(at)
    try:
        report.table_html(equity, most=100)
        refused = False
    except ValueError:
        refused = True
    points = sum(x.split('"')[0].count(",") for x in back.split('points="')[1:])
    found = [("curves", back.count("<polyline"), False), ("points", points, False), ("metrics", back.split("<h2>Folds</h2>")[1].split("</table>")[0].count("<tr>") - 1, False), ("daily rows", None, refused)]
    return spark.createDataFrame(found, "section string, n long, refused boolean")
