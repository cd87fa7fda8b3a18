"""Queries over streams, versioned tables, raw snapshots and supplier reads."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.operators.lineage import settled, shared_root
from tessaro.plans import market
from tessaro.plans.market import table
from tessaro.plans.registry import query
from tessaro.schemas import TABLES, schema
from tessaro.sources import catalog, membership_file, raw_store, supplier
from tessaro.streaming import bars as streaming


def work_folder(spark: SparkSession, what: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    kind = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice in the stream, once in the result."""
    e = event_stream(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    at = work_folder(spark, "stream-dedup")
    return streaming.run_to_table(streaming.distinct_events(twice).select("event_id", "user_id", "event_type", "value"), f"{at}/out", f"{at}/checkpoint")


@query(
    """
SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n
FROM events GROUP BY 1, 2"""
)
def daily_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed bars of the stream's plan over the whole table."""
    b = streaming.windowed_bars(table(spark, sf_dir, "events"))
    return b.select("user_id", F.col("start").cast("date").alias("day"), "open", "high", "low", "close", "n")


@query(
    """
SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, max(value) AS high, count(*) AS n FROM events
GROUP BY 1, 2 HAVING CAST(date_trunc('day', ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that the watermark has closed: the last, still open day stays out of an append-mode stream."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    at = work_folder(spark, "stream-bars")
    out = streaming.run_to_table(streaming.windowed_bars(e), f"{at}/out", f"{at}/checkpoint")
    return out.select("user_id", F.col("start").cast("date").alias("day"), "high", "n")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals kept as state for each user."""
    at = work_folder(spark, "stream-state")
    out = streaming.run_to_table(streaming.running_totals(event_stream(spark, sf_dir)), f"{at}/out", f"{at}/checkpoint")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


def daily_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"adjustment": F.lit("unadjusted"), "source": F.lit("tushare"), "ingested_at": F.lit("2002-01-01 00:00:00").cast("timestamp")}
    return market.bars(spark, sf_dir).withColumns(extra).select(*schema("daily_bar").names)


@query("SELECT symbol, count(*) AS n, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1")
def versioned_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the bars as a version, and read them back through its catalog."""
    root = work_folder(spark, "catalog")
    days = market.open_days(spark, sf_dir).select(F.col("day").alias("calendar_date"), F.lit(True).alias("is_trading_day"))
    catalog.publish(spark, root, {"daily_bar": daily_bar(spark, sf_dir), "trading_calendar": days})
    return catalog.Dataset(spark, root).query("SELECT symbol, count(*) AS n, sum(volume) AS volume FROM {daily_bar} GROUP BY 1")


@query("SELECT 'daily_bar' AS name, count(*) AS n_rows, 0 AS n_out_of_order FROM bars UNION ALL SELECT 'trading_calendar', count(*), 0 FROM open_days")
def published_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published tables read back by file and place in it: every row stands behind those that come before it."""
    root = work_folder(spark, "catalog")
    days = market.open_days(spark, sf_dir).select(F.col("day").alias("calendar_date"), F.lit(True).alias("is_trading_day"))
    catalog.publish(spark, root, {"daily_bar": daily_bar(spark, sf_dir).repartition(5), "trading_calendar": days})
    path = catalog.Dataset(spark, root).path
    one, two = (catalog.out_of_order(spark, f"{path}/{t}.parquet", t).select(F.lit(t).alias("name"), "n_rows", F.col("n_out_of_order").cast("int").alias("n_out_of_order")) for t in ("daily_bar", "trading_calendar"))
    return one.unionByName(two)


@query("SELECT symbol, count(*) AS n_new, count(*) FILTER (trade_date < DATE '1998-01-01') AS n_old, sum(volume) FILTER (trade_date >= DATE '1998-01-01')::BIGINT AS added FROM bars GROUP BY 1")
def version_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions at once, as views of the catalogue in plain SQL; commands that write are refused."""
    root, b = work_folder(spark, "catalog"), settled(daily_bar(spark, sf_dir))
    old = catalog.Dataset(spark, root, catalog.publish(spark, root, {"daily_bar": b.filter("trade_date < DATE'1998-01-01'")}))
    new = catalog.Dataset(spark, root, catalog.publish(spark, root, {"daily_bar": b}))
    before = old.attach()
    for sql in ("DROP VIEW daily_bar", "INSERT INTO daily_bar SELECT * FROM daily_bar", "CREATE TABLE t AS SELECT 1 AS x", "WITH x AS (SELECT * FROM daily_bar) INSERT INTO daily_bar SELECT * FROM x"):
        try:
            new.sql(sql)
        except catalog.WritesRefused:
            continue
        raise ValueError(f"not refused: {sql}")
    return new.sql(
        f"""SELECT n.symbol, count(*) AS n_new, count(o.symbol) AS n_old, sum(CASE WHEN o.symbol IS NULL THEN n.volume END) AS added
        FROM daily_bar n LEFT JOIN {before}.daily_bar o ON o.symbol = n.symbol AND o.trade_date = n.trade_date GROUP BY n.symbol"""
    )


@query(
    """
SELECT f AS format, count(*) FILTER (good) AS n_facts, count(*) FILTER (good AND raw_to IS NULL) AS n_open, min(raw_from) FILTER (good) AS first_start, count(*) FILTER (k % 50 = 3 AND NOT corrupt) AS n_bad_symbols, count(*) FILTER (k % 60 = 7 AND NOT corrupt) AS n_bad_dates, count(*) FILTER (corrupt) AS n_corrupt
FROM (SELECT *, NOT corrupt AND k % 50 <> 3 AND k % 60 <> 7 AND announced <= raw_from AS good FROM (SELECT f, m.*, f = 'csv' AND k % 77 = 5 AS corrupt FROM (SELECT *, CAST(symbol[2:] AS BIGINT) AS k FROM memberships) m, (SELECT unnest(['csv', 'parquet']) AS f))) GROUP BY 1"""
)
def membership_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership files as CSV and Parquet with bad symbols, bad dates and lines that don't fit: read, split into facts and rejected
    rows, and the facts written in the other format and read back."""
    m = market.memberships(spark, sf_dir).withColumn("k", F.substring("symbol", 2, 20).cast("long"))
    k, reason = F.col("k"), F.when(F.col("raw_to").isNull(), "initial_constituent").otherwise("regular_rebalance")

    def lines(reason) -> DataFrame:
        return m.select(
            "universe_id", F.when(k % 50 == 3, "bad").otherwise(F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".SH"))).alias("symbol"), F.when(k % 60 == 7, "n/a").otherwise(F.date_format("raw_from", "yyyyMMdd")).alias("raw_effective_from"),
            F.col("raw_to").cast("string").alias("raw_effective_to"), F.col("announced").cast("string").alias("announcement_date"), reason.alias("reason"),
        )

    at = work_folder(spark, "members")
    # written without quotes, commas within a value are fields too many
    lines(F.when(k % 77 == 5, "x,one,more").otherwise(reason)).write.option("header", True).option("quote", "").csv(f"{at}/members.csv")
    lines(reason).write.parquet(f"{at}/members.parquet")
    out = []
    for kind, other in (("csv", "parquet"), ("parquet", "csv")):
        good, bad = membership_file.split_import(membership_file.read_rows(spark, f"{at}/members.{kind}"), F.col("universe_id"), source="file", url="http://members", digest="0" * 64)
        membership_file.write_rows(good, f"{at}/{kind}-facts.{other}")
        back = membership_file.read_rows(spark, f"{at}/{kind}-facts.{other}")
        kept = back.agg(F.count("*").alias("n_facts"), F.count_if(F.col("raw_effective_to").isNull()).alias("n_open"), F.min(F.col("raw_effective_from").cast("date")).alias("first_start"))
        has = lambda p: F.count_if(F.array_contains("problems", p))
        lost = bad.agg(has("non_canonical_symbol").alias("n_bad_symbols"), has("raw_effective_from_missing").alias("n_bad_dates"), has("corrupt_record").alias("n_corrupt"))
        key = F.lit(kind).alias("format")
        out.append(kept.select(key, "*").join(lost.select(key, "*"), "format"))
    return out[0].unionByName(out[1])


@query("SELECT true AS same_for_any_order, true AS changes_with_content, 9 AS n_tables")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = settled(daily_bar(spark, sf_dir))
    one, other = catalog.content_hash(b), catalog.content_hash(b.repartition(7, "trade_date"))
    less = catalog.content_hash(b.filter("symbol <> 'S1'"))
    return spark.createDataFrame([(one == other, one != less, len(TABLES))], "same_for_any_order boolean, changes_with_content boolean, n_tables int")


@query("SELECT 'tushare' AS source, 'daily' AS endpoint, 1 AS n_snapshots, count(*) AS n_rows FROM bars")
def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "raw")
    key = raw_store.request_key("daily", ["S1"], "1995-01-01", "2001-12-31", {"token": "hidden"})
    rows = settled(market.bars(spark, sf_dir))
    for _ in range(2):  # the same content is one snapshot
        manifest = raw_store.save(spark, root, rows, "tushare", "daily", key, {"token": "hidden"})
    if raw_store.verify(spark, manifest):
        raise ValueError("the snapshot isn't what was written")
    return raw_store.inventory(spark, root).withColumn("n_snapshots", F.col("n_snapshots").cast("int"))


@functools.lru_cache(maxsize=8)
def opened(folder: str, path: str, changed: int, size: int):
    """A landed file of many names, as it was then, and the first and last name of each row group: requests for neighbours come one after the other."""
    from pyarrow import parquet as pq
    from pyarrow.fs import FileSystem

    f = pq.ParquetFile(path, filesystem=FileSystem.from_uri(folder)[0])
    stats = [f.metadata.row_group(g).column(0).statistics for g in range(f.num_row_groups)]
    return f, [(s.min, s.max) if s is not None and s.has_min_max else (None, None) for s in stats]


@functools.lru_cache(maxsize=8)
def row_groups(folder: str, path: str, changed: int, size: int, groups: tuple[int, ...]):
    """Rows of neighbouring row groups: a name's next window, and names beside it, are in the same ones. A task has one core, so that
    they are read by one thread."""
    return opened(folder, path, changed, size)[0].read_row_groups(groups, use_threads=False)


def landed(folder: str, symbol: str, start, end):
    """A supplier's response for a symbol: its rows in a landing folder, whatever range is asked for, and headers that tell of the budget
    left. They are in a file of its own, or in that of the names which differ in the last two characters only, whose row groups are narrow."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyarrow import parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, root = FileSystem.from_uri(folder)
    files = lambda path: [f for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    found = [t.add_column(0, "symbol", pa.repeat(symbol, len(t))) for t in (pq.ParquetFile(f.path, filesystem=fs).read() for f in files(f"{root}/symbol={symbol}"))]
    for f in files(f"{root}/names={symbol[:-2]}xx") if not found else ():
        file = (folder, f.path, f.mtime_ns, f.size)
        own = tuple(g for g, (lo, hi) in enumerate(opened(*file)[1]) if lo is None or lo <= symbol <= hi)
        if own:
            t = row_groups(*file, own)
            found.append(t.filter(pc.equal(t["symbol"], symbol)))
    if not any(map(len, found)):
        raise supplier.EmptyResponse(symbol)
    return pa.concat_tables(found), {"X-RateLimit-IP-Remaining": "180"}


def landed_first(folder: str, symbol: str, start, end):
    return landed(f"{folder}/first", symbol, start, end)


def landed_second(folder: str, symbol: str, start, end):
    return landed(f"{folder}/second", symbol, start, end)


#: The endpoints of landed bars, and which names' bars each of them has, by k, the name's number modulo three.
ENDPOINTS = {"first": "k > 0", "second": "k = 0"}


def landing(spark: SparkSession, sf_dir: str, endpoints: tuple[str, ...] = tuple(ENDPOINTS)) -> tuple[str, str]:
    """Bars as the responses of the endpoints that will be asked, of which the first lacks every third name, a file for a hundred names; and
    the symbols, of which the endpoints lack some."""
    at = work_folder(spark, "landing")
    names = F.concat(F.expr("left(symbol, length(symbol) - 2)"), F.lit("xx"))
    b = market.bars(spark, sf_dir, names).select(F.col("lot").alias("names"), "symbol", "trade_date", "close", "volume", (F.substring("symbol", 2, 20).cast("long") % 3).alias("k"))
    for name in endpoints:
        lots = b.filter(ENDPOINTS[name]).drop("k").sortWithinPartitions("names", "symbol", "trade_date")
        lots.write.option("parquet.block.row.count.limit", 2000).partitionBy("names").parquet(f"{at}/{name}")
    # the names that are asked for are configuration, as a universe is: a string of them
    names = ",".join(sorted(r.symbol for r in market.master(spark, sf_dir).select("symbol").collect()))
    return at, names


def supplier_options(at: str, names: str) -> dict:
    chain = "tessaro.plans.streams:landed_first,tessaro.plans.streams:landed_second"
    return {"connector": chain, "endpoint": at, "symbols": names + ",NONE", "headers": "true", "columns": "symbol string, trade_date date, close double, volume long", "start": "1995-01-01", "end": "2001-12-31"}


@query("SELECT symbol, trade_date, close, volume FROM bars WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '2000-02-29' AND CAST(symbol[2:] AS BIGINT) % 3 <> 0")
def supplier_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that one endpoint has, in windows of two years of which it doesn't heed the range: the source drops what wasn't asked for."""
    supplier.register(spark)
    options = supplier_options(*landing(spark, sf_dir, ("first",))) | {"connector": "tessaro.plans.streams:landed_first", "window_years": "2", "start": "1996-03-01", "end": "2000-02-29"}
    return spark.read.format("supplier").options(**options).load()


@query("SELECT symbol, trade_date, close, volume FROM bars WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'")
def supplier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars read from two endpoints, the second of which has what the first lacks."""
    supplier.register(spark)
    return spark.read.format("supplier").options(**supplier_options(*landing(spark, sf_dir))).load()


@query("SELECT symbol, trade_date, close, volume FROM bars WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'")
def supplier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars read in steps: up to a day, stopped, started again with a later end, 45 days read twice; windows are replaced."""
    at, names = landing(spark, sf_dir)
    options, work = supplier_options(at, names) | {"addresses": "4", "overlap": "45"}, work_folder(spark, "supplier")
    for end in ("1997-06-30", "1997-12-31", "2001-12-31"):
        supplier.read_on(spark, options | {"end": end}, f"{work}/out", f"{work}/checkpoint")
    return supplier.latest_version(spark, f"{work}/out", options["columns"])


@query(
    """
SELECT symbol, ex_date, cash, CASE WHEN one AND two THEN 'both' WHEN one THEN 'first' ELSE 'second' END AS feed FROM (
  SELECT symbol, ex_date, round(sum(cash), 6) AS cash, bool_or(k % 5 <> 0) AS one, bool_or(k % 3 <> 0) AS two FROM (SELECT symbol, ex_date, cash, CAST(symbol[2:] AS BIGINT) + day(ex_date) AS k FROM actions) GROUP BY symbol, ex_date)
WHERE one OR two"""
)
def supplier_event_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of corporate actions, each of which lacks some days, read through the source and brought together."""
    supplier.register(spark)
    at = work_folder(spark, "feeds")
    k = F.substring("symbol", 2, 20).cast("long") + F.dayofmonth("ex_date")
    a = market.actions(spark, sf_dir).groupBy("symbol", "ex_date").agg(F.round(F.sum("cash"), 6).alias("cash")).withColumn("k", k)
    for name, own in (("first", a.filter("k % 5 <> 0")), ("second", a.filter("k % 3 <> 0"))):
        own.select("symbol", "ex_date", "cash").repartition("symbol").write.partitionBy("symbol").parquet(f"{at}/{name}")
    names = ",".join(sorted(r.symbol for r in a.select("symbol").distinct().collect()))
    options = supplier_options(at, names) | {"columns": "symbol string, ex_date date, cash double", "day": "ex_date"}
    one, two = (spark.read.format("supplier").options(**options | {"connector": f"tessaro.plans.streams:landed_{n}"}).load().withColumn("feed", F.lit(n)) for n in ("first", "second"))
    feed = F.when(F.count_distinct("feed") > 1, "both").otherwise(F.max("feed")).alias("feed")
    return one.unionByName(two).groupBy("symbol", "ex_date").agg(F.max("cash").alias("cash"), feed)
