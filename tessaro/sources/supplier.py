"""A source over supplier endpoints, for batches and streams: tasks fetch symbols' windows of years, with retries for passing faults.
Rows whose trade_date lies outside the window are dropped, as suppliers don't all heed the range asked for.

The connector is a plain function of (endpoint, symbol, start, end) named by ``connector`` as ``module:function``; it yields
rows in the schema's order. Several, comma-separated, are a chain: each is asked until one has data, and a request for which
none has any is no fault of the others. With ``headers``, connectors return (rows, headers), and requests are spaced by what the headers say.
Windows are half-decades, so that no response meets a supplier's row limit. A batch's task makes ``requests_per_task`` requests, one after
the other, so that tasks are worth their start; unless that is given, more than a hundred where there would be too many tasks. Rows may be tuples or a pyarrow Table, whose columns are taken in the schema's order.

As a stream, the offset is the last day read: each batch asks for the days after it, up to ``end``, and for ``overlap`` days before,
in which suppliers still correct. Requests are dealt to the ``addresses``, one partition each, so that one task spaces all
requests of an address and so keeps its budget. ``keep_windows`` is the sink: what a batch has read replaces what
was carried for its symbols in its window.
"""

from __future__ import annotations

import datetime as dt
import importlib
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tessaro.operators.lineage import settled
from tessaro.operators.merging import replace_window
from tessaro.sources.catalog import Files

WINDOW_YEARS = 5
REQUESTS_PER_TASK = 100
#: Tasks of a batch from which they make more requests each rather than becoming more: starting one costs as much as some hundred requests.
MANY_TASKS = 400
#: Rows of small responses that are handed to Spark together.
BATCH_ROWS = 10_000


class TransientError(Exception):
    """A fault that may pass: worth another attempt, unlike a refused or malformed request."""


class EmptyResponse(Exception):
    """A connector without data for a request; the next one in a chain may have it."""


def windows(start: dt.date, end: dt.date, years: int = WINDOW_YEARS) -> list[tuple[dt.date, dt.date]]:
    """[start, end] cut into pieces of at most ``years`` calendar years."""
    out = []
    while start <= end:
        stop = min(end, dt.date(start.year + years - 1, 12, 31))
        out.append((start, stop))
        start = stop + dt.timedelta(days=1)
    return out


def with_retry(call, attempts: int = 3, wait: float = 1.0, sleep=time.sleep):
    """Up to ``attempts`` tries with a wait that grows by one step each; only transient faults are tried again."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except TransientError:
            if k == attempts:
                raise
            sleep(wait * k)


def whole(rows: Iterable[tuple] | pa.Table) -> list[tuple] | pa.Table:
    """A response that is there as a whole: nothing of it is still to be fetched."""
    return rows if isinstance(rows, pa.Table) else list(rows)


def first_available(*connectors):
    """A connector that asks each of the given ones in turn until one has data."""

    def fetch(endpoint: str, symbol: str, start: dt.date, end: dt.date) -> list[tuple] | pa.Table:
        for c in connectors:
            try:
                if len(rows := whole(c(endpoint, symbol, start, end))):
                    return rows
            except EmptyResponse:
                continue
        raise EmptyResponse(f"no endpoint has {symbol}")

    return fetch


# The headers of a supplier's budget, the remainder from which requests are spaced, and the seconds between them.
REMAINING, RETRY_AFTER, ANY_LIMIT = "x-ratelimit-ip-remaining", "retry-after", "x-ratelimit"
LOW_REMAINDER, SPACING = 10, 1.0


class Throttle:
    """Spaces a task's requests by what responses say of their budget: no wait until a header is seen, then a set wait after
    retry-after, a second between requests where little is left or a response says nothing, none where enough is left."""

    def __init__(self, clock=time.monotonic, sleep=time.sleep) -> None:
        self.clock, self.sleep = clock, sleep
        self.limited, self.next_at = False, 0.0

    def wait(self) -> None:
        """Before a request."""
        if self.limited and (left := self.next_at - self.clock()) > 0:
            self.sleep(left)

    def observe(self, headers: dict[str, str]) -> None:
        """After a response; names of headers in any case, values that are no numbers count as none left."""
        told = {k.lower(): v for k, v in headers.items()}
        if not self.limited and not any(k == RETRY_AFTER or k.startswith(ANY_LIMIT) for k in told):
            return
        self.limited = True
        pause = number(told.get(RETRY_AFTER))
        if pause is None:
            left = number(told[REMAINING]) or 0 if REMAINING in told else 0
            pause = SPACING if left < LOW_REMAINDER else 0.0
        self.next_at = self.clock() + max(pause, 0.0)


def throttled(request, throttle: Throttle | None = None):
    """A connector of request(endpoint, symbol, start, end) -> (rows, headers), spaced by its own headers. Each task has its own; all
    tasks of an address share its budget, so that the remainder in the headers, not a count of requests, tells how much is left."""
    held = throttle or Throttle()

    def fetch(endpoint: str, symbol: str, start: dt.date, end: dt.date) -> list[tuple] | pa.Table:
        held.wait()
        rows, headers = request(endpoint, symbol, start, end)
        held.observe(headers)
        return whole(rows)

    return fetch


def number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def within(rows: Iterator[tuple], at: int | None, start: dt.date, end: dt.date) -> Iterator[tuple]:
    """The rows whose date lies in [start, end]: suppliers don't all heed their range parameters. Without a date column all pass;
    rows without a date don't. Dates may be texts, with or without dashes."""
    lo, hi = start.strftime("%Y%m%d"), end.strftime("%Y%m%d")
    for row in rows:
        if at is None or (row[at] is not None and lo <= str(row[at])[:10].replace("-", "") <= hi):
            yield row


def within_table(rows: pa.Table, at: int | None, start: dt.date, end: dt.date) -> pa.Table:
    """``within`` for a table."""
    if at is None:
        return rows
    if pa.types.is_date32(rows.column(at).type):
        return rows.filter(pc.and_(pc.greater_equal(rows.column(at), pa.scalar(start)), pc.less_equal(rows.column(at), pa.scalar(end))))
    days = pc.replace_substring(pc.utf8_slice_codeunits(rows.column(at).cast(pa.string()), 0, 10), "-", "")
    return rows.filter(pc.and_(pc.greater_equal(days, start.strftime("%Y%m%d")), pc.less_equal(days, end.strftime("%Y%m%d"))))


class Requests(InputPartition):
    """Requests (symbol, start, end) of one task."""

    def __init__(self, asked: list[tuple[str, dt.date, dt.date]]) -> None:
        super().__init__(asked)


def connector_of(options: dict):
    """The connector that the options name, or the chain of them, spaced by headers if they have any."""
    held, found = Throttle(), []
    for name in options["connector"].split(","):
        module, _, function = name.strip().partition(":")
        own = getattr(importlib.import_module(module), function)
        found.append(throttled(own, held) if options.get("headers") == "true" else own)
    return found[0] if len(found) == 1 else first_available(*found)


def fetched(options: dict, schema, asked: list[tuple[str, dt.date, dt.date]]) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
    """The rows of requests, one after the other. A symbol's window without data has no rows."""
    found = responses(options, date_at(options, schema), asked)
    first = next(found, None)
    if first is None:
        return
    yield from in_batches(first, found, to_arrow_schema(schema)) if isinstance(first, pa.Table) else in_rows(first, found)


def responses(options: dict, day: int | None, asked: list[tuple[str, dt.date, dt.date]]) -> Iterator[list[tuple] | pa.Table]:
    connector = connector_of(options)
    for symbol, start, end in asked:
        try:
            rows = with_retry(lambda: whole(connector(options.get("endpoint", "daily"), symbol, start, end)), int(options.get("attempts", 3)), float(options.get("wait", 1.0)))  # noqa: B023
        except EmptyResponse:
            continue
        yield within_table(rows, day, start, end) if isinstance(rows, pa.Table) else list(within(rows, day, start, end))


def in_rows(first: list[tuple], rest: Iterator[list[tuple] | pa.Table]) -> Iterator[tuple]:
    """Responses as tuples; of a chain's endpoints, some may answer in tables."""
    yield from first
    for rows in rest:
        yield from zip(*(c.to_pylist() for c in rows.columns), strict=True) if isinstance(rows, pa.Table) else rows


def in_batches(first: pa.Table, rest: Iterator[list[tuple] | pa.Table], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Responses in the schema's names and types, small ones together; of a chain's endpoints, some may answer in tuples."""

    def conformed(rows: list[tuple] | pa.Table) -> pa.Table:
        columns = rows.columns if isinstance(rows, pa.Table) else [list(c) for c in zip(*rows, strict=True)] or [[] for _ in schema]
        if len(columns) != len(schema):
            raise ValueError(f"a response has {len(columns)} columns; wanted {schema.names}")
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held = [conformed(first)]
    for rows in rest:
        if sum(map(len, held)) >= BATCH_ROWS:
            yield from pa.concat_tables(held).combine_chunks().to_batches(BATCH_ROWS)
            held = []
        held.append(conformed(rows))
    yield from pa.concat_tables(held).combine_chunks().to_batches(BATCH_ROWS)


def date_at(options: dict, schema) -> int | None:
    names, column = [f.name for f in schema], options.get("day", "trade_date")
    return names.index(column) if column in names else None


def asked_for(options: dict, start: dt.date, end: dt.date) -> list[tuple[str, dt.date, dt.date]]:
    span = windows(start, end, int(options.get("window_years", WINDOW_YEARS)))
    return [(s, a, b) for s in options["symbols"].split(",") if s for a, b in span]


class OnWorkers:
    """What tasks are sent of a reader: all but the names, of which each task has its own in its partition."""

    options: dict

    def __getstate__(self) -> dict:
        return self.__dict__ | {"options": {k: v for k, v in self.options.items() if k != "symbols"}}


class SupplierReader(OnWorkers, DataSourceReader):
    def __init__(self, options: dict, schema=()) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        asked = asked_for(self.options, dt.date.fromisoformat(self.options["start"]), dt.date.fromisoformat(self.options["end"]))
        n = max(1, int(self.options.get("requests_per_task", max(REQUESTS_PER_TASK, -(-len(asked) // MANY_TASKS)))))
        return [Requests(asked[i : i + n]) for i in range(0, len(asked), n)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        yield from fetched(self.options, self.schema, partition.value if partition is not None else [])


class SupplierStream(OnWorkers, DataSourceStreamReader):
    """The offset is the last day read; a restart goes on from the checkpoint's."""

    def __init__(self, options: dict, schema=()) -> None:
        self.options, self.schema = options, schema

    def initialOffset(self) -> dict:
        return {"until": (dt.date.fromisoformat(self.options["start"]) - dt.timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"until": self.options["end"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        o = self.options
        first = dt.date.fromisoformat(o["start"])
        since = max(first, dt.date.fromisoformat(start["until"]) + dt.timedelta(days=1 - int(o.get("overlap", 0))))
        asked = asked_for(o, since, dt.date.fromisoformat(end["until"]))
        addresses = max(1, int(o.get("addresses", 1)))
        return [Requests(asked[i::addresses]) for i in range(min(addresses, len(asked)))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        yield from fetched(self.options, self.schema, partition.value)

    def commit(self, end: dict) -> None:
        pass


class SupplierSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "supplier"

    def schema(self) -> str:
        return self.options.get("columns", "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")

    def reader(self, schema) -> DataSourceReader:
        return SupplierReader(dict(self.options), schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SupplierStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SupplierSource)


def keep_windows(out: str, day: str = "trade_date"):
    """A sink for foreachBatch: version k of the table under out is version k - 1 with the batch's symbols replaced in its window. A batch
    that is run again writes the same version again; ``latest_version`` reads the last whole one."""

    def put(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        fresh = settled(batch)  # the source is asked once
        files, before = Files(spark, out), f"{out}/{k - 1}"
        carried = spark.read.schema(fresh.schema).parquet(before) if files.exists(f"{before}/_SUCCESS") else fresh.limit(0)
        lo, hi = fresh.agg(F.min(day), F.max(day)).first()
        kept = carried if lo is None else replace_window(carried, fresh, fresh.select("symbol"), lo, hi, day)
        kept.write.mode("overwrite").parquet(f"{out}/{k}")

    return put


def latest_version(spark: SparkSession, out: str, schema) -> DataFrame:
    """The last version that keep_windows has written whole."""
    files, k = Files(spark, out), 0
    if not files.exists(f"{out}/{k}/_SUCCESS"):
        return spark.createDataFrame([], schema)
    while files.exists(f"{out}/{k + 1}/_SUCCESS"):
        k += 1
    return spark.read.schema(schema).parquet(f"{out}/{k}")


def read_on(spark: SparkSession, options: dict, out: str, checkpoint: str) -> None:
    """Read what is new up to the options' end into out, from where the checkpoint stands, and stop."""
    register(spark)
    q = spark.readStream.format("supplier").options(**options).load().writeStream.foreachBatch(keep_windows(out, options.get("day", "trade_date"))).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
