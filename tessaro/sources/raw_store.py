"""Raw supplier snapshots, addressed by request and content, kept apart from cleaned tables; and small run artifacts."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.sources.catalog import Files, canonical_json, content_hash

#: Request parameters that never reach a manifest or a log.
SECRETS = re.compile(r"(?i)token|secret|password|api_?key|authorization")


def request_key(endpoint: str, symbols: list[str], start: str, end: str, params: dict | None = None) -> str:
    """The same request has the same key, whatever the order of its symbols and parameters."""
    request = {"endpoint": endpoint, "symbols": sorted(symbols), "start": start, "end": end, "params": redacted(params or {})}
    return hashlib.sha256(canonical_json(request).encode()).hexdigest()


def request_key_column(endpoint: Column, symbol: Column, start: Column, end: Column) -> Column:
    """Keys of one-symbol requests, computed in bulk."""
    return F.sha2(F.to_json(F.struct(endpoint.alias("endpoint"), symbol.alias("symbol"), start.cast("string").alias("start"), end.cast("string").alias("end"))), 256)


def redacted(params: dict) -> dict:
    return {k: "***" if SECRETS.search(k) else v for k, v in params.items()}


def save(spark: SparkSession, root: str, rows: DataFrame, source: str, endpoint: str, key: str, params: dict | None = None) -> dict:
    """Write a response once under its content's hash; returns its manifest."""
    digest = content_hash(rows)
    path = f"{root}/source={source}/endpoint={endpoint}/request={key}/{digest}"
    files = Files(spark, root)
    if not files.exists(f"{path}/manifest.json"):
        rows.write.mode("overwrite").parquet(f"{path}/data.parquet")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        manifest = {"source": source, "endpoint": endpoint, "request_key": key, "sha256": digest, "columns": kinds, "rows": spark.read.parquet(f"{path}/data.parquet").count(), "params": redacted(params or {})}
        files.write(f"{path}/manifest.json", canonical_json(manifest))
    return json.loads(files.read(f"{path}/manifest.json")) | {"path": path}


def verify(spark: SparkSession, manifest: dict) -> list[str]:
    """What differs between a snapshot and its manifest: nothing if it is as it was written."""
    files, path = Files(spark, manifest["path"]), manifest["path"]
    if not files.exists(f"{path}/manifest.json"):
        return ["manifest_missing"]
    kept, faults = json.loads(files.read(f"{path}/manifest.json")), []
    faults += [f"{k}_differs" for k in ("source", "endpoint", "request_key", "sha256") if kept.get(k) != manifest.get(k)]
    rows = spark.read.parquet(f"{path}/data.parquet")
    if content_hash(rows) != kept["sha256"]:
        faults.append("content_differs")
    return faults


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots and rows by source and endpoint, from the manifests."""
    manifests = spark.read.option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").json(root)
    return manifests.groupBy("source", "endpoint").agg(F.count("*").alias("n_snapshots"), F.sum("rows").cast("long").alias("n_rows"))


def registry_index(spark: SparkSession, root: str, order: list[str]) -> DataFrame:
    """All run manifests below root as one sorted table."""
    return spark.read.option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").json(root).orderBy(*order)


def write_once(spark: SparkSession, path: str, value: object) -> str:
    """Canonical JSON that may be written again only with the same content; returns its hash."""
    files, text = Files(spark, path), canonical_json(value)
    if files.exists(path) and files.read(path) != text:
        raise FileExistsError(f"{path} holds other content")
    files.write(path, text)
    return hashlib.sha256(text.encode()).hexdigest()


def response_issues(rows: DataFrame, by: list[str], symbols: list[str], start: str, end: str, limit: int | None = None, day: str = "trade_date") -> DataFrame:
    """by, fault for responses (groups of rows) that were cut off at the supplier's row limit, hold other names or miss some,
    have no date, or leave the window. Counts are pre-aggregated; the names asked for bound what is collected of a group."""
    asked = F.array(*map(F.lit, symbols))
    own = F.array_contains(asked, F.col("symbol"))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(own, F.lit(False))).alias("other"),
        F.count_distinct(F.when(own, F.col("symbol"))).alias("own"),
        F.count_if(F.col(day).isNull()).alias("undated"),
        F.count_if(~F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("outside"),
    )
    checks = {"truncated": F.col("n") >= limit if limit is not None else F.lit(False), "other_symbols": F.col("other") > 0, "missing_symbols": F.col("own") < len(set(symbols)), "undated": F.col("undated") > 0, "outside_window": F.col("outside") > 0}
    return g.select(*by, F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))).alias("fault"))


def response_faults(rows: DataFrame, symbols: list[str], start: str, end: str, limit: int | None = None, day: str = "trade_date") -> list[str]:
    """The faults of one response; one without rows is empty."""
    if rows.isEmpty():
        return ["empty"]
    found = {r.fault for r in response_issues(rows.withColumn("_one", F.lit(1)), ["_one"], symbols, start, end, limit, day).collect()}
    return [k for k in ("truncated", "other_symbols", "missing_symbols", "undated", "outside_window") if k in found]
