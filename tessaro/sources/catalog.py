"""Versioned tables: immutable directories named by the hash of their content, and a CURRENT pointer to the published one.

Files are named by a hash of rows, not of part files, whose bytes and cuts aren't stable. All files are handled through
Spark's file systems, so a catalog may lie in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.operators.quality import blocking
from tessaro.schemas import ORDERS, TABLES, conform, row_digest, schema


class WritesRefused(ValueError):
    """A command that isn't a query was given to a read-only version."""


class PublicationBlocked(Exception):
    """The quality gate refused a publication; CURRENT is as it was."""


class Files:
    """A few file operations on any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def rename(self, old: str, new: str) -> bool:
        self.fs.mkdirs(self.path(new).getParent())
        return self.fs.rename(self.path(old), self.path(new))

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        """Replace a small file at once: readers see the old text or the new one, also if this stops half-way."""
        new = f"{path}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(new), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.replace(new, path)

    def replace(self, new: str, path: str) -> None:
        """One rename that overwrites its target."""
        old, at = self.fs.makeQualified(self.path(new)), self.fs.makeQualified(self.path(path))
        how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(old, at, how)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def content_hash(rows: DataFrame) -> str:
    """A hash of the rows as a bag, whatever their order and partitioning: count and sums of parts of each row's digest."""
    parts = rows.select(row_digest(rows.columns).alias("h"))
    # a part of 60 bits is summed as three longs of 20: sums of wide decimals cost more than the digest
    part = lambda k: F.conv(F.substring("h", k, 15), 16, 10).cast("long")
    n, *sums = parts.agg(F.count("*"), *[F.sum(F.shiftright(part(k), by).bitwiseAND((1 << 20) - 1)) for k in (1, 16, 31, 46) for by in (40, 20, 0)]).first()
    found = [n, *((sums[i] << 40) + (sums[i + 1] << 20) + sums[i + 2] if n else None for i in range(0, len(sums), 3))]
    return hashlib.sha256(json.dumps([str(x) for x in found]).encode()).hexdigest()


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def total_order(table: str) -> list[str]:
    """The table's order, ties broken by its other columns, so that the same rows have one order."""
    first = ORDERS[table]
    return [*first, *(c for c in schema(table).names if c not in first)]


def in_order(rows: DataFrame, table: str) -> DataFrame:
    """rows in ranges of the table's order, sorted within: files follow each other in order, and their row groups hold narrow ranges of
    the leading columns, which scans skip by. A symbol with very many rows lies in several ranges."""
    order = total_order(table)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def out_of_order(spark: SparkSession, path: str, table: str) -> DataFrame:
    """n_rows, n_out_of_order: rows of a written table that stand before the row in front of them, by file name and place in the
    file. Neighbours are compared within files, and files by their ends: no task holds more than a file."""
    order = total_order(table)
    at = spark.read.schema(schema(table)).parquet(path).select(F.struct(*order).alias("at"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    within = Window.partitionBy("file").orderBy("place")
    files = at.withColumn("before", F.lag("at").over(within)).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("at") < F.col("before")).alias("bad"), F.min_by("at", "place").alias("first"), F.max_by("at", "place").alias("last"))
    between = F.lag("last").over(Window.orderBy("file"))  # a row for each file
    ends = files.withColumn("before", between)
    return ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("bad") + F.coalesce(F.col("first") < F.col("before"), F.lit(False)).cast("int")), F.lit(0)).alias("n_out_of_order"))


def refuse_writes(spark: SparkSession, sql: str) -> None:
    """Only queries pass: the parsed plan may hold no command and no statement that writes."""
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        plan = todo.pop()
        if any(k.isInstance(plan) for k in kinds):
            raise WritesRefused(f"a version is read-only: {plan.nodeName()}")
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], issues: DataFrame | None = None, config: dict | None = None) -> str:
    """Gate, stage, hash, rename, then move CURRENT; returns the version. The same content gives the same version again."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if issues is not None and (codes := [r.code for r in blocking(issues).collect()]):  # at most one row for each blocking code
        raise PublicationBlocked(", ".join(sorted(codes)))
    files, staging = Files(spark, root), f"{root}/.staging/{uuid.uuid4().hex}"
    hashes = {}
    try:
        for name, rows in sorted(tables.items()):
            in_order(conform(rows, name), name).write.parquet(f"{staging}/{name}.parquet")
            hashes[name] = content_hash(spark.read.schema(schema(name)).parquet(f"{staging}/{name}.parquet"))
        schemas = {name: hashlib.sha256(TABLES[name].encode()).hexdigest() for name in hashes}
        manifest = {"tables": hashes, "schemas": schemas, "config": config or {}}
        version = hashlib.sha256(canonical_json(manifest).encode()).hexdigest()
        if not files.exists(f"{root}/versions/{version}"):
            files.write(f"{staging}/manifest.json", canonical_json(manifest))
            files.rename(staging, f"{root}/versions/{version}")
        files.write(f"{root}/CURRENT", version)
        return version
    finally:
        if files.exists(staging):
            files.remove(staging)


class Dataset:
    """One version, read-only: ``read`` a table or ``query`` all of them by name."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None) -> None:
        files = Files(spark, root)
        self.spark, self.version = spark, version or files.read(f"{root}/CURRENT").strip()
        self.path = f"{root}/versions/{self.version}"
        if not files.exists(f"{self.path}/manifest.json"):
            raise ValueError(f"there is no version {self.version}")
        self.manifest = json.loads(files.read(f"{self.path}/manifest.json"))

    def read(self, table: str) -> DataFrame:
        if table not in self.manifest["tables"]:
            raise ValueError(f"version {self.version} has no table {table!r}")
        return self.spark.read.schema(schema(table)).parquet(f"{self.path}/{table}.parquet")

    def query(self, sql: str, **args) -> DataFrame:
        """SQL over the version's tables in braces, e.g. ``SELECT * FROM {daily_bar} WHERE symbol = :s``; values by name."""
        tables = {t: self.read(t) for t in self.manifest["tables"] if "{" + t + "}" in sql}
        return self.spark.sql(sql, args=args or None, **tables)

    def attach(self, database: str | None = None) -> str:
        """The version's tables as views of a database of the session's catalogue, version_ and the first 16 digits of its hash unless
        named; the name. Views of several versions stand beside each other. Views that don't fit are made anew."""
        name = database or f"version_{self.version[:16]}"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
        for table in self.manifest["tables"]:
            self.spark.sql(f"CREATE OR REPLACE VIEW `{name}`.`{table}` AS SELECT * FROM parquet.`{self.path}/{table}.parquet`")
        return name

    def sql(self, text: str, **args) -> DataFrame:
        """Plain SQL in which the names of the version's tables are its tables; other versions by their database. Commands that
        write are refused before they run. The caller's session keeps its current database and its own views."""
        refuse_writes(self.spark, text)
        session = self.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            session.conf.set(key, self.spark.conf.get(key))
        session.catalog.setCurrentDatabase(self.attach())
        return session.sql(text, args=args or None)

    def verify(self) -> list[str]:
        """Tables whose rows no longer have the hash of the manifest."""
        return [t for t, h in self.manifest["tables"].items() if content_hash(self.read(t)) != h]


def bootstrap(spark: SparkSession, root: str, days: DataFrame, master: DataFrame) -> str:
    """A first version: calendar (calendar_date, is_trading_day), master, and all other tables empty."""
    tables = {t: spark.createDataFrame([], schema(t)) for t in TABLES}
    return publish(spark, root, tables | {"trading_calendar": days, "security_master": master}, config={"bootstrap": True})
