"""Helpers shared by the corpus operators: shared folders, cut lineage, word bytes, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of plain words.
SPACE = b" \t\n\x0b\x0c\r"
#: Lower case of A-Z; what else in ASCII is no letter or digit separates.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bits of a likely_set, which bound what is broadcast: 2 ** 22 bits are 65,536 rows of two longs.
SET_BITS = 22
#: Bytes of an Arrow batch from which it takes no further row.
BATCH_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of this machine in local mode (as
    in tests); on a cluster that is an error, as executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not have.isDefined() and master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder, so that later plans start from files that survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """As cut, but as compressed columns in a table of the shared folder, which goes when the session ends."""
    spark = df.sparkSession
    path = new_path(spark, "stored")
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small: at most so many rows, and none after BATCH_BYTES. These are settings of the
    session, read when a plan is run, and stay as they are set here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def likely_set(values: DataFrame, columns: list[str], bits: int = SET_BITS) -> DataFrame:
    """A bit for each hash of the columns' values, in words of 64: at most 2 ** (bits - 6) rows, however many values there are."""
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << bits)).alias("__at")
    word = values.select(at).select(F.shiftright("__at", 6).alias("__word"), F.expr("shiftleft(1L, cast(__at % 64 AS int))").alias("__bit"))
    return cut(word.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))


def likely_in(rows: DataFrame, columns: list[str], likely: DataFrame, bits: int = SET_BITS, no: bool = False) -> DataFrame:
    """The rows whose columns may be among the values of likely (no: those that can't be): none that is among them is lost. The
    set is broadcast; its size is bounded by bits. It spares a join the shuffle of rows that have no partner."""
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    joined = rows.withColumn("__at", at).join(F.broadcast(likely), F.shiftright("__at", 6) == F.col("__word"), "left")
    hit = F.coalesce(F.expr("shiftright(__bits, cast(__at % 64 AS int)) & 1 = 1"), F.lit(False))
    return joined.filter(~hit if no else hit).drop("__at", "__word", "__bits")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Each wanted name, with as many underscores before it as tell it apart from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(
    docs: DataFrame,
    keys: list[str],
    rows: Callable[[Iterator[tuple[list, list[bytes]]]], Iterator[pa.RecordBatch]],
    schema: str,
    text: str = "text",
) -> DataFrame:
    """Run rows over Arrow batches of (one list for each key column, whole texts as bytes); no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(([b.column(i).to_pylist() for i in range(len(keys))], texts(b.column(len(keys)))) for b in batches if b.num_rows)

    return docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`")).mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))
