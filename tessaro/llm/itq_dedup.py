"""Embedding near-dedup by iterative quantisation, multi-index Hamming tables and a rerank with the original vectors.

Rotations that turn centred vectors into balanced binary codes are learnt on a bounded sample (SAMPLE vectors, least by a
hash of their id) by alternating signs and orthogonal Procrustes. Every vector is encoded. The code is cut into tables of a
few bits; vectors with the same bits in any table are candidates. Bits for a table grow with the logarithm of the number of
vectors, which holds the size of a bucket. The number of tables comes from pairs at the threshold that are built from the
sample and coded like any vector (centring widens their angles where vectors have a common direction): tables are added until
the wanted share of them meets in one. Widths for which MOST_TABLES do are weighed: the comparisons that each would take, from how often
vectors of the sample meet, and the copies of each vector. Where none is cheaper, all vectors meet, which is
exact, and which few vectors (up to BRUTE) do anyway. Cosines in double precision decide; a pair counts in the first table that
it shares, so nothing need be gathered to know each pair once. Tasks emit sums and a spanning forest, never pairs.

A bucket above CHUNK vectors is cut into chunks, and pairs of chunks are dealt to tasks of bounded size. Equal vectors are
one entry with a count.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id, link
with nothing: n_links 0, and their own id as component. Vectors of different lengths don't link. Rows that repeat vec_id and
vector are one row; copies under other ids link. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaro.llm.common import batch, cut
from tessaro.llm.components import components, forest

THRESHOLD = 0.9
SAMPLE = 16_384
#: Vectors of the sample that rotations are learnt on, and rounds of it.
LEARNT = 4096
ITERATIONS = 15
CHUNK = 4096
#: Rows of a chunk that are compared with the other chunk at once.
ROWS = 512
#: Vectors of a bucket, on average, from which tables get more bits.
BUCKET = 200
LEAST_BITS, MOST_BITS = 8, 20
#: Bits above those for buckets of BUCKET that are weighed too.
WIDER = 3
#: A vector is copied once for each table.
MOST_TABLES = 64
#: Vectors up to which all are compared with all.
BRUTE = 8192
#: What a copy of a vector in another table costs, in comparisons.
COPY = 100
#: Vectors of the sample whose meetings are counted to weigh a plan.
WEIGHED = 2048
#: Probability that a pair at the threshold shares a table.
RECALL = 0.93


class Quantiser:
    """Mean, principal axes and rotations; codes are signs of rotated vectors. Tables take bits from one rotation after another."""

    def __init__(self, sample: np.ndarray, seed: int = 7) -> None:
        x = unit(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = axes[:, ::-1]
        self.learnt = x[:LEARNT] @ self.axes
        self.turns = np.zeros((len(self.mean), 0))
        self.rng = np.random.default_rng(seed)
        self.bits = self.tables = 0

    def grow(self, width: int) -> None:
        """Learn rotations until there are width bits."""
        v = self.learnt
        while self.turns.shape[1] < width:
            turn, _ = np.linalg.qr(self.rng.standard_normal((v.shape[1], v.shape[1])))
            for _ in range(ITERATIONS):
                u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
                turn = (u @ w).T
            # neighbouring bits come from far apart axes
            self.turns = np.concatenate([self.turns, turn[:, self.rng.permutation(turn.shape[1])]], axis=1)

    def code(self, vectors: np.ndarray, width: int) -> np.ndarray:
        return (unit(vectors) - self.mean) @ (self.axes @ self.turns[:, :width]) > 0

    def plan(self, bits: int, tables: int) -> None:
        self.bits, self.tables = bits, tables
        self.turns, self.learnt = self.turns[:, : bits * tables], None

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One integer for each vector and table."""
        if not self.bits:
            return np.zeros((len(vectors), self.tables), np.int64)
        return self.code(vectors, self.tables * self.bits).reshape(len(vectors), self.tables, self.bits) @ (1 << np.arange(self.bits))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plan_bits(n: int) -> int:
    """Bits of a table for n vectors."""
    return 0 if n <= BRUTE else min(MOST_BITS, max(LEAST_BITS, round(math.log2(n / BUCKET))))


def built_pairs(sample: np.ndarray, threshold: float, most: int = 4096, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold: each vector with one turned off at random, and with one turned towards another of the sample."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    x = x[rng.permutation(len(x))[:most]]
    out = []
    for turn in (rng.standard_normal(x.shape), np.roll(x, 1, axis=0)):
        turn = turn - (turn * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(turn, axis=1, keepdims=True)
        some = norm[:, 0] > 1e-6
        if some.any():
            out.append((x[some], threshold * x[some] + math.sqrt(max(0.0, 1 - threshold**2)) * turn[some] / norm[some]))
    return out


def meetings(codes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """By number of tables: the share of all pairs of the codes' rows that tables so far compare, pairs counted once a table."""
    n = len(codes)
    keys = codes.reshape(n, tables, bits) @ (1 << np.arange(bits))
    each = [float((c * (c - 1.0)).sum()) for c in (np.unique(keys[:, t], return_counts=True)[1] for t in range(tables))]
    return np.cumsum(each) / max(1, n * (n - 1))


def fitted(sample: np.ndarray, n: int, threshold: float, recall: float) -> Quantiser:
    """A quantiser for n vectors whose tables hold the wanted share of each kind of built pair, at the least cost."""
    # rotations suit the vectors that they are learnt on better than others: pairs are built from those left out
    apart = len(sample) // 4 if len(sample) >= 1024 else 0
    rest = sample[:apart] if apart else sample
    pairs, sample = built_pairs(rest, threshold), sample[apart:]
    quantiser, rest = Quantiser(sample), rest[:WEIGHED]
    best, plan = n + COPY * n / CHUNK, (0, 1)  # all with all
    width = plan_bits(n)
    for bits in range(width + WIDER if width else 0, 0, -1):
        if bits < LEAST_BITS and plan[0]:
            break  # narrower tables only where no others do
        tables = 4
        while tables <= MOST_TABLES and pairs and COPY * tables < best:
            quantiser.grow(bits * tables)
            width = bits * tables
            # by kind of pair and number of tables: the share of pairs that meet
            met = [np.logical_or.accumulate((quantiser.code(x, width) == quantiser.code(y, width)).reshape(len(x), tables, bits).all(axis=2), axis=1).mean(axis=0) for x, y in pairs]
            enough = np.flatnonzero(np.minimum.reduce(met) >= recall)
            if len(enough):
                used = int(enough[0]) + 1
                # no fewer meetings than chance gives, which a sample may not show
                share = max(float(meetings(quantiser.code(rest, width), tables, bits)[used - 1]), used / 2.0**bits)
                if (cost := n * share + COPY * used) < best:
                    best, plan = cost, (bits, used)
                break
            tables *= 2
    quantiser.plan(*plan)
    return quantiser


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def compare(group: pa.Table, threshold: float) -> tuple[np.ndarray, ...]:
    """The rows of one pair of chunks -> links of each row (weighted by copies) and linked pairs of names."""
    side = group["side"].to_numpy()
    name, size = group["rep"].to_numpy(), group["copies"].to_numpy()
    x, keys = unit(matrix(group["vec"].combine_chunks())), matrix(group["keys"].combine_chunks())
    table = group["t"][0].as_py()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if group["i"][0].as_py() != group["j"][0].as_py() else left
    links = np.zeros(len(name), np.int64)
    ends, starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(left), ROWS):
        own = left[i : i + ROWS]
        a, b = np.nonzero(x[own] @ x[right].T >= threshold)
        a, b = own[a], right[b]
        new = a != b if right is not left else a < b
        a, b = a[new], b[new]
        for t in range(table):  # the first shared table counts a pair
            apart = keys[a, t] != keys[b, t]
            a, b = a[apart], b[apart]
        if len(a):
            links += (np.bincount(a, size[b], len(name)) + np.bincount(b, size[a], len(name))).astype(np.int64)
            ends, starts = forest(np.concatenate([ends, a]), np.concatenate([starts, b]))
    return name, links, name[ends], name[starts]


def compare_all(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (t, key, i, j): sums (a, links, null) and links (a, null, b)."""
    held: pa.Table | None = None

    def out(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        ids = np.stack([rows[c].to_numpy() for c in ("t", "key", "i", "j")])
        edge = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
        for lo, hi in zip(edge[:-1] if last else edge[:-2], edge[1:] if last else edge[1:-1], strict=True):
            if hi - lo > 1:
                name, links, a, b = compare(rows.slice(lo, hi - lo), threshold)
                if len(a):
                    some = links > 0
                    yield batch(a=name[some], links=links[some], b=pa.nulls(int(some.sum()), pa.int64()))
                    yield batch(a=a, links=pa.nulls(len(a), pa.int64()), b=b)
        held = None if last else rows.slice(edge[-2])

    for x in batches:
        if x.num_rows:
            now = pa.Table.from_batches([x])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows >= 2 * CHUNK:
                yield from out(held, False)
    if held is not None:
        yield from out(held, True)


def one_length(reps: DataFrame, length: int, threshold: float, recall: float, chunk: int) -> DataFrame:
    """reps: rep, copies, vec, all of one length -> sums and links."""
    spark = reps.sparkSession
    own = reps.filter(F.size("vec") == length)
    n = own.count()
    # a driver-side fit on a bounded sample
    sample = matrix(own.orderBy("h", "g").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks())
    chosen = fitted(sample, n, threshold, recall)
    kind = dict(own.dtypes)["vec"]
    tables = chosen.tables
    quantiser = spark.sparkContext.broadcast(chosen)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = quantiser.value.keys(matrix(b.column(2))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield batch(rep=b.column(0), copies=b.column(1), vec=b.column(2), keys=lists)

    coded = cut(own.select("rep", "copies", "vec").mapInArrow(encode, f"rep long, copies long, vec {kind}, keys array<int>"))
    hot = coded.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count().filter(F.col("count") > chunk)
    hot = hot.select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    rows = coded.select("rep", "copies", "vec", "keys", F.posexplode("keys").alias("t", "key")).join(hot, ["t", "key"], "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # chunk c meets each chunk, itself included, once; side tells which of the two it is
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side"), "rep", "copies", "vec", "keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["t", "key", "i", "j"]
    spread = rows.repartition(parts, *order).sortWithinPartitions(*order)
    return spread.mapInArrow(lambda b: compare_all(b, threshold), "a long, links long, b long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    doubles = vectors.schema[vec_col].dataType == T.ArrayType(T.DoubleType())
    vectors = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>" if doubles else "array<float>").alias("vec"))
    good = F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    vectors = vectors.withColumn("good", F.coalesce(good, F.lit(False)))
    named = vectors.withColumns({"h": F.when(F.col("good"), F.xxhash64("vec")), "g": F.when(F.col("good"), F.hash("vec"))})
    rows = cut(named.select("vec_id", "h", "g").distinct())
    classes = named.filter("good").select("vec_id", "h", "g", "vec").dropDuplicates(["vec_id", "h", "g"]).groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    # a class is named apart from its ids, as an id may stand with several vectors
    reps = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    lengths = [r[0] for r in reps.select(F.size("vec")).distinct().collect()]
    found = None
    for length in sorted(lengths):
        own = one_length(reps, length, threshold, recall, chunk)
        found = own if found is None else found.unionAll(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    sums = found.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("others"))
    groups = components(found.filter("b IS NOT NULL").select("a", "b"))
    joined = cut(
        reps.select("h", "g", "rep", "copies", "least")
        .join(sums, F.col("rep") == F.col("a"), "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("h", "g", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(named, "component").select("h", "g", "n_links", "component_id")
    return rows.join(known, ["h", "g"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
