"""SimHash near-dedup with BK-trees over shards of fingerprints.

Fingerprints of word shingles are grouped first, so copies cost one row each and one tree entry together. Two fingerprints
at 3 or fewer differing bits agree on at least two of five blocks of bits: each pair of blocks keys a table, and a shard is
one key of one table. A shard's BK-tree keys children by their integer Hamming distance to the parent; a search follows only
edges within the radius of the distance to the node. Trees meet the fingerprints in the task that a shuffle brings both to:
a broadcast of all trees would grow with the corpus. Shards give a spanning forest, never all pairs of a group.

A shard of more than SHARD fingerprints is split by the same rule on the bits it doesn't share: those are cut into five blocks
again, of which two must agree. As fingerprints are distinct, a shard that shares all but n bits has 2 ** n members at most, so
splitting ends and no task holds more than a bounded number, however like each other the texts are.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; a text of one or two words is
one shingle. Repeated rows give one row each. An empty table gives none. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import batch, cut, map_texts
from tessaro.llm.components import components, forest

#: Widths of the blocks; with more blocks than RADIUS, at least len(BLOCKS) - RADIUS agree.
BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a shard from which it is split; it exceeds 2 ** FREE of the last split.
SHARD = 1 << 16
#: Shards that have no more bits than this to differ in aren't split.
FREE = 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, more: dict[str, str] | None = None) -> DataFrame:
    """doc_id, fp long (the 64 bits, signed), and more columns of docs by name and type."""
    more = more or {}

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for (ids, *rest), whole in batches:
            fps = np.array([fingerprint(t, size) for t in whole], np.uint64)
            yield batch(doc_id=pa.array(ids, pa.int64()), fp=pa.array(fps.view(np.int64)), **dict(zip(more, rest, strict=True)))

    return map_texts(docs, ["doc_id", *more], run, ", ".join(["doc_id long, fp long", *(f"{k} {t}" for k, t in more.items())]))


class Trees:
    """A BK-tree for each shard, built level by level over all shards of a block of rows.

    Node arrays are aligned with the rows: child (parent row, distance) pairs are kept sorted for lookup.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray) -> None:
        n = len(value)
        self.value = value
        _, first, of = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[of]
        at, rest = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        parents, edges, children = [], [], []
        while len(rest):
            edge = np.bitwise_count(value[rest] ^ value[at[rest]]).astype(np.int64)
            slot = at[rest] * 65 + edge
            _, lead, to = np.unique(slot, return_index=True, return_inverse=True)
            node = rest[lead]
            parents.append(at[node].copy())
            edges.append(edge[lead])
            children.append(node)
            at[rest] = node[to]
            rest = rest[at[rest] != rest]
        empty = np.zeros(0, np.int64)
        slot = np.concatenate([empty, *(p * 65 + e for p, e in zip(parents, edges, strict=True))])
        order = np.argsort(slot, kind="stable")
        self.slot, self.child = slot[order], np.concatenate([empty, *children])[order]

    def within(self, query: np.ndarray, radius: int, rows: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, found row) at radius or less, found row smaller; the frontier is worked off in pieces of bounded size."""
        stack = [(query, self.root[query])]
        while stack:
            q, node = stack.pop()
            if len(q) > rows:
                stack += [(q[i : i + rows], node[i : i + rows]) for i in range(0, len(q), rows)]
                continue
            d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (node < q)
            if hit.any():
                yield q[hit], node[hit]
            # edges d - radius to d + radius of each node
            low = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            if total := int(n.sum()):
                again = np.repeat(np.arange(len(q)), n)
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                stack.append((q[again], self.child[low[again] + step]))


def shard_links(shard: np.ndarray, value: np.ndarray, name: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within shards, as pairs of names."""
    trees = Trees(shard, value)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q, f in trees.within(np.arange(len(value)), radius):
        a, b = np.concatenate([a, name[q]]), np.concatenate([b, name[f]])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
    return forest(a, b) if len(a) else (a, b)


def choices(bits: list[int], widths: tuple[int, ...]) -> list[int]:
    """Bits cut into blocks -> a mask for each choice of the blocks that must agree."""
    at, masks = 0, []
    for width in widths:
        masks.append(sum(1 << b for b in bits[at : at + width]))
        at += width
    return [sum(c) for c in combinations(masks, len(widths) - RADIUS)]


def tables() -> list[int]:
    return choices(list(range(64)), BLOCKS)


def finer(mask: int) -> list[int]:
    """The masks that split a shard whose members agree on the bits of mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = len(BLOCKS)
    return [mask | m for m in choices(free, tuple(len(free) // n + (i < len(free) % n) for i in range(n)))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sharded(distinct: DataFrame, limit: int) -> DataFrame:
    """distinct: fp, rep -> shard, fp, rep, of bounded shards: links at RADIUS or less share at least one."""
    masks = tables()
    rows = distinct.select("fp", "rep", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    fit = []
    while True:
        rows = rows.withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        if all(64 - m.bit_count() <= FREE for m in masks):
            hot = None
        else:
            hot = cut(rows.groupBy("shard", "mask").count().filter(F.col("count") > limit).select("shard", "mask"))
        if hot is None or hot.isEmpty():
            fit.append(rows.select("shard", "fp", "rep"))
            return reduce(DataFrame.unionAll, fit)
        fit.append(rows.join(hot, ["shard", "mask"], "left_anti").select("shard", "fp", "rep"))
        masks = sorted({m & (1 << 64) - 1 for (m,) in hot.select("mask").distinct().collect()})
        next_ = {m: finer(m) if 64 - m.bit_count() > FREE else [m] for m in masks}
        split = F.create_map(*[x for m, found in next_.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in found]))])
        rows = cut(rows.join(hot, ["shard", "mask"], "left_semi").select("fp", "rep", F.explode(split[F.col("mask")]).alias("mask")))
        masks = [f for found in next_.values() for f in found]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, limit: int = SHARD) -> DataFrame:
    """distinct: fp, rep (one row each) -> links (a, b) of rep, a spanning forest of each shard."""
    rows = sharded(distinct, limit)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def links(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if not count:
                return
            shard, fp, rep = (np.concatenate(c) for c in zip(*held, strict=True))
            stop = len(shard) if last else int(np.searchsorted(shard, shard[-1], "left"))  # the last shard may go on
            if stop:
                a, b = shard_links(shard[:stop], fp[:stop].view(np.uint64), rep[:stop], radius)
                if len(a):
                    yield batch(a=a, b=b)
            held, count = ([(shard[stop:], fp[stop:], rep[stop:])], len(shard) - stop) if stop < len(shard) else ([], 0)

        for x in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in x.columns))
            count += x.num_rows
            if count >= 1 << 16:
                yield from links(False)
        yield from links(True)

    spread = rows.repartition(parts, "shard").sortWithinPartitions("shard", "rep")
    return spread.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint string, component_id, kept (doc_id = component_id): one row for each row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"))
    found = components(fingerprint_links(distinct))
    classes = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of like texts, the least by doc_id and digest of the text. Decisions are per row: a
    document in rows of different texts can stay in several groups. Rows without doc_id stay; of rows that repeat doc_id and text
    one stays. All columns stay, whatever their names; texts of any length are read whole, null and empty ones are like each other. An
    empty table gives no rows."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    prints = cut(fingerprints(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", digest.alias("digest")), more={"digest": "string"}))
    # groups are of fingerprints, under their own names: ids may stand in several
    found = components(fingerprint_links(cut(prints.select("fp", F.col("fp").alias("rep")).distinct())))
    named = prints.join(found, prints.fp == found.node, "left").withColumn("group", F.coalesce("component", "fp"))
    chosen = cut(named.groupBy("group").agg(F.min(F.struct("doc_id", "digest")).alias("least")).select(F.col("least.doc_id").alias("id"), F.col("least.digest").alias("digest")))
    # a document is one column, so that none of its names meets those of this function
    own = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("own_id"), digest.alias("own"), F.struct("*").alias("row"))
    kept = own.join(chosen, (F.col("own_id") == F.col("id")) & (F.col("own") == F.col("digest")), "left_semi")
    if not prints.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["own_id", "own"])
    return kept.select("row.*").unionByName(docs.filter("doc_id IS NULL"))
