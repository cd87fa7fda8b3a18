"""Best-fit packing of token pieces into sequences, by hierarchical residuals.

Each partition packs its own pieces by best fit (longest first, into the fullest bin that still takes it) and emits bins that
are nearly full. What is underfull goes up a tree: a round brings the bins of several partitions together and packs them as
items, and again emits what is nearly full, until one group of bounded size is left or a round no longer helps.

Defined results: a null or empty text has its end id alone, and packs like any other. A document above the capacity is cut
into pieces of the capacity, the last one shorter. Repeated rows are packed one by one; pieces of one length
are told apart by document and piece. An empty table gives no rows. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import batch, cut, map_texts
from tessaro.llm.word_ids import encoder, tokenizer_file

CAPACITY = 2048
#: Bins with less room than this are done.
SLACK = 4
#: Partitions whose underfull bins meet in a round, and bins that a task may hold at most in the rounds.
FAN_IN = 8
BINS_A_TASK = 1 << 17

ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
BIN_SCHEMA = "fill int, items array<struct<doc_id: long, piece: int, start: long, length: int, ids_crc32: long>>"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    definition = tokenizer_file(docs.sparkSession, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition.value).encode
        for (ids,), whole in batches:
            rows = []
            for doc, raw in zip(ids, encode(whole), strict=True):
                raw += end
                for k, i in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[i : i + 4 * capacity]
                    rows.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
            c = list(zip(*rows, strict=True))
            yield batch(**{f.name: pa.array(x, f.type) for f, x in zip(ITEM, c, strict=True)})

    return map_texts(docs, ["doc_id"], run, "doc_id long, piece int, start long, length int, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: items from the longest down, each into the bin with the least room that takes it."""
    open_: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # rooms: bit r is set if a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            own = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, []
            bins.append(own)
        own.append(i)
        if room > n:
            open_[room - n].append(own)
            rooms |= 1 << (room - n)
    return bins


def pack_round(batches: Iterator[pa.RecordBatch], capacity: int, merge: bool) -> Iterator[pa.RecordBatch]:
    """Pack what a task holds. merge: the rows are bins (fill, items), else pieces."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    if merge:
        fill = rows["fill"].to_numpy().astype(np.int64)
        lists = rows["items"].combine_chunks()
        values, edges = lists.values, lists.offsets.to_numpy().astype(np.int64)
    else:
        fill = rows["length"].to_numpy().astype(np.int64)
        values = pa.StructArray.from_arrays([rows[f.name].combine_chunks() for f in ITEM], fields=list(ITEM))
        edges = np.arange(len(fill) + 1)
    bins = best_fit(fill, capacity)
    for i in range(0, len(bins), 4096):
        some = bins[i : i + 4096]
        total = np.array([fill[b].sum() for b in some], np.int32)
        order = np.concatenate([np.arange(edges[j], edges[j + 1]) for b in some for j in b])
        counts = [sum(int(edges[j + 1] - edges[j]) for j in b) for b in some]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield batch(fill=pa.array(total), items=pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(order))))


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, bins_a_task: int = BINS_A_TASK) -> DataFrame:
    """pieces (as from token_pieces) -> the same rows with sequence_id and offset."""
    bins = cut(pieces.mapInArrow(lambda b: pack_round(b, capacity, False), BIN_SCHEMA))
    done, left = [], bins
    groups, before = max(1, bins.rdd.getNumPartitions()), None
    while True:
        under = left.filter(F.col("fill") <= capacity - slack)
        n = under.count()
        if n == 0 or (before is not None and groups == 1) or (before is not None and n > 0.95 * before and groups * bins_a_task <= n):
            break
        done.append(left.filter(F.col("fill") > capacity - slack))
        groups, before = max(1, -(-n // bins_a_task), -(-groups // fan_in)), n
        left = cut(under.coalesce(groups).mapInArrow(lambda b: pack_round(b, capacity, True), BIN_SCHEMA))
    out = left
    for d in done:
        out = out.unionAll(d)
    out = out.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    return out.mapInArrow(lay_out, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins -> a row for each piece, with its place in the bin."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(1)
        values = lists.flatten()
        counts = np.diff(lists.offsets.to_numpy())
        length = values.field("length").to_numpy().astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)[:-1]])
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        yield batch(
            **{f.name: pa.array(length) if f.name == "length" else values.field(f.name) for f in ITEM},
            sequence_id=pa.array(np.repeat(b.column(0).to_numpy(), counts)),
            offset=pa.array(before - np.repeat(before[first], counts)),
        )
