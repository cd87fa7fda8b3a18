"""Token-id store: raw id payloads in shards, found through minimal perfect hashes of the document keys.

Documents are range-partitioned by doc_id; each task encodes its range and writes one shard, a file of nothing but ids
(unsigned little-endian, 16 bits where the vocabulary allows, else 32), in ascending doc_id order. Keys are spread over index
parts of bounded size; a part is a minimal perfect hash (levels of bit sets; a key's slot is the rank of its bit) with, slot
by slot, a fingerprint of the key, the shard, the offset and the number of ids. A lookup costs a few bit tests and one read.

Files go through the file system named by the folder's URI. A task writes under a name of its own and renames; where an earlier
attempt has left the file, it stays if it is as long, else it is replaced, so that a repeated or speculative task leaves the same
file on any store. Shards hold about SHARD_BYTES of text, so that their number follows the size of the corpus. A shard's ids and
its entries leave the task as they are encoded. Only id totals of shards reach the driver.

Defined results: a null or empty text has its end id alone. Rows that repeat a doc_id are kept, as occurrences 0, 1, ... in
order of their texts; a null doc_id comes first and is a key of its own. An unknown key isn't found (its fingerprint differs,
but for one in 2**32 of them). An empty table gives a store without shards, and no rows. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.llm.common import batch, cut, small_batches, texts
from tessaro.llm.word_ids import encoder, tokenizer_file

KEYS_A_PART = 1 << 16
#: Bytes of text of a shard, about; there are no fewer shards than shuffle partitions.
SHARD_BYTES = 256 << 20
GAMMA = 2.0
LEVELS = 40
NULL_KEY = np.uint64(0x6A09E667F3BCC908)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit values for each seed."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(doc_id: pa.Array, occurrence: np.ndarray) -> np.ndarray:
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ids = np.where(doc_id.is_null().to_numpy(zero_copy_only=False), NULL_KEY, ids)
    return np.where(occurrence > 0, mix(ids ^ mix(occurrence.astype(np.uint64), 77), 78), ids)


class MinimalHash:
    """Distinct 64-bit keys -> 0 .. n-1."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray) -> None:
        self.bits, self.rest = bits, rest
        self.rank = [np.concatenate([[0], np.cumsum(b)]) for b in bits]
        self.base = np.concatenate([[0], np.cumsum([b.sum() for b in bits])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        bits: list[np.ndarray] = []
        while len(keys) and len(bits) < LEVELS:
            m = max(64, int(GAMMA * len(keys)))
            at = mix(keys, len(bits) + 1) % np.uint64(m)
            level = np.bincount(at.astype(np.int64), minlength=m) == 1
            bits.append(level)
            keys = keys[~level[at.astype(np.int64)]]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two keys are the same")
        return cls(bits, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key can't be one of those built from."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, level in enumerate(self.bits):
            at = (mix(keys[left], i + 1) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[left[hit]] = self.base[i] + self.rank[i][at[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.base[-1] + at[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1234567) >> np.uint64(32)).astype(np.uint32)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A file that is there, whole, only once the block has ended well."""
    fs, path = opened(uri)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.part"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(own) as f:
        yield f
    settle(fs, own, path)


def settle(fs: pafs.FileSystem, own: str, path: str) -> None:
    """Give a file its name. Stores differ in what a rename onto an existing file does: an equal one stays, another goes."""
    there, mine = fs.get_file_info([path, own])
    if there.type == pafs.FileType.File and there.size == mine.size:
        fs.delete_file(own)
        return
    if there.type == pafs.FileType.File:
        fs.delete_file(path)
    try:
        fs.move(own, path)
    except OSError:  # another attempt was faster
        there, mine = fs.get_file_info([path, own])
        if there.type != pafs.FileType.File or mine.type == pafs.FileType.File and there.size != mine.size:
            raise
        if mine.type == pafs.FileType.File:
            fs.delete_file(own)


def write_file(uri: str, data: bytes) -> None:
    with new_file(uri) as f:
        f.write(data)


def read_file(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def write_index(uri: str, keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> None:
    hashed = MinimalHash.build(keys)
    slots = hashed.slots(keys)
    order = np.empty(len(keys), np.int64)
    order[slots] = np.arange(len(keys))
    held = io.BytesIO()
    np.savez(
        held,
        sizes=np.array([len(b) for b in hashed.bits], np.int64),
        bits=np.packbits(np.concatenate([*hashed.bits, np.zeros(0, bool)])),
        rest=hashed.rest,
        fingerprint=fingerprints(keys)[order],
        shard=shard[order].astype(np.uint32),
        offset=offset[order].astype(np.uint64),
        count=count[order].astype(np.uint32),
    )
    write_file(uri, held.getvalue())


class IndexPart:
    def __init__(self, uri: str) -> None:
        self.f = f = dict(np.load(io.BytesIO(read_file(uri))))
        flat = np.unpackbits(f["bits"])[: f["sizes"].sum()].astype(bool)
        self.hashed = MinimalHash(np.split(flat, np.cumsum(f["sizes"])[:-1]) if len(f["sizes"]) else [], f["rest"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and which keys are there."""
        slots = self.hashed.slots(keys)
        there = slots >= 0
        there[there] = self.f["fingerprint"][slots[there]] == fingerprints(keys[there])
        return np.where(there, slots, 0), there


class TokenStore:
    """An open store: its manifest, and lookups as DataFrames."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = json.loads(read_file(f"{path}/manifest.json"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys: doc_id, occurrence -> doc_id, occurrence, shard, offset, n_tokens of those found."""
        path, parts = self.path, self.manifest["parts"]

        def run(group: pa.Table) -> pa.Table:
            part = IndexPart(f"{path}/index/{group['part'][0].as_py():06d}.mph")
            doc_id, occurrence = group["doc_id"].combine_chunks(), group["occurrence"].to_numpy()
            slots, there = part.find(keys_of(doc_id, occurrence))
            slots, keep = slots[there], pa.array(there)
            return pa.table(
                {
                    "doc_id": doc_id.filter(keep),
                    "occurrence": pa.array(occurrence[there], pa.int32()),
                    "shard": pa.array(part.f["shard"][slots].astype(np.int32)),
                    "offset": pa.array(part.f["offset"][slots].astype(np.int64)),
                    "n_tokens": pa.array(part.f["count"][slots].astype(np.int64)),
                }
            )

        spread = keys.select("doc_id", F.col("occurrence").cast("int").alias("occurrence"), part_of(parts))
        return spread.groupBy("part").applyInArrow(run, "doc_id long, occurrence int, shard int, offset long, n_tokens long")

    def read(self, found: DataFrame, ids: bool = False) -> DataFrame:
        """What lookup gives -> doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for; each shard is read once, forwards."""
        path, width, starts = self.path, self.manifest["width"], {int(k): v for k, v in self.manifest["starts"].items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, f = -1, None
            for b in batches:
                doc_id, _, shard, offset, count = b.columns[:5]
                crc, raw = [], []
                for s, o, n in zip(shard.to_pylist(), offset.to_pylist(), count.to_pylist(), strict=True):
                    if s != now:
                        fs, file = opened(f"{path}/ids/{s:06d}.ids")
                        f, now = fs.open_input_file(file), s
                    f.seek(o * width)
                    values = np.frombuffer(f.read(n * width), f"<u{width}").astype("<u4")
                    crc.append(zlib.crc32(values.tobytes()))
                    if ids:
                        raw.append(values.astype(np.int32))
                first = np.array([starts[s] for s in shard.to_pylist()], np.int64) + offset.to_numpy()
                more = {"ids": pa.array(raw, pa.list_(pa.int32()))} if ids else {}
                yield batch(doc_id=doc_id, start=pa.array(first), n_tokens=count, ids_crc32=pa.array(crc, pa.int64()), **more)

        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
        n = max(1, min(len(starts), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return found.repartition(n, "shard").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def part_of(parts: int):
    return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(parts)).cast("int").alias("part")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shards: int | None = None, keys_a_part: int = KEYS_A_PART, shard_bytes: int = SHARD_BYTES) -> TokenStore:
    """Encode docs (doc_id, text), write shards, index and manifest under path (a URI that all executors reach)."""
    spark = docs.sparkSession
    small_batches(spark)
    definition = tokenizer_file(spark, tokenizer_path)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition.value).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    end = int(end_id).to_bytes(4, "little")
    if not shards:
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(definition.value).encode
        offset, last, occurrence = 0, (), 0
        with new_file(f"{path}/ids/{shard:06d}.ids") as f:
            for b in batches:
                ids, counts, places, nth = b.column(0).to_pylist(), [], [], []
                for doc, raw in zip(ids, encode(texts(b.column(1))), strict=True):
                    raw += end
                    occurrence = occurrence + 1 if (doc,) == last else 0
                    last = (doc,)
                    nth.append(occurrence)
                    places.append(offset)
                    counts.append(len(raw) // 4)
                    offset += len(raw) // 4
                    f.write(raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
                yield batch(doc_id=b.column(0), occurrence=pa.array(nth, pa.int32()), shard=pa.array([shard] * len(ids), pa.int32()), offset=pa.array(places, pa.int64()), n_tokens=pa.array(counts, pa.int64()))

    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    entries = cut(ordered.mapInArrow(run, "doc_id long, occurrence int, shard int, offset long, n_tokens long"))
    totals = {r["shard"]: (r["n"], r["docs"]) for r in entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    starts, total = {}, 0
    for s in sorted(totals):
        starts[s] = total
        total += totals[s][0]
    n_docs = sum(n for _, n in totals.values())
    parts = max(1, -(-n_docs // keys_a_part))

    def index(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        doc_id, occurrence = group["doc_id"].combine_chunks(), group["occurrence"].to_numpy()
        write_index(f"{path}/index/{part:06d}.mph", keys_of(doc_id, occurrence), *(group[c].to_numpy() for c in ("shard", "offset", "n_tokens")))
        return pa.table({"part": pa.array([part], pa.int32()), "n_keys": pa.array([len(doc_id)], pa.int64())})

    written = entries.withColumn("part", part_of(parts)).groupBy("part").applyInArrow(index, "part int, n_keys long")
    indexed = written.agg(F.sum("n_keys")).first()[0] or 0
    if indexed != n_docs:
        raise RuntimeError(f"{indexed} of {n_docs} documents were indexed")
    manifest = {"width": width, "parts": parts, "n_docs": n_docs, "n_ids": total, "end_id": end_id, "starts": starts}
    write_file(f"{path}/manifest.json", json.dumps(manifest).encode())
    store = TokenStore(spark, path)
    store.entries = entries
    return store
