"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (pieces, scores, types, trainer and normaliser specs), and from it a tokenizers model is
built: unigram from scores, or BPE with merges in order of the scores of what they make; byte fallback for characters
without a piece. The normaliser (dummy prefix, white space as the metaspace mark) is rebuilt around it.

The vocabulary files at hand are BPE, so the unigram branch serves other models. No piece of a usable BPE model holds the
metaspace mark after another character, so a text falls apart before each run of marks, and each worker encodes every
distinct part once, in joined strings and batches over several threads. Parts with several marks in a row, where scores tie,
and parts on which the parity check against the sentencepiece library fails, go through the agenda of the original algorithm:
best score first, leftmost of equals. Every distinct part is checked.

Defined results: null and empty texts have no ids and decode to the empty text. White space is kept; a literal metaspace mark
decodes to a space, as in the original. Special pieces in a text are ordinary text. Unknown ids decode to the unknown surface.
Bytes that are no UTF-8 decode to U+FFFD. Repeated rows are coded one by one; every row gives one row. An empty
table gives none. Of merges of one score the leftmost goes first, as in the original. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaro.llm.common import batch, map_texts, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
KEPT = 500_000
JOINED = 256
LARGEST = 64 << 20
THREADS = 2


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protobuf message; groups don't occur."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + size]
            i += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for n, value in wire(data):
            if n == 1:
                piece = dict(wire(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.types.append(piece.get(3, NORMAL))
            elif n == 2:
                spec = dict(wire(value))
                m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                m.unk_id = spec.get(40, 0)
                m.unk_surface = spec[44].decode() if 44 in spec else m.unk_surface
            elif n == 3:
                spec = dict(wire(value))
                m.charsmap, m.dummy_prefix, m.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m

    def tokenizer(self):
        """The model on the tokenizers library; a part is split before each mark."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        if self.kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        else:
            rank = {p: i for i, p in enumerate(self.pieces)}
            plain = {p for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL}
            merges = []
            for p in plain:
                i = rank[p]
                merges += [(-self.scores[i], i, k, (p[:k], p[k:])) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
            merges.sort()
            model = models.BPE(rank, [x[3] for x in merges], unk_token=self.pieces[self.unk_id], fuse_unk=True, byte_fallback=self.byte_fallback)
        t = Tokenizer(model)
        t.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        return t

    def normaliser(self):
        """Characters as the model maps them before marks come in; None where it leaves them."""
        from tokenizers import normalizers

        return normalizers.Precompiled(self.charsmap) if self.charsmap else None


class Codec:
    def __init__(self, data: bytes, threads: int = THREADS) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = m = Model.parse(data)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokenizer, self.map = m.tokenizer(), m.normaliser()
        self.rank = {p: i for i, p in enumerate(m.pieces)}
        self.plain = {p: m.scores[i] for p, i in self.rank.items() if m.types[i] == NORMAL}
        self.opens = np.array([p.startswith(MARK) for p in m.pieces])
        #: Parts are independent unless a piece holds a mark after another character, or white space is squeezed.
        self.parts = m.kind == BPE and m.dummy_prefix and not m.squeeze and not any(MARK in p.lstrip(MARK) for p in self.plain)
        self.ids: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.surface = [self.surface_of(i) for i in range(len(m.pieces))]

    def surface_of(self, i: int) -> bytes:
        kind, piece = self.model.types[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.model.unk_surface if kind == UNKNOWN else piece.replace(MARK, " ")).encode()

    def agenda(self, part: str) -> list[int]:
        """Merges of the best score first, leftmost of equals."""
        symbols: list[str | None] = list(part)
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (joined := symbols[i] + symbols[j]) in self.plain:
                heapq.heappush(heap, (-self.plain[joined], i, j, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        ids: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if s in self.rank and self.model.types[self.rank[s]] in (NORMAL, USER):
                ids.append(self.rank[s])
            elif self.model.byte_fallback:
                ids += [self.rank[f"<0x{b:02X}>"] for b in s.encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.model.unk_id:
                ids.append(self.model.unk_id)
        return ids

    def learn(self, parts: list[str]) -> None:
        simple = [p for p in parts if MARK not in p[1:]]
        lots = [simple[i : i + JOINED] for i in range(0, len(simple), JOINED)]
        found: dict[str, bytes] = {}
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast(["".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, edges = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(edges) == len(lot):
                found |= {p: raw[a:b] for p, a, b in zip(lot, edges, [*edges[1:], len(raw)], strict=True)}
        # the original puts the first mark there itself
        checked = self.original.encode([p[1:].replace(MARK, " ") for p in parts], num_threads=1)
        for p, ids in zip(parts, checked, strict=True):
            if p == MARK:  # the original has no ids for an empty text
                ids = [self.rank[MARK]]
            want = np.array(ids, "<u4").tobytes()
            if found.get(p) != want:
                found[p] = np.array(self.agenda(p), "<u4").tobytes()
                if found[p] != want:
                    self.odd.add(p)
        self.ids |= found

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bool]]:
        """For each text its ids (little-endian unsigned 32-bit) and whether they agree with the original's."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        if self.map:
            strings = [self.map.normalize_str(s) for s in strings]
        if not self.parts:
            return self.encode_whole(strings)
        split = [PART.findall(MARK + s.replace(" ", MARK)) if s else [] for s in strings]
        missing = set()
        for p in split:
            missing.update(x for x in p if x not in self.ids)
        if len(self.ids) + len(missing) > KEPT:
            recent = set().union(*split)
            self.ids = {p: self.ids[p] for p in recent.intersection(self.ids)}
            self.odd &= recent
        if missing:
            self.learn(list(missing))
        get = self.ids.__getitem__
        return [(b"".join(map(get, p)), not self.odd or self.odd.isdisjoint(p)) for p in split]

    def encode_whole(self, strings: list[str]) -> list[tuple[bytes, bool]]:
        m = self.model
        ready = [re.sub(" +", " ", s).strip(" ") if m.squeeze else s for s in strings]
        ready = [(MARK * m.dummy_prefix + s.replace(" ", MARK)) if s else "" for s in ready]
        tokenizer = m.tokenizer()
        tokenizer.pre_tokenizer = None
        out = []
        for e, s in zip(tokenizer.encode_batch_fast(ready, add_special_tokens=False), strings, strict=True):
            out.append((np.array(e.ids, "<u4").tobytes(), e.ids == self.original.encode(s)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        last = len(self.surface)
        get, unknown = self.surface.__getitem__, self.model.unk_surface.encode()
        plain = len(ids) == 0 or 0 <= ids.min() and ids.max() < last
        raw = b"".join(map(get, ids.tolist()) if plain else [get(i) if 0 <= i < last else unknown for i in ids.tolist()])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw


#: A run of marks with what follows up to the next.
PART = re.compile(f"{MARK}+[^{MARK}]*")

_CODECS: dict[int, Codec] = {}


def codec(data: bytes, threads: int = THREADS) -> Codec:
    """One for each worker process."""
    key = zlib.crc32(data) ^ threads
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def model_file(spark: SparkSession, path: str):
    size = os.path.getsize(path)
    if size > LARGEST:
        raise ValueError(f"{path} has {size} bytes; at most {LARGEST} are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """doc_id, ids array<int>, parity: one row per row of docs (doc_id, text)."""
    held = model_file(docs.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, threads)
        for (names,), whole in batches:
            found = c.encode(whole)
            ids = pa.array([np.frombuffer(raw, "<u4").astype(np.int32) for raw, _ in found], pa.list_(pa.int32()))
            yield batch(doc_id=pa.array(names, pa.int64()), ids=ids, parity=pa.array([ok for _, ok in found]))

    return map_texts(docs, ["doc_id"], run, "doc_id long, ids array<int>, parity boolean")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """coded (doc_id, ids array<int>; null is no ids) -> doc_id, text."""
    held = model_file(coded.sparkSession, model_path)
    small_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for b in batches:
            texts = [c.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield batch(doc_id=b.column(0), text=pa.array(texts, pa.string()))

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip (decoding gives the text back, a literal mark as a space)."""
    held = model_file(docs.sparkSession, model_path)
    mark = MARK.encode()

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, threads)
        for (names,), whole in batches:
            rows = [(len(raw) // 4, zlib.crc32(raw), ok, c.decode(np.frombuffer(raw, "<u4")) == text.replace(mark, b" ")) for text, (raw, ok) in zip(whole, c.encode(whole), strict=True)]
            n, crc, ok, back = zip(*rows, strict=True)
            yield batch(doc_id=pa.array(names, pa.int64()), n_tokens=pa.array(n, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), parity=pa.array(ok), round_trip=pa.array(back))

    return map_texts(docs, ["doc_id"], run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
