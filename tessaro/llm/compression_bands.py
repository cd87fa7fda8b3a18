"""Quality rules: zstandard compression bands over whole documents and fixed chunks, beside word and line counts.

Very repetitive text compresses far better than prose, and noise hardly at all. Each document's ratio (bytes / compressed
bytes) must lie in a band chosen by its length, and so must most of its fixed chunks; the rest after the last full chunk is one
too, with the band of its own length. Text of mostly ASCII bytes has a higher lower bound, between what base64, random
printable characters or random letters reach at that length and the least of clean text; other scripts take three bytes a
letter and come close to base64 themselves, so that theirs is looser. Hexadecimal text is known by its few symbols.

Defined results: a null or empty text has no words, fails the base rule (fewer than 20 words) and has ratio 0. Repeated rows
are judged one by one. Every row of the input gives one row; an empty table gives none. Further columns are ignored, whatever their
names; texts of any length are read whole. keep_good keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessaro.llm.common import SPACE, batch, map_texts, small_batches, texts

SYMBOLS = b"#*$%&|<>"
HIGH = bytes(range(128, 256))
WINDOW = 8
#: Odd multipliers of a window's words.
MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(WINDOW)], np.uint64)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, n_chunks long, n_chunks_outside long, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """(bytes below which the band holds, least ratio, greatest ratio), in ascending order; the last has no end."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 2.4),
        (512, 0.95, 2.6),
        (2048, 1.1, 3.0),
        (16384, 1.2, 3.6),
        (float("inf"), 1.25, 4.5),
    )
    #: (bytes below which it holds, least ratio) for text of at most ascii_high bytes of 128 and above, as a share.
    ascii_least: tuple[tuple[float, float], ...] = (
        (128, 0.0),
        (192, 1.02),
        (256, 1.12),
        (384, 1.25),
        (512, 1.325),
        (768, 1.39),
        (1024, 1.45),
        (float("inf"), 1.5),
    )
    ascii_high: float = 0.25
    #: From so many bytes on, text of at most so many symbols has this least ratio: 16 equal symbols give no more than 2.
    few_bytes: int = 256
    few_symbols: int = 17
    few_least: float = 2.01
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.15, 3.4)
    #: Share of chunks outside their band from which a document is rejected.
    outside: float = 0.25
    level: int = 3
    min_words: int = 20
    repeat_percent: int = 30


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        m = n - WINDOW + 1
        key = h[:m] * MIX[0]
        for j in range(1, WINDOW):
            key += h[j : m + j] * MIX[j]
        order = np.argsort(key)
        same = (s := key[order])[1:] == s[:-1]
        if same.any():
            found = np.zeros(m, bool)
            found[order[1:][same]] = True
            found[order[:-1][same]] = True
            starts = np.flatnonzero(found)
            edge = np.zeros(n + 1, np.int32)
            edge[starts] += 1
            np.subtract.at(edge, starts + WINDOW, 1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def least_ratio(text: bytes, least: float, bands: Bands) -> float:
    """The lower bound of a text or chunk: least, or more where its bytes say so."""
    n = len(text)
    if n - len(text.translate(None, HIGH)) <= bands.ascii_high * n:
        least = max(least, next(x for end, x in bands.ascii_least if n < end))
    if n >= bands.few_bytes and len(set(text.translate(None, SPACE))) <= bands.few_symbols:
        least = max(least, bands.few_least)
    return least


def banded(text: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """ratio, chunks, chunks outside the band, verdict. The last chunk may be short."""
    if not text:
        return 0.0, 0, 0, False

    def fits(part: bytes, ratio: float, band: tuple[float, float]) -> bool:
        return least_ratio(part, band[0], bands) <= ratio <= band[1]

    def of_length(n: int) -> tuple[float, float]:
        return next((a, b) for end, a, b in bands.whole if n < end)

    ratio, size = len(text) / len(zip_.compress(text)), bands.chunk_bytes
    good = fits(text, ratio, of_length(len(text)))
    if len(text) < size:
        return ratio, 1, int(not good), good
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    outside = sum(not fits(x, len(x) / len(zip_.compress(x)), bands.chunk if len(x) == size else of_length(len(x))) for x in parts)
    return ratio, len(parts), outside, good and outside <= bands.outside * len(parts)


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of docs (doc_id, text) with counts, ratio and verdict; a single pass without a shuffle."""

    def run(batches: Iterator[tuple[list, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for (ids,), whole in batches:
            out = []
            for text in whole:
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < bands.min_words or 100 * repeat > bands.repeat_percent * n
                ratio, chunks, outside, good = banded(text, bands, zip_)
                out.append((n, chars, symbols, dup, repeat, failed, ratio, chunks, outside, good and not failed))
            c = list(zip(*out, strict=True))
            names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
            yield batch(doc_id=pa.array(ids, pa.int64()), **dict(zip(names, map(pa.array, c), strict=True)))

    return map_texts(docs, ["doc_id"], run, SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of docs that pass the rules, with all their columns, whatever their names. Null and empty texts don't pass; repeated rows
    are judged one by one; texts of any length are read whole; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            good = []
            for t in texts(b.column(place)):
                n, *_, repeat = base_counts(t)
                good.append(n >= bands.min_words and 100 * repeat <= bands.repeat_percent * n and banded(t, bands, zip_)[-1])
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
