"""Suffix-array dedup by a depth-limited radix sort: every window of so many tokens that starts anywhere else is found, exactly.

Tokens are bytes (windows of 400) or words (windows of 50, of lower-cased letters and digits, whatever stands between them); one
pass over the texts may look for windows of several kinds. Sorting all suffixes would shuffle the corpus many times over. Only
suffixes at anchors are sorted: each window's anchor is the leftmost place of the least-hashed gram in it, a function of the
window's tokens alone, so equal windows hold equal anchors at equal places. Suffixes at anchors are ordered by
most-significant-digit passes. The first digit is the gram: anchors that are alone under it drop out, and with them all their
windows. Further digits widen the tokens compared around the anchor, until they are the windows themselves: equal groups are
then exactly the repeated windows.

The passes after the first run inside a task for all groups of bounded size. A gram with more anchors than that is split by
passes over the data: the range of window starts of each anchor is halved, which widens what its windows share (the next
digit) and so splits the group; ranges whose whole extent is the same elsewhere are settled at once and only one stays as
partner for others. The passes are grouped counts, pre-aggregated before the shuffle.

Copies of a whole text are settled by its digest: each is repeated throughout, and one of them goes through the passes.
Windows are removed wherever they stand, or (keep_first) everywhere but at their first place: in the text of the least digest,
and of its places there the leftmost. Of copies of a whole text the row of the least doc_id is that text.

Texts are worked off in pieces that overlap by a window, so that memory doesn't grow with the longest text's windows.

Defined results: null, empty and short texts (under one window) lose nothing. Overlapping windows count, also within a text
(one repeated line). Repeated rows are copies of each other. Every row gives one row; doc_id may repeat or be null. An empty table
gives none. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import PLAIN, batch, cut, likely_in, likely_set, small_batches, stored, unused


@dataclass(frozen=True)
class Kind:
    """Windows of width tokens, anchored at grams of gram tokens."""

    width: int
    gram: int
    words: bool = False

    @property
    def size(self) -> int:
        """Bytes of a token where tokens are passed on."""
        return 8 if self.words else 1


BYTES = Kind(400, 64)
PASSAGES = Kind(50, 16, words=True)
#: Anchors of one gram that a task may hold.
GROUP = 1 << 14
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A 64-bit value for each byte.
VALUES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8").astype(np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows along the last axis, by doubling."""
    n = values.shape[-1]
    h, power, have, out, done = values, BASE, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                m = n - done - have + 1
                out = h[..., :m] if out is None else out[..., :m] * power + h[..., done : done + m]
                done += have
            if have * 2 > width:
                return out
            m = h.shape[-1] - have
            h, power, have = h[..., :m] * power + h[..., have:], power * power, have * 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least value in each window of x."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    # the place goes into the low bits, so that one minimum gives value and leftmost place within a block's reach
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: Windows whose anchors are found at once.
BLOCK = 1 << 17
#: Places take these low bits of a key, so the key's order is a function of the window alone, leftmost first.
PLACE_BITS = np.uint64(32)
SETTLED = -1
#: Bytes of a text that are split into words at once, and words that a worker remembers.
SPLIT = 1 << 20
REMEMBERED = 1 << 17
#: Contexts whose windows are hashed at once.
HASHED = 512


class WordValues(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordValues()


def word_values(text: bytes) -> np.ndarray:
    """A 64-bit value for each word."""
    known, out, at = _WORDS, [], 0
    while at < len(text):
        stop = len(text)
        if stop - at > SPLIT:  # up to the next separator
            stop = at + SPLIT
            while stop < len(text) and PLAIN[text[stop]] != 32:
                stop += 1
        words = text[at:stop].translate(PLAIN).split()
        out.append(np.fromiter((known[w] for w in words), np.uint64, len(words)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes."""
    inside = np.frombuffer(text.translate(PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[::2], edges[1::2]


def pieces(text: bytes, kind: Kind) -> Iterator[tuple[int, np.ndarray]]:
    """Values of a text's tokens in pieces of at most BLOCK windows, each with the place of its first token."""
    values = word_values(text) if kind.words else None
    windows = (len(values) if kind.words else len(text)) - kind.width + 1
    for i in range(0, windows, BLOCK):
        stop = min(i + BLOCK, windows) + kind.width - 1
        yield i, values[i:stop] if kind.words else VALUES[np.frombuffer(text, np.uint8, stop - i, i)]


def anchors(codes: np.ndarray, edges: list[int], kind: Kind, keep_first: bool) -> tuple[np.ndarray, ...]:
    """Pieces put together, each of width tokens or more, and their edges -> piece number, gram hash, place, first and last
    window start of each anchor, counted from the piece's beginning. A row with place SETTLED gives starts that repeat within
    their piece; keep_first: all but the first of each window."""
    width, gram = kind.width, kind.gram
    grams = scrambled(window_hashes(codes, gram))
    key = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(key, width - gram + 1) & np.uint64((1 << 32) - 1)).astype(np.int64)
    ends = np.array(edges[1:])
    owner = np.searchsorted(ends, np.arange(len(place)), "right")
    starts = np.flatnonzero(np.arange(len(place)) + width <= ends[owner])
    place, owner = place[starts], owner[starts]

    def changes() -> np.ndarray:
        return np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(starts) != 1)])

    new, settled = changes(), []
    # periodic text has anchors far closer than others: each window that repeats in its own piece stays once
    crowded = np.bincount(owner[new], minlength=len(ends)) * (width - gram + 1) > 8 * np.bincount(owner, minlength=len(ends))
    if crowded.any():
        tight = np.flatnonzero(crowded[owner])
        h = window_hashes(codes, width)[starts[tight]] ^ scrambled(owner[tight].astype(np.uint64))
        _, lead, count = np.unique(h, return_index=True, return_counts=True)
        once = np.ones(len(starts), bool)
        once[tight] = False
        once[tight[lead]] = True
        again = ~once
        if not keep_first:
            again[tight[lead[count > 1]]] = True
        settled = ranges(starts[again], owner[again])
        starts, place, owner = starts[once], place[once], owner[once]
        new = changes()
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    number, at = owner[first], place[first]
    base = np.array(edges[:-1])[number]
    out = [number, grams[at].view(np.int64), at - base, starts[first] - base, starts[last] - base]
    if settled:
        number, a, b = settled
        base = np.array(edges[:-1])[number]
        more = [number, np.zeros(len(a), np.int64), np.full(len(a), SETTLED), a - base, b - base]
        out = [np.concatenate(x) for x in zip(out, more, strict=True)]
    return tuple(out)


def ranges(starts: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Ascending starts -> owner, first and last of each consecutive run."""
    if not len(starts):
        return [np.zeros(0, np.int64)] * 3
    new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (owner[1:] != owner[:-1])]))
    return [owner[new], starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]]


def anchor_rows(base: DataFrame, kinds: tuple[Kind, ...], keep_first: bool) -> DataFrame:
    """base: digest, text -> kind (its number), digest, gram, place, first, last; texts met before in the same task are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        lots: list[tuple[list, list, list, list]] = [([], [], [], [0]) for _ in kinds]

        def flush(k: int) -> Iterator[pa.RecordBatch]:
            names, offsets, codes, edges = lots[k]
            lots[k] = ([], [], [], [0])
            if names:
                number, g, place, first, last = anchors(np.concatenate(codes), edges, kinds[k], keep_first)
                offset = np.array(offsets)[number]
                yield batch(
                    kind=pa.array(np.full(len(number), k, np.int8)),
                    digest=pa.array(names, pa.binary()).take(pa.array(number)),
                    gram=pa.array(g),
                    place=pa.array(np.where(place == SETTLED, SETTLED, place + offset).astype(np.int32)),
                    first=pa.array((first + offset).astype(np.int32)),
                    last=pa.array((last + offset).astype(np.int32)),
                )

        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest in met:
                    continue
                met.add(digest)
                for k, kind in enumerate(kinds):
                    for offset, codes in pieces(text, kind):
                        names, offsets, held, edges = lots[k]
                        names.append(digest)
                        offsets.append(offset)
                        held.append(codes)
                        edges.append(edges[-1] + len(codes))
                        if edges[-1] >= BLOCK:
                            yield from flush(k)
        for k in range(len(kinds)):
            yield from flush(k)

    return base.select("digest", "text").mapInArrow(run, "kind byte, digest binary, gram long, place int, first int, last int")


def contexts(rows: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """digest, text, anchors -> a row for each anchor, with the tokens of its windows as context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            c = list(zip(*held, strict=True))
            held, size = [], 0
            types = (pa.int64(), pa.int8(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return batch(**{n: pa.array(x, t) for n, x, t in zip(("key", "kind", "digest", "place", "first", "last", "n", "context"), c, types, strict=True)})

        for b in batches:
            for digest, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = None
                for a in found:
                    kind = kinds[a["kind"]]
                    lo, hi = a["first"], a["last"] + kind.width
                    if kind.words:
                        words = word_values(text) if words is None else words
                        part = words[lo:hi].astype("<u8").tobytes()
                    else:
                        part = text[lo:hi]
                    held.append((a["gram"], a["kind"], digest, a["place"], lo, a["last"], a["n"], part))
                    size += len(part)
                    if size >= 1 << 20:
                        yield flush()
        if held:
            yield flush()

    return rows.select("digest", "text", "anchors").mapInArrow(run, "key long, kind byte, digest binary, place int, first int, last int, n long, context binary")


def digest_order(digests: pa.Array) -> np.ndarray:
    """The rank of each 16-byte digest."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.unique(halves, axis=0, return_inverse=True)[1].ravel()


def repeated_runs(batches: Iterator[pa.RecordBatch], kinds: tuple[Kind, ...], keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, digest, first, context) sorted by key and kind -> kind, digest, first, last of window starts that repeat
    under their key; keep_first: all but the first place of each window."""
    held: list[pa.RecordBatch] = []
    count = 0

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows["key"].to_numpy()
        stop = len(key) if last else int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        rest = rows.slice(stop)
        held, count = rest.to_batches(), len(key) - stop
        lo = 0
        while lo < stop:  # whole groups, a bounded number of rows at a time
            hi = min(stop, lo + 4096)
            while hi < stop and key[hi] == key[hi - 1]:
                hi += 1
            part, of = rows.slice(lo, hi - lo), rows["kind"].to_numpy()[lo:hi]
            for k in np.unique(of).tolist():
                yield from windows(part.filter(pa.array(of == k)), k)
            lo = hi

    def windows(rows: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
        kind = kinds[k]
        key = rows["key"].to_numpy().view(np.uint64)
        context = rows["context"].to_pylist()
        n = np.array([len(c) for c in context]) // kind.size - kind.width + 1
        parts = []
        for i in range(0, len(n), HASHED):
            some = n[i : i + HASHED]
            joined = b"".join(context[i : i + HASHED])
            found = window_hashes(np.frombuffer(joined, "<u8").astype(np.uint64) if kind.words else VALUES[np.frombuffer(joined, np.uint8)], kind.width)
            # a row's windows, without those that run into the next row
            parts.append(found[np.arange(some.sum()) + np.repeat(np.arange(len(some)) * (kind.width - 1), some)])
        h = np.concatenate(parts)
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        # the key tells groups apart: windows are only compared under one digit
        h = scrambled(h ^ key[owner])
        order = np.argsort(h)
        same = (s := h[order])[1:] == s[:-1]
        found = np.zeros(len(h), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        hit = np.flatnonzero(found)
        first = rows["first"].to_numpy()
        if keep_first and len(hit):
            rank, at = digest_order(rows["digest"])[owner[hit]], first[owner[hit]] + within[hit]
            least = np.lexsort((at, rank, h[hit]))
            lead = np.flatnonzero(np.concatenate([[True], np.diff(h[hit[least]]) != 0]))
            lead = least[np.repeat(lead, np.diff(np.concatenate([lead, [len(least)]])))]
            # a row may be there more than once: it is one place
            found[hit[least[(rank[least] == rank[lead]) & (at[least] == at[lead])]]] = False
            hit = np.flatnonzero(found)
        if len(hit):
            who, a, b = ranges(within[hit], owner[hit])
            yield batch(
                kind=pa.array(np.full(len(who), k, np.int8)),
                digest=rows["digest"].combine_chunks().take(pa.array(who)),
                first=pa.array((first[who] + a).astype(np.int32)),
                last=pa.array((first[who] + b).astype(np.int32)),
            )

    for x in batches:
        if x.num_rows:
            held.append(x)
            count += x.num_rows
            if count >= 1 << 14:
                yield from settle(False)
    if count:
        yield from settle(True)


def in_task(rows: DataFrame, kinds: tuple[Kind, ...], keep_first: bool) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select("key", "kind", "digest", "first", "context").repartition(parts, "key").sortWithinPartitions("key", "kind")
    return spread.mapInArrow(lambda b: repeated_runs(b, kinds, keep_first), "kind byte, digest binary, first int, last int")


def split_passes(rows: DataFrame, kind: Kind, group: int, keep_first: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows (key, kind, digest, place, first, last, context) of large groups of one kind -> runs settled, and rows of groups that fit a task."""
    settled, fit = [], []
    width, size = kind.width, kind.size
    reach = 1
    while reach < width - kind.gram + 1:
        reach *= 2
    rows = rows.withColumn("low", F.lit(0))  # the windows of a row start low to low + reach - 1 tokens before the place
    while True:
        # ranges whose whole extent is also elsewhere; the one that stays is the first by digest, as in the passes within a task
        extent = ["key", "near", "far", "hull"]
        rows = rows.withColumns({"near": F.col("place") - F.col("last"), "far": F.col("place") - F.col("first"), "hull": F.xxhash64("context", F.lit(1)), "me": F.struct("digest", "first")})
        rows = cut(rows)
        classes = rows.groupBy(*extent).agg(F.count("*").alias("n"), F.min("me").alias("one"))
        rows = rows.join(classes, extent)
        settled.append(rows.filter("n > 1 AND me <> one" if keep_first else "n > 1").select("kind", "digest", "first", "last"))
        rows = cut(rows.filter("me = one").drop("n", "one", *extent[1:], "me"))
        rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
        fit.append(rows.filter(F.col("n") <= group).select("key", "kind", "digest", "first", "context"))
        large = rows.filter(F.col("n") > group).drop("n")
        if reach == 1 or large.isEmpty():
            return settled, fit
        reach //= 2
        halves = []
        for side in (0, 1):
            low = F.col("low") + side * reach
            high = low + (reach - 1)
            first = F.greatest(F.col("first"), F.col("place") - high)
            last = F.least(F.col("last"), F.col("place") - low)
            part = large.withColumns({"low": low, "was": F.col("first"), "first": first, "last": last}).filter("first <= last")
            part = part.withColumn("context", F.expr(f"substring(context, {size} * (first - was) + 1, {size} * (last - first + {width}))"))
            # what all windows of the range share: from low tokens before the place to width - (low + reach - 1) after it
            shared = F.expr(f"substring(context, {size} * (place - low - first) + 1, {size} * ({width} - {reach} + 1))")
            halves.append(part.withColumn("key", F.xxhash64("key", "low", shared)).drop("was"))
        rows = halves[0].unionByName(halves[1])


def repeated_spans(docs: DataFrame, kinds: tuple[Kind, ...], group: int = GROUP, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> base (doc_id, digest, text as bytes) and info (doc_id, digest, n_bytes, sha256, whole, runs): whole
    is true where all of a text repeats, runs are kind, first and last starts of repeated windows."""
    small_batches(docs.sparkSession, 500)
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    meta = cut(base.select("doc_id", "digest", F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha256")))
    counts = meta.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    found = stored(anchor_rows(base, kinds, keep_first))
    open_ = found.filter("place >= 0")
    me = F.hash("digest", "place", "first")
    grams = open_.groupBy("kind", "gram").agg(F.min(me).alias("a"), F.max(me).alias("b"), F.count("*").alias("n")).filter("a <> b").select("kind", "gram", "n")
    grams = cut(grams)
    # sets drop what several tasks found in copies of a text; a distinct() would reuse the partitioning by gram, and a frequent
    # gram would stay whole in one task
    candidates = likely_in(open_, ["kind", "gram"], likely_set(grams, ["kind", "gram"])).join(grams, ["kind", "gram"])
    by_text = candidates.groupBy("digest").agg(F.collect_set(F.struct("kind", "gram", "place", "first", "last", "n")).alias("anchors"))
    wanted = cut(by_text.join(counts.select("digest", "rep"), "digest").select(F.col("digest").alias("d"), F.col("rep").alias("r"), "anchors"))
    some = likely_in(base, ["doc_id", "digest"], likely_set(wanted, ["r", "d"]))
    spread = contexts(some.join(wanted, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("digest") == F.col("d"))).select("digest", "text", "anchors"), kinds)
    runs = found.filter(F.col("place") == SETTLED).select("kind", "digest", "first", "last")
    hot = {r[0] for r in grams.filter(F.col("n") > group).select("kind").distinct().collect()}
    if not hot:
        runs = runs.unionAll(in_task(spread, kinds, keep_first))
    else:
        spread = cut(spread)
        rows = spread.filter(F.col("n") <= group).select("key", "kind", "digest", "first", "context")
        for k in sorted(hot):
            settled, fit = split_passes(spread.filter((F.col("n") > group) & (F.col("kind") == k)).drop("n"), kinds[k], group, keep_first)
            rows = reduce(DataFrame.unionAll, fit, rows)
            runs = reduce(DataFrame.unionAll, settled, runs)
        runs = runs.unionAll(in_task(rows, kinds, keep_first))
    spans = runs.groupBy("digest").agg(F.collect_set(F.struct("kind", "first", "last")).alias("runs"))
    texts = counts.join(spans, "digest", "full").filter("copies > 1 OR runs IS NOT NULL").select("digest", "copies", "rep", "runs")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    if keep_first:
        whole = whole & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    info = meta.join(texts, "digest", "left").select("doc_id", "digest", "n_bytes", "sha256", whole.alias("whole"), F.when(~whole, F.col("runs")).alias("runs"))
    return base, cut(info)


def touched(base: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of base with whole or runs, and these; only such texts are shuffled, and the few that the bit set lets through."""
    one = info.filter("whole OR runs IS NOT NULL").dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("__i"), F.col("digest").alias("__d"), F.col("whole").alias("__whole"), F.col("runs").alias("__runs"))
    some = likely_in(base, ["doc_id", "digest"], likely_set(one, ["__i", "__d"]))
    return some.join(one, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("digest") == F.col("__d"))).drop("__i", "__d")


def spans_of(text: bytes, whole: bool, runs: list[dict] | None, kind: Kind, number: int) -> tuple[list[tuple[int, int]], int]:
    """Maximal removed spans of a kind in bytes, and the tokens in them."""
    own = [(r["first"], r["last"] + kind.width) for r in runs or () if r["kind"] == number]
    if not whole and not own:
        return [], 0
    begin, end = word_places(text) if kind.words else (None, None)
    n = len(begin) if kind.words else len(text)
    if whole:
        own = [(0, n)] if n >= kind.width else []
    spans: list[list[int]] = []
    for a, b in sorted(own):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    tokens = sum(b - a for a, b in spans)
    return [(int(begin[a]), int(end[b - 1])) if kind.words else (a, b) for a, b in spans], tokens


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text, put together."""
    rest, at = [], 0
    for a, b in spans:
        rest.append(text[at:a])
        at = b
    rest.append(text[at:])
    return b"".join(rest)


def remove_repeats(docs: DataFrame, kind: Kind = BYTES, group: int = GROUP, with_text: bool = True, passages: Kind | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (of bytes, removed). with_text: kept
    (bytes). passages: also n_passage_words and passages (spans of bytes) of that kind, which are reported and not removed."""
    kinds = (kind,) if passages is None else (kind, passages)
    base, info = repeated_spans(docs, kinds, group)
    span = "array<struct<start: long, stop: long>>"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span}" + ", kept binary" * with_text + f", n_passage_words long, passages {span}" * (passages is not None)
    names = [x.strip().split()[0] for x in schema.replace("start: long, stop", "").split(", ")]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = {"kept_sha256": pa.string(), "spans": spans_type, "passages": spans_type, "kept": pa.binary()}
    listed = lambda spans: [{"start": a, "stop": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for doc, text, whole, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans, _ = spans_of(text, whole, runs, kind, 0)
                kept = without(text, spans)
                row = {"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": listed(spans), "kept": kept}
                if passages:
                    more, n = spans_of(text, whole, runs, passages, 1)
                    row |= {"n_passage_words": n, "passages": listed(more)}
                rows.append(row)
            yield batch(**{n: pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names})

    changed = touched(base, info).select("doc_id", "text", "__whole", "__runs").mapInArrow(run, schema)
    zero, nothing = F.lit(0).cast("long"), F.array().cast(span)
    plain = {"n_bytes": F.col("n_bytes").cast("long"), "n_removed": zero, "n_spans": zero, "kept_sha256": F.lower(F.hex("sha256")), "spans": nothing, "n_passage_words": zero, "passages": nothing}
    rest = info.filter("NOT whole AND runs IS NULL")
    if with_text:
        rest = base.join(rest.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "n_bytes", "sha256").distinct(), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")))
        plain["kept"] = F.col("text")
    return changed.unionAll(rest.select("doc_id", *(plain[n].alias(n) for n in names[1:])))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text when no character is cut: one that is covered in part stays."""
    rest, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        rest.append(text[at:a])
        at = b
    rest.append(text[at:])
    return b"".join(rest)


def strip_repeats(docs: DataFrame, kind: Kind = PASSAGES, group: int = GROUP) -> DataFrame:
    """docs with repeated passages taken out of text everywhere but at their first place, and n_chars counted anew if there is
    one; all rows stay, with all columns, whatever their names. Rows that repeat doc_id and text are one document. Null and empty texts
    stay as they are, texts of any length are read whole; an empty table gives no rows."""
    _, info = repeated_spans(docs, (kind,), group, keep_first=True)
    one = info.filter("whole OR runs IS NOT NULL").dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "whole", "runs")
    likely = likely_set(one, ["i", "d"])
    # a document is one column, so that none of its names meets those of this function
    named = docs.select(F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).alias("digest"), F.struct("*").alias("row"))
    some, others = likely_in(named, ["id", "digest"], likely), likely_in(named, ["id", "digest"], likely, no=True)
    joined = some.join(one, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    names, place = docs.columns, docs.columns.index("text")
    all_of, own_of = unused(names, "whole", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            whole, runs = (c.to_pylist() for c in columns[-2:])
            out = []
            for text, all_, own in zip(columns[place].to_pylist(), whole, runs, strict=True):
                if text and (all_ or own):
                    raw = text.encode("utf-8", "surrogatepass")
                    spans, _ = spans_of(raw, all_, own, kind, 0)
                    text = whole_characters(raw, spans).decode("utf-8", "replace")
                out.append(text)
            columns[place] = pa.array(out, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns[:-2], names)

    out = joined.select("row.*", F.col("whole").alias(all_of), F.col("runs").alias(own_of)).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.unionAll(others.select("row.*"))
