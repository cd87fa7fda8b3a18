"""Phrases of two and three words, counted exactly through minimal perfect hashes over candidates that may be frequent.

A word of a language is known by a 64-bit hash, checked to be different for each word that occurs. Levels go up as in Apriori: two
words can be a frequent phrase only if both are frequent, three only if both pairs are; a set of bits of bounded size, broadcast,
keeps every such phrase and few others. Each task sums the phrases of a lot of texts and sends them, packed, to their part (by
hash; the number of parts follows the number of words). In a part, sums over buckets leave only phrases that can reach the
least count; over these a minimal perfect hash is built, with each slot's key (the word hashes) stored. Blocks of rows look up their
slots, are verified by the stored keys and bincount into arrays, which are summed in a tree. A part's hash, keys and counts are
kept as a file of the shared folder. The counts of a phrase's cuts are read from those files by slot; requests are dealt by range
of (part, phrase), so that a part with many requests is split over tasks.

Arrays over all candidates would grow with the corpus in every task, so an array covers a part, and tasks share parts by a shuffle.

Defined results: a null text is empty; a null lang is `und`; repeated rows count again; ties are ranked by phrase; an empty table
gives no rows. Texts of any length are read whole. Only lang and text are read, so other columns may have any names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaro.llm.common import batch, cut, new_path, small_batches, texts
from tessaro.llm.token_store import MinimalHash, mix, read_file, write_file

#: What ends a piece; all of it becomes a line feed. Tabs become spaces, A-Z lower case.
ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAST = 10
SHARE = 50
SCALE = 1_000_000
TOP = 2000
#: Bytes of the texts whose phrases a task sums before it sends them; a longer text is a lot of its own.
LOT = 4 << 20
#: Rows of a part, on average and at most (there is one for each lot in which a phrase stands).
PART_ROWS = 1 << 19
#: Bits of the broadcast set of what is frequent (8 MB): more of it keeps more that isn't, and loses nothing.
SET_BITS = 26
#: Buckets of a part for the sums that bound counts.
BUCKETS = 1 << 20
#: Rows that are looked up and counted at once.
BLOCK = 1 << 16


class Lot:
    """Words of some texts: codes of distinct (language, word) pairs with their hashes, and -1 between pieces."""

    def __init__(self, langs: list[str], texts: list[bytes], seed: int) -> None:
        spaced = [t.translate(PLAIN).replace(b"\n", b" \n ") + b" \n" for t in texts]
        lists = pc.split_pattern(pa.array(spaced, pa.large_binary()), " ")
        coded = lists.values.dictionary_encode()
        names = {g: i for i, g in enumerate(dict.fromkeys(langs))}
        word, lang = coded.indices.to_numpy(), np.repeat([names[g] for g in langs], np.diff(lists.offsets.to_numpy()))
        tokens = coded.dictionary.to_pylist()
        size = len(tokens)
        kinds = np.array([0 if w == b"" else 1 if w == b"\n" else 2 for w in tokens], np.int8)
        there = kinds[word] > 0
        word, lang = word[there], lang[there]
        code = lang.astype(np.int64) * size + word
        is_word = kinds[word] == 2
        counts = np.bincount(code[is_word], minlength=1)
        self.seen = np.flatnonzero(counts)
        self.n = counts[self.seen]
        number = np.full(max(len(counts), len(names) * size), -1, np.int64)
        number[self.seen] = np.arange(len(self.seen))
        self.at = np.where(is_word, number[code], -1)
        # a word has no space, so that this names a language's word
        ends = [b" " + g.encode("utf-8", "surrogatepass") for g in names]
        self.names = [tokens[w] + ends[g] for w, g in zip((self.seen % size).tolist(), (self.seen // size).tolist(), strict=True)]
        self.h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in self.names), np.uint64, len(self.names))


def lots(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Lot]:
    """Batches of (lang, text) in lots of bounded size."""
    langs, whole, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            if whole and size + len(text) > LOT:
                yield Lot(langs, whole, seed)
                langs, whole, size = [], [], 0
            langs.append(lang)
            whole.append(text)
            size += len(text)
    if whole:
        yield Lot(langs, whole, seed)


def key_hash(keys: list[np.ndarray], seed: int = 0) -> np.ndarray:
    out = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        out = mix(out ^ k, 101 + seed)
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << SET_BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_set(spark: SparkSession, hashes: DataFrame, column: str) -> Broadcast:
    """The hashes' lowest SET_BITS bits as a set of bits: at most 2 ** (SET_BITS - 6) rows reach the driver, however many hashes there are."""
    at = hashes.select(F.expr(f"{column} & {(1 << SET_BITS) - 1}").alias("at"))
    words = at.select(F.expr("cast(shiftright(at, 6) as int)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(1 << (SET_BITS - 6), np.int64)
    found = words.toArrow()
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def pairs_of(lot: Lot, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where two words stand together that may both be frequent, the pair of each, and the distinct pairs: first, second, count."""
    keep = np.concatenate([has(frequent, lot.h), [False]])[lot.at]  # -1 is the last
    places = np.flatnonzero(keep[:-1] & keep[1:])
    size = max(1, len(lot.h))
    pairs, which, count = np.unique(lot.at[places] * size + lot.at[places + 1], return_inverse=True, return_counts=True)
    return places, which, pairs // size, pairs % size, count


def triples_of(lot: Lot, frequent: np.ndarray, frequent_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples of which both pairs may be frequent: their words, and count."""
    places, which, first, second, _ = pairs_of(lot, frequent)
    passes = has(frequent_pairs, key_hash([lot.h[first], lot.h[second]]))[which]
    follows = np.flatnonzero(passes[:-1] & passes[1:] & (np.diff(places) == 1))
    size = max(1, len(lot.h))
    triples, count = np.unique(which[follows] * size + second[which[follows + 1]], return_counts=True)
    pair = triples // size
    return first[pair], second[pair], triples % size, count


def packed(keys: list[np.ndarray], count: np.ndarray, parts: int, names: list[bytes] | None = None) -> pa.RecordBatch:
    """A row for each part: the part's keys, one after the other by word, counts, and the names' lengths and bytes if given."""
    part = (key_hash(keys, 7) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, start = np.unique(part[order], return_index=True)
    ends = [*start[1:].tolist(), len(order)]
    keys, count = [k[order] for k in keys], count[order].astype(np.uint32)
    cuts = list(zip(start.tolist(), ends, strict=True))
    named = {}
    if names is not None:
        names = [names[i] for i in order.tolist()]
        lengths = np.fromiter(map(len, names), np.uint32, len(names))
        named = {"lengths": pa.array([lengths[i:j].tobytes() for i, j in cuts], pa.binary()), "names": pa.array([b"".join(names[i:j]) for i, j in cuts], pa.binary())}
    return batch(part=pa.array(found, pa.int32()), keys=pa.array([b"".join(k[i:j].tobytes() for k in keys) for i, j in cuts], pa.binary()), counts=pa.array([count[i:j].tobytes() for i, j in cuts], pa.binary()), **named)


def unpacked(group: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    rows = [np.frombuffer(x, np.uint64).reshape(width, -1) for x in group["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"].to_pylist()]).astype(np.int64)
    return [np.concatenate([r[i] for r in rows]) for i in range(width)], counts


def names_of(group: pa.Table) -> pa.Array:
    """The names of the group's rows, in the order of unpacked."""
    lengths = np.concatenate([np.frombuffer(x, np.uint32) for x in group["lengths"].to_pylist()])
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(group["names"].to_pylist()))])


def tree_sum(arrays: Iterator[np.ndarray]) -> np.ndarray:
    """Sums of 1, 2, 4, ... arrays wait, so that as many are held as the logarithm of their number."""
    waiting: list[tuple[int, np.ndarray]] = []
    for a in arrays:
        n = 1
        while waiting and waiting[-1][0] == n:
            a = waiting.pop()[1] + a
            n *= 2
        waiting.append((n, a))
    return sum((a for _, a in waiting[1:]), waiting[0][1])


class Part:
    """A minimal perfect hash over the candidates of a part, with each slot's key and count."""

    def __init__(self, hashed: MinimalHash, seed: int, keys: list[np.ndarray], counts: np.ndarray) -> None:
        self.hashed, self.seed, self.keys, self.counts = hashed, seed, keys, counts

    @classmethod
    def build(cls, keys: list[np.ndarray], counts: np.ndarray, least: int) -> Part:
        """From rows of keys with counts; a key may stand in many rows."""
        h = key_hash(keys)
        # an upper bound of a phrase's count: that of its bucket
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        may = (np.bincount(bucket, weights=counts, minlength=BUCKETS) >= least)[bucket]
        keys, counts = [k[may] for k in keys], counts[may]
        for seed in range(64):
            h = key_hash(keys, seed)
            distinct, lead, of = np.unique(h, return_index=True, return_inverse=True)
            if all(np.array_equal(k[lead][of], k) for k in keys):
                break
        else:
            raise RuntimeError("no seed tells the keys of a part apart")
        hashed = MinimalHash.build(distinct)
        slots = hashed.slots(distinct)
        stored = []
        for k in keys:
            by_slot = np.empty(len(distinct), np.uint64)
            by_slot[slots] = k[lead]
            stored.append(by_slot)
        part = cls(hashed, seed, stored, np.zeros(len(distinct), np.int64))
        if len(distinct):
            part.counts = tree_sum(part.counted([k[i : i + BLOCK] for k in keys], counts[i : i + BLOCK]) for i in range(0, len(counts), BLOCK))
        return part

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Slots, verified by the stored keys; -1 where a key isn't there."""
        slots = self.hashed.slots(key_hash(keys, self.seed))
        there = slots >= 0
        for stored, k in zip(self.keys, keys, strict=True):
            there[there] = stored[slots[there]] == k[there]
        return np.where(there, slots, -1)

    def counted(self, keys: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        slots = self.find(keys)
        there = slots >= 0
        return np.bincount(slots[there], weights=counts[there], minlength=len(self.counts)).astype(np.int64)

    def write(self, uri: str) -> None:
        held = io.BytesIO()
        bits = self.hashed.bits
        flat = np.packbits(np.concatenate([*bits, np.zeros(0, bool)]))
        np.savez(held, sizes=np.array([len(b) for b in bits], np.int64), bits=flat, rest=self.hashed.rest, seed=self.seed, keys=np.array(self.keys), counts=self.counts)
        write_file(uri, held.getvalue())

    @classmethod
    def read(cls, uri: str) -> Part:
        f = np.load(io.BytesIO(read_file(uri)))
        sizes = f["sizes"]
        flat = np.unpackbits(f["bits"])[: sizes.sum()].astype(bool)
        return cls(MinimalHash(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], f["rest"]), int(f["seed"]), list(f["keys"]), f["counts"])


def count_words(docs: DataFrame, seed: int, parts: int, path: str, least: int) -> DataFrame:
    """lang, word, h, n of the words that reach the least count, and for each part and language a row without a word with the sum
    of all n. A row without a language tells that two words have one hash. Each part's file is written beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, seed):
            h, n, names = lot.h, lot.n, lot.names
            while len(h):  # a count of more than 32 bits goes as several rows
                yield packed([h], np.minimum(n, 2**32 - 1), parts, names)
                more = np.flatnonzero(n >= 2**32)
                h, n, names = h[more], n[more] - (2**32 - 1), [names[i] for i in more.tolist()]

    def count(group: pa.Table) -> pa.Table:
        keys, counts = unpacked(group, 1)
        names = names_of(group)
        _, lead, of = np.unique(keys[0], return_index=True, return_inverse=True)
        distinct = names.take(pa.array(lead))
        same = pc.all(pc.equal(distinct.take(pa.array(of)), names)).as_py()
        part = Part.build(keys, counts, least)
        part.write(f"{path}/{group['part'][0].as_py():06d}.mph")
        n = np.bincount(of, weights=counts).astype(np.int64)
        often = np.flatnonzero(n >= least)
        split = [x.split(b" ", 1) for x in distinct.take(pa.array(often)).to_pylist()]
        langs = pa.array([x.split(b" ", 1)[1] for x in distinct.to_pylist()], pa.binary())
        coded = langs.dictionary_encode()
        totals = np.bincount(coded.indices.to_numpy(), weights=n, minlength=len(coded.dictionary)).astype(np.int64)
        own, all_of = len(often), len(totals)
        clash = 0 if same else 1
        return pa.table(
            {
                "lang": pa.array([x[1].decode("utf-8", "replace") for x in split] + [x.decode("utf-8", "replace") for x in coded.dictionary.to_pylist()] + [None] * clash, pa.string()),
                "word": pa.array([x[0].decode("utf-8", "replace") for x in split] + [None] * (all_of + clash), pa.string()),
                "h": pa.array(np.concatenate([keys[0][lead[often]].view(np.int64), np.zeros(all_of + clash, np.int64)])),
                "n": pa.array(np.concatenate([n[often], totals, np.zeros(clash, np.int64)])),
            }
        )

    rows = docs.mapInArrow(run, "part int, keys binary, counts binary, lengths binary, names binary")
    return cut(rows.groupBy("part").applyInArrow(count, "lang string, word string, h long, n long"))


def count_level(rows: DataFrame, width: int, path: str, least: int) -> DataFrame:
    """Packed rows by part -> h1, h2, .., a of the phrases that reach the least count; each part's file is written beside."""
    names = [f"h{i + 1}" for i in range(width)]

    def run(group: pa.Table) -> pa.Table:
        part = Part.build(*unpacked(group, width), least)
        part.write(f"{path}/{group['part'][0].as_py():06d}.mph")
        often = part.counts >= least
        return pa.table({n: pa.array(k[often].view(np.int64)) for n, k in zip(names, part.keys, strict=True)} | {"a": pa.array(part.counts[often])})

    return cut(rows.groupBy("part").applyInArrow(run, ", ".join(f"{n} long" for n in [*names, "a"])))


def read_counts(asks: DataFrame, path: str, parts: dict[int, int]) -> DataFrame:
    """asks: h1, h2, h3, length, what, level, k1, k2 -> h1, h2, h3, length, what, found: the count of the key (k1) or (k1, k2) of the level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for b in batches:
            level, at, k1, k2 = (b.column(i).to_numpy() for i in (5, 6, 7, 8))
            found = np.zeros(b.num_rows, np.int64)
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(level) != 0) | (np.diff(at) != 0)]))
            for i, j in zip(edges, [*edges[1:], b.num_rows], strict=True):
                if now != (level[i], at[i]):
                    now = (level[i], at[i])
                    part = Part.read(f"{path}/{level[i]}/{at[i]:06d}.mph")
                slots = part.find([k[i:j].view(np.uint64) for k in (k1, k2)[: level[i]]])
                if (slots < 0).any():
                    raise RuntimeError("a part of a frequent phrase has no slot")
                found[i:j] = part.counts[slots]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found)], ["h1", "h2", "h3", "length", "what", "found"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level, k1, k2 = b.column(5).to_numpy(), b.column(6).to_numpy().view(np.uint64), b.column(7).to_numpy().view(np.uint64)
            at = np.where(level == 1, key_hash([k1], 7) % np.uint64(parts[1]), key_hash([k1, k2], 7) % np.uint64(parts[2])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(at), *b.columns[6:]], [*b.schema.names[:6], "part", *b.schema.names[6:]])

    placed = asks.select("h1", "h2", "h3", "length", "what", "level", "k1", "k2").mapInArrow(place, "h1 long, h2 long, h3 long, length int, what int, level int, part int, k1 long, k2 long")
    dealt = placed.repartitionByRange("level", "part", "h1", "h2", "h3").sortWithinPartitions("level", "part")
    return dealt.mapInArrow(run, "h1 long, h2 long, h3 long, length int, what int, found long")


def scored(phrases: DataFrame, path: str, parts: dict[int, int]) -> DataFrame:
    """h1, h2, h3, length, a -> and l, r, score of the lowest cut (the first of equals)."""
    zero = F.lit(0).cast("long")

    def ask(what: int, level: int, *keys: str):
        return F.struct(F.lit(what).alias("what"), F.lit(level).alias("level"), F.col(keys[0]).alias("k1"), (F.col(keys[1]) if level == 2 else zero).alias("k2"))

    two = F.array(ask(0, 1, "h1"), ask(1, 1, "h2"))
    three = F.array(ask(0, 1, "h1"), ask(1, 2, "h2", "h3"), ask(2, 2, "h1", "h2"), ask(3, 1, "h3"))
    asks = phrases.select("h1", "h2", "h3", "length", F.explode(F.when(F.col("length") == 2, two).otherwise(three)).alias("ask")).select("h1", "h2", "h3", "length", "ask.*")
    found = read_counts(asks, path, parts)
    key = ["h1", "h2", "h3", "length"]
    wide = found.groupBy(*key).agg(*[F.max(F.when(F.col("what") == i, F.col("found"))).alias(f"f{i}") for i in range(4)])
    exact = "decimal(15,0)"

    def cut_at(k: int, left: str, right: str):
        value = F.expr(f"(cast(a as {exact}) * cast(a as {exact}) * cast({SCALE} as decimal(7,0))) div (cast({left} as {exact}) * cast({right} as {exact}))")
        return F.when(F.col(left).isNotNull(), F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))

    lowest = F.least(cut_at(1, "f0", "f1"), cut_at(2, "f2", "f3"))
    return phrases.join(wide, key).select(*key, "a", lowest.alias("cut")).select(*key, "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, part_rows: int = PART_ROWS) -> DataFrame:
    """docs (lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = new_path(spark, "collocations")
    parts = {1: max(1, n_bytes // (16 * part_rows))}
    for seed in range(8):
        words = count_words(docs, seed, parts[1], f"{path}/1", least)
        if not words.filter("lang IS NULL").limit(1).count():
            break
    else:
        raise RuntimeError("no seed tells all words apart")
    frequent = words.filter("word IS NOT NULL")
    totals = words.filter("word IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    parts |= {2: max(1, -(-n_words // part_rows)), 3: max(1, -(-n_words // part_rows))}
    word_bits = bit_set(spark, frequent, "h")

    def pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, seed):
            _, _, first, second, count = pairs_of(lot, word_bits.value)
            yield packed([lot.h[first], lot.h[second]], count, parts[2])

    def pack_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches, seed):
            *words_of, count = triples_of(lot, word_bits.value, pair_bits.value)
            yield packed([lot.h[w] for w in words_of], count, parts[3])

    schema = "part int, keys binary, counts binary"
    pairs = count_level(docs.mapInArrow(pack_pairs, schema), 2, f"{path}/2", least)

    def hash_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(h=pa.array(key_hash([b.column(i).to_numpy().view(np.uint64) for i in range(2)]).view(np.int64)))

    pair_bits = bit_set(spark, pairs.select("h1", "h2").mapInArrow(hash_pairs, "h long"), "h")
    triples = count_level(docs.mapInArrow(pack_triples, schema), 3, f"{path}/3", least)

    both = pairs.select("h1", "h2", F.lit(0).cast("long").alias("h3"), F.lit(2).alias("length"), "a").unionAll(triples.select("h1", "h2", "h3", F.lit(3).alias("length"), "a"))
    inside = triples.select(F.explode(F.array(F.struct("h1", "h2", "a"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))).alias("e")).select("e.*")
    longer = inside.groupBy("h1", "h2").agg(F.max("a").alias("longer")).withColumn("length", F.lit(2))
    kept = both.join(longer, ["h1", "h2", "length"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    ranked = cut(scored(cut(kept.select("h1", "h2", "h3", "length", "a")), path, parts))

    known = frequent.select("h", "lang", "word")
    word = {i: known.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")) for i in (2, 3)}
    first = ranked.join(known.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1")), "h1")
    order = [F.desc("score"), F.desc("a")]
    # all that may be among the first, ties included; their texts decide among these
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place")
    named = first.join(word[2], "h2").join(word[3].withColumn("length", F.lit(3)), ["h3", "length"], "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    last = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return last.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
