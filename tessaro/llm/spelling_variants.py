"""Spelling variants: words at one edit from each other, each with the much more frequent word that it may stand for.

A word's mask has a bit for each letter, set if the letter stands in it an odd number of times. A replaced letter flips two bits,
an inserted or deleted one flips one. The bits are dealt to three bands, so that the masks of two near words agree on at least one
band: words meet by an equi-join on (band, its bits, length), a word of length n with words of length n and n + 1. Pairs are kept
at the first band that they agree on, if the masks differ in exactly two bits (same length) or one, and then verified by a
Levenshtein distance of one. A bucket of more than BUCKET words is split by the same rule on the 60 bits that it doesn't share:
at most two of them flip, so that one of three sub-bands agrees. Nothing but built-in expressions runs here.

Forms point to words of at least five times the occurrences, so chains of forms are no longer than the logarithm of the largest
count; roots are found by doubling.

Defined results: null texts have no words; a null doc_id counts as an empty string in the hashed text; repeated rows count
again (same hash, same deletion); an empty table gives no rows; ties between forms go to the smallest word in code-point order.
Texts and words of any length are read whole. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import cut

#: Letters of a run: ASCII and U+00C0 to U+00FF.
NO_LETTERS = "[^A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least so many times the occurrences.
TIMES = 5
#: One hash in so many loses a letter of its run.
EVERY = 199
BANDS = 3
#: Words of a bucket from which it is split.
BUCKET = 2048
#: Every third bit of a band of 30.
THIRD = sum(1 << i for i in range(0, 30, 3))


def lower_ascii(run: Column) -> Column:
    """Lower case of A-Z alone."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, capitals, capitals.lower()))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, some of them with a letter deleted, that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.split("text", NO_LETTERS)).alias("run"))
    runs = runs.filter(F.char_length("run") >= LEAST_LENGTH).select("doc", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    place = F.pmod("h", F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = hashed.select(F.when(F.pmod("h", F.lit(EVERY)) == 0, without).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def with_masks(words: DataFrame) -> DataFrame:
    """The bands of each word's parity mask, m0 to m2: the letter number i (a-z, then U+00C0 on) has bit i / 3 of band i % 3."""
    letters = words.withColumn("letters", F.transform(F.split("word", ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - ord("a")).otherwise(F.ascii(c) - 0xC0 + 26)))
    masks = {f"m{b}": F.expr(f"aggregate(filter(letters, x -> x % {BANDS} = {b}), 0, (m, x) -> m ^ shiftleft(1, x div {BANDS}))") for b in range(BANDS)}
    return letters.withColumns(masks | {"size": F.char_length("word")}).drop("letters")


def sub_bands(band: str) -> Column:
    """Three sub-bands of the bits of the two other bands, as an array of (sub, rest)."""
    others = [[f"m{b}" for b in range(BANDS) if b != own] for own in range(BANDS)]
    each = [
        F.array(*[F.struct(F.lit(j).alias("sub"), F.expr(f"shiftleft(cast({x} & {THIRD << j} as bigint), 30) | cast({y} & {THIRD << j} as bigint)").alias("rest")) for j in range(3)])
        for x, y in others
    ]
    return F.when(F.col(band) == 0, each[0]).when(F.col(band) == 1, each[1]).otherwise(each[2])


def in_buckets(words: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Words by (band, bits, span, sub, rest): the shorter or first of a pair by its own length, the other by its length or one less."""
    banded = words.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("bits")) for b in range(BANDS)])).alias("at")).select("*", "at.*").drop("at")
    key = ["band", "bits", "span"]
    first = banded.withColumn("span", F.col("size"))
    second = banded.withColumn("span", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    hot = cut(second.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > bucket))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")))

    def split(rows: DataFrame) -> DataFrame:
        marked = rows.join(hot, key, "left")
        return marked.select("*", F.explode(F.when(F.col("members").isNotNull(), sub_bands("band")).otherwise(whole)).alias("at")).select("*", "at.*").drop("at", "members")

    return split(first), split(second)


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Words with masks -> a, a_n, b, b_n: each pair at one edit, once."""
    first, second = in_buckets(words, bucket)
    key = ["band", "bits", "span", "sub", "rest"]
    a, b = first.alias("a"), second.alias("b")
    flips = reduce(lambda x, y: x + y, [F.bit_count(F.expr(f"a.m{i} ^ b.m{i}")) for i in range(BANDS)])
    same = F.col("a.size") == F.col("b.size")
    earlier = [(F.col("a.band") > i) & (F.col(f"a.m{i}") == F.col(f"b.m{i}")) for i in range(BANDS - 1)]

    def agree(j: int) -> Column:
        """Whether sub-band j agrees, which stands before the one that the pair has met in."""
        other = [F.expr(f"((a.m{i} ^ b.m{i}) & {THIRD << j}) = 0") | (F.col("a.band") == i) for i in range(BANDS)]
        return (F.col("a.sub") > j) & reduce(lambda x, y: x & y, other)

    met_before = reduce(lambda x, y: x | y, [*earlier, agree(0), agree(1)])
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key])
    likely = (same & (flips == 2) & (F.col("a.word") < F.col("b.word"))) | (~same & (flips == 1))
    found = a.join(b, on & likely & ~met_before & (F.levenshtein("a.word", "b.word", 1) == 1))
    return found.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the end of each chain, whose known length doubles with each round."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n: a row for each word."""
    words = cut(count_words(docs))
    pairs = near_pairs(cut(with_masks(words)), bucket)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    sides = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    shows = -F.col("best.least") >= TIMES * F.col("n")
    joined = words.join(best, "word", "left").select(
        "word",
        F.when(shows, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(shows, -F.col("best.least")).alias("form_n"),
    )
    joined = cut(joined)
    ends = roots(joined.filter("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
