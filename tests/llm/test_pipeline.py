"""The pipeline's stages against plain versions, over documents with nulls, empty and repeated texts and extra columns."""

import inspect
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from test_text_operators import left_of, plain_passages, prose, raw, reference_ids, union

from pyspark.sql import functions as F

import corpus_pipeline
from tessaro.llm import compression_bands, ordinal_quality, queries, simhash_bk

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """sf0.001 and what it lacks: null and empty texts, repeated rows, one id with two texts, no id, shared passages."""
    rng = random.Random(31)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    passages = [prose(rng, 51) for _ in range(3)]
    rows += [(10_000 + k, prose(rng, 70) + ".\n" + passages[k % 3] + ".\n" + prose(rng, 50)) for k in range(12)]
    rows += [(20_000, None), (20_001, ""), (20_002, "  \n"), rows[0], rows[0], (rows[1][0], prose(rng, 90)), (None, prose(rng, 90)), (None, None)]
    rows += [(20_003, rows[3][1] + " more"), (20_004, rows[3][1]), (20_005, "and again " * 300), (20_006, prose(rng, 6000))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words long, digest string").repartition(3)


@pytest.fixture(scope="module")
def kept(spark, docs, tmp_path_factory):
    """What each stage kept, by name, and its input."""
    out, folder = {}, tmp_path_factory.mktemp("stages")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        stage(spark, now, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert after.columns == docs.columns
        out[name] = (now, after)
        now = after
    return out


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_rules(kept):
    before, after = (pairs(x) for x in kept["quality_rules"])
    zip_, bands = zstandard.ZstdCompressor(level=3), compression_bands.Bands()

    def good(text):
        words = raw(text).split()
        windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        hit = {k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
        return len(words) >= 20 and 100 * len(hit) <= 30 * len(words) and compression_bands.banded(raw(text), bands, zip_)[-1]

    assert after == Counter({r: n for r, n in before.items() if good(r[1])})


def test_quality_classifier(spark, kept):
    before, after = (pairs(x) for x in kept["quality_classifier"])
    model = ordinal_quality.train(queries.table(spark, SF, "documents"), ordinal_quality.graded(queries.table(spark, SF, "labels")))

    def tail(text):
        words = raw(text).lower().split()
        count = Counter(zlib.crc32(w) % 65536 for w in words)
        norm = math.sqrt(sum(count.values()))
        score = sum(math.sqrt(n) / norm * model.weights[k] for k, n in count.items())
        solid = b"".join(raw(text).split())
        lines = [x for x in raw(text).split(b"\n") if x.strip()]
        shape = [
            1.0, sum(chr(c).isalpha() or c >= 128 or c < 33 or c == 127 for c in solid) / len(solid), 4 * sum(c in b"#*$%&|<>" for c in solid) / len(solid), len(count) / len(words),
            4 * sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 - len(set(lines)) / max(1, len(lines)), min(math.log1p(len(words)), 12) / 12, min(len(solid) / len(words), 20) / 20,
        ]
        score += sum(w * x for w, x in zip(model.weights[65536:], shape))
        return 1 / (1 + math.exp(-(score - model.thresholds[0])))

    assert after == Counter({r: n for r, n in before.items() if tail(r[1]) >= 0.5})
    assert sum(before.values()) > sum(after.values())


def test_near_dedup(kept):
    before, after = (pairs(x) for x in kept["near_dedup"])
    prints = {t: simhash_bk.fingerprint(raw(t)) for _, t in before}
    names = sorted(set(prints.values()))
    of = union([(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 3], names)
    groups = defaultdict(list)
    for i, t in before:
        if i is not None:
            groups[of[prints[t]]].append((i, t))
    assert len(groups) + sum(n for (i, _), n in before.items() if i is None) == sum(after.values())
    for g, rows in groups.items():
        own = [r for r in after if r[0] is not None and of[prints[r[1]]] == g]
        assert len(own) == 1 and own[0] in rows and own[0][0] == min(i for i, _ in rows)


def test_passage_dedup(kept):
    before, after = kept["passage_dedup"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    want = Counter()
    for (i, words, _), n in plain_passages(rows, 50, True).items():
        want[(i, words)] += n
    assert left_of(after) == want
    assert after.filter("n_chars <> length(text)").count() == 0
    changed = sum(n for r, n in (pairs(before) - pairs(after)).items())
    assert changed >= 9  # of the passages in twelve documents, each stays in one


def test_packing(kept):
    before, after = kept["packing"]
    got = after.collect()
    assert after.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = Counter()
    for r in before.collect():
        ids = reference_ids(r.text, 0)
        for k, i in enumerate(range(0, len(ids), 2048)):
            part = ids[i : i + 2048]
            want[(r.doc_id, k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 2048) + 2


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_columns_of_any_name(spark, docs, name):
    """Names that the stages use within: rows and columns as without them."""
    names = ["__own", "__i", "__d", "__digest", "__id", "__whole", "__runs", "__at", "__word", "__bits", "whole", "runs", "id", "row", "own", "fp", "node", "component", "group", "least", "I", "D"]
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    plain, wide = STAGES[name](spark, docs, SF), STAGES[name](spark, more, SF)
    assert wide.columns == more.columns
    assert Counter(map(tuple, wide.select(docs.columns).collect())) == Counter(map(tuple, plain.collect()))
    assert {tuple(r) for r in wide.select(names).collect()} == {tuple(range(len(names)))}


@pytest.mark.parametrize("name", list(STAGES))
def test_a_very_long_text(spark, name):
    """A text of two million words stands among others, and is read to its end."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
    long = " ".join(rng.choice(words) for _ in range(2_000_000))
    end = " ".join(long.split(" ")[-60:])
    rows = [(1, long, "en", "s", len(long)), (2, prose(rng, 80) + " " + end + " " + prose(rng, 40), "en", "s", 1), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = STAGES[name](spark, docs, SF).collect()
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id == 1) == len(reference_ids(long, 0))
    elif name == "passage_dedup":
        # of the two places of the passage one stays
        assert sorted((end in r.text) for r in got if r.text) == [False, True]
    else:
        assert {r.doc_id: r.text for r in got}.get(1) in (long, None)
        assert name != "near_dedup" or {r.doc_id for r in got} == {1, 2, 3}
        zip_, bands = zstandard.ZstdCompressor(level=3), compression_bands.Bands()
        assert name != "quality_rules" or {r.doc_id for r in got} == {i for i, t in ((1, long), (2, rows[1][1])) if compression_bands.banded(raw(t), bands, zip_)[-1]}


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run(spark, tmp_path):
    now = queries.table(spark, SF, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    plain = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert plain(corpus_pipeline.run(spark, SF)) == plain(now) != []


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 14)}


def test_very_long_text(spark):
    """A text of eight megabytes among others goes through every text operator."""
    rng = random.Random(41)
    base = prose(rng, 40_000)
    long = " ".join(base[i : i + 190_000] for i in range(0, 40)) [: 8 << 20]
    rows = [(1, long), (2, prose(rng, 80)), (3, long[5000:9000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tessaro.llm import best_fit_packing, license_scan, piece_codec, radix_dedup, toxicity_knn
    from tessaro.llm.queries import word_bpe

    import public_tokenizers

    assert len(raw(long)) > 4 << 20
    assert compression_bands.quality_rules(docs).count() == 3
    assert simhash_bk.simhash_groups(docs).count() == 3
    assert {r.doc_id: r.n_words for r in license_scan.license_scan(docs).collect()}[2] == len(raw(rows[1][1]).translate(radix_dedup.PLAIN).split())
    got = {r.doc_id: r for r in radix_dedup.remove_repeats(docs, with_text=False, passages=radix_dedup.PASSAGES).collect()}
    assert got[3].n_removed == got[3].n_bytes and got[2].n_removed == 0 and got[1].n_removed > 4 << 20
    pieces = best_fit_packing.pack(best_fit_packing.token_pieces(docs, word_bpe(), end_id=0)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == len(reference_ids(long, 0))
    assert piece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 3
    assert toxicity_knn.toxicity(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")).count() == 3
