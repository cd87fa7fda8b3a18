"""The text operators against plain versions, over texts chosen for their edges."""

import base64
import hashlib
import math
import random
import re
import string
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from tokenizers import Tokenizer

from tessaro.llm import best_fit_packing, compression_bands, license_scan, ordinal_quality, piece_codec, radix_dedup, simhash_bk, token_store, toxicity_knn
from tessaro.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, n_words long, digest string, kept string, key long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    shared = prose(rng, 120)
    long = prose(rng, 9000)
    out = [prose(rng, rng.randint(5, 300)) for _ in range(30)]
    out += ["", None, " \n\t ", "one", "two words", "a b c", "MIT License", "x" * 3000, "ab " * 900, "line one here\n" * 60]
    out += [out[0], out[0], out[1] + " extra", out[2].upper(), shared, prose(rng, 40) + " " + shared + " " + prose(rng, 50), shared + prose(rng, 10), long, long[5000:9000]]
    out += ["日本語のテキスト " * 50, "😀" * 500, "MIT license. The Apache License, version 2; GNU General Public License mit license", "###$$$ %%% <a> |b| " * 20]
    out += ["He said <|endoftext|> and <|startoftext|>s it's done ok é Σ ΟΔΟΣ \x1c x", "▁ marks ▁▁  two   three    " + " " * 20]
    rows = list(enumerate(out))
    return [*rows, (7, out[7]), (None, out[3]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "d", "k", 5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


def raw(text):
    return (text or "").encode()


def test_quality_rules(docs, rows, none):
    zip_, bands = zstandard.ZstdCompressor(level=3), compression_bands.Bands()

    def plain(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = len(words)
        windows = Counter(tuple(words[j : j + 8]) for j in range(n - 7))
        hit = {k for j in range(n - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = n < 20 or 100 * len(hit) > 30 * n
        good = compression_bands.banded(text.encode(), bands, zip_)[-1]
        return i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, good and not failed

    got = compression_bands.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert by_row(got) == Counter(plain(*r) for r in rows)
    assert compression_bands.quality_rules(none).count() == 0
    kept = compression_bands.keep_good(docs)
    assert kept.columns == docs.columns and by_row(kept.select("doc_id")) == by_row(got.filter("kept").select("doc_id"))


def test_compression_bands_reject_repetition_and_noise():
    zip_, bands = zstandard.ZstdCompressor(level=3), compression_bands.Bands()
    rng = random.Random(5)
    assert not compression_bands.banded(b"spam and eggs " * 200, bands, zip_)[-1]
    assert not compression_bands.banded(bytes(rng.randrange(256) for _ in range(5000)), bands, zip_)[-1]
    assert compression_bands.banded(prose(rng, 500).encode(), bands, zip_)[-1]
    mixed = prose(rng, 3000).encode() + b"spam and eggs " * 1000
    assert compression_bands.banded(mixed, bands, zip_)[2] > 0


def valid_noise(rng: random.Random, kind: str, n: int) -> bytes:
    raw_ = rng.randbytes(n)
    if kind == "base64":
        return base64.encodebytes(raw_)[:n]
    if kind == "hex":
        return b" ".join(raw_.hex().encode()[i : i + 64] for i in range(0, n, 64))[:n]
    signs = string.ascii_letters + " " * 10 if kind == "letters" else "".join(map(chr, range(32, 127)))
    return "".join(rng.choice(signs) for _ in range(n)).encode()


@pytest.mark.parametrize("kind", ["base64", "hex", "letters", "printable"])
def test_compression_bands_reject_noise_of_valid_text(kind):
    zip_, bands, rng = zstandard.ZstdCompressor(level=3), compression_bands.Bands(), random.Random(6)
    for n in (600, 900, 1400, 3000, 5400, 12_000, 16_000, 40_000):
        assert not compression_bands.banded(valid_noise(rng, kind, n), bands, zip_)[-1], n
    clean = prose(rng, 600).encode()[:2500]
    assert compression_bands.banded(clean, bands, zip_)[-1]
    # a short last part is a chunk
    text = prose(rng, 3000).encode()[:4096]
    assert compression_bands.banded(text + valid_noise(rng, kind, 3000), bands, zip_)[1:] == (2, 1, False)


def test_compression_bands_keep_text_of_three_bytes_a_letter():
    rng = random.Random(7)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(500)).encode()
    assert 1.2 < len(text) / len(zstandard.ZstdCompressor(level=3).compress(text)) < 1.5
    assert compression_bands.banded(text, compression_bands.Bands(), zstandard.ZstdCompressor(level=3))[-1]


def test_license_base_and_templates(spark, docs, rows, none):
    def plain(i, text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        starts, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        return i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))

    got = license_scan.license_scan(docs)
    assert by_row(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == Counter(plain(*r) for r in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got.collect())
    assert license_scan.license_scan(none).count() == 0
    texts_ = [(k, "prefix words here. " + t.capitalize() + ". code follows " * 30) for k, (t, _) in enumerate(license_scan.TEMPLATES.values())]
    found = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert all(label in found[k] for k, label in enumerate(license_scan.TEMPLATES))
    half = [(0, "redistribution and use in source and binary forms is fun")]
    assert license_scan.license_scan(spark.createDataFrame(half, "doc_id long, text string")).first().labels == ""


def test_license_of_a_file_does_not_depend_on_the_other_licenses_in_it(spark):
    full = {k: t for k, (t, _) in license_scan.TEMPLATES.items()}
    # MIT's words are the commonest of the corpus, and the file has no base phrase of MIT
    texts_ = [(0, ". code follows. ".join(full.values())), *((k, full["mit"] + f" file {k}") for k in range(1, 200))]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert set(got[0].labels.split(",")) == set(full) and got[1].labels == "mit"


def test_license_labels_tell_notices_apart(spark):
    """Each notice alone among other text has its own label, and none that it doesn't name."""
    texts_ = [(k, f"/* file {k}\n" + t + "*/ int main() { return 0; } " * 40) for k, (t, _) in enumerate(license_scan.TEMPLATES.values())]
    texts_ += [(100 + k, "the weather was fine and the work went on " * 50) for k in range(30)]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.license_scan(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    for k, (label, (text, _)) in enumerate(license_scan.TEMPLATES.items()):
        words = [w.decode() for w in license_scan.words_of(text.encode())]
        named = {other for other, (_, phrases) in license_scan.TEMPLATES.items() if any(f" {p} " in f" {' '.join(words)} " for p in phrases)}
        base = {v for p, v in license_scan.BASE.items() if f" {p} " in f" {' '.join(words)} "}
        assert label in got[k] and got[k] <= named | base, label
    assert all(got[100 + k] == {""} for k in range(30))


def test_license_share_is_the_greatest_over_all_places():
    rng = random.Random(4)
    plain = {k: [w.decode() for w in license_scan.words_of(t.encode())] for k, (t, _) in license_scan.TEMPLATES.items()}
    words = sorted({w for t in plain.values() for w in t})
    counts = {w.encode(): rng.randrange(1000) for w in words}
    index = license_scan.Index(license_scan.TEMPLATES, counts, 1000)
    for _ in range(40):
        own = [w for t in rng.sample(list(plain.values()), 4) for w in t if rng.random() < 0.6] + rng.choices(words, k=60)
        places = defaultdict(list)
        for i, w in enumerate(own):
            places[w.encode()].append(i)
        for label, t in plain.items():
            hits = [sum(index.idf[w.encode()] for i, w in enumerate(t) if 0 <= at + i < len(own) and own[at + i] == w) for at in range(-len(t), len(own))]
            assert index.share(label, places) == pytest.approx(max(hits) / index.total[label])


def union(pairs, names):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, rows, none):
    own = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    pairs = [(a, b) for a, x in own for b, y in own if a < b and (x ^ y).bit_count() <= 3]
    group = union(pairs, {i for i, _ in own})
    got = simhash_bk.simhash_groups(docs).filter("doc_id IS NOT NULL")
    assert by_row(got.select("doc_id", "fingerprint", "component_id", "kept")) == Counter((i, f"{f:016x}", group[i], group[i] == i) for i, f in own)
    assert simhash_bk.simhash_groups(none).count() == 0
    kept = simhash_bk.keep_one(docs).filter("doc_id IS NOT NULL")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i in group if group[i] == i})


def test_keep_one_decides_by_row_where_ids_repeat(spark):
    rng = random.Random(13)
    x, y, z = (prose(rng, 80) for _ in range(3))
    keep = lambda rows: sorted((r.doc_id, r.text) for r in simhash_bk.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert keep([(3, y), (5, y), (5, x), (6, x)]) == sorted([(3, y), (5, x)])
    assert keep([(5, x), (5, y), (5, z), (5, z), (6, y)]) == sorted([(5, x), (5, y), (5, z)])


def test_bk_trees_find_every_link_of_clustered_fingerprints(spark):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(25)}
    values = sorted(values)
    names = list(range(len(values)))
    pairs = [(a, b) for a in names for b in names[:a] if (values[a] ^ values[b]).bit_count() <= 3]
    want = union(pairs, names)
    distinct = spark.createDataFrame([(simhash_bk.signed(v), k) for k, v in enumerate(values)], "fp long, rep long")
    from tessaro.llm.components import components

    found = {r.node: r.component for r in components(simhash_bk.fingerprint_links(distinct)).collect()}
    assert {k: found.get(k, k) for k in names} == want
    trees = simhash_bk.Trees(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    hits = {(int(a), int(b)) for q, f in trees.within(np.arange(len(values)), 3, rows=64) for a, b in zip(q, f)}
    assert hits == set(pairs)


def test_components_of_a_long_path_and_a_hub(spark):
    from tessaro.llm.components import components

    path = [(k, k + 1) for k in range(100, 160)]
    hub = [(5, k) for k in range(1000, 1400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + hub + [(7, 7)], "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5} | {k: 5 for k in range(1000, 1400)}
    # names are any longs, such as fingerprints
    big = 2**63 - 100
    got = components(spark.createDataFrame([(big + 2 * k, big + 2 * k + 1) for k in range(40)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {big + k: big + k - k % 2 for k in range(80)}


def plain_repeats(rows, width):
    count = Counter()
    for _, t in rows:
        b = raw(t)
        count.update(b[j : j + width] for j in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = raw(t)
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if count[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def plain_passages(rows, width, keep_first):
    """By row: the words left, and how many went, of windows of whole words that stand anywhere else."""
    order = {}
    for i, t in rows:
        digest = hashlib.md5(raw(t)).digest()
        order.setdefault(digest, []).append(i)
    words = {hashlib.md5(raw(t)).digest(): [raw(t)[m.start() : m.end()].lower() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw(t))] for _, t in rows}
    places = defaultdict(list)
    for digest in sorted(order):
        w = words[digest]
        for j in range(len(w) - width + 1):
            places[tuple(w[j : j + width])].append((digest, j))
    out = []
    for i, t in rows:
        digest = hashlib.md5(raw(t)).digest()
        w, own = words[digest], order[digest]
        rep = min((x for x in own if x is not None), default=None)
        gone = bytearray(len(w))
        for j in range(len(w) - width + 1):
            found = places[tuple(w[j : j + width])]
            copied = len(own) > 1 and (i != rep if keep_first else True)
            if copied or (found[0] != (digest, j) if keep_first else len(found) > 1):
                gone[j : j + width] = b"\1" * width
        out.append((i, tuple(x for x, g in zip(w, gone) if not g), sum(gone)))
    return Counter(out)


KINDS = [radix_dedup.BYTES, radix_dedup.Kind(60, 16)]


@pytest.mark.parametrize("kind, group", [(KINDS[0], 1 << 14), (KINDS[1], 4)])
def test_radix_dedup(docs, rows, none, kind, group, monkeypatch):
    got = radix_dedup.remove_repeats(docs, kind, group, passages=radix_dedup.PASSAGES)
    assert by_row(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == plain_repeats(rows, kind.width)
    for r in got.collect():
        assert r.n_removed == sum(s.stop - s.start for s in r.spans) and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert by_row(got.select("doc_id", "n_passage_words")) == Counter((i, n) for (i, _, n), c in plain_passages(rows, 50, False).items() for _ in range(c))
    assert radix_dedup.remove_repeats(none, kind, group, passages=radix_dedup.PASSAGES).count() == 0


def test_radix_pieces_of_long_texts(monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 3000).encode()
    for kind in (radix_dedup.Kind(60, 16), radix_dedup.Kind(12, 3, words=True)):
        whole = list(radix_dedup.pieces(text, kind))
        monkeypatch.setattr(radix_dedup, "BLOCK", 500)
        monkeypatch.setattr(radix_dedup, "SPLIT", 777)
        parts = list(radix_dedup.pieces(text, kind))
        assert len(whole) == 1 and len(parts) > 2 and max(len(c) for _, c in parts) <= 500 + kind.width - 1
        assert all((whole[0][1][i : i + len(c)] == c).all() for i, c in parts)
        found = {(int(p) + i, int(g)) for i, c in parts for n, g, p, *_ in zip(*radix_dedup.anchors(c, [0, len(c)], kind, False))}
        assert found == {(int(p), int(g)) for n, g, p, *_ in zip(*radix_dedup.anchors(whole[0][1], [0, len(whole[0][1])], kind, False))}
        monkeypatch.undo()


def test_radix_split_passes_of_a_hot_passage(spark):
    rng = random.Random(2)
    passage = prose(rng, 40)
    rows = [(k, prose(rng, rng.randint(3, 20)) + " " + passage[rng.randint(0, 20) :] + " " + prose(rng, rng.randint(3, 20))) for k in range(60)]
    got = radix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), radix_dedup.Kind(48, 12), 5, with_text=False)
    assert by_row(got.drop("spans")) == plain_repeats(rows, 48)


def left_of(df):
    plain = lambda t: tuple(radix_dedup.PLAIN and raw(t).translate(radix_dedup.PLAIN).split())
    return Counter((r.doc_id, plain(r.text)) for r in df.collect())


@pytest.mark.parametrize("kind, group", [(radix_dedup.PASSAGES, 1 << 14), (radix_dedup.Kind(9, 3, words=True), 4)])
def test_strip_repeats_keeps_the_first_place(docs, rows, none, kind, group):
    out = radix_dedup.strip_repeats(docs, kind, group)
    assert out.schema == docs.schema and out.count() == len(rows)
    want = Counter()
    for (i, words, _), c in plain_passages(rows, kind.width, True).items():
        want[(i, words)] += c
    assert left_of(out) == want
    assert radix_dedup.strip_repeats(none, kind, group).count() == 0


def test_strip_repeats_of_passages_just_over_fifty_words(spark):
    """Passages of 51 words, some under 300 bytes, in up to 40 documents: one copy of each is left, and all other text stays."""
    rng = random.Random(4)
    passages = [prose(rng, 51) for _ in range(5)]
    loud = [re.sub("[a-z]", lambda m: m[0].upper(), p) for p in passages]
    rows = [(k, prose(rng, 80) + ".\n" + (loud if k % 2 else passages)[k % 5] + "\n" + prose(rng, 60)) for k in range(40)]
    out = {r.doc_id: r.text for r in radix_dedup.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for p in passages:
        words = p.lower()
        assert sum(words in t.lower() for t in out.values()) == 1
    for k, t in rows:
        assert out[k].startswith(t[: t.index("\n")]) and out[k].endswith(t[t.rindex("\n") :])


def reference_ids(text, end):
    return [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, docs, rows, none):
    store = token_store.write_store(docs, new_path(spark, "store"), WORD_BPE, end_id=2, shards=3, keys_a_part=16)
    entries = store.lookup(store.entries.select("doc_id", "occurrence"))
    got = store.read(entries, ids=True).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, raw(r[1])))
    want, at = [], 0
    for i, t in ordered:
        ids = reference_ids(t, 2)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert all(crc(np.array(r.ids, np.int64)) == r.ids_crc32 for r in got)
    unknown = spark.createDataFrame([(10**9 + k, 0) for k in range(500)], "doc_id long, occurrence int")
    assert store.lookup(unknown).count() == 0
    empty = token_store.write_store(none, new_path(spark, "store"), WORD_BPE, shards=2)
    assert empty.manifest["n_docs"] == 0 and empty.read(empty.lookup(empty.entries.select("doc_id", "occurrence"))).count() == 0


def test_minimal_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(4).choice(2**62, 20_000, replace=False).astype(np.uint64)
    hashed = token_store.MinimalHash.build(keys)
    assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_store.MinimalHash.build(np.array([1, 2, 2], np.uint64))


def test_best_fit_packing(docs, rows, none):
    pieces = best_fit_packing.token_pieces(docs, WORD_BPE, end_id=0, capacity=256)
    packed = best_fit_packing.pack(pieces, capacity=256, fan_in=2).collect()
    want = Counter()
    for i, t in rows:
        ids = reference_ids(t, 0)
        for k, j in enumerate(range(0, len(ids), 256)):
            want[i, k, j, len(ids[j : j + 256]), crc(ids[j : j + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 256
    total = sum(r.length for r in packed)
    assert len(bins) <= 1.1 * total / 256 + 1
    assert best_fit_packing.pack(best_fit_packing.token_pieces(none, WORD_BPE)).count() == 0


def test_packing_merges_underfull_bins_of_partitions(spark):
    rows = [(k, 0, 0, 700, 0) for k in range(64)] + [(100 + k, 0, 0, 300, 0) for k in range(64)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long").repartition(32)
    packed = best_fit_packing.pack(pieces, capacity=1000, fan_in=4)
    assert packed.select("sequence_id").distinct().count() <= 68 and packed.count() == 128


def test_sentencepiece(docs, rows, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = piece_codec.encode(docs, path)
    assert Counter((r.doc_id, tuple(r.ids), r.parity) for r in coded.collect()) == Counter((i, tuple(sp.encode(t or "")), True) for i, t in rows)
    back = piece_codec.decode(coded, path)
    assert by_row(back) == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in rows)
    assert all(r.parity and r.round_trip for r in piece_codec.round_trip(docs, path).collect())
    assert piece_codec.round_trip(none, path).count() == 0


def written_model(pieces, spec):
    """A model protobuf put together by hand."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    def piece(text, score, kind):
        return part(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)

    trainer = b"".join(varint(n << 3) + varint(v) for n, v in spec.items())
    normalizer = part(1, b"identity") + b"\x18\x01\x20\x01"
    return b"".join(part(1, piece(*p)) for p in pieces) + part(2, trainer) + part(3, normalizer)


def test_unigram_model_is_rebuilt():
    words = ["▁alpha", "▁beta", "▁gam", "ma", "▁delta", "▁", "a", "b", "e", "t", "l", "p", "h", "g", "m", "d", "be", "ta", "al", "pha", "▁al"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256))]
    pieces += [(w, -1.0 - 0.37 * k, 1) for k, w in enumerate(words)]
    c = piece_codec.Codec(written_model(pieces, {3: 1, 35: 1, 40: 0}))
    assert not c.parts and c.model.kind == piece_codec.UNIGRAM and c.model.byte_fallback and c.model.squeeze
    for text in ("alpha gamma", "beta é", "", "  delta  alpha ", "albetadelta ma 日"):
        ids, ok = c.encode([text.encode()])[0]
        assert ok, text
        assert np.frombuffer(ids, "<u4").tolist() == c.original.encode(text)


@pytest.mark.parametrize("grades", [2, 3, 4])
def test_ordinal_fit_reaches_the_least_loss(grades):
    """The penalised likelihood, row by row in plain Python, at the fit and at the end of a plain descent by finite differences."""
    rng = np.random.default_rng(grades)
    bits, n, l2 = 3, 120, 1e-2
    size = (1 << bits) + ordinal_quality.SHAPE
    x = rng.standard_normal((n, size)) * (rng.random((n, size)) < 0.6)
    true = rng.standard_normal(size)
    grade = np.digitize(x @ true + rng.logistic(size=n), np.linspace(-1.5, 1.5, grades - 1))
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]

    def loss(w, cuts):
        total = 0.0
        for r, g in zip(x, grade, strict=True):
            above = [1.0, *(1 / (1 + math.exp(-max(-40.0, min(40.0, float(r @ w) - c)))) for c in cuts), 0.0]
            total -= math.log(max(above[g] - above[g + 1], 1e-9))
        return total / n + l2 / 2 * float(w @ w)

    def quick(p):
        cuts = np.concatenate([p[size : size + 1], p[size] + np.cumsum(np.exp(p[size + 1 :]))])
        above = 1 / (1 + np.exp(-np.clip((x @ p[:size])[:, None] - cuts[None, :], -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        return float(-np.log(np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-9)).mean() + l2 / 2 * p[:size] @ p[:size])

    p, step = np.concatenate([np.zeros(size), [-1.0], np.zeros(grades - 2)]), 1.0
    for _ in range(1500):
        now = quick(p)
        slope = np.array([(quick(p + e) - quick(p - e)) / 2e-6 for e in np.eye(len(p)) * 1e-6])
        while step > 1e-6 and quick(p - step * slope) > now - step * slope @ slope / 4:
            step /= 2
        if step <= 1e-6 or np.abs(slope).max() < 1e-5:
            break
        p, step = p - step * slope, step * 2
    best = quick(p)
    model = ordinal_quality.fit(rows, grade, bits, l2=l2)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == grades - 1
    found = loss(model.weights, model.thresholds)
    assert best - 1e-6 <= found <= best + 2e-3
    cuts = np.concatenate([p[size : size + 1], p[size] + np.cumsum(np.exp(p[size + 1 :]))])
    assert loss(p[:size], cuts) == pytest.approx(best)
    # and nothing near the fit is better by more than that
    for _ in range(20):
        assert loss(model.weights + 0.05 * rng.standard_normal(size), model.thresholds) >= found - 2e-3


def test_ordinal_quality_on_held_out_rows(spark, none):
    rng = random.Random(8)
    good, bad = [prose(rng, 1).split()[0] + "g" for _ in range(50)], [prose(rng, 1).split()[0] + "b" for _ in range(50)]

    def text(grade):
        return " ".join(rng.choice(good if rng.random() < (0.1, 0.5, 0.9)[grade] else bad) for _ in range(60))

    grades = [k % 3 for k in range(900)]
    docs = spark.createDataFrame([(k, text(g)) for k, g in enumerate(grades)] + [(900, None), (901, ""), (5, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(grades[:600])] + [(None, 1), (3, None)], "doc_id long, grade int")
    model = ordinal_quality.train(docs, labels)
    assert model.grades == 3 and np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in ordinal_quality.score(docs, model).collect() if r.doc_id != 5}
    held = range(600, 900)
    assert np.mean([got[k].predicted == grades[k] for k in held]) > 0.9
    assert all(0 <= got[k].tail <= 1 and 0 <= got[k].expected_grade <= 2 for k in got) and {900, 901} <= set(got)
    assert ordinal_quality.score(none, model).count() == 0
    one = ordinal_quality.train(docs, labels.filter("grade = 2"))
    assert ordinal_quality.score(docs, one).filter("kept").count() == docs.count()


@pytest.mark.parametrize("grades", [2, 3])
def test_ordinal_quality_keeps_a_large_sample_in_tasks(spark, monkeypatch, grades):
    """Long texts, more features than the driver takes: it gets sums of slopes alone, and the model is that of the same rows at hand."""
    rng, bits = random.Random(grades), 6
    words = [prose(rng, 1).split()[0] + str(k) for k in range(400)]
    docs = [(k, " ".join(rng.choice(words[(k % grades) * 60 :]) for _ in range(300))) for k in range(900)] + [(900, None), (901, "")]
    labels = [(k, k % grades) for k in range(600)] + [(900, 0), (901, 1), (7, 0)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int")
    held = sorted({(k, g) for k, g in labels})
    rows = [ordinal_quality.features(raw(dict(docs)[k]), bits) for k, _ in held]
    rows = [(a, v.astype(np.float32).astype(np.float64)) for a, v in rows]
    want = ordinal_quality.fit(rows, np.array([g for _, g in held]), bits)
    sent, most = [], 4 * 8 * ((1 << bits) + ordinal_quality.SHAPE + grades)
    assert 8 * sum(len(a) for a, _ in rows) > 50 * most
    kind, collect = type(frames[0]), type(frames[0]).toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: [out := collect(self), sent.append(out.nbytes)][0])
    monkeypatch.setattr(ordinal_quality, "LOCAL", 1000, raising=False)
    got = ordinal_quality.train(*frames, bits=bits)
    assert len(sent) >= 1 and max(sent) <= 2 * most
    assert got.grades == want.grades == grades
    assert np.allclose(got.weights, want.weights, atol=1e-6) and np.allclose(got.thresholds, want.thresholds, atol=1e-6)
    monkeypatch.undo()
    near = ordinal_quality.train(*frames, bits=bits)
    assert np.array_equal(near.weights, want.weights) and np.array_equal(near.thresholds, want.thresholds)


def test_toxicity_block_max_is_exact_and_separates(spark, none):
    rng = random.Random(9)
    examples = [({rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}, k % 2, k) for k in range(500)]
    index = toxicity_knn.BlockMaxIndex.build(np.array([1 + rng.random() for _ in range(40)]), examples)
    dense = np.zeros((500, 40))
    for i, d in enumerate(index.doc_id.tolist()):
        t, w = index.vector(examples[d][0])
        dense[i, t] = w
    for c, _, _ in examples[:60]:
        t, q = index.vector(c)
        cosine = dense[:, t] @ q
        want = sorted(range(500), key=lambda j: (-round(cosine[j], 12), j))[:16]
        at, found = index.nearest(c, 16)
        assert np.allclose(np.sort(found), np.sort(cosine[want]))
    rows = [(k, prose(rng, 60) + (" nastyword vileness" if k % 4 == 0 else "")) for k in range(800)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_knn.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in range(800) if got[k].held_out]) > 0.98
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score
    assert toxicity_knn.toxicity(docs, labels.limit(0)).filter("score > 0.6").count() == 0
    assert toxicity_knn.toxicity(none, labels).count() == 0


def test_toxic_words_stay_beside_many_copies_of_a_long_clean_text(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    long = " ".join(word(8) for _ in range(1200))
    rows = [(k, 1, f"nasty{k % 10}word " + " ".join(word(5) for _ in range(20))) for k in range(100)]
    rows += [(k, 0, " ".join(word(5) for _ in range(20))) for k in range(100, 500)]
    rows += [(k, 0, long) for k in range(500, 1200)]
    sample = spark.createDataFrame(rows, "doc_id long, y int, text string")
    voter = toxicity_knn.train(sample.select("doc_id", "text"), sample.select("doc_id", "y"))
    assert {f"nasty{k}word".encode() for k in range(10)} <= set(voter.vocabulary)
    assert not set(long.encode().split()) & set(voter.vocabulary)


def test_simhash_shards_are_split_and_lose_no_link(spark):
    """A ball of like fingerprints above the limit of a shard: the same groups as by brute force, from bounded shards."""
    from tessaro.llm.components import components

    rng = random.Random(17)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)})
    names = list(range(1, len(values) + 1))
    pairs = [(names[a], names[b]) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    distinct = spark.createDataFrame([(simhash_bk.signed(v), n) for v, n in zip(values, names)], "fp long, rep long")
    sizes = [r["count"] for r in simhash_bk.sharded(distinct, 40).groupBy("shard").count().collect()]
    assert max(sizes) <= 40
    found = {r.node: r.component for r in components(simhash_bk.fingerprint_links(distinct, limit=40)).collect()}
    assert {k: found.get(k, k) for k in names} == union(pairs, names)


def test_token_store_files_of_repeated_tasks(tmp_path):
    for old, new in ((b"abc", b"abc"), (b"abcd", b"abc"), (None, b"abc")):
        path = f"{tmp_path}/x/{old}"
        if old:
            token_store.write_file(path, old)
        token_store.write_file(path, new)
        assert token_store.read_file(path) == new

    class Strict:
        """A store whose rename fails where the target is there; another attempt comes first."""

        def __init__(self):
            self.files = {"own": b"abc"}

        def get_file_info(self, paths):
            kind = lambda p: token_store.pafs.FileType.File if p in self.files else token_store.pafs.FileType.NotFound
            return [token_store.pafs.FileInfo(p, kind(p), size=len(self.files.get(p, b""))) for p in paths]

        def delete_file(self, p):
            del self.files[p]

        def move(self, a, b):
            self.files[b] = b"abc"
            raise OSError("there already")

    store = Strict()
    token_store.settle(store, "own", "there")
    assert store.files == {"there": b"abc"}


def test_token_store_has_shards_by_bytes(spark, docs):
    store = token_store.write_store(docs, new_path(spark, "store"), WORD_BPE, end_id=2, shard_bytes=4096)
    assert len(store.manifest["starts"]) > 4


def test_block_max_opens_few_blocks():
    """Examples in groups of their own words: a query opens the blocks of its group and passes over the rest."""
    rng = random.Random(5)
    examples = [({40 * (k // 200) + rng.randrange(40): rng.randint(1, 3) for _ in range(6)} | {800: rng.randint(1, 5)}, k % 2, k) for k in range(4000)]
    index = toxicity_knn.BlockMaxIndex.build(np.array([1 + rng.random() for _ in range(800)] + [0.1]), examples, 800)
    for c, _, _ in examples[::50]:
        index.nearest(c, 16)
    assert index.skipped > 3 * index.opened > 0


def test_toxicity_scores_of_the_table_against_dense_vectors(spark):
    """All of sf0.01: scores from dense cosines over the same terms, without an index."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    voter = toxicity_knn.train(docs, labels.filter(~toxicity_knn.held_out(labels.doc_id)).selectExpr("doc_id", "toxic AS y"))
    lookup = toxicity_knn.Lookup(voter.vocabulary)
    text = {r.doc_id: raw(r.text) for r in docs.select("doc_id", "text").collect()}

    def dense(d):
        out = np.zeros(len(voter.index.idf))
        t, w = voter.index.vector(toxicity_knn.term_counts(text[d], lookup))
        out[t] = w
        return out

    known = np.stack([dense(d) for d in voter.index.doc_id.tolist()])
    for r in toxicity_knn.score(docs, voter).collect():
        cosine = known @ dense(r.doc_id)
        best = sorted(np.flatnonzero(cosine > 0), key=lambda j: (-round(cosine[j], 9), j))[: toxicity_knn.K]
        least = cosine[best[-1]] if len(best) else 0
        if (np.abs(cosine - least) < 1e-9).sum() > 1 and len(best) == toxicity_knn.K:
            continue  # ties for the last place may vote for either
        vote = (cosine[best] @ voter.index.label[best] + toxicity_knn.SMOOTH * voter.rate) / (cosine[best].sum() + toxicity_knn.SMOOTH) if len(best) else voter.rate
        assert r.score == pytest.approx(voter.calibrated(float(vote)), abs=1e-6)
    df = Counter()
    for t in text.values():
        df.update({x for w in set(t.translate(toxicity_knn.TABLE).split()) for x in lookup[w]})
    want = [np.log((1 + len(text)) / (1 + df[k])) + 1 for k in range(len(voter.vocabulary))]
    assert np.allclose(voter.index.idf[:-1], want)
