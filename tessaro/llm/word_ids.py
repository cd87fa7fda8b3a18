"""Token ids of whole texts from a tokenizers file whose pieces never cross white space.

Such a tokenizer drops white space and treats what lies between by itself, so a text's ids are the ids of its parts put
together. Each worker encodes every distinct part once (in batches) and keeps it; the memory for that is bounded. Texts that
may hold a special token's string are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Parts kept by a worker; beyond it, it keeps those of its last texts only.
KEPT = 600_000
#: A vocabulary file above this many bytes isn't broadcast.
LARGEST = 64 << 20
#: Bytes of texts whose parts are told apart at once; a longer text is a lot of its own.
LOT = 4 << 20
#: Parts encoded in one string, with a special token between them.
JOINED = 256
#: A run of these after letters is a piece of its own.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PROBES = (".", ",", "###", "!?", "<|", "&&&.")


def tokenizer_file(spark: SparkSession, path: str) -> Broadcast:
    """The file's text for the executors, which needn't have the file; its size is checked."""
    size = os.path.getsize(path)
    if size > LARGEST:
        raise ValueError(f"{path} has {size} bytes; at most {LARGEST} are broadcast")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class WordEncoder:
    """Encodes to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        rules = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        special = [t for t in rules["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        if not special or len(special) < len(rules["added_tokens"]):
            raise ValueError("special tokens that match as they stand are needed")
        self.between, self.mark = special[0]["content"], special[0]["id"]
        self.openings = {t["content"][:2].encode() for t in special}
        normalizer = rules.get("normalizer") or {}
        kinds = [x["type"] for x in normalizer.get("normalizers", [normalizer]) if x]
        #: ASCII capitals may go first where the tokenizer lower-cases anyway.
        self.lower = "Lowercase" in kinds
        self.plain = self.letters_only(rules)

    def letters_only(self, rules: dict):
        """A tokenizer without normaliser and pattern for words of a-z, which neither changes; None where it differs on a probe."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = rules["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for w, i in plain.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
        probe = "the quick brown fox jumps over lazy dogs supercalifragilistic zqxjk a".split()
        whole = [self.tokenizer.encode(w + p, add_special_tokens=False).ids for w in probe for p in ("", *PROBES)]
        parts = [plain.encode(w, add_special_tokens=False).ids + self.tokenizer.encode(p, add_special_tokens=False).ids for w in probe for p in ("", *PROBES)]
        return plain if whole == parts else None

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: list[bytes]) -> None:
        if not self.plain:
            return self.learn_any(parts)
        stems = [w.rstrip(MARKS) for w in parts]
        letters = [x.isalpha() and x.islower() for x in stems]
        tails = {w[len(x) :] for w, x, plain in zip(parts, stems, letters, strict=True) if plain and len(x) < len(w)}
        self.learn_any([m for m in tails if m not in self.known])
        self.learn_letters(list(compress(parts, letters)), list(compress(stems, letters)), {b"": b""} | {m: self.known[m] for m in tails})
        self.learn_any([w for w, plain in zip(parts, letters, strict=True) if not plain])

    def learn_letters(self, parts: list[bytes], stems: list[bytes], tails: dict[bytes, bytes]) -> None:
        """parts: stems of letters, each with one of the tails."""
        known = self.known
        lots = range(0, len(stems), JOINED)
        strings = [b" ".join(stems[i : i + JOINED]).decode() for i in lots]
        for i, found in zip(lots, self.plain.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            raw, start = ids.tobytes(), 0
            for w, x, end in zip(parts[i : i + JOINED], stems[i : i + JOINED], (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist(), strict=True):
                known[w] = raw[start:end] + tails[w[len(x) :]]
                start = end

    def learn_any(self, parts: list[bytes]) -> None:
        lots = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        strings = [self.between.join([w.decode("utf-8", "replace") for w in lot]) for lot in lots]
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 4).tolist()
            start = 0
            for w, end in zip(lot, [*ends, len(raw)], strict=True):
                self.known[w] = raw[start:end]
                start = end + 4

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Texts in lots of bounded size: Arrow finds the distinct parts of a lot, and their ids are gathered part by part."""
        out: list[bytes] = []
        lot, size = [], 0
        for t in texts:
            if lot and size + len(t) > LOT:
                out += self.encode_lot(lot)
                lot, size = [], 0
            lot.append(t)
            size += len(t)
        return out + self.encode_lot(lot) if lot else out

    def encode_lot(self, texts: list[bytes]) -> list[bytes]:
        odd = {i for i, t in enumerate(texts) if any(x in t for x in self.openings)}
        column = pa.array([b"" if i in odd else t for i, t in enumerate(texts)], pa.binary()).cast(pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if self.lower else column)
        coded = lists.values.dictionary_encode()
        parts, which = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        missing = [w for w in parts if w not in self.known]
        if len(self.known) + len(missing) > KEPT:
            self.known = {w: self.known[w] for w in parts if w in self.known}
        self.known[b""] = b""  # what stands before leading white space
        self.learn([w for w in missing if w])
        found = [self.known[w] for w in parts]
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(count) - count
        own = count[which]
        after = np.concatenate([[0], np.cumsum(own)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[which] - after[:-1], own) + np.arange(after[-1])]
        raw, edges = ids.tobytes(), (4 * after[lists.offsets.to_numpy()]).tolist()
        return [self.whole(texts[i]) if i in odd else raw[edges[i] : edges[i + 1]] for i in range(len(texts))]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    """One for each worker process, so that what it has learnt outlives a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    digest = hashlib.sha256(definition.encode()).hexdigest()
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = WordEncoder(definition)
    return _ENCODERS[digest]
