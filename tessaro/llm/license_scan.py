"""License scans: a positional index of rare words over licence templates.

Templates are whole texts of short licences, and the notices that long ones ask to be put into files. They are indexed word by word with positions. Corpus-wide document counts of the template words give their IDF. Each
template with one of its mandatory key phrases in the file is looked up by itself, from its highest IDF down: its postings vote
for the place where it would start in the file (file position less template position). Once all words still to come weigh no
more than the best place has, no new place is opened, so that the greatest share of weight at one place is exact, whatever
other licences the file holds.

Defined results: a null or empty text has no words, no labels and score 0. A text may carry several labels. Repeated rows
are scanned one by one; every row gives one row. Phrases can overlap; each place counts. Labels are sorted, so ties have no order. An empty
table gives no rows. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import PLAIN, batch, map_texts
from tessaro.llm.licences import TEMPLATES

# Phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


class Index:
    """Template postings by word, and what a place must score."""

    def __init__(self, templates: dict, counts: dict[bytes, int], n_docs: int) -> None:
        words: dict[str, dict[bytes, list[int]]] = {label: defaultdict(list) for label in templates}
        self.phrases: dict[str, list[list[bytes]]] = {}
        for label, (text, phrases) in templates.items():
            for i, w in enumerate(words_of(text.encode())):
                words[label][w].append(i)
            self.phrases[label] = [p.encode().split() for p in phrases]
        self.idf = {w: math.log((1 + n_docs) / (1 + counts.get(w, 0))) + 1 for x in words.values() for w in x}
        #: By template: its words from the highest IDF down, each with its positions.
        self.postings = {label: sorted(x.items(), key=lambda p: (-self.idf[p[0]], p[0])) for label, x in words.items()}
        self.total = {label: sum(self.idf[w] for w in words_of(text.encode())) for label, (text, _) in templates.items()}

    def find(self, places: dict[bytes, list[int]], least: float) -> tuple[set[str], float]:
        """Labels of templates in a file, and the greatest share of a template's weight found at one place."""
        labels, best = set(), 0.0
        for label, phrases in self.phrases.items():
            if any(phrase_places(p, places) for p in phrases):
                share = self.share(label, places)
                best = max(best, share)
                if share >= least:
                    labels.add(label)
        return labels, best

    def share(self, label: str, places: dict[bytes, list[int]]) -> float:
        """The greatest share of the template's weight at one place."""
        known = [(self.idf[w], posts, places[w]) for w, posts in self.postings[label] if w in places]
        left = sum(idf * len(posts) for idf, posts, _ in known)
        votes: dict[int, float] = {}
        most = 0.0
        for idf, posts, at in known:
            new = most < left
            for i in posts:
                for p in at:
                    if new or p - i in votes:
                        votes[p - i] = v = votes.get(p - i, 0.0) + idf
                        most = max(most, v)
            left -= idf * len(posts)
        return min(1.0, most / self.total[label])


def phrase_places(phrase: list[bytes], places: dict[bytes, list[int]]) -> list[int]:
    """Starts of the consecutive words of a phrase."""
    if any(w not in places for w in phrase):
        return []
    rest = [set(places[w]) for w in phrase[1:]]
    return [p for p in places[phrase[0]] if all(p + 1 + i in s for i, s in enumerate(rest))]


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and with each word of a fixed vocabulary. What reaches the driver is one row per word of it."""
    names = sorted(vocabulary)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for _, whole in batches:
            for text in whole:
                n += 1
                seen.update(vocabulary.intersection(text.translate(PLAIN).split()))
        yield batch(word=pa.array([*names, b""], pa.binary()), n=pa.array([*(seen[w] for w in names), n], pa.int64()))

    got = map_texts(docs, [], run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in got}
    return counts.pop(b"", 0), counts


def license_scan(docs: DataFrame, templates: dict = TEMPLATES, base: dict = BASE, least: float = 0.3) -> DataFrame:
    """One row per row of docs (doc_id, text). least: share of weight to be found."""
    vocabulary = {w for text, phrases in templates.values() for p in (text, *phrases) for w in words_of(p.encode())}
    n_docs, counts = word_counts(docs, vocabulary)
    base_words = [(p.encode().split(), label) for p, label in base.items()]
    needed = vocabulary | {w for p, _ in base_words for w in p}
    phrase_sets = [set(p.encode().split()) for p in (*base, *(p for _, phrases in templates.values() for p in phrases))]

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        index = Index(templates, counts, n_docs)
        for (ids,), whole in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in whole:
                words = words_of(text)
                places: dict[bytes, list[int]] = defaultdict(list)
                # most files hold no phrase's words at all, and need no positions
                present = needed.intersection(words)
                if any(p <= present for p in phrase_sets):
                    for i, w in enumerate(words):
                        if w in present:
                            places[w].append(i)
                starts, names = [], set()
                for phrase, label in base_words:
                    if at := phrase_places(phrase, places):
                        starts += at
                        names.add(label)
                more, share = index.find(places, least) if places else (set(), 0.0)
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | more)), 1.0 if names else share)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            long, string = pa.int64(), pa.string()
            kinds = (long, long, long, long, string, string, pa.float64())
            names_ = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
            yield batch(doc_id=pa.array(ids, pa.int64()), **{k: pa.array(c, t) for k, c, t in zip(names_, cols, kinds, strict=True)})

    return map_texts(docs, ["doc_id"], run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
