"""Toxicity: nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Examples are a bounded, stratified sample of labelled rows (at most TOXIC and CLEAN of each label, least by a hash of
doc_id). Terms are words and their prefixes of 4 to 7 bytes; the vocabulary is every term that differs between the labels beyond chance
(G-test with a Bonferroni bound over all terms tested; equal texts of a label count once); the sample bounds it. IDF counts every document of the corpus. All
other words of a text are one more term, so that the density of telling words counts and not their number alone. The
index keeps postings by term, cut into blocks of examples, with the greatest weight of a term in a block: a query adds up
the bounds, opens the blocks of the highest bounds, and then those whose bound reaches the k-th best cosine; no other block
can hold one of its K neighbours, so they are exact. Examples of equal vectors are one row of the index with several copies, so that a group of copies is
opened once; a task remembers the votes of equal queries. Cosine-weighted votes, smoothed towards the base rate, are calibrated by a logistic fit to
leave-one-out votes, weighted back to the labels' true shares. Evidence: the ids of the nearest examples.

Defined results: a null or empty text, or one without any term of the vocabulary, has no neighbours and gets the calibrated
score of the base rate alone. With no labelled rows, or one label only, every score is the smoothed base rate. Labels that are
null aren't used. Of several texts under a labelled doc_id
the least counts. Repeated rows are scored one by one. Ties in cosine go to the lower example. An empty table gives no rows.
Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import PLAIN, batch, cut, map_texts

TOXIC, CLEAN = 2048, 6144
K = 16
BLOCK = 64
#: Blocks opened before the k-th best cosine is known.
FIRST = 4
#: IDF of the words outside the vocabulary, as one term; their number counts in steps of a quarter of a doubling.
BACKGROUND = 2.0
#: Terms of all queries whose votes a task remembers; a query of more terms isn't.
REMEMBERED = 1_000_000
PREFIXES = (4, 5, 6, 7)
#: Least documents of a term to be tested.
LEAST_DOCS = 5
#: Added to the log of the number of terms tested, in nats.
MARGIN = 1.0
#: Weight of the base rate among the votes.
SMOOTH = 0.5

TABLE = PLAIN


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


class Lookup(dict):
    """Word -> the vocabulary's numbers of its terms; remembers, within bounds."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        self[word] = found
        return found


def term_counts(text: bytes, lookup: Lookup) -> dict[int, int]:
    """Counts of the vocabulary's terms and, where there are any, of the other words under the number after the last term."""
    counts: dict[int, int] = {}
    other = 0
    for w, n in Counter(text.translate(TABLE).split()).items():
        if found := lookup[w]:
            for t in found:
                counts[t] = counts.get(t, 0) + n
        else:
            other += n
    if counts:
        counts[len(lookup.vocabulary)] = round(2 ** (round(4 * math.log2(max(1, other))) / 4))
    return counts


@dataclass
class BlockMaxIndex:
    """Distinct vectors of unit length in rows, the examples of a row side by side; by term: row, weight; and by term: block of
    rows, greatest weight."""

    idf: np.ndarray
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    doc_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Where the examples of each row begin, and the end.
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    #: Rows and weights of all postings, by term and row; and by term, where the postings of each block begin.
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    maxima: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Blocks of all queries so far: opened, and passed over by their bound.
    opened: int = 0
    skipped: int = 0

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weight = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        return terms, weight / norm if len(terms) and (norm := np.linalg.norm(weight)) else weight

    @classmethod
    def build(cls, idf: np.ndarray, examples: list[tuple[dict[int, int], int, int]], background: int = -1) -> BlockMaxIndex:
        """examples: counts, label, doc_id. background: a term that most examples have, and that says nothing of their kind."""
        index = cls(idf)
        copies: dict[tuple, list[tuple[int, int]]] = {}
        for c, y, d in examples:
            if c:
                copies.setdefault(tuple(sorted(c.items())), []).append((d, y))
        rows = [(*index.vector(dict(c)), sorted(x)) for c, x in copies.items()]
        # rows of the same leading term stand together, so that blocks differ in their bounds
        rows.sort(key=lambda r: (int(r[0][np.where(r[0] == background, -1, r[1]).argmax()]), r[2][0]))
        index.label = np.array([y for r in rows for _, y in r[2]], np.float64)
        index.doc_id = np.array([d for r in rows for d, _ in r[2]], np.int64)
        index.first = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r[2]) for r in rows], dtype=np.int64)])
        lists: list[list[tuple[int, float]]] = [[] for _ in idf]
        for i, (terms, weight, _) in enumerate(rows):
            for t, w in zip(terms.tolist(), weight.tolist(), strict=True):
                lists[t].append((i, w))
        n_blocks, before = -(-len(rows) // BLOCK), 0
        index.rows = np.array([i for x in lists for i, _ in x], np.int32)
        index.weights = np.array([w for x in lists for _, w in x])
        index.start = np.zeros((len(lists), n_blocks + 1), np.int64)
        for t, x in enumerate(lists):
            at, w = np.array([i for i, _ in x], np.int64), np.array([v for _, v in x])
            index.start[t] = before + np.searchsorted(at, np.arange(n_blocks + 1) * BLOCK)
            before += len(x)
            blocks, start = np.unique(at // BLOCK, return_index=True)
            index.maxima.append((blocks, np.maximum.reduceat(w, start) if len(w) else w))
        return index

    def nearest(self, counts: dict[int, int], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the greatest cosine above 0, best first; without: an example left out."""
        terms, query = self.vector(counts)
        n_rows = len(self.first) - 1
        bound = np.zeros(-(-n_rows // BLOCK))
        for t, q in zip(terms.tolist(), query.tolist(), strict=True):
            blocks, most = self.maxima[t]
            bound[blocks] += q * most
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        size, need = np.diff(self.first), k + (without >= 0)
        best, score, full = np.zeros(0, np.int64), np.zeros(0), False
        at, step = 0, FIRST
        while at < len(order):  # waves of blocks in order of their bounds, each twice as long as the last
            wave = order[at : at + step]
            if full:
                wave = wave[bound[wave] >= score[-1] - 1e-12]
            if not len(wave):
                break
            at, step = at + len(wave), 2 * step
            lo, hi = self.start[terms][:, wave].ravel(), self.start[terms][:, wave + 1].ravel()
            n = hi - lo
            post = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            own = np.bincount(self.rows[post], self.weights[post] * np.repeat(np.repeat(query, len(wave)), n), n_rows)
            hit = np.flatnonzero(own > 0)
            if len(hit) > 4 * need:  # a row has an example at least; rows that tie with the last one stay
                hit = hit[own[hit] >= np.partition(own[hit], -need)[-need]]
            best, score = np.concatenate([best, hit]), np.concatenate([score, own[hit]])
            keep = np.lexsort((best, -score))
            so_far = np.cumsum(size[best[keep]])
            stop = int(np.searchsorted(so_far, need)) + 1
            keep, full = keep[:stop], stop <= len(so_far)
            best, score = best[keep], score[keep]
        self.opened, self.skipped = self.opened + at, self.skipped + len(bound) - at
        # a row gives as many of its examples as are needed
        found = [(e, c) for r, c in zip(best.tolist(), score.tolist(), strict=True) for e in range(self.first[r], min(self.first[r + 1], self.first[r] + need)) if e != without][:k]
        return np.array([e for e, _ in found], np.int64), np.array([c for _, c in found])


@dataclass
class Voter:
    index: BlockMaxIndex
    vocabulary: dict[bytes, int]
    rate: float
    slope: float = 1.0
    offset: float = 0.0

    def vote(self, counts: dict[int, int], without: int = -1) -> tuple[float, np.ndarray]:
        if not counts:
            return self.rate, np.zeros(0, np.int64)
        at, cosine = self.index.nearest(counts, K, without)
        return float((cosine @ self.index.label[at] + SMOOTH * self.rate) / (cosine.sum() + SMOOTH)), at

    def calibrated(self, vote: float) -> float:
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(vote / (1 - vote)) + self.offset)))

    def calibrate(self, votes: np.ndarray, label: np.ndarray, weight: np.ndarray, l2: float = 1e-2) -> None:
        """Logistic regression on the logit of the votes, with smoothed targets."""
        votes = np.clip(votes, 1e-6, 1 - 1e-6)
        x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], axis=1)
        up, down = weight[label == 1].sum(), weight[label == 0].sum()
        target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
        b = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (weight * (p - target)) + l2 * (b - [1.0, 0.0])
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(2), grad)
            b = b - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(b[0]), float(b[1])


def choose_terms(sample: DataFrame) -> list[bytes]:
    """sample: y, text. All terms whose share of toxic texts differs beyond chance from that of the sample's distinct texts."""
    distinct = cut(sample.select("y", "text").distinct())
    totals = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        n, up = Counter(), Counter()
        for (label,), whole in batches:
            for y, text in zip(label, whole, strict=True):
                terms = {t for w in set(text.translate(TABLE).split()) for t in terms_of(w)}
                n.update(terms)
                if y:
                    up.update(terms)
        names = list(n)
        yield batch(term=pa.array(names, pa.binary()), n=pa.array([n[t] for t in names], pa.int64()), up=pa.array([up[t] for t in names], pa.int64()))

    counts = map_texts(distinct, ["y"], run, "term binary, n long, up long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).filter(F.col("n") >= LEAST_DOCS)
    counts = cut(counts)
    tested = counts.count()
    base = toxic / (toxic + clean)
    rate = F.col("up") / F.col("n")
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    g = F.col("n") * (part(rate, F.lit(base)) + part(1 - rate, F.lit(1 - base)))
    kept = counts.withColumn("g", g).filter(F.col("g") >= math.log(max(1, tested)) + MARGIN)
    return sorted(bytes(r["term"]) for r in kept.select("term").collect())


def corpus_idf(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Over all documents; one row per term and task is shuffled, one per term reaches the driver."""

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        lookup, seen, n = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for _, whole in batches:
            for text in whole:
                n += 1
                if hits := {t for w in set(text.translate(TABLE).split()) for t in lookup[w]}:
                    seen[list(hits)] += 1
        yield batch(term=pa.array([*range(len(seen)), -1], pa.int32()), n=pa.array([*seen.tolist(), n], pa.int64()))

    got = {r["term"]: r["n"] for r in map_texts(docs, [], run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = got.pop(-1, 0)
    return np.array([*(math.log((1 + total) / (1 + got.get(t, 0))) + 1 for t in range(len(vocabulary))), BACKGROUND])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Voter:
    """docs (doc_id, text), labels (doc_id, y)."""
    spark = docs.sparkSession
    rows = labels.filter("doc_id IS NOT NULL AND y IN (0, 1)").select("doc_id", F.col("y").cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    up, down = totals.get(1, 0), totals.get(0, 0)
    rate = (up + 1) / (up + down + 2)
    if not up or not down:
        return Voter(BlockMaxIndex(np.zeros(0)), {}, rate)
    pick = lambda y, n: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = cut(pick(1, toxic).unionAll(pick(0, clean)).select(F.col("doc_id").alias("labelled"), "y"))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    n_up, n_down = min(up, toxic), min(down, clean)
    vocabulary = {t: i for i, t in enumerate(choose_terms(sample))}
    idf = corpus_idf(docs, vocabulary)
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(held.value)
        for (ids, label), whole in batches:
            found = [term_counts(t, lookup) for t in whole]
            yield batch(doc_id=pa.array(ids, pa.int64()), y=pa.array(label, pa.int32()), t=pa.array([list(c) for c in found], pa.list_(pa.int32())), n=pa.array([list(c.values()) for c in found], pa.list_(pa.int32())))

    got = map_texts(sample, ["doc_id", "y"], run, "doc_id long, y int, t array<int>, n array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["t"]))
    examples = [(dict(zip(r["t"], r["n"], strict=True)), r["y"], r["doc_id"]) for r in got]
    voter = Voter(BlockMaxIndex.build(idf, examples, len(vocabulary)), vocabulary, (n_up + 1) / (n_up + n_down + 2))
    place = {d: i for i, d in enumerate(voter.index.doc_id.tolist())}
    votes = np.array([voter.vote(c, place.get(d, -1))[0] for c, _, d in examples])
    label = np.array([y for _, y, _ in examples])
    voter.calibrate(votes, label, np.where(label == 1, up / n_up, down / n_down))
    return voter


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """doc_id, score, predicted, evidence (ids of up to 3 nearest examples): one row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        v = held.value
        lookup = Lookup(v.vocabulary)
        known: dict[tuple, tuple[float, np.ndarray]] = {}
        held_terms = 0

        def vote(counts: dict[int, int]) -> tuple[float, np.ndarray]:
            nonlocal held_terms
            key = tuple(sorted(counts.items()))
            if (found := known.get(key)) is None:
                found = v.vote(counts)
                if held_terms + len(key) + 1 > REMEMBERED:
                    known.clear()
                    held_terms = 0
                if len(key) < REMEMBERED:
                    known[key] = found
                    held_terms += len(key) + 1
            return found

        for (ids,), whole in batches:
            found = [vote(term_counts(t, lookup)) for t in whole]
            scores = [v.calibrated(x) for x, _ in found]
            near = [v.index.doc_id[at[:3]].tolist() for _, at in found]
            yield batch(doc_id=pa.array(ids, pa.int64()), score=pa.array(scores, pa.float64()), predicted=pa.array([int(s >= 0.5) for s in scores], pa.int32()), evidence=pa.array(near, pa.list_(pa.int64())))

    return map_texts(docs, ["doc_id"], run, "doc_id long, score double, predicted int, evidence array<long>")


def held_out(doc_id):
    """True where crc32 of the id as text leaves remainder 0 by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted, evidence. Held-out labels aren't learnt from."""
    voter = train(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("y")))
    return score(docs, voter).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
