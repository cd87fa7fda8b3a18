"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings over hashed text.

One weight vector over hashed words and shape features is shared by all grades; ordered thresholds cut its score:
P(grade > k) = sigmoid(w.x - t_k), t_0 < t_1 < ... Fitting is full-batch on a bounded sample of rated documents (SAMPLE, least
by a hash of doc_id), by Adam with L2. The sample's features stay in a table of the shared folder. Up to LOCAL of them are
fitted on the driver; more, as long texts have, are read by at most TASKS tasks in each step, and the driver gets their sums of
slopes alone, so that what it holds doesn't grow with the texts. Both ways use the whole sample and take the same steps, and
differ by the rounding of sums. Scoring is one pass over all whole texts with the weights broadcast (2 ** BITS doubles).

Grades here come from labels: 0 for quality 0, 1 for quality 1 that is toxic, 2 for quality 1 that isn't. Any number of
grades works. Selection keeps a document if P(grade > 0) reaches the least probability.

Defined results: null and empty texts have no features and get the score that the thresholds give. Ratings that are null, or
whose document is missing, aren't used; a document counts once for each grade it has, with the least of its texts. With fewer than two grades, all documents get
the only grade. Repeated rows are scored one by one. An empty table gives none. The sample keeps whole texts. Ties in
the sample's hash go to the lesser doc_id. Texts of any length are read whole. Only doc_id and text are read, so
other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaro.llm.common import SPACE, batch, cut, map_texts, small_batches, stored, texts

BITS = 16
SAMPLE = 12_000
#: Features of the sample that are fitted on the driver: 48 MB sent to it. 12,000 documents of 3 KB have about 4,200,000.
LOCAL = 6_000_000
#: Tasks of a step where the sample has more: each sends 2 ** BITS doubles.
TASKS = 64
STEPS = 250
L2 = 1e-4
LEAST = 0.5
#: Features beside words, at the end of the vector.
SHAPE = 8


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: hashed lower-case words, weighted by the root of their frequency, and shape of the text."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    places = np.fromiter(map(zlib.crc32, words), np.int64, n) & ((1 << bits) - 1)
    at, count = np.unique(places, return_counts=True)
    value = np.sqrt(count)
    value /= np.linalg.norm(value)
    solid = text.translate(None, SPACE)
    letters = len(solid.translate(None, b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) / len(solid)
    marks = (len(solid) - len(solid.translate(None, b"#*$%&|<>"))) / len(solid)
    distinct = len(at) / n
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    shape = np.array([1.0, letters, 4 * marks, distinct, 4 * same, repeated, min(np.log1p(n), 12) / 12, min(len(solid) / n, 20) / 20])
    return np.concatenate([at, (1 << bits) + np.arange(SHAPE)]), np.concatenate([value, shape])


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: int

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def pulls(score: np.ndarray, grade: np.ndarray, n: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slopes of the mean loss over n rows by the score of each of these, and what these add to those by threshold."""
    own, k = len(grade), len(cuts) + 1
    s = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))
    edge = np.concatenate([np.ones((own, 1)), s, np.zeros((own, 1))], axis=1)  # P(grade > k - 1)
    p = np.maximum(edge[np.arange(own), grade] - edge[np.arange(own), grade + 1], 1e-9)
    slope = np.concatenate([np.zeros((own, 1)), s * (1 - s), np.zeros((own, 1))], axis=1)
    high, low = slope[np.arange(own), grade] / p, slope[np.arange(own), grade + 1] / p
    by_cut = np.zeros(k + 1)
    np.add.at(by_cut, grade, high / n)
    np.add.at(by_cut, grade + 1, -low / n)
    return -(high - low) / n, by_cut[1:k]


def descend(count: np.ndarray, size: int, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], steps: int = STEPS, l2: float = L2) -> CumulativeLink:
    """Maximum likelihood of the cumulative link, thresholds kept in order by positive steps between them. count: rows of each
    grade; of: weights and thresholds -> the slopes of the mean loss over all rows."""
    k, n = len(count), int(count.sum())
    if np.count_nonzero(count) < 2:
        return CumulativeLink(np.zeros(size), np.zeros(max(0, k - 1)) - 20.0 * (k > 1), k)
    share = np.array([np.clip(count[j + 1 :].sum() / n, 1e-3, 1 - 1e-3) for j in range(k - 1)])
    start = -np.log(share / (1 - share))
    w = np.zeros(size)
    # t_0 and the logs of the steps
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    moments = [np.zeros(size + k - 1), np.zeros(size + k - 1)]
    for step in range(1, steps + 1):
        by_w, by_cut = of(w, np.concatenate([t[:1], t[:1] + np.cumsum(np.exp(t[1:]))]))
        by_t = np.concatenate([[by_cut.sum()], np.exp(t[1:]) * by_cut[::-1].cumsum()[::-1][1:]])
        g = np.concatenate([by_w + l2 * w, by_t])
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:size]
        t -= move[size:]
    return CumulativeLink(w, np.concatenate([t[:1], t[:1] + np.cumsum(np.exp(t[1:]))]), k)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, bits: int = BITS, steps: int = STEPS, l2: float = L2) -> CumulativeLink:
    """The fit to rows that are at hand."""
    n, size = len(rows), (1 << bits) + SHAPE
    at, value = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.float64), zip(*rows, strict=True) if n else ([], []), strict=True))
    row = np.repeat(np.arange(n), [len(a) for a, _ in rows])

    def of(w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pull, by_cut = pulls(np.bincount(row, value * w[at], n), grade, n, cuts)
        return np.bincount(at, value * pull[row], size), by_cut

    return descend(np.bincount(grade) if n else np.zeros(1, np.int64), size, of, steps, l2)


def fit_in_tasks(found: DataFrame, count: np.ndarray, bits: int = BITS, steps: int = STEPS, l2: float = L2) -> CumulativeLink:
    """The fit to rows of a table (grade, at, value): a job for each step, whose tasks send a sum of slopes each."""
    sc, n, size = found.sparkSession.sparkContext, int(count.sum()), (1 << bits) + SHAPE
    small_batches(found.sparkSession)
    dealt = found.select("grade", "at", "value").coalesce(min(TASKS, sc.defaultParallelism))

    def of(w: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = sc.broadcast((w, cuts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, cuts = sent.value
            total = np.zeros(size + len(cuts))
            for b in batches:
                if b.num_rows:
                    rows = list(zip(*(unpacked(b.column(i).to_pylist(), kind) for i, kind in ((1, "<i4"), (2, "<f4"))), strict=True))
                    pull, by_cut = pulls(np.array([w[a] @ v for a, v in rows]), b.column(0).to_numpy(), n, cuts)
                    for (a, v), x in zip(rows, pull, strict=True):
                        np.add.at(total, a, v * x)
                    total[size:] += by_cut
            yield batch(sums=[total.tobytes()])

        sums = sum(unpacked(dealt.mapInArrow(run, "sums binary").toArrow()["sums"].to_pylist(), "<f8"), np.zeros(size + len(cuts)))
        sent.destroy()
        return sums[:size], sums[size:]

    return descend(count, size, of, steps, l2)


def unpacked(column: list[bytes], kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column]


def graded(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) -> doc_id, grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> CumulativeLink:
    """docs (doc_id, text), ratings (doc_id, grade): fits on the sample rated documents of least hash."""
    chosen = cut(ratings.filter("grade IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample).select(F.col("doc_id").alias("rated"), "grade"))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("rated")).groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for (ids, grade), whole in batches:
            rows = [features(t, bits) for t in whole]
            yield batch(doc_id=pa.array(ids, pa.int64()), grade=pa.array(grade, pa.int32()), n=pa.array([len(a) for a, _ in rows], pa.int32()), at=pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), value=pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()))

    found = stored(map_texts(joined, ["doc_id", "grade"], run, "doc_id long, grade int, n int, at binary, value binary"))
    each = found.groupBy("grade").agg(F.count("*").alias("rows"), F.sum("n").alias("features")).collect()
    count = np.zeros(max((r["grade"] for r in each), default=0) + 1, np.int64)
    for r in each:
        count[r["grade"]] = r["rows"]
    if sum(r["features"] for r in each) > LOCAL:
        return fit_in_tasks(found, count, bits)
    got = found.drop("n").toArrow()
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending"), ("grade", "ascending")]))
    rows = [(a.astype(np.int64), v.astype(np.float64)) for a, v in zip(unpacked(got["at"].to_pylist(), "<i4"), unpacked(got["value"].to_pylist(), "<f4"), strict=True)]
    return fit(rows, got["grade"].to_numpy().astype(np.int64), bits)


def score(docs: DataFrame, model: CumulativeLink, least: float = LEAST, bits: int = BITS) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade > 0)), predicted (the likeliest grade), kept: one row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        m = held.value
        for (ids,), whole in batches:
            raw = np.array([float(v @ m.weights[a]) for a, v in (features(t, bits) for t in whole)])
            above = m.above(raw) if m.grades > 1 else np.ones((len(raw), 1))
            edge = np.concatenate([np.ones((len(raw), 1)), above[:, : m.grades - 1], np.zeros((len(raw), 1))], axis=1)
            tail = above[:, 0]
            yield batch(doc_id=pa.array(ids, pa.int64()), expected_grade=pa.array(above[:, : m.grades - 1].sum(axis=1)), tail=pa.array(tail), predicted=pa.array((edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype(np.int32)), kept=pa.array(tail >= least))

    return map_texts(docs, ["doc_id"], run, "doc_id long, expected_grade double, tail double, predicted int, kept boolean")


def quality_grades(docs: DataFrame, labels: DataFrame, least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, graded(labels), sample), least)


def keep_good(docs: DataFrame, model: CumulativeLink, least: float = LEAST, bits: int = BITS, text: str = "text") -> DataFrame:
    """The rows of docs whose P(grade > 0) reaches least, with all their columns, whatever their names. Null and empty texts have the
    probability that the thresholds give; repeated rows are judged one by one; texts of any length are read whole; an empty table
    gives no rows."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            raw = np.array([float(v @ m.weights[a]) for a, v in (features(t, bits) for t in texts(b.column(place)))])
            yield b.filter(pa.array(m.above(raw)[:, 0] >= least if m.grades > 1 else np.ones(len(raw), bool)))

    return docs.mapInArrow(run, docs.schema)
