import numpy as np
import pytest

from tessaro.llm import itq_dedup


def brute(rows, threshold=0.9):
    """rows: (id, vector or None); exact repeats of a row are one."""
    rows = list({(i, None if v is None else tuple(v)): (i, v) for i, v in rows}.values())
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.array(rows[k][1], np.float32), np.float64) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = min(rows[j][0] for j in seen) if i is not None else None
        out.append((i, len(links[k]), component, i is None or i == component))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    near = [base[k % 12] + 0.05 * rng.standard_normal(32) * (k % 7) for k in range(180)]
    vectors = [*base, *near, base[0], base[0], 3 * base[1]]
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [1.0, 2.1]]
    rows = list(enumerate([*vectors, *odd]))
    return [*rows, rows[3], (None, vectors[0])]


@pytest.mark.parametrize("chunk", [2048, 16])
def test_links_against_brute_force(spark, rows, chunk):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, h long")
    got = sorted(map(tuple, itq_dedup.near_vectors(df, chunk=chunk).collect()), key=str)
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and found >= 0.97 * there
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    if found == there:
        assert got == want


def test_one_id_with_several_vectors(spark):
    """Vectors 1 and 1 are near each other and vector 2: a row for each, two links each, one component."""
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.05, 0.05]
    rows = [(1, a), (1, b), (2, c), (1, a), (9, [0.0, 0.0, 1.0]), (1, [0.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, itq_dedup.near_vectors(df).collect()))
    assert got == sorted(brute(rows)) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (8, 1, 1, False), (9, 0, 9, True)]


def test_doubles_are_compared_as_doubles(spark):
    """A pair just below the threshold in doubles reaches it in floats."""
    x = [1.0, 0.0]
    pairs = [[0.9 * (1 - e), (1 - (0.9 * (1 - e)) ** 2) ** 0.5] for e in (1e-9, -1e-9)]
    rows = [(0, x), (1, pairs[0]), (2, pairs[1])]
    got = {r.vec_id: r.n_links for r in itq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.8, 0.9])
def test_a_plan_costs_less_than_comparing_all(mean):
    rng = np.random.default_rng(4)
    common = np.zeros(64)
    common[0] = mean
    x = itq_dedup.unit(common + np.sqrt(1 - mean**2) * itq_dedup.unit(rng.standard_normal((4000, 64))))
    n = 10**6
    quantiser = itq_dedup.fitted(x, n, 0.9, itq_dedup.RECALL)
    keys = quantiser.keys(x)
    share = sum(float((c * (c - 1.0)).sum()) for c in (np.unique(k, return_counts=True)[1] for k in keys.T)) / len(x) / (len(x) - 1)
    assert n * share + itq_dedup.COPY * quantiser.tables <= 1.1 * n
    assert mean > 0.7 or share < 0.05


def test_empty_and_all_bad(spark):
    schema = "vec_id long, embedding array<float>"
    assert itq_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = itq_dedup.near_vectors(spark.createDataFrame([(4, None), (5, [0.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_bits_grow_with_the_input():
    assert [itq_dedup.plan_bits(n) for n in (10, 10**4, 10**6, 10**9)] == [0, 8, 12, 20]


@pytest.mark.parametrize("sample", [np.array([[1.0, 2.0], [1.0, 2.1]]), np.ones((50, 4)), np.random.default_rng(3).standard_normal((5, 3))])
def test_vectors_that_no_tables_suit_are_all_compared(sample):
    quantiser = itq_dedup.fitted(sample, 10**6, 0.9, itq_dedup.RECALL)
    assert quantiser.tables <= itq_dedup.MOST_TABLES
    pairs = itq_dedup.built_pairs(sample, 0.9)
    assert all((quantiser.keys(x) == quantiser.keys(y)).any(axis=1).mean() > 0.9 for x, y in pairs)


def test_links_of_vectors_with_a_common_mean(spark, monkeypatch):
    """Tables, and not the comparison of all with all: recall 0.9 at least, and no link below the threshold."""
    monkeypatch.setattr(itq_dedup, "BRUTE", 100)
    rng = np.random.default_rng(8)
    v = (rng.standard_normal(32) + 0.31 * rng.standard_normal((900, 32)) * rng.uniform(0.5, 4, (900, 1))).astype(np.float32)
    x = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = near.sum(axis=1) - 1
    got = itq_dedup.near_vectors(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")).collect()
    links = {r.vec_id: r.n_links for r in got}
    assert all(links[k] <= want[k] for k in range(900)) and sum(links.values()) >= 0.9 * want.sum()


@pytest.mark.parametrize("n, mean", [(10**4, 0.0), (10**4, 0.7), (10**6, 0.7)])
def test_recall_at_the_threshold_of_vectors_with_a_common_direction(n, mean):
    rng = np.random.default_rng(21)

    def draw(count):
        z = itq_dedup.unit(rng.standard_normal((count, 48)))
        common = np.zeros(48)
        common[0] = mean
        return itq_dedup.unit(common + np.sqrt(1 - mean**2) * z)

    quantiser = itq_dedup.fitted(draw(3000), n, 0.9, itq_dedup.RECALL)
    assert quantiser.bits >= 8
    x, to = draw(3000), draw(3000)
    turn = to - (to * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * itq_dedup.unit(turn)
    assert (quantiser.keys(x) == quantiser.keys(y)).any(axis=1).mean() > 0.91
