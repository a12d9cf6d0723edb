"""Hard negatives and whitening against brute force in numpy, on small tables with every odd case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, at long, block int, x string, component int, deviation string"


def rows_of(vectors, labels, ids=None):
    return [(int(i), None if v is None else [None if c is None else float(c) for c in v], l, 1, 2, "x", 3, "y")
            for i, v, l in zip(range(len(vectors)) if ids is None else ids, vectors, labels, strict=True)]


@pytest.fixture(scope="module")
def odd():
    rnd = np.random.default_rng(3)
    vectors = [*(rnd.normal(size=(90, 11)) / 3).astype(np.float32).tolist(), None, [None] * 11, [float("nan")] * 11, [float("inf")] + [0.0] * 10, [], [0.25, -1.0]]
    labels = [*(int(x) for x in rnd.integers(0, 3, 90)), 1, 1, 1, 1, 1, 2]
    vectors[20] = vectors[0]  # equal vectors under several ids: ties
    vectors[21] = vectors[0]
    labels[20] = labels[21] = labels[0]
    labels[30] = None
    return rows_of(vectors, labels)


def brute_negatives(rows, every, n_positives, n_negatives, low, high, scale=256.0):
    good = [(r[0], r[2], [int(np.floor(scale * c)) for c in r[1]]) for r in rows
            if r[0] is not None and r[2] is not None and r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    out = []
    for k, (i, label, x) in enumerate(good):
        if i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(x, y)), j, m) for n, (j, m, y) in enumerate(good) if n != k)
        for s, j, m in [c for c in near if c[2] == label][:n_positives]:
            inside = [c for c in near if c[2] != label and low * -s <= 100 * -c[0] <= high * -s][:n_negatives]
            out += [(i, j, rank + 1, c[1], -s, -c[0]) for rank, c in enumerate(inside)]
    return sorted(out)


def mined(df, every, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_negatives_equal_brute_force(spark, odd, parts):
    rows = [*odd, odd[7], odd[12], (None, *odd[3][1:])]  # repeated rows count twice, rows without an id not at all
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = mined(df, 4)
    assert got == brute_negatives(rows, 4, 5, 3, 50, 95) and len(got) > 50
    assert hard_negatives.mine(df, F.col("vec_id") % 4 == 0).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_over_many_cells(spark, odd, monkeypatch):
    for name, value in (("PAGE_ROWS", 8), ("BLOCK_ANCHORS", 4), ("CELL_ROWS", 16), ("STEP", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(odd, SCHEMA).repartition(3)
    assert mined(df, 3, n_positives=4, n_negatives=6, low=10, high=99) == brute_negatives(odd, 3, 4, 6, 10, 99)


def test_negatives_of_nothing(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA)
    assert mined(df.where("false"), 4) == []
    assert mined(df.where("vec_id % 4 <> 0"), 4) == []


def test_negatives_with_a_hot_vector(spark):
    """A third of all rows are one vector: ties go by id, and no row is lost."""
    rnd = np.random.default_rng(9)
    v = rnd.normal(size=(300, 16)).astype(np.float32)
    v[::3] = v[0]
    rows = rows_of(v.tolist(), [int(x) for x in rnd.integers(0, 2, 300)])
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(4), 10) == brute_negatives(rows, 10, 5, 3, 50, 95)


@pytest.mark.parametrize("top", [1, 300, 2**31, 2**40])
def test_full_scores(top):
    """Lookups and shifts give the inner products, in 32 bits and in 64."""
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(-top, top + 1, (7, 19)), rnd.integers(-top // 3 - 1, top + 1, (50, 19))
    planes = hard_negatives.bit_planes(y)
    assert (hard_negatives.whole_rows(planes, np.arange(50), 19) == y).all()
    kind = hard_negatives.sum_type(x, len(planes))
    assert kind == (np.int32 if top <= 300 else np.int64)
    assert (hard_negatives.full_scores(hard_negatives.subset_sums(x, kind), planes) == y @ x.T).all()


def brute_whitening(rows, dims, components=8):
    good = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in r[1]] + [100_000] * (dims - len(r[1])) for r in good], np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    return good, ((n * x - s) ** 2).sum(axis=1), white, values / values.sum()


@pytest.mark.parametrize("block", [16, 1024])
def test_whitening_equals_numpy(spark, odd, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    rows = [*odd, odd[5]]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0], r[4]))
    good, deviation, white, share = brute_whitening(rows, 11)
    assert len(got) == 8 * len(good) and {r[2] for r in got} == {len(good)}
    for k in range(8):
        mine = [r for r in got if r[1] == k + 1]
        sign = np.sign(sum(a[4] * b for a, b in zip(sorted(mine), sorted(zip([g[0] for g in good], white[:, k])), strict=True) for b in [b[1]]))
        want = sorted((g[0], int(d), float(sign * w)) for g, d, w in zip(good, deviation, white[:, k], strict=True))
        have = sorted((r[0], r[3], r[4]) for r in mine)
        assert [w[:2] for w in want] == [h[:2] for h in have]
        assert np.allclose([w[2] for w in want], [h[2] for h in have], atol=1e-9)
        assert abs(mine[0][5] - share[k]) < 1e-12 and all(r[6] < 1e-9 for r in mine)


def test_whitening_of_few_dimensions_and_constants(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(40, 3))
    v[:, 1] = 0.5
    got = whitening.whiten(spark.createDataFrame(rows_of(v.tolist(), [0] * 40), SCHEMA)).collect()
    assert len(got) == 120 and {r.component for r in got} == {1, 2, 3}
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component == 3)
    one = whitening.whiten(spark.createDataFrame(rows_of([[0.5, 0.25]], [0]), SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 2


def test_whitening_of_nothing_and_of_huge_entries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame(rows_of([None, [], [None]], [0, 0, 0]), SCHEMA)).collect() == []
    huge = whitening.whiten(spark.createDataFrame(rows_of([[1e30, 0.0], [0.0, 1.0], [1.0, 3.0]], [0, 0, 0]), SCHEMA)).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge)


def test_whitening_of_rows_without_an_id(spark):
    rows = rows_of([[0.0, 1.0], [1.0, 5.0], [2.0, 3.0]], [0, 0, 0])
    rows[1] = (None, *rows[1][1:])
    assert sorted((r.vec_id is None, r.component) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()).count((True, 1)) == 1
