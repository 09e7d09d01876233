"""Whitening against numpy on the whole matrix."""

import numpy as np
import pytest

from corpusloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(5)


def wanted(rows, most=32):
    used = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and not any(c is None for c in v) and np.isfinite(np.array(v, dtype=float)).all()]
    x = np.floor(64 * np.stack([v for _, v in used])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = x - s / n
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:most] > 1e-9 * e[0]).sum())
    return [i for i, _ in used], deviation, centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(covariance)


def check(spark, rows, most=32):
    ids, deviation, projected, explained = wanted(rows, most)
    got = whitening.whitened(frame(spark, rows), most)
    assert got.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.toPandas()
    k = projected.shape[1]
    assert len(got) == len(ids) * k and set(got.n) == {len(ids)} and got.identity_error.nunique() == 1 and got.identity_error.max() <= 1e-4
    signs = None
    for i, dev, row in zip(ids, deviation, projected):
        if i is None or ids.count(i) > 1:
            continue
        mine = got[got.id == i].sort_values("component")
        assert list(mine.component) == list(range(1, k + 1)) and set(mine.deviation) == {dev}
        signs = np.sign(mine.whitened.to_numpy() * row) if signs is None else signs
        assert np.abs(mine.whitened.to_numpy() * signs - row).max() < 1e-6
        assert np.abs(mine.explained.to_numpy() / explained - 1).max() < 1e-6


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    spread = np.linspace(3, 0.4, 40)
    out = [(k, (rng.normal(size=40) * spread + 0.3).tolist()) for k in range(700)]
    out += [(800, None), (801, []), (802, [None] * 40), (803, [float("nan")] * 40), (804, [float("inf")] * 40), (805, [0.0] * 40), (None, out[0][1]), (806, out[1][1]), (806, out[1][1])]
    return out


def test_equal_to_numpy(spark, rows):
    check(spark, rows)


def test_blocks_of_few_rows(spark, rows, monkeypatch):
    """Many blocks, the last one of each task padded: the grid of the projection has holes and edges."""
    monkeypatch.setattr(whitening, "BLOCK", 40 * 7)
    check(spark, rows)
    check(spark, rows[:300], 5)


def test_directions_without_variance_have_no_rows(spark, rows):
    flat = [(i, [*v[:6], 1.5, v[0]]) for i, v in rows[:200]]
    got = whitening.whitened(frame(spark, flat)).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3, 4, 5, 6] and got.identity_error.max() < 1e-4
    assert whitening.whitened(frame(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0])])).count() == 0


def test_empty_tables_odd_lengths_and_large_entries(spark, rows):
    assert whitening.whitened(frame(spark, rows[:1]).where("vec_id = 99")).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    mixed = [*rows[:50], (900, [1.0, 2.0]), (901, [1e30] * 40)]
    assert set(whitening.whitened(frame(spark, mixed)).toPandas().id) == set(range(50))
    large = [(k, [float(2.0**40 * (k % 3)), float(k)]) for k in range(20)]
    got = whitening.whitened(frame(spark, large)).toPandas()
    ids, deviation, *_ = wanted(large)
    assert {i: d for i, d in zip(got.id, got.deviation)}.keys() == set(ids) and got.deviation.isna().all() and min(deviation) > 2**63


def test_exact_sums():
    assert whitening.exact_sum(np.array([[2**62, 1], [2**62, 2]])) == [2**63, 3] and whitening.exact_sum(np.zeros((0, 2), dtype=np.int64)) == [0, 0]
