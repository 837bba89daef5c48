import numpy as np
import pytest
from pyspark.sql import types as T

from cellclock.llm import whitening

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *[T.StructField(c, T.StringType()) for c in ("label", "n", "x", "ids", "sums", "component", "part")],
    ]
)


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, v, *"abcdefg") for i, v in rows], SCHEMA)


def expected(rows, k=8):
    """By a full eigendecomposition of the exact covariance."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in good], object)
    n, s = len(good), x.sum(0)
    y = (x - s / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in good], ((n * x - s) ** 2).sum(1), y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def checked(rows, got, k=8):
    ids, deviation, white, share = expected(rows, k)
    assert len(got) == len(ids) * k
    table = {}
    for r in got:
        table.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == len(ids) and abs(r.explained - share[r.component - 1]) < 1e-10 and r.identity_error < 1e-10
    assert sorted({k for k in table}, key=str) == sorted({(str(i), d) for i, d in zip(ids, deviation)}, key=str)
    sign = None
    for row, (i, d) in enumerate(zip(ids, deviation)):
        have = np.array([sorted(table[str(i), d][c + 1])[0] for c in range(k)])
        if sign is None:
            sign = np.sign(have * white[row])
        assert np.abs(have * sign - white[row]).max() < 1e-8


def test_whitened(frame):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((64, 64)) * np.geomspace(1, 0.05, 64)
    v = (rng.standard_normal((3000, 64)) @ mix * 0.1).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(5000, None), (5001, []), (5002, [None] * 64), (5003, [float("nan")] * 64), (5004, [float("inf")] + [0.0] * 63), (5005, [1.0, 2.0]), (None, v[0].tolist()), (0, v[0].tolist())]
    got = whitening.whitened(frame(rows + odd)).collect()
    checked(rows + odd[-2:], got)


def test_flat_spectrum_and_few_dimensions(frame):
    rng = np.random.default_rng(2)
    flat = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((900, 48)).astype(np.float32) / 8)]
    checked(flat, whitening.whitened(frame(flat)).collect())
    few = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((50, 5)).astype(np.float32))]
    checked(few, whitening.whitened(frame(few)).collect(), k=5)


def test_hot_vector(frame):
    rng = np.random.default_rng(3)
    rows = [(i, [0.25] * 40) for i in range(400)] + [(400 + i, x.tolist()) for i, x in enumerate(rng.standard_normal((300, 40)).astype(np.float32))]
    checked(rows, whitening.whitened(frame(rows)).collect())


def test_nothing_to_whiten(frame):
    assert whitening.whitened(frame([])).collect() == []
    assert whitening.whitened(frame([(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whitened(frame([(1, [0.5] * 8), (2, [0.5] * 8)])).collect() == []
    line = whitening.whitened(frame([(i, [float(i)] * 8) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9
    with pytest.raises(Exception, match="does not fit"):
        whitening.whitened(frame([(1, [1e30] * 4), (2, [0.0] * 4)])).collect()


def test_deviations_are_exact(frame):
    rows = [(i, [float((i * 7919 + j * 104729) % 4000) * 100 for j in range(6)]) for i in range(2000)]
    _, want, _, _ = expected(rows, 6)
    got = {r.vec_id: r.deviation for r in whitening.whitened(frame(rows)).collect()}
    assert [got[i] for i, _ in rows] == want.tolist()


def test_certificate(frame, spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((500, 64)).astype(np.float32))]
    blocks = whitening.packed(whitening.usable(frame(rows))).cache()
    v = whitening.Covariance(blocks)
    e, p = whitening.components(v)
    assert np.abs(v.times(p) - p * e).max() < 1e-10 * e[0] and np.abs(p.T @ p - np.eye(8)).max() < 1e-12
    assert v.passes < 200
    blocks.unpersist()
