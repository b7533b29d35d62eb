"""Golden values and a dense numpy model against runs."""

import numpy as np
import pytest

from runloom import config
from runloom.errors import IncompatibleTensor
from runloom.operators import convolve, manipulate, reduce
from runloom.operators import tensor as T


def disc(spark, d=64, r=16):
    y = np.arange(d)
    q = r * r - (y - d / 2 + 0.5) ** 2
    a = np.zeros((d, d), np.int32)
    for k in np.flatnonzero(q >= 0):
        a[k, int(d / 2 - 0.5 - np.sqrt(q[k])) : int(d / 2 - 0.5 + np.sqrt(q[k]))] = 1
    return a, T.from_numpy(spark, a)


def test_point_slice_and_set_goldens(spark):
    x = T.full(spark, 5)
    x[2], x[1], x[4] = 5, 3, 2
    assert x.to_list() == [0, 3, 5, 0, 2]
    assert x[2] == 5 and x[-1] == 2
    assert [x[s].to_list() for s in (slice(0, 3), slice(2, 4), slice(2, 5, 2), slice(0, 4, 3))] == [[0, 3, 5], [5, 0], [5, 2], [0, 0]]
    x[0:3], x[2:5] = 2, 3
    x[1:3] = -x[2:4]
    x[4:5] = x[0:1] * 2
    assert x.to_list() == [2, -3, -3, 3, 4]
    x[0:3:2] = 1
    x[1:5:2] = x[0:3:2] * 2
    assert x.to_list() == [1, 2, 1, 2, 4]
    assert x[1:5][::2].to_list() == [2, 2]


def test_runs_and_dumps(spark):
    x = T.from_list(spark, [1, 3, 3, 2, 2])
    assert x.dumps() == "1=>1, 3=>3, 5=>2"
    assert x.rle_length() == 3
    assert T.full(spark, 0).to_list() == [] and T.full(spark, 0).empty()
    b = T.builder(spark, 10, 1)
    b[1], b[3] = 3, 4
    assert b.build()[0:10:2].dumps() == "5=>1"
    b[2:8] = 9
    b[5] = 1
    assert b.build().to_list() == [1, 3, 9, 9, 9, 1, 9, 9, 1, 1]
    assert T.full(spark, 1, 7).item() == 7
    b = T.builder(spark, (1, 6))
    b[0, 1:5] = 9
    assert b.build().to_list() == [0, 9, 9, 9, 9, 0]
    rng = np.random.default_rng(5)
    b, dense = T.builder(spark, (5, 4, 3), 1), np.ones((3, 4, 5), np.int32)
    for k in range(25):
        low = [int(rng.integers(0, n)) for n in (5, 4, 3)]
        cut = tuple(slice(a, int(rng.integers(a, n + 1))) for a, n in zip(low, (5, 4, 3)))
        if k % 3:
            b[cut], dense[cut[::-1]] = k, k
        else:
            block = rng.integers(0, 9, dense[cut[::-1]].shape).astype(np.int32)
            dense[cut[::-1]] = block
            if block.size:
                b[cut] = T.from_numpy(spark, block)
    assert b.build().to_numpy().tolist() == dense.tolist()


def test_many_updates_of_one_place(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("start"), (F.col("id") % 3 + 1 + F.col("id") % 50).alias("end"), (F.col("id") % 1000).cast("int").alias("val"))
    dense = np.full(60, -1)
    for k in range(39_000, 40_000):
        dense[k % 3 : k % 3 + 1 + k % 50] = k % 1000
    assert T.apply_updates(rows, 60, -1, "i").to_list() == dense.tolist()


def test_no_window_holds_the_whole_domain(spark):
    from runloom.plans import runs as R

    a = np.repeat(np.random.default_rng(0).integers(0, 2, 4000), 3).astype(np.int32)
    a[2000:9000] = 1
    frame = T.from_numpy(spark, a).frame()
    for block, fan in ((4, 3), (16, 4), (1 << 16, 4)):
        R.FAN, before = fan, R.FAN
        try:
            got = R.canonical(R.split(frame, 7).select("start", "end", "val"), len(a), block)
            rows = sorted(tuple(r) for r in got.collect())
        finally:
            R.FAN = before
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        assert rows == [(s, e, a[s]) for s, e in zip(start.tolist(), [*start[1:].tolist(), len(a)])]
    plan = R.canonical(frame, 1 << 40)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_strided_sets_in_two_dimensions(spark):
    t = T.full(spark, (4, 4))
    t[0::2, 0::2], t[1::2, 0::2], t[0::2, 1::2], t[1::2, 1::2] = 1, 2, 3, 4
    assert t.to_list() == [1, 2, 1, 2, 3, 4, 3, 4] * 2
    assert t[1:4, 0:4:2].to_list() == [2, 1, 2, 2, 1, 2]
    u = T.full(spark, (3, 3))
    u[1, 0:2], u[0:2, 0], u[2:3, 2:3] = 1, 2, 3
    assert u.to_numpy().tolist() == [[2, 2, 0], [0, 1, 0], [0, 0, 3]]


@pytest.mark.parametrize("seed", range(6))
def test_random_expressions_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(3, 12, rng.integers(1, 4)))
    a, b = (np.repeat(rng.integers(-9, 9, 1 + int(np.prod(shape)) // 3), 3)[: int(np.prod(shape))].reshape(shape).astype(np.int32) for _ in range(2))
    x, y = T.from_numpy(spark, a), T.from_numpy(spark, b)
    with config.config_scope(block=int(rng.integers(5, 40))):
        assert (x * y + x - 3).to_numpy().tolist() == (a * b + a - 3).tolist()
        assert (x.min(y)).to_numpy().tolist() == np.minimum(a, b).tolist()
        assert ((x < y) & (x != 0)).to_numpy().tolist() == ((a < b) & (a != 0)).tolist()
        cut = tuple(slice(int(rng.integers(0, n // 2 + 1)), int(rng.integers(n // 2, n + 1)), int(rng.integers(1, 4))) for n in shape)
        got = (x + y)[cut[::-1]]
        assert got.to_numpy().tolist() == (a + b)[cut].tolist()
        c = a.copy()
        c[cut] = (b[cut] * 2).astype(np.int32)
        z = x.clone()
        z[cut[::-1]] = y[cut[::-1]] * 2
        assert z.to_numpy().tolist() == c.tolist()
        rows = x.runs().orderBy("start").collect()
        assert [r[0] for r in rows[1:]] == [r[1] for r in rows[:-1]] and rows[-1][1] == a.size
        assert all(p[2] != q[2] for p, q in zip(rows, rows[1:]))
        for axis in range(len(shape)):
            assert reduce.sum(x, axis).to_numpy().reshape(-1).tolist() == a.sum(len(shape) - 1 - axis).reshape(-1).tolist()
        assert reduce.sum(x, wide=True) == a.sum()


def test_integer_and_float_rules(spark):
    x = T.from_list(spark, [-7, 7, 2**31 - 1, 46341])
    assert (x // 2).to_list() == [-3, 3, 1073741823, 23170]
    assert (x % 3).to_list() == [-1, 1, 1, 0]
    assert (x + 1).to_list()[2] == -(2**31)
    assert (x * x).to_list()[3] == 46341 * 46341 - 2**32
    assert (x << 1).to_list()[0] == -14 and (x >> 1).to_list()[0] == -4
    f = T.from_list(spark, [1.0, -1.0, 0.0, float("nan")])
    z = T.from_list(spark, [0.0, 0.0, 0.0, 1.0])
    d = (f / z).to_list()
    assert d[:2] == [float("inf"), float("-inf")] and d[2] != d[2] and d[3] != d[3]
    assert (f == f).to_list() == [True, True, True, False]
    assert T.from_list(spark, [-1.7, 2.9]).to(int).to_list() == [-1, 2]
    assert (2 ** T.from_list(spark, [3, 5])).to_list() == [8, 32]
    assert T.from_list(spark, [0, 4]).coalesce(9).to_list() == [9, 4]
    assert T.where(T.from_list(spark, [True, False]), 5, T.from_list(spark, [1, 2])).to_list() == [5, 2]
    with pytest.raises(IncompatibleTensor):
        T.from_list(spark, [1, 2]) + T.from_list(spark, [1, 2, 3])


def test_reductions(spark):
    for values, want in (([], 0), ([2], 2), ([2, -3], -1), ([2, -3, 4], 3), (list(range(1, 9)), 36)):
        assert reduce.sum(T.from_list(spark, values, "i")) == want
    t = T.from_list(spark, [3, 3, -2, 5])
    assert reduce.prod_(t) == -90
    for values in ([], [0, 5], [7] * 40, [2] * 31, [2] * 32, [-1, -1, -1], [123456789, -987654321, 4, 3], [2**31 - 1, -(2**31), 1], [-(2**31), 3]):
        want = 1
        for v in values:
            want = want * v % 2**32
        assert reduce.prod_(T.from_list(spark, values, "i")) == (want + 2**31) % 2**32 - 2**31, values
    assert reduce.prod_(T.from_list(spark, [2.0, 0.0, 3.0])) == 0.0 and reduce.prod_(T.from_list(spark, [], "f")) == 1.0
    assert reduce.prod_(T.from_list(spark, [2.0, -0.5, 3.0])) == -3.0
    long = np.arange(1000) * 37 % 911
    assert reduce.reduce(lambda a, b: a - b * 0 + b, T.from_list(spark, long.tolist())) == long.sum()
    assert reduce.reduce(lambda a, b: a.max(b), t) == 5
    assert {r[0]: r[1] for r in reduce.histogram(t).collect()} == {3: 2, -2: 1, 5: 1}
    a = np.arange(24, dtype=np.int32).reshape(2, 3, 4)
    assert reduce.reduce(lambda x, y: x + y, T.from_numpy(spark, a), 1).to_numpy().tolist() == a.sum(1).tolist()


def test_composition(spark):
    a, b = T.full(spark, (2, 1), 1), T.full(spark, (1, 2), 2)
    assert manipulate.stack(a, b).to_numpy().tolist() == [[1, 1, 0], [0, 0, 2], [0, 0, 2]]
    assert manipulate.concat([T.from_list(spark, [1, 2]), T.from_list(spark, [3])]).to_list() == [1, 2, 3]
    assert manipulate.pad(T.full(spark, (1, 1), 5), 1, 2).to_numpy().tolist() == [[2, 2, 2], [2, 5, 2], [2, 2, 2]]
    n = np.arange(24, dtype=np.int32).reshape(2, 3, 4)
    t = T.from_numpy(spark, n)
    assert manipulate.transpose(t).to_numpy().tolist() == n.transpose().tolist()
    assert t.reshape(4, 6).to_numpy().tolist() == n.reshape(6, 4).tolist()
    assert manipulate.take(t, slice(1, None, 2), 0).to_numpy().tolist() == n[:, :, 1::2].tolist()
    assert t.reshape(1, 24).squeeze().shape == (24,)


def test_convolution(spark):
    a, t = disc(spark)
    assert reduce.sum(t) == a.sum()
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], np.int32)
    p = np.pad(a, 1)
    want = sum(k[i, j] * p[i : i + 64, j : j + 64] for i in range(3) for j in range(3))
    assert convolve.conv_2d(t, k, 1).to_numpy().tolist() == want.tolist()
    got = convolve.conv(t.to(float), k.astype(np.float32), 1).to_numpy()
    assert np.allclose(got, want)
    assert convolve.conv(T.full(spark, (3, 3), 1), np.ones((2, 2), np.int32), 1, 4).to_numpy().tolist() == [[13, 10, 10, 13], [10, 4, 4, 10], [10, 4, 4, 10], [13, 10, 10, 13]]
    assert np.allclose(convolve.downsample(t).to_numpy(), a.reshape(32, 2, 32, 2).mean((1, 3)))
    n = np.random.default_rng(3).integers(-4, 9, (5, 4, 7)).astype(np.int32)
    edge = np.pad(n, [(0, 1), (0, 0), (0, 1)], mode="edge")
    assert np.allclose(convolve.downsample(T.from_numpy(spark, n)).to_numpy(), edge.reshape(3, 2, 2, 2, 4, 2).mean((1, 3, 5)))
    assert np.allclose(convolve.box(t).to_numpy(), sum(p[i : i + 64, j : j + 64] for i in range(3) for j in range(3)) / 9)
    assert convolve.sharpen(t).to_numpy().tolist() == (9 * a - sum(p[i : i + 64, j : j + 64] for i in range(3) for j in range(3))).tolist()
    assert convolve.highlight_runs(T.from_list(spark, [1, 1, 2, 2, 2, 3])).to_list() == [True, False, True, True, False, False]


def test_shuffles(spark):
    x, y = T.from_list(spark, list(range(50))).eval(), T.from_list(spark, list(range(50))).eval()
    assert "Exchange" not in (x[3:40:2] * 2 + 1).frame()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in (x * x + x).frame()._jdf.queryExecution().executedPlan().toString()
    plan = (x[1:] * y[:-1] - x[1:] % 7).frame()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
