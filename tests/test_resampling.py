"""Bootstraps, permutations and Kendall's tau against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadweave.operators import resampling


def number(key, seed):
    return int(hashlib.md5(f"{seed}-{key}".encode()).hexdigest()[:8], 16) % resampling.PRIME


def draws(keys, n, seed):
    """draws x rows of values, by Python's own integers."""
    c = resampling.coefficients(n, seed).tolist()
    x = [number(k, seed) for k in keys]
    return [[(((a * v + b) * v + d) * v + e) % resampling.PRIME for v in x] for a, b, d, e in c]


def weight(v):
    return sum((v + 0.5) / resampling.PRIME > p for p in resampling.POISSON)


def test_weights_are_poisson():
    x = np.arange(1, 20_001) * 7919 % resampling.PRIME
    w = sum((resampling.values_of(resampling.coefficients(40, 3), x) >= k).astype(int) for k in resampling.poisson_steps())
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w)[np.triu_indices(40, 1)]).max() < 0.05
    assert resampling.poisson_steps() == [next(k for k in range(int(p * resampling.PRIME) - 3, resampling.PRIME) if (k + 0.5) / resampling.PRIME > p) for p in resampling.POISSON]


def test_sums_by_group(spark, monkeypatch):
    monkeypatch.setattr(resampling, "GROUPS", 2)
    monkeypatch.setattr(resampling, "CELLS", 200)
    rows = [(i, "abc"[i % 3] if i % 7 else None, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, g string, v double").repartition(4)
    got = {(r.g, r.draw): (r.n, r.s) for r in resampling.resampled_sums(df, "k", {"n": F.lit(1), "s": F.col("v")}, 30, 5, "g").collect()}
    want, made = {}, draws(range(60), 30, 5)
    for d in range(30):
        for i, g, v in rows:
            n, s = want.get((g, d + 1), (0, 0))
            want[g, d + 1] = (n + weight(made[d][i]), s + v * weight(made[d][i]))
    assert got == want


def test_paired_bootstrap_draws_each_row_by_itself(spark):
    """Keys whose numbers for the other bootstraps are equal, a null difference and a null key."""
    keys, twins = range(40), (82326, 84844)
    assert number(twins[0], 42) == number(twins[1], 42)
    share = lambda k, d: (int(hashlib.md5(f"42-{k}-{d}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    w = np.array([[sum(share(k, d) > p for p in resampling.POISSON) for k in keys] for d in range(1, 201)])
    v = np.array([float(k % 7) for k in keys])
    df = spark.createDataFrame([*zip(keys, v.tolist()), (900, None), (None, 5.0)], "k long, v double").repartition(3)
    got = resampling.paired_bootstrap(df, "k", F.col("v"), 200).first()
    assert [got.low, got.high] == pytest.approx(np.quantile(w @ v / w.sum(axis=1), [0.025, 0.975])) and got.n_defined == 200
    two = resampling.paired_bootstrap(spark.createDataFrame([*zip(twins, (0.0, 1.0))], "k long, v double"), "k", F.col("v"), 200).first()
    assert (two.low, two.high) == (0.0, 1.0)
    none = resampling.paired_bootstrap(df.limit(0), "k", F.col("v"), 20).first()
    assert (none.low, none.high, none.n_defined) == (None, None, 0)


def test_bootstrap_mean(spark):
    df = spark.createDataFrame([(i, "g", float(i % 10)) for i in range(300)] + [(900, "h", None), (901, None, 2.0), (902, None, 4.0)], "k long, g string, x double")
    out = {r.g: r for r in resampling.bootstrap_mean(df, "k", "g", "x", 400).collect()}
    assert set(out) == {"g", None} and (out["g"].n, out["g"].mean) == (300, 4.5) and 3.9 < out["g"].low < 4.5 < out["g"].high < 5.1
    assert resampling.bootstrap_mean(df.limit(0), "k", "g", "x", 20).count() == 0


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_permutation(spark, bins):
    r = np.random.default_rng(2)
    rows = [(i, bool(i % 3 == 0), float(r.normal() + (i % 3 == 0) * 0.5)) for i in range(90)]
    df = spark.createDataFrame([*rows, (100, True, None)], "k long, g boolean, v double").repartition(3)
    got = resampling.permutation_test(df, "k", F.col("g"), "v", 200, 9, bins).first()
    v = np.array([x[2] for x in rows])
    mean = lambda g: v[g].mean() - v[~g].mean()
    observed = mean(np.array([x[1] for x in rows]))
    far = 0
    for one in draws(range(90), 200, 9):
        g = np.zeros(90, bool)
        g[sorted(range(90), key=lambda i: (one[i], i))[:30]] = True
        far += abs(mean(g)) >= abs(observed) - 1e-9
    assert got.difference == pytest.approx(observed) and got.p == pytest.approx((far + 1) / 201)


def test_no_spread(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0), (3, 1, 2.0)], "k int, x int, v double")
    assert resampling.kendall_tau(df, "x", "v").first().tau is None
    assert resampling.kendall_tau(df.where("k > 9"), "x", "v").first().n == 0
    assert resampling.kendall_tau(df, "k", "k").first().tau == 1.0
    assert resampling.permutation_test(df, "k", F.col("k") == 1, "v", 50).first().p == 1.0
    assert resampling.permutation_test(df, "k", F.col("k") > 9, "v", 50).first().p is None
    one = resampling.paired_bootstrap(df, "k", F.col("v"), 50).first()
    assert (one.low, one.high) == (2.0, 2.0)


@pytest.mark.parametrize("strip", [1 << 20, 40, 7])
def test_kendall(spark, strip):
    """Ties, one value with a third of the rows, more levels than rows of a strip."""
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=300), 1)
    x[:100] = 0.3
    y = np.round(x + r.normal(size=300), 1)
    y[50:120] = -0.2
    up = down = tx = ty = 0
    for i in range(300):
        for j in range(i):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            up, down, tx, ty = up + (s > 0), down + (s < 0), tx + (x[i] == x[j]), ty + (y[i] == y[j])
    every = 300 * 299 / 2
    want = (up - down) / np.sqrt((every - tx) * (every - ty))
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0)], "x double, y double").repartition(3)
    got = resampling.kendall_tau(df, "x", "y", strip).first()
    assert got.n == 300 and got.tau == pytest.approx(want)


def test_points_below_and_left():
    r = np.random.default_rng(1)
    x, y, w = r.integers(0, 9, 200), r.integers(0, 30, 200), r.integers(1, 4, 200)
    want = [w[(x < x[k]) & (y < y[k])].sum() for k in range(200)]
    assert resampling.below_left(x.astype(float), y.astype(float), w).tolist() == want
