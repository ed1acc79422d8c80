"""Statistics of the published vector: 200 draws of a seeded mixture of two normals, and the values expected of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import stats as S

# Median, 1.4826 MAD, mean, rms, clipped mean, median and rms, moments.
MEDIAN, MAD, MEAN, RMS = 0.032658645, 0.30728245008874866, 0.86586417685994999, 3.2996406358899497
CLIPPED = (-0.0020337793885611471, -0.023632809, 0.19585230166658546)
M1, M2, M3, M4 = 0.865864176934, 2166.6380378, 11987.8113948, 207693.943081


@pytest.fixture(scope="module")
def vector(spark):
    rng = np.random.RandomState(0)
    second = rng.binomial(1, 0.35, 200)
    y = rng.normal(0.0, 0.2, 200) + second * rng.normal(3.0, 5.0, 200)
    return spark.createDataFrame([(float(v),) for v in y], "w double")


def test_median_and_mad(vector):
    m, s = S.median_mad(vector)
    assert abs(m - MEDIAN) < 1e-6 and abs(s - MAD) < 1e-6


def test_moments(vector):
    r = vector.agg(*S.moments()).collect()[0]
    assert r.n == 200 and abs(r["mean"] - M1) < 1e-6 and abs(r.m2 - M2) < 1e-6 * M2
    assert abs(r.m3 - M3) < 1e-8 * M3 * 10 and abs(r.m4 - M4) < 1e-8 * M4 * 10
    parts = vector.withColumn("k", F.pmod(F.hash("w"), F.lit(7))).groupBy("k").agg(*S.moments())
    q = S.merged_moments(parts).collect()[0]
    assert q.n == 200 and all(abs(q[c] - r[c]) < 1e-9 * abs(r[c]) for c in ("mean", "m2", "m3", "m4"))


def test_mean_and_rms(vector):
    r = vector.agg(*S.image_stats()).collect()[0]
    assert abs(r["mean"] - MEAN) < 1e-6 and abs(r.rms - RMS) < 1e-6


def test_clipped(vector):
    whole = S.clipped(vector, [], k=3.0, rounds=10, tol=1e-6).collect()[0]
    grouped = S.clipped(vector.withColumn("k", F.lit(1)), ["k"], k=3.0, rounds=10, tol=1e-6).collect()[0]
    tiles = S.clipped_tiles(vector.withColumn("k", F.lit(1)), ["k"], k=3.0, rounds=10, tol=1e-6).collect()[0]
    for r in (whole, grouped, tiles):
        assert all(abs(a - b) < 1e-6 for a, b in zip((r["mean"], r["median"], r["rms"]), CLIPPED))


def test_whole_table_biweight_is_that_of_one_group(vector):
    a = S.biweight(vector, []).collect()[0]
    b = S.biweight(vector.withColumn("k", F.lit(1)), ["k"]).collect()[0]
    assert a.n == b.n == 200 and abs(a.location - b.location) < 1e-9 and abs(a.scale - b.scale) < 1e-9


def test_cumulative_threshold_with_a_heavy_tail(spark, monkeypatch):
    """Nearly all values in one of the equal ranges: it is cut again until few are left."""
    monkeypatch.setattr(S, "COLLECT", 40)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.random(3000), [1e9]])
    df = spark.createDataFrame([(float(x),) for x in v], "w double")
    for fraction in (1e-8, 5e-7, 1.2e-6, 0.9):
        order = np.sort(v)
        want = order[np.searchsorted(np.cumsum(order), fraction * v.sum() * (1 - 1e-12))]
        assert S.cumulative_threshold(df, fraction).collect()[0].threshold == pytest.approx(want, rel=1e-12)
    assert S.cumulative_threshold(df.limit(0), 0.5).collect()[0].threshold is None


def test_nearest_neighbours_match_brute_force(spark):
    from skyloom.operators import extended as X

    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(size=(150, 2)), rng.normal(5, 0.01, (60, 2)), [[40.0, -30.0]], [[5.0, 5.0]] * 5])
    q = rng.normal(1, 2, (80, 2))
    a, b = (spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(z)], "id long, x double, y double") for z in (p, q))
    for other, points, same in ((a, p, True), (b, q, False)):
        got = {r.id: r.d for r in X.nearest_distances(a, other, ["x", "y"], 3, same).collect()}
        for i in range(len(p)):
            d = np.sort(np.sqrt(((points - p[i]) ** 2).sum(axis=1))[[j for j in range(len(points)) if not (same and j == i)]])
            assert abs(got[i] - d[2]) < 1e-9
    assert {r.d for r in X.nearest_distances(a, b.limit(2), ["x", "y"], 3, False).collect()} == {None}


def test_nearest_mean_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(e)], "id long, e array<double>").repartition(5)
    got = {r.id: r.d for r in S.nearest_mean(df.where("id % 20 = 0"), df, 4, block=6).collect()}
    assert sorted(got) == list(range(0, 300, 20))
    for i, d in got.items():
        assert abs(d - np.sort(np.sqrt(((e - e[i]) ** 2).sum(axis=1)))[1:5].mean()) < 1e-9
