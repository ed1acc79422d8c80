"""Overlaps of ellipses against clipping of their polygons one by one."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import extended as X


def test_overlaps_match_clipping(spark):
    rng = np.random.default_rng(0)
    n = 60
    e = [rng.uniform(0, 12, n), rng.uniform(0, 12, n), rng.uniform(1, 4, n), rng.uniform(0.2, 2, n), rng.uniform(0, 6, n)]
    for k, v in enumerate(e):
        v[1] = v[0]  # the same twice
        v[3] = v[2] * (3 if k in (2, 3) else 1)  # one in the other, same centre
    e[2][4:6] = e[3][4:6] = 2  # circles turned by two sides
    for v in e[:2]:
        v[5] = v[4]
    e[4][5] = e[4][4] + 4 * np.pi / 64
    df = spark.createDataFrame([(i, *(float(v[i]) for v in e)) for i in range(n)], "id long, x double, y double, major double, minor double, theta double")
    overlaps = X.ellipse_overlaps(df, df, once=True).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in overlaps}) > 1
    got = {(r.a, r.b): (r.area, r.fraction) for r in overlaps}
    p = [X._polygon([v[i] for v in e]) for i in range(n)]
    want = {(i, j): X.clip_area(p[i], p[j]) for i in range(n) for j in range(i + 1, n)}
    assert set(got) == {k for k, v in want.items() if v > 0} and len(got) > 100
    for (i, j), (area, fraction) in got.items():
        assert abs(area - want[i, j]) < 1e-9 and abs(fraction * np.pi * min(e[2][i] * e[3][i], e[2][j] * e[3][j]) - area) < 1e-9
