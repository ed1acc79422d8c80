import random

from skyloom.operators import stats as S
from skyloom.plans import extended_queries as E
from skyloom.plans import image_queries as I


def test_bending_energy_reads_every_row(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(64)]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.key, r.scale) for r in E.d46(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, s) for i in range(30) for s in (1.0, 2.0, 4.0)]


def test_labels_of_tiles_stay_apart_in_a_tall_image(spark, tmp_path):
    """Over 10,000 rows the gaps between tiles number more than 100."""
    bright = {(0, 10299), (1, 1)}
    rows = [(j, [5.0 if (i, j) in bright else float((i + j) % 2) for i in range(2)]) for j in range(10300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert I.d34(spark, str(tmp_path)).collect() == [(2, 2, 1)]


def test_image_stats_of_millions_of_pixels(spark):
    """The cube of the count doesn't fit a long."""
    n = 3_000_000
    r = spark.range(n).selectExpr("id % 7D AS w").agg(*S.image_stats()).collect()[0]
    assert r.n == n and abs(r.skewness_err - (6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))) ** 0.5) < 1e-12
