"""Sky models: a noise image with point and extended sources, and the catalog of what is true."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import gauss2d

SHAPES = ("point", "gauss", "ring", "disk", "ellipse", "bubble")


def true_catalog(spark: SparkSession, n: int, nx: int, ny: int, seed: int = 1) -> DataFrame:
    """n sources of all shapes with random places, fluxes and sizes."""
    r = [F.rand(seed + i) for i in range(5)]
    s = spark.range(n)
    return s.select(
        F.col("id").alias("source_id"), F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("id") % len(SHAPES) + 1).cast("int")).alias("shape"), (r[0] * (nx - 1)).alias("x0"), (r[1] * (ny - 1)).alias("y0"), (1 + 9 * r[2]).alias("amp"), (2 + 4 * r[3]).alias("size"), (r[4] * 3.14159).alias("theta")
    )


def sky_model(catalog: DataFrame, nx: int, ny: int, noise: float, seed: int = 7, reach: int = 24) -> DataFrame:
    """(ix, iy, w): normal noise plus the sources, each added to the pixels within `reach` of it."""
    spark = catalog.sparkSession
    px = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"), (F.randn(seed) * noise).alias("w"))
    box = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col(c)) - reach), F.least(F.lit(n - 1), F.floor(F.col(c)) + reach)))
    s = catalog.withColumn("ix", box("x0", nx)).withColumn("iy", box("y0", ny))
    r = F.sqrt(F.pow(F.col("ix") - F.col("x0"), 2) + F.pow(F.col("iy") - F.col("y0"), 2))
    amp, size = F.col("amp"), F.col("size")
    point = gauss2d(F.col("ix"), F.col("iy"), amp, F.col("x0"), F.col("y0"), F.lit(1.2), F.lit(1.2), F.lit(0.0))
    wide = gauss2d(F.col("ix"), F.col("iy"), amp, F.col("x0"), F.col("y0"), size, size * 0.6, F.col("theta"))
    v = F.when(F.col("shape") == "point", point).when(F.col("shape").isin("gauss", "ellipse"), wide).when(F.col("shape") == "disk", F.when(r <= size, amp).otherwise(0.0))
    v = v.when(F.col("shape") == "ring", F.when(F.abs(r - size) <= 1.5, amp).otherwise(0.0)).otherwise(F.when(r <= size, amp * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(r / size, 2)))).otherwise(0.0))
    add = s.select("ix", "iy", v.alias("v")).groupBy("ix", "iy").agg(F.sum("v").alias("v"))
    return px.join(add, ["ix", "iy"], "left").select("ix", "iy", (F.col("w") + F.coalesce("v", F.lit(0.0))).alias("w"))
