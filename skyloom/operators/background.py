"""Background and noise: samples, grids of samples, and maps interpolated from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import stats as S
from .graph import written

ESTIMATORS = ("mean", "median", "biweight", "clipped")
LEAST_PIXELS = 10


def sample_background(px: DataFrame, keys: list[str], estimator: str = "median", w: str = "w", zero: bool = False) -> DataFrame:
    """(keys, n, bkg, rms, reliable) of each group of pixels; unreliable with under 10 pixels or a value that is 0 or not finite.

    zero: a background of 0 is as good as any other, as it is in a residual.
    """
    if estimator == "mean":
        s = px.groupBy(*keys).agg(F.count(w).alias("n"), F.avg(w).alias("bkg"), F.stddev_samp(w).alias("rms"))
    elif estimator == "median":
        s = S.grouped_median_mad(px, keys, w).withColumnRenamed("median", "bkg")
    elif estimator == "biweight":
        s = S.biweight(px, keys, w).withColumnsRenamed({"location": "bkg", "scale": "rms"})
    elif estimator == "clipped":
        s = S.clipped_tiles(px, keys, w, 3.0, 100, 0.1).withColumnRenamed("median", "bkg")
    else:
        raise ValueError(f"unknown estimator {estimator!r}: {', '.join(ESTIMATORS)}")
    good = (F.col("n") >= LEAST_PIXELS) & ((F.col("bkg") != 0) | F.lit(zero)) & ~F.isnan("bkg") & ~F.isnan("rms") & (F.abs("bkg") < float("inf"))
    return s.select(*keys, "n", "bkg", "rms", F.coalesce(good, F.lit(False)).alias("reliable"))


def tile_starts(n: int, box: int, fraction: float) -> list[tuple[int, int]]:
    """Inclusive ranges of tiles of `box` pixels in steps of a fraction of the box; the last is cut off, one of no width is dropped."""
    step = max(1, int(fraction * box + 0.5))
    out = []
    for a in range(0, n, step):
        z = min(a + box, n) - 1
        if z > a:
            out.append((a, z))
        if z >= n - 1:
            break
    return out


def grid_centres(n: int, box: int, grid: int) -> list[int]:
    """Centres of sampling boxes: from box / 2 on in steps of the grid while the box fits."""
    out, c = [], box // 2
    while c <= n - 1 - box // 2:
        out.append(c)
        c += max(1, grid)
    return out or [n // 2]


def grid_background(px: DataFrame, nx: int, ny: int, box: tuple[int, int], grid: tuple[int, int], estimator: str = "median", zero: bool = False) -> DataFrame:
    """(i, j, cx, cy, n, bkg, rms, reliable): samples at grid nodes, failed ones replaced.

    A pixel goes to the few boxes it lies in, found by arithmetic on its index (boxes are centre - box / 2 .. + box - 1).
    A failed sample takes the mean of up to 3 reliable ones before it in x, then in y.
    """
    spark = px.sparkSession
    axes = []
    for name, n, b, g in (("x", nx, box[0], grid[0]), ("y", ny, box[1], grid[1])):
        rows = [(k, c, c - b // 2, c - b // 2 + b - 1) for k, c in enumerate(grid_centres(n, b, g))]
        axes.append(spark.createDataFrame(rows, f"{'i' if name == 'x' else 'j'} long, c{name} long, {name}0 long, {name}1 long"))
    cols = spark.createDataFrame([(x, k) for k, c in enumerate(grid_centres(nx, box[0], grid[0])) for x in range(max(0, c - box[0] // 2), min(nx, c - box[0] // 2 + box[0]))], "ix long, i long")
    rows = spark.createDataFrame([(y, k) for k, c in enumerate(grid_centres(ny, box[1], grid[1])) for y in range(max(0, c - box[1] // 2), min(ny, c - box[1] // 2 + box[1]))], "iy long, j long")
    # A row of `cols` and `rows` per pixel index and box: of the size of the image's sides.
    s = sample_background(px.join(F.broadcast(cols), "ix").join(F.broadcast(rows), "iy"), ["i", "j"], estimator, zero=zero)
    nodes = axes[0].select("i", "cx").crossJoin(axes[1].select("j", "cy")).join(s, ["i", "j"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    for axis, other in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(other).orderBy(axis).rowsBetween(-3, -1)
        for v in ("bkg", "rms"):
            nodes = nodes.withColumn(f"_{v}", F.avg(F.when(F.col("reliable"), F.col(v))).over(w))
        rescued = ~F.col("reliable") & F.col("_bkg").isNotNull()
        nodes = nodes.select("i", "j", "cx", "cy", "n", F.when(rescued, F.col("_bkg")).otherwise(F.col("bkg")).alias("bkg"), F.when(rescued, F.col("_rms")).otherwise(F.col("rms")).alias("rms"), (F.col("reliable") | rescued).alias("reliable"))
    return nodes


def bilinear(px: DataFrame, nodes: DataFrame, grid: tuple[int, int], first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """`px` with bkg and rms interpolated between the four nodes around each pixel, clamped outside the grid.

    first and last: centres of the first and last node in x and y; last[k] - first[k] is a multiple of grid[k].
    """
    top = [(last[k] - first[k]) // grid[k] for k in (0, 1)]

    def node(c, k):
        u = F.least(F.greatest((F.col(c) - first[k]) / grid[k], F.lit(0.0)), F.lit(float(top[k])))
        a = F.least(F.floor(u), F.lit(max(0, top[k] - 1)))
        return a, u - a

    (i, fx), (j, fy) = node("ix", 0), node("iy", 1)
    p = px.withColumns({"_i": i, "_fx": fx, "_j": j, "_fy": fy})
    # One row a cell of the grid with the values of its four corners, so that pixels are joined once.
    nodes = written(nodes.select("i", "j", "bkg", "rms"), "nodes")
    cells = nodes.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.struct("bkg", "rms").alias("v00"))
    for dx, dy in ((1, 0), (0, 1), (1, 1)):
        n = nodes.select(F.col("i").alias("_a"), F.col("j").alias("_b"), F.struct("bkg", "rms").alias(f"v{dx}{dy}"))
        cells = cells.join(n, (F.least(F.col("_i") + dx, F.lit(top[0])) == F.col("_a")) & (F.least(F.col("_j") + dy, F.lit(top[1])) == F.col("_b"))).drop("_a", "_b")
    p = p.join(written(cells, "cells"), ["_i", "_j"])

    def mix(v):
        x0 = F.col("v00")[v] * (1 - F.col("_fx")) + F.col("v10")[v] * F.col("_fx")
        x1 = F.col("v01")[v] * (1 - F.col("_fx")) + F.col("v11")[v] * F.col("_fx")
        return x0 * (1 - F.col("_fy")) + x1 * F.col("_fy")

    return p.select(*px.columns, mix("bkg").alias("bkg"), mix("rms").alias("rms"))


def local_background(px: DataFrame, nx: int, ny: int, box: tuple[int, int], grid: tuple[int, int], estimator: str = "median", second_pass: bool = False) -> DataFrame:
    """`px` with bkg and rms maps; the second pass replaces rms by that of the residual."""
    cx, cy = grid_centres(nx, box[0], grid[0]), grid_centres(ny, box[1], grid[1])
    ends = ((cx[0], cy[0]), (cx[-1], cy[-1]))
    out = bilinear(px, grid_background(px, nx, ny, box, grid, estimator), grid, *ends)
    if second_pass:
        rest = out.select("ix", "iy", (F.col("w") - F.col("bkg")).alias("w"))
        again = bilinear(rest.select("ix", "iy", "w"), grid_background(rest, nx, ny, box, grid, estimator, zero=True), grid, *ends)
        out = out.drop("rms").join(again.select("ix", "iy", "rms"), ["ix", "iy"])
    return out


def global_background(px: DataFrame, estimator: str = "median", w: str = "w") -> tuple[float, float]:
    """Background and noise of the whole image, by distributed steps; NaN for an image without pixels."""
    if estimator == "median":
        return S.median_mad(px, w)
    if estimator == "mean":
        r = px.agg(F.avg(w).alias("bkg"), F.stddev_samp(w).alias("rms")).collect()[0]
    elif estimator == "biweight":
        r = S.biweight(px, [], w).select("location", "scale").collect()[0]
    elif estimator == "clipped":
        r = S.clipped(px, [], w, 3.0, 100, 0.1).select("median", "rms").collect()[0]
    else:
        raise ValueError(f"unknown estimator {estimator!r}: {', '.join(ESTIMATORS)}")
    return tuple(float("nan") if v is None else v for v in r)


def significance(px: DataFrame, threshold_noise: float = 0.0) -> DataFrame:
    """`px` (w, bkg, rms) with z = (w - bkg) / rms; 0 where the pixel is missing or there is no noise."""
    ok = (F.col("w") != 0) & (F.col("rms") > threshold_noise)
    return px.withColumn("z", F.when(ok, (F.col("w") - F.col("bkg")) / F.col("rms")).otherwise(0.0))
