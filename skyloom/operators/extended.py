"""Further operators: extended-source finders, saliency variants, information measures, contours' curvature, level sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import detect as D
from . import segment as SG
from . import stats as S
from . import stencil as ST
from .catalog import CELL, merge_pixels, overlapping, shared_pixels
from .graph import written


# --- information measures -------------------------------------------------------------------------------------------------
def nearest_distances(a: DataFrame, b: DataFrame, columns: list[str], k: int, same: bool) -> DataFrame:
    """(id, d): distance of each row of `a` to its k-th nearest row of `b` (columns id, *columns); `same` leaves out the row itself.

    A search on cells: every row meets the rows of the cells around its own, and its answer is final if the k-th of
    these is no further off than a cell is wide. The others go on with cells of twice the width. d is null if `b` has
    too few rows.
    """
    dim = len(columns)
    ends = b.agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).collect()[0]
    if ends.n < k + same:
        return a.select("id", F.lit(None).cast("double").alias("d"))
    span = max(ends[f"hi_{c}"] - ends[f"lo_{c}"] for c in columns)
    width = span / max(1.0, (ends.n / (2.0 * k)) ** (1 / dim)) or 1.0
    steps = [()]
    for _ in columns:
        steps = [(*s, i) for s in steps for i in (-1, 0, 1)]
    around = F.array(*[F.array(*[F.lit(i).cast("long") for i in s]) for s in steps])
    other = b.select(F.col("id").alias("_o"), *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    left, done = a.select("id", *columns), []
    while True:
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        x = left.select("id", *columns, F.explode(around).alias("_s")).select("id", *columns, *[(cell(c) + F.col("_s")[i]).alias(f"_cell{i}") for i, c in enumerate(columns)])
        y = other.select("*", *[cell(f"_{c}").alias(f"_cell{i}") for i, c in enumerate(columns)])
        p = x.join(y, [f"_cell{i}" for i in range(dim)])
        p = p.where(F.col("id") != F.col("_o")) if same else p
        d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in columns), F.lit(0.0)))
        near = p.groupBy("id").agg(F.get(F.array_sort(F.collect_list(d)), F.lit(k - 1)).alias("d"))
        found = written(left.join(near, "id", "left").withColumn("final", F.coalesce(F.col("d") <= width, F.lit(False))), "nearest")
        done.append(found.where("final").select("id", "d"))
        left = found.where("NOT final").select("id", *columns)
        if left.isEmpty():
            break
        width *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _ball(m: int) -> float:
    return math.pi ** (m / 2) / math.gamma(m / 2 + 1)


def _digamma(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def entropy(a: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(h): Kozachenko-Leonenko estimate of the differential entropy of rows (id, *columns)."""
    n, m = a.count(), len(columns)
    d = nearest_distances(a, a, columns, k, True)
    return d.agg((F.avg(F.log(F.greatest(F.col("d"), F.lit(1e-300)))) * m + math.log(_ball(m)) + _digamma(n) - _digamma(k)).alias("h"))


def cross_entropy(a: DataFrame, b: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(h): k-nearest-neighbour estimate of the cross entropy of `a` under `b`."""
    n, m = b.count(), len(columns)
    d = nearest_distances(a, b, columns, k, False)
    return d.agg((F.avg(F.log(F.greatest(F.col("d"), F.lit(1e-300)))) * m + math.log(_ball(m)) + math.log(n) - _digamma(k)).alias("h"))


def divergence(a: DataFrame, b: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(kld): Kullback-Leibler divergence of `a` from `b` by distances to the k-th neighbour in both."""
    n, m, dim = a.count(), b.count(), len(columns)
    own = nearest_distances(a, a, columns, k, True).withColumnRenamed("d", "r")
    other = nearest_distances(a, b, columns, k, False)
    ratio = F.log(F.greatest(F.col("d"), F.lit(1e-300)) / F.greatest(F.col("r"), F.lit(1e-300)))
    return own.join(other, "id").agg((F.avg(ratio) * dim + math.log(m / (n - 1))).alias("kld"))


# --- saliency variants ----------------------------------------------------------------------------------------------------
def saliency_global(r: DataFrame, falloff: float) -> DataFrame:
    """(label, saliency): 1 minus the normalised sum over all regions of exp(-falloff * distance)."""
    p = SG.region_pairs(r).groupBy(F.col("label_a").alias("label")).agg(F.sum(F.exp(-falloff * SG.colour_distance())).alias("s"))
    return SG.scaled(p, "s").select("label", (1 - F.col("s")).alias("saliency"))


def saliency_two_gaussians(r: DataFrame, sigma_space: float, sigma_colour: float, k: float) -> DataFrame:
    """(label, saliency): uniqueness times exp(-k * distribution), weights normalised by region.

    Uniqueness sums colour differences weighted by nearness; distribution sums places weighted by likeness.
    """
    # A region counts for itself as well.
    cols = r.columns
    a, b = (r.select(*[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    p = a.crossJoin(b).select("label_a", "x_b", "y_b", SG.colour_distance().alias("dc"), SG.space_distance().alias("ds"))
    ws, wc = F.exp(-F.pow("ds", 2) / (2 * sigma_space**2)), F.exp(-F.pow("dc", 2) / (2 * sigma_colour**2))
    g = p.groupBy(F.col("label_a").alias("label")).agg(
        (F.sum(F.pow("dc", 2) * ws) / F.sum(ws)).alias("u"), (F.sum(F.col("x_b") * wc) / F.sum(wc)).alias("mx"), (F.sum(F.col("y_b") * wc) / F.sum(wc)).alias("my"),
        (F.sum((F.pow("x_b", 2) + F.pow("y_b", 2)) * wc) / F.sum(wc)).alias("m2"),
    )
    g = g.withColumn("d", F.col("m2") - F.pow("mx", 2) - F.pow("my", 2))
    return SG.scaled(g.select("label", "u", "d"), "u", "d").select("label", (F.col("u") * F.exp(-k * F.col("d"))).alias("saliency"))


def saliency_knn(edges: DataFrame, k: int) -> DataFrame:
    """(label, saliency) on dissimilarities (a, b, total): 1 - exp(-mean of the k least)."""
    g = edges.groupBy(F.col("a").alias("label")).agg(F.slice(F.array_sort(F.collect_list("total")), 1, k).alias("t"))
    return g.select("label", (1 - F.exp(-F.aggregate("t", F.lit(0.0), lambda x, y: x + y) / F.size("t"))).alias("saliency"))


def spectral_residual(px: DataFrame, shape: tuple[int, int], size: int = 64) -> DataFrame:
    """(ix, iy, w): saliency from what the log spectrum of each block of `size` pixels has over its running mean."""

    def go(a):
        f = np.fft.fft2(a)
        log = np.log(np.abs(f) + 1e-12)
        rest = log - sum(np.roll(log, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
        out = np.abs(np.fft.ifft2(np.exp(rest + 1j * np.angle(f)))) ** 2
        return ST.correlate(out, ST.gauss_kernel(5, 1.0))

    return ST.tiled_apply(px, 0, go, shape, tile=size)


# --- finders --------------------------------------------------------------------------------------------------------------
def saliency_sources(px: DataFrame, shape: tuple[int, int], sizes: list[int], factor: float = 1.0, min_pixels: int = 5) -> DataFrame:
    """(source_id, ix, iy): blobs of the saliency map over its optimal threshold."""
    sal = written(SG.multi_saliency(px, shape, sizes), "saliency")
    thr = S.optimal_threshold(sal, factor, 50, "saliency").collect()[0][0]
    if math.isinf(thr):
        thr = factor * S.quantile(sal, "saliency", [0.9])[0]
    z = sal.select("ix", "iy", (F.col("saliency") / (thr or 1.0)).alias("z"))
    return D.find_blobs(z, shape, 1.0, 1.0, min_pixels).select("source_id", "ix", "iy")


def contour_sources(px: DataFrame, shape: tuple[int, int], rounds: int, min_pixels: int = 5, lambda2: float = 1.0) -> DataFrame:
    """(source_id, ix, iy): blobs inside the level set whose median is over that of the image."""
    inside = SG.chan_vese(px, shape, rounds, lambda2=lambda2)
    blob = D.find_blobs(inside.select("ix", "iy", F.col("w").alias("z")), shape, 1.0, 1.0, min_pixels).select("source_id", "ix", "iy")
    whole = S.quantile(px, "w", [0.5])[0]
    good = blob.join(px, ["ix", "iy"]).groupBy("source_id").agg(F.percentile("w", 0.5).alias("m")).where(F.col("m") > whole)
    return blob.join(good, "source_id", "left_semi")


def superpixel_sources(px: DataFrame, shape: tuple[int, int], size: int, limit: float, k: float = 2.0) -> DataFrame:
    """(source_id, ix, iy): connected superpixels, merged while alike, whose mean stands k rms over the median of all."""
    lab = written(SG.merge_hierarchical(SG.superpixels(px, shape, size, rounds=4), 0.3, limit, 4, 3), "segments")
    med, rms = S.median_mad(px)
    top = SG.regions(lab).where(F.col("mean") > med + k * rms / F.sqrt("n"))
    z = lab.join(top.select("label"), "label", "left_semi").select("ix", "iy", F.lit(1.0).alias("z"))
    return D.find_blobs(z, shape, 1.0, 1.0, 1).select("source_id", "ix", "iy")


def superpixel_background(px: DataFrame, shape: tuple[int, int], size: int, cut: float = 5.991) -> DataFrame:
    """(bkg, rms, n): median and 1.4826 MAD of the pixels in superpixels whose mean and rms lie within a Mahalanobis cut."""
    lab = written(SG.superpixels(px, shape, size, rounds=4), "superpixels")
    r = SG.regions(lab).select("label", "mean", "rms")
    c = r.agg(F.avg("mean").alias("mx"), F.avg("rms").alias("my"), F.var_samp("mean").alias("sxx"), F.var_samp("rms").alias("syy"), F.covar_samp("mean", "rms").alias("sxy"))
    d2 = F.expr("(syy * power(mean - mx, 2) - 2 * sxy * (mean - mx) * (rms - my) + sxx * power(rms - my, 2)) / (sxx * syy - sxy * sxy)")
    inside = lab.join(r.crossJoin(F.broadcast(c)).where(d2 <= cut).select("label"), "label", "left_semi")
    m, s = S.median_mad(inside)
    return px.sparkSession.createDataFrame([(m, s, inside.count())], "bkg double, rms double, n long")


def multi_scale_sources(px: DataFrame, shape: tuple[int, int], sigmas: list[float], least: int, min_pixels: int) -> DataFrame:
    """(source_id, ix, iy): blobs of pixels that are significant at enough scales."""
    m = ST.multi_scale_mask(px, shape, sigmas).where(F.col("n_scales") >= least)
    return D.find_blobs(m.select("ix", "iy", F.col("n_scales").cast("double").alias("z")), shape, float(least), float(least), min_pixels).select("source_id", "ix", "iy")


def convolved_model(pixels: DataFrame, shape: tuple[int, int], kernel: np.ndarray, fraction: float = 0.95) -> DataFrame:
    """(source_id, ix, iy, w) of true sources seen through a beam.

    Each source is spread by the kernel, cut where its brightest pixels hold `fraction` of its flux, and its
    largest connected part stays; sources that come to touch merge and add up.
    """
    h, v = kernel.shape[0] // 2, kernel.shape[1] // 2
    table = F.array(*[F.struct(F.lit(int(i - v)).alias("dx"), F.lit(int(j - h)).alias("dy"), F.lit(float(kernel[j, i])).alias("k")) for j, i in zip(*np.nonzero(kernel))])
    p = pixels.select("source_id", "ix", "iy", "w", F.explode(table).alias("t"))
    p = p.select("source_id", (F.col("ix") + F.col("t.dx")).alias("ix"), (F.col("iy") + F.col("t.dy")).alias("iy"), (F.col("w") * F.col("t.k")).alias("w")).where(F.col("ix").between(0, shape[0] - 1) & F.col("iy").between(0, shape[1] - 1))
    p = p.groupBy("source_id", "ix", "iy").agg(F.sum("w").alias("w"))
    run = F.sum("w").over(Window.partitionBy("source_id").orderBy(F.desc("w"), "ix", "iy")) - F.col("w")
    p = written(p.withColumn("before", run).withColumn("total", F.sum("w").over(Window.partitionBy("source_id"))).where(F.col("before") < fraction * F.col("total")).select("source_id", "ix", "iy", "w"), "convolved")

    def largest(pdf):
        # Of equal parts the one whose first pixel, x outer and y inner, is last.
        x, y = pdf["ix"].to_numpy() - pdf["ix"].min(), pdf["iy"].to_numpy() - pdf["iy"].min()
        mask = np.zeros((y.max() + 1, x.max() + 1), bool)
        mask[y, x] = True
        part = D._runs(mask, False)[y, x]
        place, sizes = x * len(mask) + y, np.bincount(part)
        best = max(np.unique(part), key=lambda k: (sizes[k], place[part == k].min()))
        return pdf[part == best]

    best = p.groupBy("source_id").applyInPandas(largest, p.schema)
    from .catalog import adjacent

    return merge_pixels(best, adjacent(best, best), sum_shared=True)


# --- contours and ellipses ------------------------------------------------------------------------------------------------
def curvature(points: DataFrame, n: int, sigma: float) -> DataFrame:
    """(key, t, curvature) of closed contours (key, t, x, y) of n points each: derivatives and smoothing in the Fourier domain."""

    def one(pdf):
        import pandas as pd

        p = pdf.sort_values("t")
        f = np.fft.fft(p["x"].to_numpy() + 1j * p["y"].to_numpy())
        w = 2j * np.pi * np.fft.fftfreq(len(p))
        g = np.exp(-(np.abs(w) ** 2) * sigma * sigma / 2)
        d1, d2 = np.fft.ifft(f * w * g), np.fft.ifft(f * w * w * g)
        k = (d1.real * d2.imag - d1.imag * d2.real) / np.maximum(np.abs(d1) ** 3, 1e-12)
        return pd.DataFrame({"key": p["key"].to_numpy(), "t": p["t"].to_numpy(), "curvature": k})

    return points.select(F.col("key").cast("long"), F.col("t").cast("long"), "x", "y").groupBy("key").applyInPandas(one, "key long, t long, curvature double")


def bending_energy(points: DataFrame, n: int, scales: list[float]) -> DataFrame:
    """(key, scale, energy): mean squared curvature at each smoothing scale."""
    out = None
    for s in scales:
        e = curvature(points, n, s).groupBy("key").agg(F.avg(F.pow("curvature", 2)).alias("energy")).select("key", F.lit(float(s)).alias("scale"), "energy")
        out = e if out is None else out.unionByName(e)
    return out


def _polygon(e, n: int = 64) -> np.ndarray:
    x, y, a, b, t = e
    u = np.linspace(0, 2 * np.pi, n, endpoint=False)
    c, s = np.cos(t), np.sin(t)
    return np.stack([x + a * np.cos(u) * c - b * np.sin(u) * s, y + a * np.cos(u) * s + b * np.sin(u) * c], 1)


def clip_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area of the intersection of two convex polygons, both counter-clockwise."""
    out = list(map(tuple, p))
    for (x0, y0), (x1, y1) in zip(q, np.roll(q, -1, axis=0)):
        side = lambda v: (x1 - x0) * (v[1] - y0) - (y1 - y0) * (v[0] - x0)  # noqa: B023, E731
        new = []
        for a, b in zip(out, out[1:] + out[:1]):
            sa, sb = side(a), side(b)
            if sa >= 0:
                new.append(a)
            if sa * sb < 0:
                f = sa / (sa - sb)
                new.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
        out = new
        if not out:
            return 0.0
    v = np.array(out)
    w = np.roll(v, -1, axis=0)
    return float(abs((v[:, 0] * w[:, 1] - w[:, 0] * v[:, 1]).sum()) / 2)


_SIDES = 64
_TURN = np.linspace(0, 2 * np.pi, _SIDES, endpoint=False)
_CORNERS, _NORMALS = (np.stack([np.cos(u), np.sin(u)], 1) for u in (_TURN, _TURN + np.pi / _SIDES))


def _relative(xa, ya, aa, ba, ta, xb, yb, ab, bb, tb) -> np.ndarray:
    """(pairs, 64, 2): the polygon of ellipse a where that of b is the regular one of radius 1 around 0."""
    c, s = np.cos(ta - tb), np.sin(ta - tb)
    dx, dy = xa - xb, ya - yb
    cb, sb = np.cos(tb), np.sin(tb)
    u, v = _CORNERS[:, 0], _CORNERS[:, 1]
    x = ((aa * c / ab)[:, None] * u - (ba * s / ab)[:, None] * v) + ((dx * cb + dy * sb) / ab)[:, None]
    y = ((aa * s / bb)[:, None] * u + (ba * c / bb)[:, None] * v) + ((dy * cb - dx * sb) / bb)[:, None]
    return np.stack([x, y], 2)


def _kept(p: np.ndarray, edge: float) -> np.ndarray:
    """(pairs, 64): the share of each polygon side that lies in the regular polygon whose sides are `edge` from 0."""
    side = np.floor(np.arctan2(p[..., 1], p[..., 0]) * (_SIDES / (2 * np.pi))).astype(np.int64) % _SIDES
    inside = (p * _NORMALS[side]).sum(2) <= edge
    after = np.roll(inside, -1, 1)
    d = np.roll(p, -1, 1) - p
    out = (inside & after).astype(float)
    # Sides that may cross the border: one end inside, or both outside and a point between them within the circle.
    least = np.clip(-(p * d).sum(2) / np.maximum((d * d).sum(2), 1e-300), 0, 1)
    nearest = p + least[..., None] * d
    i, k = np.nonzero((inside != after) | (~inside & ~after & ((nearest * nearest).sum(2) < 1)))
    room, speed = edge - p[i, k] @ _NORMALS.T, d[i, k] @ _NORMALS.T
    with np.errstate(divide="ignore", invalid="ignore"):
        t = room / speed
    hi = np.minimum(np.where(speed > 0, t, 1.0).min(1, initial=1.0), 1.0)
    lo = np.maximum(np.where(speed < 0, t, 0.0).max(1, initial=0.0), 0.0)
    outside = ((speed == 0) & (room < 0)).any(1)
    out[i, k] = np.where(outside, 0.0, np.maximum(hi - lo, 0.0))
    return out


def ellipse_areas(a: tuple, b: tuple) -> np.ndarray:
    """Areas common to the 64-sided polygons of pairs of ellipses, each five arrays (x, y, major, minor, theta).

    The border of the common part is made of the sides of either polygon that lie in the other. Sides that both have
    count for the first one only.
    """
    edge = np.cos(np.pi / _SIDES)
    p = _relative(*a, *b)
    cross = p[..., 0] * np.roll(p[..., 1], -1, 1) - p[..., 1] * np.roll(p[..., 0], -1, 1)
    part = (_kept(p, edge * (1 + 1e-13)) * cross).sum(1) + _kept(_relative(*b, *a), edge * (1 - 1e-13)).sum(1) * np.sin(2 * np.pi / _SIDES)
    area = part / 2 * b[2] * b[3]
    # Of polygons that hardly meet the rounding of the borders would decide: they are clipped one by one.
    for i in np.flatnonzero(area < 1e-6 * np.minimum(a[2] * a[3], b[2] * b[3])):
        area[i] = clip_area(_polygon([v[i] for v in a]), _polygon([v[i] for v in b])) if area[i] else 0.0
    return area


def ellipse_overlaps(a: DataFrame, b: DataFrame, once: bool = False) -> DataFrame:
    """(a, b, area, fraction) of overlapping ellipses (id, x, y, major, minor, theta in radians); the fraction is of the smaller one.

    once: only pairs a < b.
    """
    box = lambda e: e.select(F.col("id").alias("source_id"), (F.col("x") - F.col("major")).alias("x0"), (F.col("x") + F.col("major")).alias("x1"), (F.col("y") - F.col("major")).alias("y0"), (F.col("y") + F.col("major")).alias("y1"), "x", "y", "major", "minor", "theta")
    sizes = a.select("major").union(b.select("major")).agg(F.avg("major"), F.max("major")).collect()[0]
    # Cells of the ellipses' own size, so that pairs are spread over tasks; the largest ellipse meets some 70 x 70.
    cell = max(2 * (sizes[0] or 0.0), (sizes[1] or 0.0) / 32) or CELL
    p = overlapping(box(a), box(b), 0, cell, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = p.where(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2) <= F.pow(F.col("major_a") + F.col("major_b"), 2))
    p = p.where("major_a > 0 AND minor_a > 0 AND major_b > 0 AND minor_b > 0")
    p = p.where("source_id_a < source_id_b") if once else p
    names = ("x", "y", "major", "minor", "theta")

    def go(batches):
        import pandas as pd

        for pdf in batches:
            for first in range(0, len(pdf), 1000):
                q = pdf.iloc[first : first + 1000]
                e, f = (tuple(q[f"{c}_{s}"].to_numpy(float) for c in names) for s in "ab")
                area = ellipse_areas(e, f)
                least = math.pi * np.minimum(e[2] * e[3], f[2] * f[3])
                out = pd.DataFrame({"a": q["source_id_a"].to_numpy(), "b": q["source_id_b"].to_numpy(), "area": area, "fraction": area / least})
                yield out[area > 0]

    return p.select("source_id_a", "source_id_b", *[f"{c}_{s}" for s in "ab" for c in names]).mapInPandas(go, "a long, b long, area double, fraction double")


def on_contour(points: DataFrame, contour: DataFrame, tol: float) -> DataFrame:
    """Points (id, x, y) with on: whether a contour point (x, y) lies within tol in both axes; an equi-join on cells."""
    cell = max(tol, 1e-9)
    at = lambda c: F.floor(F.col(c) / cell)
    near = points.select("id", "x", "y", F.explode(F.sequence(at("x") - 1, at("x") + 1)).alias("_cx"), at("y").alias("_c"))
    near = near.select("id", "x", "y", "_cx", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1)).alias("_cy"))
    hit = near.join(contour.select(F.col("x").alias("u"), F.col("y").alias("v"), at("x").alias("_cx"), at("y").alias("_cy")), ["_cx", "_cy"])
    hit = hit.where((F.abs(F.col("x") - F.col("u")) <= tol) & (F.abs(F.col("y") - F.col("v")) <= tol)).select("id").distinct().withColumn("on", F.lit(True))
    return points.join(hit, "id", "left").withColumn("on", F.coalesce("on", F.lit(False)))


def at_limit(value: Column, lo: Column, hi: Column, tol: float = 1e-6) -> Column:
    """Whether a parameter lies at one of its limits, relative to their distance."""
    return (F.abs(value - lo) <= tol * (hi - lo)) | (F.abs(hi - value) <= tol * (hi - lo))


# --- level set with local regions -----------------------------------------------------------------------------------------
def local_contour(px: DataFrame, shape: tuple[int, int], start: DataFrame, rounds: int, radius: int, smooth: float = 0.2, tile: int = ST.TILE) -> DataFrame:
    """(ix, iy, w): 1 inside a contour that moves by the contrast of the means inside and outside, within `radius` of each point.

    start: pixels inside at first. Each block of steps works on tiles with a margin of radius + steps.
    """
    inner = 5
    state = px.join(start.select("ix", "iy", F.lit(1.0).alias("phi")), ["ix", "iy"], "left").select("ix", "iy", F.col("w").alias("v"), F.coalesce("phi", F.lit(-1.0)).alias("phi"))
    state = written(state, "contour")

    def evolve(v, phi):
        k = np.ones((2 * radius + 1, 2 * radius + 1))
        for _ in range(inner):
            inside = (phi > 0).astype(float)
            n_in, n_out = ST.correlate(inside, k), ST.correlate(1 - inside, k)
            u, w = ST.correlate(v * inside, k) / np.maximum(n_in, 1), ST.correlate(v * (1 - inside), k) / np.maximum(n_out, 1)
            force = np.where((n_in > 0) & (n_out > 0), (v - w) ** 2 - (v - u) ** 2, 0.0)
            mean = sum(ST.shifted(phi, j, i) for j, i in ((0, 1), (1, 0), (0, -1), (-1, 0))) / 4
            force = force / max(np.abs(force).max(), 1e-12) + smooth * (mean - phi)
            edge = np.abs(ST.correlate(inside, np.ones((3, 3))) / 9 - 0.5) < 0.5
            phi = np.clip(np.where(edge, phi + 0.45 * force, phi), -1, 1)
        return {"phi": phi}

    for _ in range(max(1, rounds // inner)):
        new = ST.tiled_apply(state, min(tile, radius + inner + 2), evolve, shape, "mirror", ("phi",), ("v", "phi"), tile=tile)
        state = written(state.drop("phi").join(new, ["ix", "iy"]), "contour")
    return state.select("ix", "iy", (F.col("phi") > 0).cast("double").alias("w"))


def interpolated(points: DataFrame, shape: tuple[int, int], reach: int, power: float = 2.0) -> DataFrame:
    """(ix, iy, w): inverse-distance surface of scattered points (x, y, v) on the unit grid, from points within `reach`."""
    box = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col(c) - reach)), F.least(F.lit(n - 1), F.floor(F.col(c) + reach))))
    p = points.withColumn("ix", box("x", shape[0])).withColumn("iy", box("y", shape[1]))
    d2 = F.pow(F.col("ix") - F.col("x"), 2) + F.pow(F.col("iy") - F.col("y"), 2)
    k = 1 / F.pow(d2 + 1e-9, power / 2)
    return p.groupBy("ix", "iy").agg((F.sum(k * F.col("v")) / F.sum(k)).alias("w"))


def occluded_regions(px: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(label, at_edge): whether a region touches the image's border."""
    edge = (F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") == shape[0] - 1) | (F.col("iy") == shape[1] - 1)
    return px.groupBy("label").agg(F.max(edge).alias("at_edge"))


def true_match_records(true: DataFrame, rec: DataFrame, stats: DataFrame, least: float) -> DataFrame:
    """One row a true source: its match by overlap with the found source's flux, -1 where there is none, and the flux ratio."""
    from .catalog import match_by_overlap

    flux = true.groupBy(F.col("source_id").alias("a")).agg(F.sum("w").alias("s_true"))
    m = match_by_overlap(true, rec, least)
    out = flux.join(m, "a", "left").join(stats.select(F.col("source_id").alias("b"), F.col("flux").alias("s_rec")), "b", "left")
    return out.select("a", F.coalesce("b", F.lit(-1)).alias("b"), "s_true", F.coalesce("s_rec", F.lit(-1.0)).alias("s_rec"), F.coalesce(F.col("s_rec") / F.col("s_true"), F.lit(-1.0)).alias("ratio"))


def merge_candidates(pixels: DataFrame) -> DataFrame:
    """(a, b, n): sources of different tiles that share pixels."""
    a = pixels.select("tile_id", "source_id", "ix", "iy")
    return shared_pixels(a, a).where("a < b")
