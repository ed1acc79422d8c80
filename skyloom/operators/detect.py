"""Detection: connected pixels, blobs, nested sources, residual maps, source finders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import stencil as ST
from .background import local_background, significance
from .graph import components, written


def _runs(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Labels (0 outside) of a tile's connected pixels, by union of overlapping row runs."""
    h, v = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, z = np.nonzero(edge == -1)
    up = list(range(len(row)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    more = 1 if diagonal else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if a[i] < z[j] + more and a[j] < z[i] + more:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
            if z[i] < z[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, v), np.int64)
    for k in range(len(row)):
        out[row[k], a[k] : z[k]] = root(k) + 1
    return out


def label_mask(mask: DataFrame, shape: tuple[int, int], diagonal: bool = False, tile: int = ST.TILE) -> DataFrame:
    """(ix, iy, component) for pixels (ix, iy): 4-connected, or 8-connected if diagonal.

    Tiles are labelled on their own; only labels that touch across a tile border enter the distributed search.
    component is the least ix * ny + iy of the connected pixels.
    """
    nx, ny = shape

    def one(pdf):
        import pandas as pd

        x0, y0 = int(pdf["tx"].iloc[0]) * tile, int(pdf["ty"].iloc[0]) * tile
        xx, yy = pdf["ix"].to_numpy() - x0, pdf["iy"].to_numpy() - y0
        m = np.zeros((tile, tile), bool)
        m[yy, xx] = True
        lab = _runs(m, diagonal)[yy, xx]
        key = (xx + x0) * ny + yy + y0
        least = np.full(lab.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, lab, key)
        return pd.DataFrame({"ix": xx + x0, "iy": yy + y0, "label": least[lab]})

    t = mask.select("ix", "iy", F.floor(F.col("ix") / tile).alias("tx"), F.floor(F.col("iy") / tile).alias("ty"))
    lab = t.groupBy("tx", "ty").applyInPandas(one, "ix long, iy long, label long")
    if nx <= tile and ny <= tile:
        return lab.withColumnRenamed("label", "component")
    lab = written(lab, "labels")
    x, y = F.col("ix") % tile, F.col("iy") % tile
    rim = lab.where((x == 0) | (y == 0) | (x == tile - 1) | (y == tile - 1))
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if diagonal else [])]
    to = F.explode(F.array(*[F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx, dy in steps]))
    e = rim.select(F.col("label").alias("a"), to.alias("p")).select("a", "p.ix", "p.iy").join(rim.select("ix", "iy", F.col("label").alias("b")), ["ix", "iy"]).where("a <> b").select("a", "b")
    comp = components(e)
    return lab.join(comp.withColumnRenamed("id", "label"), "label", "left").select("ix", "iy", F.coalesce("component", "label").alias("component"))


def find_blobs(z: DataFrame, shape: tuple[int, int], seed: float, merge: float, min_pixels: int = 5, negative: bool = False, merge_below_seed: bool = False) -> DataFrame:
    """(source_id, ix, iy, z, seed): pixels of connected regions z >= merge that hold a seed z >= seed.

    source_id is ix * ny + iy of the region's first seed, x outer and y inner, so it doesn't depend on tiling.
    negative: regions z <= -merge with seeds z <= -seed as well. merge_below_seed: regions stop at the seed
    threshold, so that pixels above it are not flooded.
    """
    ny = shape[1]
    out = None
    for sign in (1, -1) if negative else (1,):
        v = z.withColumn("v", F.col("z") * sign).where(F.col("v") >= merge)
        if merge_below_seed:
            v = v.where(F.col("v") <= seed)
        lab = label_mask(v.select("ix", "iy"), shape).join(v.select("ix", "iy", "z", "v"), ["ix", "iy"])
        key = F.when(F.col("v") >= seed, F.col("ix") * ny + F.col("iy"))
        good = lab.groupBy("component").agg(F.count("*").alias("n"), F.min(key).alias("source_id")).where((F.col("n") >= min_pixels) & F.col("source_id").isNotNull())
        part = lab.join(good, "component").select("source_id", "ix", "iy", "z", (F.col("v") >= seed).alias("seed"))
        out = part if out is None else out.unionByName(part)
    return out


def numbered(catalog: DataFrame, by: str = "source_id", prefix: str = "S") -> DataFrame:
    """`catalog` with `name`: the prefix and the rank of `by`, counted by ranges so that no task holds all rows."""
    ranged = written(catalog.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("_part").agg(F.min(by).alias("_lo"), F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return ranged.join(F.broadcast(sizes.select("_part", start.alias("_start"))), "_part").withColumn("name", F.concat(F.lit(prefix), (F.col("_start") + place).cast("string"))).drop("_part", "_start")


def blob_stats(pixels: DataFrame, w: str = "w") -> DataFrame:
    """One row a source of pixels (source_id, ix, iy, w): size, flux, centroid, weighted second moments, box, extremes."""
    s, x, y = F.col(w), F.col("ix"), F.col("iy")
    mean = lambda e: F.sum(s * e) / F.sum(s)
    return pixels.groupBy("source_id").agg(
        F.count("*").alias("n_pix"), F.sum(s).alias("flux"), F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("rms"), F.max(s).alias("s_max"), F.min(s).alias("s_min"), F.percentile(s, 0.5).alias("median"),
        F.avg(x).alias("x0"), F.avg(y).alias("y0"), mean(x).alias("sx"), mean(y).alias("sy"),
        (mean(x * x) - mean(x) * mean(x)).alias("sxx"), (mean(y * y) - mean(y) * mean(y)).alias("syy"), (mean(x * y) - mean(x) * mean(y)).alias("sxy"),
        F.min(x).alias("ix_min"), F.max(x).alias("ix_max"), F.min(y).alias("iy_min"), F.max(y).alias("iy_max"), F.max_by(F.struct(x, y), F.struct(s, x, y)).alias("peak"),
    )


def image_moments(pixels: DataFrame, w: str = "w") -> DataFrame:
    """(source_id, m00, x, y, nu20, nu11, nu02, nu30, nu21, nu12, nu03, hu1 .. hu7): normalised central moments and Hu's invariants."""
    p = pixels.withColumn("s", F.col(w)).select("source_id", "ix", "iy", "s")
    c = p.groupBy("source_id").agg(F.sum("s").alias("m00"), (F.sum(F.col("s") * F.col("ix")) / F.sum("s")).alias("x"), (F.sum(F.col("s") * F.col("iy")) / F.sum("s")).alias("y"))
    j = p.join(c, "source_id")
    dx, dy = F.col("ix") - F.col("x"), F.col("iy") - F.col("y")
    orders = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
    n = j.groupBy("source_id", "m00", "x", "y").agg(*[(F.sum(F.col("s") * F.pow(dx, a) * F.pow(dy, b)) / F.pow(F.first("m00"), 1 + (a + b) / 2)).alias(f"nu{a}{b}") for a, b in orders])
    g = {f"{a}{b}": F.col(f"nu{a}{b}") for a, b in orders}
    p30, p12, q21, q03 = g["30"] + g["12"], g["30"] - 3 * g["12"], g["21"] + g["03"], 3 * g["21"] - g["03"]
    hu = [
        g["20"] + g["02"],
        (g["20"] - g["02"]) * (g["20"] - g["02"]) + 4 * g["11"] * g["11"],
        p12 * p12 + q03 * q03,
        p30 * p30 + q21 * q21,
        p12 * p30 * (p30 * p30 - 3 * q21 * q21) + q03 * q21 * (3 * p30 * p30 - q21 * q21),
        (g["20"] - g["02"]) * (p30 * p30 - q21 * q21) + 4 * g["11"] * p30 * q21,
        q03 * p30 * (p30 * p30 - 3 * q21 * q21) - p12 * q21 * (3 * p30 * p30 - q21 * q21),
    ]
    return n.select("*", *[h.alias(f"hu{i + 1}") for i, h in enumerate(hu)])


def zernike(pixels: DataFrame, order: int, radius: float | None = None, w: str = "w") -> DataFrame:
    """(source_id, n, l, modulus) of the Zernike moments up to an order, n - l even, on the disc around the box centre."""
    import math

    terms = [
        (n, m, n - 2 * s, (-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + m) // 2 - s) * math.factorial((n - m) // 2 - s)))
        for n in range(order + 1) for m in range(n + 1) if (n - m) % 2 == 0 for s in range((n - m) // 2 + 1)
    ]
    table = pixels.sparkSession.createDataFrame(terms, "n int, l int, p int, c double")
    box = pixels.groupBy("source_id").agg(((F.min("ix") + F.max("ix")) / 2).alias("cx"), ((F.min("iy") + F.max("iy")) / 2).alias("cy"), (F.sqrt(F.pow(F.max("ix") - F.min("ix") + 1, 2) + F.pow(F.max("iy") - F.min("iy") + 1, 2)) / 2).alias("half"), F.sum(w).alias("total"))
    rad = F.lit(float(radius)) if radius else F.col("half")
    p = pixels.join(box, "source_id").withColumns({"dx": (F.col("ix") - F.col("cx")) / rad, "dy": (F.col("iy") - F.col("cy")) / rad})
    p = p.withColumns({"r": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "t": F.atan2("dy", "dx")}).where("r <= 1")
    k = F.col("c") * F.pow("r", "p") * F.col(w) / F.col("total")
    a = p.crossJoin(F.broadcast(table)).groupBy("source_id", "n", "l").agg(F.sum(k * F.cos(F.col("l") * F.col("t"))).alias("re"), F.sum(k * F.sin(F.col("l") * F.col("t"))).alias("im"))
    return a.select("source_id", "n", "l", ((F.col("n") + 1) / np.pi * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("modulus"))


def dilated(pixels: DataFrame, size: int, shape: tuple[int, int], kind: str = "ellipse") -> DataFrame:
    """(source_id, ix, iy): each source's pixels and those under the structuring element around them, once."""
    h = size // 2
    el = ST.element(kind, size)
    steps = F.array(*[F.struct(F.lit(int(i - h)).alias("dx"), F.lit(int(j - h)).alias("dy")) for j, i in zip(*np.nonzero(el))])
    p = pixels.select("source_id", "ix", "iy", F.explode(steps).alias("d")).select("source_id", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"))
    return p.where(F.col("ix").between(0, shape[0] - 1) & F.col("iy").between(0, shape[1] - 1)).distinct()


def residual_map(px: DataFrame, pixels: DataFrame, size: int, shape: tuple[int, int], model: str = "median", randomize: bool = False, seed: int = 0) -> DataFrame:
    """(ix, iy, w): sources replaced within their dilated pixels by the source's median or mean (model), or by bkg (a column of px).

    randomize adds noise of the column rms, a normal cut off at one sigma.
    """
    spread = dilated(pixels, size, shape)
    med = pixels.groupBy("source_id").agg((F.avg("w") if model == "mean" else F.percentile("w", 0.5)).alias("m"))
    fill = spread.join(med, "source_id").groupBy("ix", "iy").agg(F.min_by("m", "source_id").alias("m"))
    j = px.join(fill, ["ix", "iy"], "left")
    new = F.col("bkg") if model == "bkg" else F.col("m")
    if randomize:
        # Uniform on the cumulative range of [-1, 1] sigma, turned into a normal by its quantile's series.
        u = F.rand(seed) * 2 - 1
        new = new + F.col("rms") * (u * 0.8557 + F.pow(u, 3) * 0.1083 + F.pow(u, 5) * 0.036)
    return j.select("ix", "iy", F.when(F.col("m").isNotNull(), new).otherwise(F.col("w")).alias("w"))


def nested_sources(px: DataFrame, mothers: DataFrame, shape: tuple[int, int], k: float = 5.0, min_pixels: int = 5, min_offset: float = 2.0, max_fraction: float = 0.5, least_mother: int = 0) -> DataFrame:
    """(mother_id, source_id, ix, iy): blobs of the negated Laplacian inside sources, attached to the containing one.

    The only nested blob of a mother stays if its centre is far enough from the mother's or it covers little of it.
    """
    from .stats import median_mad

    curv = ST.convolve(px, -ST.LAPLACE, shape)
    _, noise = median_mad(curv)
    inside = curv.join(mothers.select("ix", "iy", F.col("source_id").alias("mother_id")), ["ix", "iy"]).where(F.col("w") >= k * noise)
    blob = find_blobs(inside.select("ix", "iy", (F.col("w") / noise).alias("z")), shape, k, k, min_pixels)
    held = blob.join(inside.select("ix", "iy", "mother_id"), ["ix", "iy"])
    one = held.groupBy("source_id").agg(F.min("mother_id").alias("mother_id"), F.count("*").alias("n"), F.avg("ix").alias("x"), F.avg("iy").alias("y"))
    m = mothers.groupBy(F.col("source_id").alias("mother_id")).agg(F.count("*").alias("mn"), F.avg("ix").alias("mx"), F.avg("iy").alias("my")).where(F.col("mn") > least_mother)
    one = one.join(m, "mother_id").withColumn("sisters", F.count("*").over(Window.partitionBy("mother_id")))
    off = F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))
    ok = one.where((F.col("sisters") > 1) | (off > min_offset) | (F.col("n") / F.col("mn") < max_fraction)).select("source_id", "mother_id")
    return held.drop("mother_id").join(ok, "source_id").select("mother_id", "source_id", "ix", "iy")


def find_compact(
    px: DataFrame, shape: tuple[int, int], seed: float = 5.0, merge: float = 2.6, min_pixels: int = 5, box: tuple[int, int] | None = None, grid: tuple[int, int] | None = None, rounds: int = 1, step: float = 0.5,
    negative: bool = False, merge_below_seed: bool = False, background=None,
) -> DataFrame:
    """(source_id, ix, iy, w, z): local background, significance map, blobs; repeated with lower seeds on what is left.

    In each later round found sources are masked to 0, the background is estimated again and the seed threshold
    falls by `step` as long as it is above the merge threshold. background: a function from pixels to pixels with
    bkg and rms that takes the place of the local medians on `box` and `grid`.
    """
    box = box or (max(8, shape[0] // 4), max(8, shape[1] // 4))
    grid = grid or (max(1, box[0] // 2), max(1, box[1] // 2))
    background = background or (lambda p: local_background(p, *shape, box, grid))
    left, every = px.select("ix", "iy", "w"), None
    for k in range(rounds):
        z = significance(background(left))
        z = written(z, "significance") if rounds > 1 else z
        found = find_blobs(z.select("ix", "iy", "z"), shape, seed, merge, min_pixels, negative, merge_below_seed).join(px.select("ix", "iy", "w"), ["ix", "iy"]).select("source_id", "ix", "iy", "w", "z")
        found = written(found, "found") if rounds > 1 else found
        every = found if every is None else every.unionByName(found)
        if k + 1 < rounds:
            left = left.join(found.select("ix", "iy", F.lit(True).alias("_hit")), ["ix", "iy"], "left").select("ix", "iy", F.when(F.col("_hit"), 0.0).otherwise(F.col("w")).alias("w"))
            left = written(left, "masked")
            seed = seed - step if seed - step > merge else seed
    return every


def selected(stats: DataFrame, min_box: int = 2, max_elongation: float = 3.0, n_beams: float = 10.0, max_pixels: int = 1000, beam_pixels: float = 1.0) -> DataFrame:
    """Catalog rows with good, point_like, fittable and type (1 compact, 2 point-like)."""
    from ..functions.columns import ellipse_of

    a, b, _ = ellipse_of(F.col("sxx"), F.col("syy"), F.col("sxy"))
    good = F.least(F.col("ix_max") - F.col("ix_min") + 1, F.col("iy_max") - F.col("iy_min") + 1) >= min_box
    point = (F.col("n_pix") <= max_pixels) & (F.col("n_pix") / beam_pixels <= n_beams) & (a <= max_elongation * F.greatest(b, F.lit(0.3)))
    out = stats.withColumns({"good": good, "point_like": good & point})
    return out.withColumns({"type": F.when(F.col("point_like"), 2).otherwise(1), "fittable": F.col("point_like") | (F.col("n_pix") / beam_pixels <= n_beams)})


def selected_by_shape(
    catalog: DataFrame, beam_pixels: float = 1.0, min_box: float | None = None, circularity: float | None = None, elongation: float | None = None, ellipse_ratio: tuple[float, float] | None = None,
    n_beams: float | None = None, max_pixels: float | None = None, n_beams_to_fit: float = 20.0,
) -> DataFrame:
    """Catalog rows (blob_stats with the columns of contour_shapes) with good, point_like, fittable and type (1 compact, 2 point-like).

    A cut that is None is not made, nor is one whose value a source's outline doesn't have. Good: the least box is at
    least min_box wide. Point-like: circularity and elongation, ellipse_ratio within its range, at most n_beams and
    max_pixels. Fittable: point-like, or of at most n_beams_to_fit.
    """

    def passes(column: str, low: float | None = None, high: float | None = None):
        c, ok = F.col(column), F.lit(True)
        ok = ok if low is None else ok & (c >= low)
        ok = ok if high is None else ok & (c <= high)
        return c.isNull() | F.isnan(c) | ok

    beams = F.col("n_pix") / beam_pixels
    good = passes("box_min", min_box)
    point = passes("circularity", circularity) & passes("elongation", None, elongation) & passes("ellipse_area_ratio", *(ellipse_ratio or ()))
    point = point if n_beams is None else point & (beams <= n_beams)
    point = point if max_pixels is None else point & (F.col("n_pix") <= max_pixels)
    return catalog.withColumns({"good": good, "point_like": good & point}).withColumns({"type": F.when(F.col("point_like"), 2).otherwise(1), "fittable": F.col("point_like") | (F.col("good") & (beams <= n_beams_to_fit))})


def wavelet_sources(px: DataFrame, shape: tuple[int, int], scales: range, seed: float = 5.0, merge: float = 2.6, min_pixels: int = 5) -> DataFrame:
    """(source_id, ix, iy): blobs of the union of the significant pixels of several wavelet planes."""
    from .stats import median_mad

    planes = written(ST.wavelet(px, max(scales), shape), "planes")
    top = None
    for s in scales:
        m, r = median_mad(planes, f"w{s}")
        z = planes.select("ix", "iy", ((F.col(f"w{s}") - m) / r).alias("z"))
        top = z if top is None else top.unionByName(z)
    best = top.groupBy("ix", "iy").agg(F.max("z").alias("z"))
    return find_blobs(best, shape, seed, merge, min_pixels).select("source_id", "ix", "iy")
