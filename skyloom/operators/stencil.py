"""Stencils. An image is cut into tiles, each with a margin of the stencil's reach; a tile is filtered in NumPy.

Only pixels near a tile's border are sent to more than one tile, so the shuffle is the image times about
(1 + 2 * reach / TILE)^2, whatever the kernel's size, and a task holds one tile. Beyond the image's border the margin is
zero, a reflection without the edge (`mirror`), or missing.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .graph import written

TILE = 256


def with_margins(px: DataFrame, reach: int, shape: tuple[int, int], tile: int) -> DataFrame:
    """`px` with tx and ty, the tile: pixels within `reach` of other tiles have a row for each of these as well."""
    nx, ny = shape
    tx, ty = F.floor(F.col("ix") / tile), F.floor(F.col("iy") / tile)
    copies = []
    for dx, dy in product((-1, 0, 1), repeat=2):
        near_x = F.lit(True) if dx == 0 else (F.col("ix") - tx * tile < reach if dx < 0 else (tx + 1) * tile - F.col("ix") <= reach)
        near_y = F.lit(True) if dy == 0 else (F.col("iy") - ty * tile < reach if dy < 0 else (ty + 1) * tile - F.col("iy") <= reach)
        inside = (tx + dx >= 0) & (tx + dx <= (nx - 1) // tile) & (ty + dy >= 0) & (ty + dy <= (ny - 1) // tile)
        copies.append(F.when(near_x & near_y & inside, F.struct((tx + dx).alias("tx"), (ty + dy).alias("ty"))))
    if reach > tile:
        raise ValueError(f"a reach of {reach} needs tiles of at least that size")
    return px.select("*", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())).alias("t")).select("t.tx", "t.ty", *px.columns)


def tiled_apply(px: DataFrame, reach: int, fn: Callable[..., dict[str, np.ndarray] | np.ndarray], shape: tuple[int, int], border: str = "zero", names: tuple[str, ...] = ("w",), w: tuple[str, ...] = ("w",), tile: int = TILE) -> DataFrame:
    """(ix, iy, *names): fn of each tile with its margin.

    fn gets a 2-D array [iy, ix] for each column of `w`, of the tile and `reach` more pixels on each side, and returns
    arrays of the same shape; the margin of the result is thrown away. Pixels absent from the frame are 0 and
    have no output.
    """
    nx, ny = shape
    spread = with_margins(px.select("ix", "iy", *[F.col(c).cast("double").alias(c) for c in w]), reach, shape, tile)

    def one(pdf):
        import pandas as pd

        x0, y0 = int(pdf["tx"].iloc[0]) * tile, int(pdf["ty"].iloc[0]) * tile
        lo_x, lo_y, hi_x, hi_y = max(0, x0 - reach), max(0, y0 - reach), min(nx, x0 + tile + reach), min(ny, y0 + tile + reach)
        have = np.zeros((hi_y - lo_y, hi_x - lo_x), bool)
        yy, xx = pdf["iy"].to_numpy() - lo_y, pdf["ix"].to_numpy() - lo_x
        have[yy, xx] = True
        # The far margins of a cut-off tile lie beyond the image; only `reach` of them matters.
        pad = tuple((p, min(q, reach)) for p, q in ((lo_y - y0 + reach, y0 + tile + reach - hi_y), (lo_x - x0 + reach, x0 + tile + reach - hi_x)))
        arrays = []
        for c in w:
            a = np.zeros(have.shape)
            a[yy, xx] = pdf[c].to_numpy()
            arrays.append(np.pad(a, pad, mode="reflect") if border == "mirror" else np.pad(a, pad, constant_values=0.0 if border == "zero" else np.nan))
        got = fn(*arrays)
        got = got if isinstance(got, dict) else {names[0]: got}
        cx, cy = min(tile, nx - x0), min(tile, ny - y0)
        core = have[y0 - lo_y : y0 - lo_y + cy, x0 - lo_x : x0 - lo_x + cx]
        iy, ix = np.nonzero(core)
        out = {"ix": ix + x0, "iy": iy + y0}
        for n in names:
            out[n] = got[n][reach : reach + cy, reach : reach + cx][iy, ix].astype(float)
        return pd.DataFrame(out)

    return spread.groupBy("tx", "ty").applyInPandas(one, "ix long, iy long, " + ", ".join(f"{n} double" for n in names))


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """b[y, x] = a[y + dy, x + dx]; what comes from outside is 0 and lies in the margin."""
    b = np.zeros_like(a)
    h, v = a.shape
    y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(v, v - dx)
    b[y0:y1, x0:x1] = a[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return b


def correlate(a: np.ndarray, k: np.ndarray, gap: int = 1) -> np.ndarray:
    """Sum of k[j, i] * a[y + (j - cy) * gap, x + (i - cx) * gap]."""
    cy, cx = k.shape[0] // 2, k.shape[1] // 2
    out = np.zeros_like(a)
    for j, i in zip(*np.nonzero(k)):
        out += k[j, i] * shifted(a, (j - cy) * gap, (i - cx) * gap)
    return out


# Kernels.
B3 = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1]) / 256.0
SCHARR_X = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)
SOBEL_X = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
LAPLACE = np.array([[1, 1, 1], [1, -8, 1], [1, 1, 1]], float)


def kirsch_kernels() -> list[np.ndarray]:
    """The 8 compass kernels: three neighbours in a row weigh 5, the other five -3."""
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    out = []
    for s in range(8):
        k = np.full((3, 3), -3.0)
        k[1, 1] = 0
        for j in range(3):
            k[ring[(s + j) % 8]] = 5
        out.append(k)
    return out


def norm_log_kernel(size: int, scale: float) -> np.ndarray:
    """Scale-normalised Laplacian of Gaussian with zero mean."""
    h = size // 2
    y, x = np.mgrid[-h : h + 1, -h : h + 1]
    r2, s2 = x * x + y * y, scale * scale
    k = -s2 / (np.pi * s2 * s2) * (1 - r2 / (2 * s2)) * np.exp(-r2 / (2 * s2))
    return k - k.mean()


def gauss_kernel(size: int, sigma_x: float, sigma_y: float | None = None, theta: float = 0.0, peak: bool = False) -> np.ndarray:
    """Elliptical Gaussian rotated by theta (radians): unit sum, or unit peak."""
    sigma_y = sigma_y or sigma_x
    h = size // 2
    y, x = np.mgrid[-h : h + 1, -h : h + 1].astype(float)
    u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
    k = np.exp(-u * u / (2 * sigma_x**2) - v * v / (2 * sigma_y**2))
    return k / (k.max() if peak else k.sum())


def beam_kernel(bmaj: float, bmin: float, bpa: float, n_sigmas: int = 5, scale: float = 1.0) -> np.ndarray:
    """Kernel of an elliptical beam (widths in pixels, position angle in degrees from north)."""
    f = 2 * np.sqrt(2 * np.log(2))
    sx, sy = bmaj / f * scale, bmin / f * scale
    size = 2 * (int(n_sigmas * max(sx, sy) + 0.5) + 1)
    return gauss_kernel(size + 1 - size % 2, sx, sy, np.deg2rad(bpa + 90), peak=True)


def gabor_kernel(size: int, sigma: float, theta: float, lam: float, gamma: float, psi: float) -> np.ndarray:
    h = size // 2
    y, x = np.mgrid[-h : h + 1, -h : h + 1].astype(float)
    u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
    return np.exp(-(u * u + gamma * gamma * v * v) / (2 * sigma * sigma)) * np.cos(2 * np.pi * u / lam + psi)


def convolve(px: DataFrame, kernel: np.ndarray, shape: tuple[int, int], border: str = "zero", gap: int = 1) -> DataFrame:
    """Convolution (kernel turned round) with the anchor in its centre."""
    k = kernel[::-1, ::-1]
    return tiled_apply(px, max(kernel.shape) // 2 * gap, lambda a: correlate(a, k, gap), shape, border)


def wavelet(px: DataFrame, scales: int, shape: tuple[int, int]) -> DataFrame:
    """(ix, iy, w1 .. wN, smooth): isotropic undecimated wavelet planes by the B3 spline.

    The margin covers the reach of all scales that fit a tile, so none of these waits for a shuffle of its own;
    each further scale takes a pass on larger tiles.
    """
    near = 1
    while near < scales and sum(2 * 2**s for s in range(near + 1)) <= TILE:
        near += 1

    def planes(first, last):
        def go(f):
            out = {}
            for s in range(first, last):
                g = correlate(f, B3, 2**s)
                out[f"w{s + 1}"], f = f - g, g
            return out | {"smooth": f}

        return go

    out = tiled_apply(px, sum(2 * 2**s for s in range(near)), planes(0, near), shape, "mirror", tuple(f"w{s + 1}" for s in range(near)) + ("smooth",))
    for s in range(near, scales):
        out = written(out, "planes")
        further = tiled_apply(out, 2 * 2**s, planes(s, s + 1), shape, "mirror", (f"w{s + 1}", "smooth"), ("smooth",), max(TILE, 2 * 2**s))
        out = out.drop("smooth").join(further, ["ix", "iy"])
    return out


def gradient(px: DataFrame, shape: tuple[int, int], kernel: np.ndarray = SCHARR_X) -> DataFrame:
    return tiled_apply(px, 1, lambda a: np.hypot(correlate(a, kernel), correlate(a, kernel.T)), shape)


def kirsch(px: DataFrame, shape: tuple[int, int]) -> DataFrame:
    return tiled_apply(px, 1, lambda a: np.max([correlate(a, k) for k in kirsch_kernels()], axis=0), shape)


def element(kind: str, size: int) -> np.ndarray:
    """Structuring element: rect, cross or ellipse."""
    h = size // 2
    if kind == "rect":
        return np.ones((size, size), bool)
    y, x = np.mgrid[-h : h + 1, -h : h + 1]
    return (x == 0) | (y == 0) if kind == "cross" else x * x + y * y <= h * h + 0.25


def _rank(a: np.ndarray, el: np.ndarray, largest: bool) -> np.ndarray:
    """Dilation or erosion; NaN (outside the image) takes no part."""
    c = el.shape[0] // 2
    pick, out = (np.fmax if largest else np.fmin), np.full_like(a, np.nan)
    p = np.pad(a, c, constant_values=np.nan)
    for j, i in zip(*np.nonzero(el)):
        out = pick(out, p[j : j + a.shape[0], i : i + a.shape[1]])
    return np.where(np.isnan(a), np.nan, out)


MORPHOLOGY = {
    "dilate": (1, lambda a, d, e: d(a)),
    "erode": (1, lambda a, d, e: e(a)),
    "open": (2, lambda a, d, e: d(e(a))),
    "close": (2, lambda a, d, e: e(d(a))),
    "gradient": (1, lambda a, d, e: d(a) - e(a)),
    "tophat": (2, lambda a, d, e: a - d(e(a))),
    "blackhat": (2, lambda a, d, e: e(d(a)) - a),
}


def morphologies(px: DataFrame, ops: tuple[str, ...], size: int, shape: tuple[int, int], kind: str = "rect", rounds: int = 1) -> DataFrame:
    """(ix, iy, one column for each operation), all in one pass."""
    el = element(kind, size)

    def many(largest):
        def go(a):
            for _ in range(rounds):
                a = _rank(a, el, largest)
            return a

        return go

    steps = max(MORPHOLOGY[op][0] for op in ops)
    return tiled_apply(px, steps * rounds * (size // 2), lambda a: {op: MORPHOLOGY[op][1](a, many(True), many(False)) for op in ops}, shape, "missing", ops)


def morphology(px: DataFrame, op: str, size: int, shape: tuple[int, int], kind: str = "rect", rounds: int = 1) -> DataFrame:
    return morphologies(px, (op,), size, shape, kind, rounds).withColumnRenamed(op, "w")


def local_maxima(px: DataFrame, size: int, shape: tuple[int, int], skip_border: bool = True) -> DataFrame:
    """(ix, iy, w): pixels equal to their own dilation; plateaus are told apart by the upper left neighbour being different."""
    el, h = element("rect", size), size // 2

    def peaks(a):
        top = _rank(a, el, True)
        flat = (a == shifted(a, -1, -1)) & (shifted(a, -1, -1) == _rank(shifted(a, -1, -1), el, True))
        return {"w": a, "peak": ((a == top) & ~flat).astype(float)}

    out = tiled_apply(px, size, peaks, shape, "missing", ("w", "peak")).where("peak = 1").select("ix", "iy", "w")
    if skip_border:
        out = out.where(F.col("ix").between(h, shape[0] - 1 - h) & F.col("iy").between(h, shape[1] - 1 - h))
    return out


def find_peaks(px: DataFrame, shape: tuple[int, int], sizes=(3, 5, 7), tolerance: int = 2, least: int = 1) -> DataFrame:
    """(peak, n_kernels, x, y): maxima of several kernels linked within the tolerance in both axes; mean positions."""
    from .graph import components

    every = None
    for s in sizes:
        m = local_maxima(px, s, shape).select("ix", "iy", F.lit(s).alias("size"))
        every = m if every is None else every.unionByName(m)
    spots = every.select("ix", "iy", (F.col("iy") * shape[0] + F.col("ix")).alias("id")).distinct()
    cell = max(1, tolerance)
    a = spots.withColumns({"cx": F.floor(F.col("ix") / cell), "cy": F.floor(F.col("iy") / cell)})
    b = a.select(F.col("id").alias("b"), F.col("ix").alias("bx"), F.col("iy").alias("by"), F.explode(F.expr(f"sequence(cx - 1, cx + 1)")).alias("cx"), "cy")  # noqa: F541
    b = b.select("b", "bx", "by", "cx", F.explode(F.expr("sequence(cy - 1, cy + 1)")).alias("cy"))
    near = a.join(b, ["cx", "cy"]).where((F.col("id") < F.col("b")) & (F.abs(F.col("ix") - F.col("bx")) <= tolerance) & (F.abs(F.col("iy") - F.col("by")) <= tolerance))
    label = components(near.select(F.col("id").alias("a"), "b"), spots)
    g = every.join(spots, ["ix", "iy"]).join(label, "id").groupBy(F.col("component").alias("peak")).agg(F.count_distinct("size").alias("n_kernels"), F.avg("ix").alias("x"), F.avg("iy").alias("y"))
    return g.where(F.col("n_kernels") >= least)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over r x r pixels, anchor r // 2."""
    out = np.zeros_like(a)
    for dy in range(-(r // 2), r - r // 2):
        for dx in range(-(r // 2), r - r // 2):
            out += shifted(a, dy, dx)
    return out / (r * r)


def guided_filter(px: DataFrame, radius: int, eps: float, shape: tuple[int, int]) -> DataFrame:
    """Edge-preserving smoothing with the image as its own guide; boxes are radius x radius."""

    def go(a):
        m = box_mean(a, radius)
        var = box_mean(a * a, radius) - m * m
        k = var / (var + eps)
        return box_mean(k, radius) * a + box_mean(m - k * m, radius)

    return tiled_apply(px, 2 * radius, go, shape, "mirror")


def bilateral_filter(px: DataFrame, size: int, sigma_value: float, sigma_space: float, shape: tuple[int, int]) -> DataFrame:
    h = size // 2

    def go(a):
        num, den = np.zeros_like(a), np.zeros_like(a)
        for dy, dx in product(range(-h, h + 1), repeat=2):
            if dx * dx + dy * dy <= h * h:
                b = shifted(a, dy, dx)
                g = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2) - (b - a) ** 2 / (2 * sigma_value**2))
                num, den = num + g * b, den + g
        return num / den

    return tiled_apply(px, h, go, shape, "mirror")


def gabor_bank(px: DataFrame, size: int, n_theta: int, sigma: float, lam: float, gamma: float, psi: float, shape: tuple[int, int]) -> DataFrame:
    """Greatest response over the orientations."""
    ks = [gabor_kernel(size, sigma, np.pi * i / n_theta, lam, gamma, psi) for i in range(n_theta)]
    return tiled_apply(px, size // 2, lambda a: np.max([correlate(a, k[::-1, ::-1]) for k in ks], axis=0), shape, "mirror")


def zero_crossings(px: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(ix, iy): pixels whose sign differs from that of one of the 8 neighbours."""

    def go(a):
        s = np.where(np.isnan(a), 0, np.sign(a))
        return (np.max([np.where(shifted(s, dy, dx) * s < 0, 1.0, 0.0) for dy, dx in product((-1, 0, 1), repeat=2)], axis=0) > 0).astype(float)

    return tiled_apply(px, 1, go, shape, "missing").where("w = 1").select("ix", "iy")


def skeleton(px: DataFrame, threshold: float, size: int, shape: tuple[int, int], rounds: int = 20, tile: int = TILE) -> DataFrame:
    """(ix, iy): union of what opening takes away from ever more eroded versions of the mask, until nothing is left of it.

    A pass makes `rounds` erosions with the margin these need, so the result depends neither on them nor on the tiles.
    """
    el = element("cross", size)
    reach = (rounds + 1) * (size // 2)

    def go(m, out):
        for _ in range(rounds):
            e = _rank(m, el, False)
            out = np.maximum(out, m - _rank(e, el, True))
            m = e
            if not m.any():
                break
        return {"m": m, "out": out}

    state = px.select("ix", "iy", (F.col("w") >= threshold).cast("double").alias("m"), F.lit(0.0).alias("out"))
    left = None
    while True:
        state = written(tiled_apply(state, reach, go, shape, "zero", ("m", "out"), ("m", "out"), max(tile, reach)), "skeleton")
        before, left = left, state.where("m > 0").count()
        if not left or left == before:
            return state.where("out = 1").select("ix", "iy")


def multi_scale_mask(px: DataFrame, shape: tuple[int, int], sigmas: list[float], factor: int = 6, threshold: float = 2.0, tile: int = TILE) -> DataFrame:
    """(ix, iy, n_scales): at how many scales the negated NormLoG response is over `threshold` times its rms over the image."""
    ks = [-norm_log_kernel(int(factor * s) // 2 * 2 + 1, s) for s in sigmas]
    names = tuple(f"f{i}" for i in range(len(ks)))
    reach = max(k.shape[0] for k in ks) // 2
    found = written(tiled_apply(px, reach, lambda a: {n: correlate(a, k) for n, k in zip(names, ks)}, shape, "mirror", names, tile=max(tile, reach)), "responses")
    rms = found.agg(*[F.stddev_pop(n).alias(n) for n in names]).collect()[0]
    over = sum((F.when(F.col(n) >= threshold * (rms[n] or 0.0), 1).otherwise(0) for n in names), F.lit(0))
    return found.select("ix", "iy", over.cast("int").alias("n_scales"))


def canny(px: DataFrame, shape: tuple[int, int], low: float, ratio: float) -> DataFrame:
    """(ix, iy): edges thinned along the gradient; weak ones stay where a component has a strong one."""
    from .detect import label_mask

    def go(a):
        gx, gy = correlate(a, SOBEL_X), correlate(a, SOBEL_X.T)
        g, ang = np.hypot(gx, gy), np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
        keep = np.zeros_like(a, bool)
        for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
            keep |= (ang == k) & (g >= shifted(g, dy, dx)) & (g >= shifted(g, -dy, -dx))
        return np.where(keep, g, 0.0)

    thin = tiled_apply(px, 2, go, shape, "mirror").where(F.col("w") >= low)
    label = label_mask(thin.select("ix", "iy"), shape, diagonal=True)
    strong = thin.where(F.col("w") >= low * ratio).join(label, ["ix", "iy"]).select("component").distinct()
    return label.join(strong, "component", "left_semi").select("ix", "iy")


def hough_lines(points: DataFrame, n_theta: int, rho_step: float, least: int) -> DataFrame:
    """(theta, rho, votes) of straight lines through many points (ix, iy)."""
    t = F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1)))
    v = points.select("ix", "iy", t.alias("theta"))
    a = F.col("theta") * float(np.pi / n_theta)
    v = v.withColumn("rho", F.round((F.col("ix") * F.cos(a) + F.col("iy") * F.sin(a)) / rho_step).cast("long"))
    return v.groupBy("theta", "rho").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def hough_circles(points: DataFrame, radii: list[int], n_angles: int, least: int) -> DataFrame:
    """(radius, cx, cy, votes) of circles through many points."""
    v = points.select("ix", "iy", F.explode(F.array(*map(F.lit, radii))).alias("radius")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_angles - 1))).alias("k"))
    a = F.col("k") * float(2 * np.pi / n_angles)
    v = v.select("radius", F.round(F.col("ix") + F.col("radius") * F.cos(a)).cast("long").alias("cx"), F.round(F.col("iy") + F.col("radius") * F.sin(a)).cast("long").alias("cy"))
    return v.groupBy("radius", "cx", "cy").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def dft(points: DataFrame, key: str, n: int, inverse: bool = False) -> DataFrame:
    """(key, k, re, im): discrete Fourier transform of (key, t, re, im) with n points a key, shared by a group."""
    sign = 1.0 if inverse else -1.0
    p = points.select(key, "t", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    a = sign * 2 * float(np.pi) * ((F.col("k") * F.col("t")) % n) / n
    s = 1.0 / n if inverse else 1.0
    return p.groupBy(key, "k").agg((F.sum(F.col("re") * F.cos(a) - F.col("im") * F.sin(a)) * s).alias("re"), (F.sum(F.col("re") * F.sin(a) + F.col("im") * F.cos(a)) * s).alias("im"))


def colour_guided_filter(px: DataFrame, radius: int, eps: float, shape: tuple[int, int], guides: tuple[str, str, str] = ("w", "g1", "g2")) -> DataFrame:
    """Guided filter of `w` with three guide columns: a 3 x 3 system for each pixel's box."""

    def go(*arrays):
        p, g = arrays[0], arrays[1:]
        mean = lambda a: box_mean(a, radius)
        mg, mp = [mean(a) for a in g], mean(p)
        cov = np.stack([np.stack([mean(a * b) - ma * mb for b, mb in zip(g, mg)], -1) for a, ma in zip(g, mg)], -2) + eps * np.eye(3)
        rhs = np.stack([mean(a * p) - ma * mp for a, ma in zip(g, mg)], -1)
        k = np.linalg.solve(cov, rhs[..., None])[..., 0]
        b = mp - sum(k[..., i] * mg[i] for i in range(3))
        return sum(mean(k[..., i]) * g[i] for i in range(3)) + mean(b)

    return tiled_apply(px.withColumn("_p", F.col("w")), 2 * radius, go, shape, "mirror", ("w",), ("_p", *guides))
