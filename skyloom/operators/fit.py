"""Source fits, contours and their shape parameters: small computations on one source, in NumPy, by group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import SIGMA2FWHM
from .detect import _runs

FIT_SCHEMA = "source_id long, component int, amplitude double, x0 double, y0 double, sigma_x double, sigma_y double, theta double, offset double, flux double, chi2 double, ndof int, status int"
#: Fit status: converged, stopped at the step limit, parameters at a limit, too few pixels.
CONVERGED, NOT_CONVERGED, AT_LIMIT, TOO_SMALL = 0, 1, 2, 3


def _model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.full(len(x), p[-1])
    for a, x0, y0, sx, sy, t in p[:-1].reshape(-1, 6):
        u, v = (x - x0) * np.cos(t) + (y - y0) * np.sin(t), -(x - x0) * np.sin(t) + (y - y0) * np.cos(t)
        out = out + a * np.exp(-u * u / (2 * sx * sx) - v * v / (2 * sy * sy))
    return out


def fit_gaussians(x, y, s, peaks, noise: float, rounds: int = 100, tol: float = 1e-6):
    """Levenberg-Marquardt fit of rotated Gaussians on an offset within bounds: parameters, chi2, status."""
    span = max(np.ptp(x), np.ptp(y), 1.0) + 1
    p = np.array([v for px, py in peaks for v in (s[(x == px) & (y == py)][0], px, py, max(0.7, span / 5), max(0.7, span / 5), 0.0)] + [float(s.min())])
    lo = np.array([v for px, py in peaks for v in (0.0, px - 2, py - 2, 0.3, 0.3, -np.pi / 2)] + [-abs(s).max()])
    hi = np.array([v for px, py in peaks for v in (2 * abs(s).max(), px + 2, py + 2, span, span, np.pi / 2)] + [abs(s).max()])
    p, lam = np.clip(p, lo, hi), 1e-2
    res = (s - _model(p, x, y)) / noise
    cost, status = float(res @ res), NOT_CONVERGED
    for _ in range(rounds):
        jac = np.empty((len(x), len(p)))
        for i in range(len(p)):
            h = 1e-6 * max(1.0, abs(p[i]))
            q = p.copy()
            q[i] += h
            jac[:, i] = (_model(q, x, y) - _model(p, x, y)) / h / noise
        g, hess = jac.T @ res, jac.T @ jac
        for _ in range(20):
            step = np.linalg.solve(hess + lam * np.diag(np.diag(hess) + 1e-12), g)
            q = np.clip(p + step, lo, hi)
            r = (s - _model(q, x, y)) / noise
            if r @ r < cost:
                break
            lam *= 4
        else:
            status = CONVERGED
            break
        gain, p, res, lam = cost - float(r @ r), q, r, lam / 3
        cost = float(r @ r)
        if gain <= tol * max(cost, 1e-12):
            status = CONVERGED
            break
    width = np.maximum(hi - lo, 1e-12)
    if status == CONVERGED and ((np.abs(p - lo) / width < 1e-6) | (np.abs(hi - p) / width < 1e-6)).any():
        status = AT_LIMIT
    return p, cost, status


def fit_sources(pixels: DataFrame, noise: float, components: int = 3) -> DataFrame:
    """Fit of every source of pixels (source_id, ix, iy, w): one row a Gaussian, brightest peaks first.

    A source's pixels are one group; sources are small against an image. Sources with too few pixels for the
    parameters have status 3 and no values.
    """

    def one(pdf):
        import pandas as pd

        x, y, s = (pdf[c].to_numpy(float) for c in ("ix", "iy", "w"))
        at = {(a, b): v for a, b, v in zip(x, y, s)}
        tops = [k for k, v in at.items() if all(v >= at.get((k[0] + i, k[1] + j), -np.inf) for i in (-1, 0, 1) for j in (-1, 0, 1))]
        tops = sorted(tops, key=lambda k: (-at[k], k))[: max(1, min(components, (len(x) - 1) // 6))]
        sid, cols = int(pdf["source_id"].iloc[0]), [c.split()[0] for c in FIT_SCHEMA.split(", ")]
        if len(x) < 7:
            return pd.DataFrame([[sid, 0, *[None] * 8, None, len(x) - 7, TOO_SMALL]], columns=cols)
        p, chi2, status = fit_gaussians(x, y, s, tops, noise)
        rows = []
        for i, (a, x0, y0, sx, sy, t) in enumerate(p[:-1].reshape(-1, 6)):
            rows.append([sid, i, a, x0, y0, sx, sy, float(np.rad2deg(t)), p[-1], 2 * np.pi * a * sx * sy, chi2, len(x) - len(p), status])
        return pd.DataFrame(rows, columns=cols)

    return pixels.select("source_id", "ix", "iy", "w").groupBy("source_id").applyInPandas(one, FIT_SCHEMA)


#: The eight neighbours (dx, dy), counter-clockwise from the right.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def contour_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Outer border of the largest 8-connected part of the pixels, counter-clockwise, through the pixels' centres.

    Border pixels come in the order of the walk around them; a pixel of a thin arm is passed on the way out and on
    the way back, so a line of n pixels has 2 n - 2 points. Holes have no part in it. Of equally large parts the one
    of the lowest row counts.
    """
    if not len(x):
        return np.empty((0, 2))
    x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
    x0, y0 = x.min(), y.min()
    mask = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
    mask[y - y0, x - x0] = True
    part = _runs(mask, True)
    mask = np.pad(part == np.bincount(part[part > 0]).argmax(), 1)
    top = np.flatnonzero(mask.any(axis=1))[-1]
    here = first = (int(np.flatnonzero(mask[top])[0]), int(top))
    # Nothing lies above the first pixel or to its left in its row, so the walk begins downwards along the left side.
    points, came, leave = [], 7, None
    while True:
        for turn in range(8):
            to = (came + 6 + turn) % 8 if came % 2 else (came + 7 + turn) % 8
            there = (here[0] + AROUND[to][0], here[1] + AROUND[to][1])
            if mask[there[1], there[0]]:
                break
        else:
            return np.array([[first[0] - 1 + x0, first[1] - 1 + y0]], float)
        if here == first and to == leave:
            break
        leave = to if leave is None else leave
        points.append(here)
        here, came = there, to
    return np.array(points, float) - 1 + [x0, y0]


def hull_of(p: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def fit_ellipse(p: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Direct least-squares ellipse (centre, semi-axes, angle in degrees) through at least 6 points."""
    if len(p) < 6:
        return None
    m = p.mean(axis=0)
    x, y = p[:, 0] - m[0], p[:, 1] - m[1]
    d1, d2 = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
    try:
        t = -np.linalg.solve(d2.T @ d2, (d1.T @ d2).T)
        e = np.linalg.solve(np.array([[0, 0, 2], [0, -1, 0], [2, 0, 0]], float), d1.T @ d1 + d1.T @ d2 @ t)
        vec = np.real(np.linalg.eig(e)[1])
    except np.linalg.LinAlgError:
        return None
    good = np.flatnonzero(4 * vec[0] * vec[2] - vec[1] ** 2 > 0)
    if not len(good):
        return None
    a, b, c = vec[:, good[0]]
    d, f, g = t @ vec[:, good[0]]
    q = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(2 * q, [-d, -f])
    k = centre @ q @ centre - g
    w, v = np.linalg.eigh(q / k) if k else (np.array([-1.0, -1.0]), q)
    if (w <= 0).any():
        return None
    return float(centre[0] + m[0]), float(centre[1] + m[1]), float(1 / np.sqrt(w[0])), float(1 / np.sqrt(w[1])), float(np.rad2deg(np.arctan2(v[1, 0], v[0, 0])))


SHAPE_SCHEMA = (
    "source_id long, n_points int, area double, perimeter double, circularity double, box_area double, elongation double, rectangularity double, cx double, cy double, eccentricity double, tilt double, "
    "ellipse_area double, bending double, box_min double, roundness double, ellipse_area_ratio double, ellipse_chi2 double"
)


def least_box(p: np.ndarray) -> tuple[float, float]:
    """Longer and shorter side of the rectangle of least area around points; the shorter is 0 for points on one line."""
    hull, best = hull_of(p), None
    if len(hull) < 3:
        return float(np.hypot(*np.ptp(p, axis=0))), 0.0
    for dx, dy in np.roll(hull, -1, axis=0) - hull:
        n = np.hypot(dx, dy)
        wide, high = np.ptp(hull @ [dx / n, dy / n]), np.ptp(hull @ [-dy / n, dx / n])
        if best is None or wide * high < best[0] * best[1]:
            best = (float(max(wide, high)), float(min(wide, high)))
    return best


def ellipse_residual(p: np.ndarray, e: tuple[float, float, float, float, float]) -> float:
    """Mean squared distance of points from an ellipse along the ray from its centre, over points less parameters; NaN with five points or fewer."""
    if len(p) <= len(e):
        return float("nan")
    x0, y0, a, b, t = *e[:4], np.deg2rad(e[4])
    u, v = (p[:, 0] - x0) * np.cos(t) + (p[:, 1] - y0) * np.sin(t), -(p[:, 0] - x0) * np.sin(t) + (p[:, 1] - y0) * np.cos(t)
    k = np.hypot(u / a, v / b)
    away = np.where(k > 0, np.hypot(u, v) * (1 - 1 / np.maximum(k, 1e-12)), min(a, b))
    return float((away**2).sum() / (len(p) - len(e)))


def shape_of(p: np.ndarray) -> list[float]:
    """The values of SHAPE_SCHEMA from area on, for a counter-clockwise outline that encloses an area."""
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area, edge = cross.sum() / 2, q - p
    length = float(np.hypot(*edge.T).sum())
    wide, high = least_box(p)
    cx, cy = (((p[:, i] + q[:, i]) * cross).sum() / (6 * area) for i in (0, 1))
    mxx, myy = (((p[:, i] ** 2 + p[:, i] * q[:, i] + q[:, i] ** 2) * cross).sum() / (12 * area) - c * c for i, c in ((0, cx), (1, cy)))
    mxy = ((p[:, 0] * q[:, 1] + 2 * p[:, 0] * p[:, 1] + 2 * q[:, 0] * q[:, 1] + q[:, 0] * p[:, 1]) * cross).sum() / (24 * area) - cx * cy
    half, diff = (mxx + myy) / 2, np.sqrt(((mxx - myy) / 2) ** 2 + mxy * mxy)
    ell, none = fit_ellipse(p), float("nan")
    covered = np.pi * ell[2] * ell[3] if ell else none
    turn = np.angle(np.exp(1j * np.diff(np.arctan2(*np.vstack([edge, edge[:1]]).T[::-1]))))
    return [
        area, length, 4 * np.pi * area / length**2, wide * high, 1 - high / wide, area / (wide * high), cx, cy,
        float(np.sqrt(max(0.0, 1 - max(0.0, half - diff) / (half + diff)))) if half + diff > 0 else 0.0, float(np.rad2deg(0.5 * np.arctan2(2 * mxy, mxx - myy))),
        covered, float((turn**2).mean()), high, 4 * area / (np.pi * wide**2), area / covered if ell else none, ellipse_residual(p, ell) if ell else none,
    ]


def _area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def contour_shapes(pixels: DataFrame) -> DataFrame:
    """Shape parameters of each source's outline; sources whose outline has under 4 points or no area have only box_min."""

    def one(pdf):
        import pandas as pd

        p = contour_of(pdf["ix"].to_numpy(), pdf["iy"].to_numpy())
        cols = [c.split()[0] for c in SHAPE_SCHEMA.split(", ")]
        sid = int(pdf["source_id"].iloc[0])
        if len(p) < 4 or _area(p) <= 0:
            return pd.DataFrame([{**dict.fromkeys(cols), "source_id": sid, "n_points": len(p), "box_min": least_box(p)[1]}], columns=cols)
        return pd.DataFrame([[sid, len(p), *map(float, shape_of(p))]], columns=cols)

    return pixels.select("source_id", "ix", "iy").groupBy("source_id").applyInPandas(one, SHAPE_SCHEMA)


def fourier_descriptors(pixels: DataFrame, n: int = 8, of: str = "position") -> DataFrame:
    """(source_id, k, modulus) of each source's outline: scale- and start-independent. Sources whose outline has under 4 points or no area have none.

    of: "position", the outline resampled to 64 points as complex numbers, from k = 2 on; or "distance", the distances of
    its points from the centroid, from k = 0 on. Both are divided by the first harmonic; where that is 0, as the
    distances' is for outlines of half-turn symmetry, there are none.
    """
    if of not in ("position", "distance"):
        raise ValueError(f"descriptors of {of!r}: position or distance")

    def one(pdf):
        import pandas as pd

        p = contour_of(pdf["ix"].to_numpy(), pdf["iy"].to_numpy())
        sid = int(pdf["source_id"].iloc[0])
        empty = pd.DataFrame({"source_id": [], "k": [], "modulus": []}).astype({"source_id": "int64", "k": "int32", "modulus": "float64"})
        if len(p) < 4 or _area(p) <= 0:
            return empty
        if of == "distance":
            f, low = np.fft.fft(np.hypot(*(p - shape_of(p)[6:8]).T)), 0
        else:
            q = np.vstack([p, p[:1]])
            at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(q, axis=0).T))])
            t = np.linspace(0, at[-1], 64, endpoint=False)
            f, low = np.fft.fft(np.interp(t, at, q[:, 0]) + 1j * np.interp(t, at, q[:, 1])), 2
        if abs(f[1]) < 1e-9:
            return empty
        v = np.abs(f[low : low + n]) / abs(f[1])
        return pd.DataFrame({"source_id": sid, "k": np.arange(low, low + len(v), dtype=np.int32), "modulus": v})

    return pixels.select("source_id", "ix", "iy").groupBy("source_id").applyInPandas(one, "source_id long, k int, modulus double")


def robust_outliers(df: DataFrame, key: str, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(key, *columns, distance, outlier) per group: Mahalanobis distance about the half of least scatter, cut by a Grubbs bound."""

    def one(pdf):
        x = pdf[columns].to_numpy(float)
        n, k = x.shape
        inside = np.argsort(((x - np.median(x, axis=0)) ** 2).sum(axis=1), kind="stable")[: max(k + 1, (n + k + 1) // 2)]
        for _ in range(20):
            m, c = x[inside].mean(axis=0), np.cov(x[inside].T).reshape(k, k) + 1e-12 * np.eye(k)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[: len(inside)]
            if set(new) == set(inside):
                break
            inside = new
        d = np.sqrt(d * k / max(np.median(d), 1e-12))
        return pdf.assign(distance=d, outlier=d > np.sqrt(k) + np.sqrt(2 * np.log(2 * n / alpha)))

    kinds = dict(df.dtypes)
    names = [key, *columns]
    return df.select(*names).groupBy(key).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in names) + ", distance double, outlier boolean")


def ward_clusters(df: DataFrame, key: str, columns: list[str], height: float) -> DataFrame:
    """(key, *columns, cluster) per group of rows: Ward's agglomeration, cut at a height."""

    def one(pdf):
        x = pdf[columns].to_numpy(float)
        n = len(x)
        size, alive, label = np.ones(n), list(range(n)), np.arange(n)
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        while len(alive) > 1:
            sub = d[np.ix_(alive, alive)]
            i, j = np.unravel_index(sub.argmin(), sub.shape)
            if np.sqrt(sub[i, j]) > height:
                break
            a, b = sorted((alive[i], alive[j]))
            for c in alive:
                if c not in (a, b):
                    t = size[a] + size[b] + size[c]
                    d[a, c] = d[c, a] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d[a, b]) / t
            size[a] += size[b]
            label[label == b] = a
            alive.remove(b)
        return pdf.assign(cluster=label.astype(np.int64))

    kinds = dict(df.dtypes)
    return df.select(key, *columns).groupBy(key).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (key, *columns)) + ", cluster long")


def ds9_regions(shapes: DataFrame) -> DataFrame:
    """(value): lines of a region file, one ellipse a fitted component (full widths at half maximum, 1-based positions)."""
    half = SIGMA2FWHM / 2
    return shapes.where("amplitude IS NOT NULL").select(
        F.format_string("ellipse(%.4f,%.4f,%.4f,%.4f,%.4f) # text={S%d} tag={component %d}", F.col("x0") + 1, F.col("y0") + 1, F.col("sigma_x") * half, F.col("sigma_y") * half, "theta", "source_id", "component").alias("value")
    )
