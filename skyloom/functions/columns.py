"""Column expressions of the scalar image math."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Full width at half maximum of a Gaussian over its sigma.
SIGMA2FWHM = 2 * math.sqrt(2 * math.log(2))


def rounded(c, digits: int = 6) -> Column:
    """Rounded for comparison; never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def valid(w) -> Column:
    """A pixel that counts where 0 means missing: finite, not 0."""
    w = F.col(w) if isinstance(w, str) else w
    return w.isNotNull() & ~F.isnan(w) & (w != 0) & (F.abs(w) < float("inf"))


def linear_norm(w, lo, hi, to_lo: float, to_hi: float) -> Column:
    return F.lit(to_lo) + (to_hi - to_lo) * (w - lo) / (hi - lo)


def log_norm(w, lo, hi, to_lo: float, to_hi: float) -> Column:
    """Mapped to [1, 256] first, then by its logarithm."""
    return F.lit(to_lo) + F.log10(linear_norm(w, lo, hi, 1.0, 256.0)) / math.log10(256.0) * (to_hi - to_lo)


def sigmoid(w, x0: float, sigma: float) -> Column:
    return 1 / (1 + F.exp(-(w - x0) / sigma))


def beam_area(bmaj, bmin) -> Column:
    return math.pi * bmaj * bmin / (4 * math.log(2))


def beam_area_pixels(bmaj, bmin, dx, dy) -> Column:
    return beam_area(bmaj, bmin) / F.abs(dx * dy)


def beam_width_pixels(bmaj, bmin, dx, dy) -> Column:
    return F.ceil(F.sqrt(bmaj * bmin) / F.sqrt(F.abs(dx * dy)))


def mirror_index(i, n) -> Column:
    """Reflected at the borders without repeating the edge."""
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def find_bin(x, lo: float, hi: float, n: int) -> Column:
    """Truncated bin of a coordinate; -1 outside."""
    return F.when((x >= lo) & (x <= hi), ((n - 1) * (x - lo) / (hi - lo)).cast("long")).otherwise(F.lit(-1))


def linspace(first: float, last: float, n: int) -> Column:
    step = (last - first) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(first) + i * step)


def min_max_array(a, lo: float, hi: float) -> Column:
    return F.transform(a, lambda x: lo + (hi - lo) * (x - F.array_min(a)) / (F.array_max(a) - F.array_min(a)))


def gauss2d(x, y, amp, x0, y0, sx, sy, theta) -> Column:
    """Rotated two-dimensional Gaussian; theta in radians."""
    c, s = F.cos(theta), F.sin(theta)
    a = c * c / (2 * sx * sx) + s * s / (2 * sy * sy)
    b = F.sin(2 * theta) / (4 * sx * sx) - F.sin(2 * theta) / (4 * sy * sy)
    d = s * s / (2 * sx * sx) + c * c / (2 * sy * sy)
    dx, dy = x - x0, y - y0
    return amp * F.exp(-(a * dx * dx + 2 * b * dx * dy + d * dy * dy))


def flux_density(amp, sx, sy) -> Column:
    return 2 * math.pi * amp * sx * sy


def ellipse_of(sxx, syy, sxy) -> tuple[Column, Column, Column]:
    """Semi-axes and angle (degrees) of the ellipse of a 2 x 2 covariance."""
    half, diff = (sxx + syy) / 2, F.sqrt(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy)
    return F.sqrt(half + diff), F.sqrt(F.greatest(half - diff, F.lit(0.0))), F.degrees(F.atan2(2 * sxy, sxx - syy) / 2)


def erfc(x) -> Column:
    """Complementary error function for x >= 0: Taylor series below 2, continued fraction above."""
    n, k = F.sequence(F.lit(0), F.lit(60)), F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    term = F.aggregate(
        n,
        F.struct(F.lit(0.0).alias("s"), (x * 1.0).alias("t")),
        lambda a, i: F.struct((a["s"] + a["t"] / (2 * i + 1)).alias("s"), (a["t"] * (-(x * x)) / (i + 1)).alias("t")),
    )["s"]
    tail = F.aggregate(k, x * 1.0, lambda a, i: x + (i / 2.0) / a)
    return F.when(x < 2.0, 1 - 2 / math.sqrt(math.pi) * term).otherwise(F.exp(-(x * x)) / (math.sqrt(math.pi) * tail))


def sigma_contour_scale(n) -> Column:
    """Scale of an ellipse's axes that holds n sigma of a two-dimensional Gaussian."""
    return F.sqrt(-2 * F.log(erfc(n / math.sqrt(2))))


def cl_contour_scale(cl) -> Column:
    return F.sqrt(-2 * F.log(1 - cl))


def tan_world(ix, iy, crpix1, crpix2, crval1, crval2, cdelt1, cdelt2, crota=0.0) -> tuple[Column, Column]:
    """World coordinates (degrees) of 0-based pixels in a gnomonic projection."""
    r = math.radians(crota)
    u, v = (ix + 1 - crpix1) * cdelt1, (iy + 1 - crpix2) * cdelt2
    xi, eta = F.radians(u * math.cos(r) - v * math.sin(r)), F.radians(u * math.sin(r) + v * math.cos(r))
    d0 = math.radians(crval2)
    den = math.cos(d0) - eta * math.sin(d0)
    ra = F.atan2(xi, den)
    dec = F.atan((math.sin(d0) + eta * math.cos(d0)) * F.cos(ra) / den)
    return F.pmod(F.degrees(ra) + crval1, F.lit(360.0)), F.degrees(dec)


def galactic(ra, dec) -> tuple[Column, Column]:
    """Equatorial (J2000) to galactic coordinates, degrees."""
    # The galactic pole and the longitude of the ascending node's pole.
    ra0, dec0, l0 = math.radians(192.85948), math.radians(27.12825), math.radians(122.93192)
    a, d = F.radians(ra) - ra0, F.radians(dec)
    b = F.asin(F.sin(d) * math.sin(dec0) + F.cos(d) * math.cos(dec0) * F.cos(a))
    lon = l0 - F.atan2(F.cos(d) * F.sin(a), F.sin(d) * math.cos(dec0) - F.cos(d) * math.sin(dec0) * F.cos(a))
    return F.pmod(F.degrees(lon), F.lit(360.0)), F.degrees(b)
