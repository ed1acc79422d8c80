"""Queries of the stencil (W), background and detection (D), join (J) and merge operators."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import background as B
from ..operators import catalog as K
from ..operators import detect as D
from ..operators import stats as S
from ..operators import stencil as ST
from ..sources.image import embedding_image, table
from .registry import query
from .stats_queries import GLOBAL, IMG, R, TILED, out, r, rs, tiled

NY = "(SELECT count(*) FROM embeddings)"
TEST_KERNEL = np.array([[1, 2, 0], [0, -4, 1], [3, 0, -1]], float)


def _values(k: np.ndarray, turn: bool, gap: int = 1) -> str:
    """SQL rows (dx, dy, v) of a kernel."""
    cy, cx = k.shape[0] // 2, k.shape[1] // 2
    s = -1 if turn else 1
    return ", ".join(f"({s * (i - cx) * gap}, {s * (j - cy) * gap}, {k[j, i]!r})".replace("np.float64(", "").replace("))", ")") for j, i in zip(*np.nonzero(k)))


def conv(name: str, src: str, kernel: np.ndarray, border: str = "zero", gap: int = 1, turn: bool = True) -> str:
    """SQL CTEs of a convolution of src (ix, iy, w)."""
    ax, ay = "a.ix + k.dx", "a.iy + k.dy"
    if border == "mirror":
        ax, ay = (f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= {n} THEN 2 * ({n} - 1) - ({e}) ELSE {e} END)" for e, n in ((ax, "64"), (ay, "(SELECT ny FROM dims)")))
    return (
        f"k_{name}(dx, dy, v) AS (VALUES {_values(kernel, turn, gap)}), p_{name} AS (SELECT a.ix, a.iy, {ax} AS bx, {ay} AS by_, k.v FROM {src} a, k_{name} k), "
        f"{name} AS (SELECT p.ix, p.iy, sum(p.v * b.w) AS w FROM p_{name} p JOIN {src} b ON b.ix = p.bx AND b.iy = p.by_ GROUP BY p.ix, p.iy)"
    )


DIMS = f"{IMG}, dims AS (SELECT count(*) AS ny FROM embeddings)"


def image(spark, d):
    px = embedding_image(spark, d)
    return px, (64, table(spark, d, "embeddings").count())


def _w(df):
    return out(df, "ix", "iy", w="w")


@query("w01_convolution", f"WITH {DIMS}, {conv('c', 'img', TEST_KERNEL)} SELECT ix, iy, {r('w')} AS w FROM c")
def w01(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, TEST_KERNEL, s))


@query("w02_mirror_convolution", f"WITH {DIMS}, {conv('c', 'img', TEST_KERNEL, 'mirror')} SELECT ix, iy, {r('w')} AS w FROM c")
def w02(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, TEST_KERNEL, s, "mirror"))


@query("w03_atrous", f"WITH {DIMS}, {conv('c', 'img', ST.B3, 'mirror', 2)} SELECT ix, iy, {r('w')} AS w FROM c")
def w03(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, ST.B3, s, "mirror", 2))


@query("w04_wavelet", f"WITH {DIMS}, {conv('f1', 'img', ST.B3, 'mirror')}, {conv('f2', 'f1', ST.B3, 'mirror', 2)} SELECT img.ix, img.iy, {rs(w1='img.w - f1.w', w2='f1.w - f2.w', smooth='f2.w')} FROM img JOIN f1 USING (ix, iy) JOIN f2 USING (ix, iy)")
def w04(spark, d):
    px, s = image(spark, d)
    return out(ST.wavelet(px, 2, s), "ix", "iy", w1="w1", w2="w2", smooth="smooth")


@query("w05_b3_kernel", f"WITH k(dx, dy, v) AS (VALUES {_values(ST.B3, False)}) SELECT dx, dy, {r('v', 9)} AS v FROM k")
def w05(spark, d):
    rows = [(i - 2, j - 2, float(ST.B3[j, i])) for j in range(5) for i in range(5)]
    return spark.createDataFrame(rows, "dx int, dy int, v double").select("dx", "dy", R("v", 9).alias("v"))


@query("w06_gradient", f"WITH {DIMS}, {conv('gx', 'img', ST.SCHARR_X, turn=False)}, {conv('gy', 'img', ST.SCHARR_X.T, turn=False)} SELECT gx.ix, gx.iy, {r('sqrt(gx.w * gx.w + gy.w * gy.w)')} AS w FROM gx JOIN gy USING (ix, iy)")
def w06(spark, d):
    px, s = image(spark, d)
    return _w(ST.gradient(px, s))


@query("w07_laplace", f"WITH {DIMS}, {conv('c', 'img', ST.LAPLACE)} SELECT ix, iy, {r('w')} AS w FROM c")
def w07(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, ST.LAPLACE, s))


_KIRSCH = ", ".join(conv(f"q{i}", "img", k, turn=False) for i, k in enumerate(ST.kirsch_kernels()))


@query("w08_kirsch", f"WITH {DIMS}, {_KIRSCH} SELECT ix, iy, {r('greatest(' + ', '.join(f'q{i}.w' for i in range(8)) + ')')} AS w FROM q0 " + " ".join(f"JOIN q{i} USING (ix, iy)" for i in range(1, 8)))
def w08(spark, d):
    px, s = image(spark, d)
    return _w(ST.kirsch(px, s))


# The 7 x 7 Laplacian-of-Gaussian kernel.
LOG7 = np.array(
    [[0, 0, 1, 1, 1, 0, 0], [0, 1, 3, 3, 3, 1, 0], [1, 3, 0, -7, 0, 3, 1], [1, 3, -7, -24, -7, 3, 1], [1, 3, 0, -7, 0, 3, 1], [0, 1, 3, 3, 3, 1, 0], [0, 0, 1, 1, 1, 0, 0]], float
)


@query("w09_log", f"WITH {DIMS}, {conv('c', 'img', LOG7)} SELECT ix, iy, {r('w')} AS w FROM c")
def w09(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, LOG7, s))


_NLOG = ST.norm_log_kernel(7, 1.5)


@query("w10_norm_log", f"WITH {DIMS}, {conv('c', 'img', _NLOG)} SELECT ix, iy, {r('w')} AS w FROM c")
def w10(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, _NLOG, s))


_BEAMK = ST.beam_kernel(5.0, 3.0, 20.0, 2)


@query("w11_beam", f"WITH {DIMS}, {conv('c', 'img', _BEAMK)} SELECT ix, iy, {r('w')} AS w FROM c")
def w11(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, _BEAMK, s))


_GAUSS = ST.gauss_kernel(5, 1.0)


@query("w12_gaussian_blur", f"WITH {DIMS}, {conv('c', 'img', _GAUSS, 'mirror')} SELECT ix, iy, {r('w')} AS w FROM c")
def w12(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, _GAUSS, s, "mirror"))


def _box(name: str, src: str, v: int) -> str:
    k = np.zeros((2 * (v // 2) + 1, 2 * (v // 2) + 1))
    k[: v, : v] = 1.0 / (v * v)
    return conv(name, src, k, "mirror", turn=False)


def _guided(src: str, eps: str, v: int = 4) -> str:
    return (
        f"sq AS (SELECT ix, iy, w * w AS w FROM {src}), {_box('m', src, v)}, {_box('c2', 'sq', v)}, ab AS (SELECT m.ix, m.iy, (c2.w - m.w * m.w) / (c2.w - m.w * m.w + {eps}) AS a, m.w AS m FROM m JOIN c2 USING (ix, iy)), "
        f"aa AS (SELECT ix, iy, a AS w FROM ab), bb AS (SELECT ix, iy, m - a * m AS w FROM ab), {_box('ma', 'aa', v)}, {_box('mb', 'bb', v)}, gf AS (SELECT s.ix, s.iy, ma.w * s.w + mb.w AS w FROM {src} s JOIN ma USING (ix, iy) JOIN mb USING (ix, iy))"
    )


@query("w13_guided_filter", f"WITH {DIMS}, {_guided('img', '0.01')} SELECT ix, iy, {r('w')} AS w FROM gf WHERE ix BETWEEN 4 AND 59 AND iy BETWEEN 4 AND (SELECT ny - 5 FROM dims)")
def w13(spark, d):
    px, s = image(spark, d)
    return _w(ST.guided_filter(px, 4, 0.01, s)).where(F.col("ix").between(4, 59) & F.col("iy").between(4, s[1] - 5))


@query("w15_guided_image", f"WITH {DIMS}, b AS (SELECT min(w) lo, max(w) hi FROM img), n AS (SELECT ix, iy, 1 + 255.0 * (w - lo) / (hi - lo) AS w FROM img, b), {_guided('n', '(0.04 * 255 * 255)')} SELECT ix, iy, {r('w', 4)} AS w FROM gf WHERE ix BETWEEN 4 AND 59 AND iy BETWEEN 4 AND (SELECT ny - 5 FROM dims)")
def w15(spark, d):
    px, s = image(spark, d)
    lim = px.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    n = px.crossJoin(F.broadcast(lim)).select("ix", "iy", C.linear_norm(F.col("w"), F.col("lo"), F.col("hi"), 1.0, 256.0).alias("w"))
    g = ST.guided_filter(n, 4, 0.04 * 255 * 255, s).where(F.col("ix").between(4, 59) & F.col("iy").between(4, s[1] - 5))
    return g.select("ix", "iy", R("w", 4).alias("w"))


def _win(f: str, src: str, name: str, h: int, extra: str = "") -> str:
    """Separable running extreme over a (2 h + 1) square, cut off at the border."""
    return (
        f"{name}x AS (SELECT ix, iy, {f}(w) OVER (PARTITION BY iy ORDER BY ix ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS w FROM {src}), "
        f"{name} AS (SELECT ix, iy, {f}(w) OVER (PARTITION BY ix ORDER BY iy ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS w FROM {name}x)"
    )


@query("w16_local_maxima", f"WITH {DIMS}, {_win('max', 'img', 'd', 2)} SELECT ix, iy, {r('img.w')} AS w FROM img JOIN d USING (ix, iy) WHERE img.w = d.w AND ix BETWEEN 2 AND 61 AND iy BETWEEN 2 AND (SELECT ny - 3 FROM dims)")
def w16(spark, d):
    px, s = image(spark, d)
    return _w(ST.local_maxima(px, 5, s))


_MORPH = (
    f"{_win('max', 'img', 'dil', 1)}, {_win('min', 'img', 'ero', 1)}, {_win('max', 'ero', 'opn', 1)}, {_win('min', 'dil', 'cls', 1)}"
)


@query(
    "w17_morphology",
    f"WITH {IMG}, {_MORPH} SELECT img.ix, img.iy, {rs(dilate='dil.w', erode='ero.w', opened='opn.w', closed='cls.w', gradient='dil.w - ero.w', tophat='img.w - opn.w', blackhat='cls.w - img.w')} FROM img JOIN dil USING (ix, iy) JOIN ero USING (ix, iy) JOIN opn USING (ix, iy) JOIN cls USING (ix, iy)",
)
def w17(spark, d):
    px, s = image(spark, d)
    m = ST.morphologies(px, tuple(ST.MORPHOLOGY), 3, s)
    return out(m, "ix", "iy", **{{"open": "opened", "close": "closed"}.get(op, op): op for op in ST.MORPHOLOGY})


_PEAKS = f"""WITH RECURSIVE {DIMS}, {", ".join(_win("max", "img", f"d{h}", h) for h in (1, 2, 3))},
tops AS ({" UNION ALL ".join(f"SELECT {h} AS h, ix, iy FROM img JOIN d{h} USING (ix, iy), dims WHERE img.w = d{h}.w AND ix BETWEEN {h} AND 63 - {h} AND iy BETWEEN {h} AND ny - 1 - {h}" for h in (1, 2, 3))}),
spots AS (SELECT DISTINCT ix, iy, iy * 64 + ix AS id FROM tops),
near AS (SELECT a.id AS a, b.id AS b FROM spots a, range(-2, 3) x(dx), range(-2, 3) y(dy) JOIN spots b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE a.id <> b.id),
walk AS (SELECT id, id AS root FROM spots UNION SELECT near.b, walk.root FROM walk JOIN near ON near.a = walk.id), comp AS (SELECT id, min(root) AS peak FROM walk GROUP BY id)
SELECT peak, count(DISTINCT h) AS n_kernels, {r("avg(ix)")} AS x, {r("avg(iy)")} AS y FROM tops JOIN spots USING (ix, iy) JOIN comp USING (id) GROUP BY peak HAVING count(DISTINCT h) >= 2"""


@query("w18_find_peaks", _PEAKS)
def w18(spark, d):
    px, s = image(spark, d)
    return out(ST.find_peaks(px, s, (3, 5, 7), 2, 2), "peak", "n_kernels", x="x", y="y")


@query("w20_dilate_pixels", f"WITH {IMG}, s AS (SELECT ix, iy FROM img WHERE w > 0.35), o AS (SELECT x.i AS dx, y.i AS dy FROM range(-2, 3) x(i), range(-2, 3) y(i) WHERE x.i * x.i + y.i * y.i <= 4) SELECT DISTINCT s.ix + dx AS ix, s.iy + dy AS iy FROM s, o WHERE s.ix + dx BETWEEN 0 AND 63 AND s.iy + dy BETWEEN 0 AND {NY} - 1")
def w20(spark, d):
    px, s = image(spark, d)
    return D.dilated(px.where("w > 0.35").withColumn("source_id", F.lit(1)), 5, s).select("ix", "iy")


@query("w23_dft", f"WITH p AS (SELECT vec_id, unnest(range(64)) AS t, unnest(embedding)::DOUBLE AS re FROM embeddings) SELECT vec_id, k, {rs(re='sum(re * cos(-2 * pi() * ((k * t) % 64) / 64))', im='sum(re * sin(-2 * pi() * ((k * t) % 64) / 64))')} FROM p, range(64) x(k) GROUP BY vec_id, k")
def w23(spark, d):
    p = embedding_image(spark, d).select(F.col("iy").alias("vec_id"), F.col("ix").alias("t"), F.col("w").alias("re"), F.lit(0.0).alias("im"))
    return out(ST.dft(p, "vec_id", 64).withColumn("k", F.col("k").cast("long")), "vec_id", "k", re="re", im="im")


@query("w24_inverse_dft", f"SELECT vec_id, unnest(range(64)) AS t, {r('unnest(embedding)::DOUBLE')} AS re FROM embeddings")
def w24(spark, d):
    p = embedding_image(spark, d).select(F.col("iy").alias("vec_id"), F.col("ix").alias("t"), F.col("w").alias("re"), F.lit(0.0).alias("im"))
    f = ST.dft(p, "vec_id", 64).select("vec_id", F.col("k").alias("t"), "re", "im")
    return out(ST.dft(f, "vec_id", 64, inverse=True).select("vec_id", F.col("k").cast("long").alias("t"), "re"), "vec_id", "t", re="re")


@query(
    "w26_bilateral",
    f"WITH {IMG}, o AS (SELECT x.i AS dx, y.i AS dy FROM range(-2, 3) x(i), range(-2, 3) y(i) WHERE x.i * x.i + y.i * y.i <= 4), p AS (SELECT a.ix, a.iy, b.w, exp(-(dx * dx + dy * dy) / 8.0 - pow(b.w - a.w, 2) / 0.02) AS g FROM img a, o JOIN img b ON b.ix = a.ix + dx AND b.iy = a.iy + dy) SELECT ix, iy, {r('sum(g * w) / sum(g)')} AS w FROM p WHERE ix BETWEEN 2 AND 61 AND iy BETWEEN 2 AND {NY} - 3 GROUP BY ix, iy",
)
def w26(spark, d):
    px, s = image(spark, d)
    return _w(ST.bilateral_filter(px, 5, 0.1, 2.0, s)).where(F.col("ix").between(2, 61) & F.col("iy").between(2, s[1] - 3))


def _mirrored(e: str, n: str) -> str:
    return f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} >= {n} THEN 2 * ({n} - 1) - ({e}) ELSE {e} END"


_EDGES = f"""WITH RECURSIVE {DIMS}, {conv("gx", "img", ST.SOBEL_X, "mirror", turn=False)}, {conv("gy", "img", ST.SOBEL_X.T, "mirror", turn=False)}, way(d, dx, dy) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1)),
g AS (SELECT gx.ix, gx.iy, sqrt(gx.w * gx.w + gy.w * gy.w) AS w, (round(atan2(gy.w, gx.w) / (pi() / 4))::INT % 4 + 4) % 4 AS d FROM gx JOIN gy USING (ix, iy)),
sides AS (SELECT ix, iy, w, s.i, {_mirrored("ix + s.i * dx", "64")} AS jx, {_mirrored("iy + s.i * dy", "ny")} AS jy FROM g JOIN way USING (d), (VALUES (1), (-1)) s(i), dims),
thin AS (SELECT sides.ix, sides.iy, sides.w, sides.iy * 64 + sides.ix AS id FROM sides JOIN g ON g.ix = jx AND g.iy = jy WHERE sides.w >= 0.6 GROUP BY ALL HAVING bool_and(sides.w >= g.w)),
near AS (SELECT a.id AS a, b.id AS b FROM thin a, range(-1, 2) x(dx), range(-1, 2) y(dy) JOIN thin b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE a.id <> b.id),
walk AS (SELECT id FROM thin WHERE w >= 1.2 UNION SELECT near.b FROM walk JOIN near ON near.a = walk.id) SELECT ix, iy FROM thin SEMI JOIN walk USING (id)"""


@query("w27_canny", _EDGES)
def w27(spark, d):
    px, s = image(spark, d)
    return ST.canny(px, s, 0.6, 2.0)


@query("w28_zero_crossings", f"WITH {IMG} SELECT DISTINCT a.ix, a.iy FROM img a, range(-1, 2) x(dx), range(-1, 2) y(dy) JOIN img b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE sign(a.w) * sign(b.w) < 0")
def w28(spark, d):
    px, s = image(spark, d)
    return ST.zero_crossings(px, s)


_GABOR = [ST.gabor_kernel(7, 2.0, np.pi * i / 4, 4.0, 0.5, 0.0) for i in range(4)]


@query("w29_gabor", f"WITH {DIMS}, " + ", ".join(conv(f"g{i}", "img", k, "mirror") for i, k in enumerate(_GABOR)) + f" SELECT ix, iy, {r('greatest(g0.w, g1.w, g2.w, g3.w)')} AS w FROM g0 JOIN g1 USING (ix, iy) JOIN g2 USING (ix, iy) JOIN g3 USING (ix, iy)")
def w29(spark, d):
    px, s = image(spark, d)
    return _w(ST.gabor_bank(px, 7, 4, 2.0, 4.0, 0.5, 0.0, s))


_BONES = f"""WITH RECURSIVE {DIMS}, {conv("soft", "img", _GAUSS, "mirror")}, o(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
worn AS (SELECT 0 AS k, ix, iy FROM soft WHERE w >= 0.02 UNION ALL SELECT k + 1, ix - dx, iy - dy FROM worn, o GROUP BY ALL HAVING count(*) = 5),
opened AS (SELECT DISTINCT k - 1 AS k, ix + dx AS ix, iy + dy AS iy FROM worn, o WHERE k > 0) SELECT DISTINCT ix, iy FROM worn ANTI JOIN opened USING (k, ix, iy)"""


@query("w30_skeleton", _BONES)
def w30(spark, d):
    px, s = image(spark, d)
    return ST.skeleton(ST.convolve(px, _GAUSS, s, "mirror"), 0.02, 3, s, 10)


@query("w31_sobel", f"WITH {DIMS}, {conv('gx', 'img', ST.SOBEL_X, turn=False)}, {conv('gy', 'img', ST.SOBEL_X.T, turn=False)} SELECT gx.ix, gx.iy, {r('sqrt(gx.w * gx.w + gy.w * gy.w)')} AS w FROM gx JOIN gy USING (ix, iy)")
def w31(spark, d):
    px, s = image(spark, d)
    return _w(ST.gradient(px, s, ST.SOBEL_X))


@query("w32_sharpen", f"WITH {DIMS}, {conv('c', 'img', ST.LAPLACE)} SELECT ix, iy, {r('img.w - 0.3 * c.w')} AS w FROM img JOIN c USING (ix, iy)")
def w32(spark, d):
    px, s = image(spark, d)
    lap = ST.convolve(px, ST.LAPLACE, s).select("ix", "iy", F.col("w").alias("l"))
    return out(px.join(lap, ["ix", "iy"]), "ix", "iy", w=F.col("w") - 0.3 * F.col("l"))


_SCALES = {f"s{i}": -ST.norm_log_kernel(n, sigma) for i, (n, sigma) in enumerate(((7, 1.0), (9, 1.5), (13, 2.0)))}
_MULTI = f"""WITH {DIMS}, {", ".join(conv(n, "img", k, "mirror") for n, k in _SCALES.items())}, f AS ({" UNION ALL ".join(f"SELECT '{n}' AS s, ix, iy, w FROM {n}" for n in _SCALES)}),
q AS (SELECT s, 2 * stddev_pop(w) AS least FROM f GROUP BY s) SELECT ix, iy, count(*)::INT AS n_scales FROM f JOIN q USING (s) WHERE w >= least GROUP BY ix, iy"""


@query("w35_multi_scale_mask", _MULTI)
def w35(spark, d):
    px, s = image(spark, d)
    return ST.multi_scale_mask(px, s, [1.0, 1.5, 2.0]).where("n_scales > 0")


_PTS = f"{IMG}, pts AS (SELECT ix, iy FROM img WHERE w > 0.3)"


@query("w36_hough_lines", f"WITH {_PTS}, v AS (SELECT t.i AS theta, round((ix * cos(t.i * {np.pi / 18!r}) + iy * sin(t.i * {np.pi / 18!r})) / 2.0)::BIGINT AS rho FROM pts, range(18) t(i)) SELECT theta, rho, count(*) AS votes FROM v GROUP BY 1, 2 HAVING count(*) >= 8")
def w36(spark, d):
    return ST.hough_lines(embedding_image(spark, d).where("w > 0.3").select("ix", "iy"), 18, 2.0, 8).withColumn("theta", F.col("theta").cast("long"))


@query("w37_hough_circles", f"WITH {_PTS}, v AS (SELECT rr.i AS radius, round(ix + rr.i * cos(k.i * {2 * np.pi / 24!r}))::BIGINT AS cx, round(iy + rr.i * sin(k.i * {2 * np.pi / 24!r}))::BIGINT AS cy FROM pts, range(24) k(i), range(4, 7) rr(i)) SELECT radius, cx, cy, count(*) AS votes FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def w37(spark, d):
    return ST.hough_circles(embedding_image(spark, d).where("w > 0.3").select("ix", "iy"), [4, 5, 6], 24, 5).withColumn("radius", F.col("radius").cast("long"))


# --- D: background, detection ---------------------------------------------------------------------------------------------
BOX, GRIDSTEP = (16, 50), (8, 25)
_NODES = (
    f"{IMG}, dims AS (SELECT count(*) AS ny FROM embeddings), xs AS (SELECT i, 8 + 8 * i AS c FROM range(100) t(i) WHERE 8 + 8 * i <= 63 - 8), ys AS (SELECT j, 25 + 25 * j AS c FROM range(10000) t(j), dims WHERE 25 + 25 * j <= ny - 1 - 25), "
    "s AS (SELECT i, j, w FROM img JOIN xs ON ix BETWEEN xs.c - 8 AND xs.c + 7 JOIN ys ON iy BETWEEN ys.c - 25 AND ys.c + 24), sm AS (SELECT i, j, median(w) AS med FROM s GROUP BY 1, 2), "
    "nodes AS (SELECT i, j, count(*) AS n, first(med) AS bkg, 1.4826 * median(abs(w - med)) AS rms FROM s JOIN sm USING (i, j) GROUP BY 1, 2)"
)
_MAPS = (
    f"{_NODES}, mx AS (SELECT max(i) AS mi, max(j) AS mj FROM nodes), u AS (SELECT ix, iy, w, least(greatest((ix - 8) / 8.0, 0), mi) AS ux, least(greatest((iy - 25) / 25.0, 0), mj) AS uy, mi, mj FROM img, mx), "
    "v AS (SELECT *, least(floor(ux)::BIGINT, mi - 1) AS i0, least(floor(uy)::BIGINT, mj - 1) AS j0 FROM u), "
    "maps AS (SELECT ix, iy, w, (a.bkg * (1 - (ux - i0)) + b.bkg * (ux - i0)) * (1 - (uy - j0)) + (c.bkg * (1 - (ux - i0)) + e.bkg * (ux - i0)) * (uy - j0) AS bkg, (a.rms * (1 - (ux - i0)) + b.rms * (ux - i0)) * (1 - (uy - j0)) + (c.rms * (1 - (ux - i0)) + e.rms * (ux - i0)) * (uy - j0) AS rms "
    "FROM v JOIN nodes a ON a.i = i0 AND a.j = j0 JOIN nodes b ON b.i = i0 + 1 AND b.j = j0 JOIN nodes c ON c.i = i0 AND c.j = j0 + 1 JOIN nodes e ON e.i = i0 + 1 AND e.j = j0 + 1)"
)


@query("d03_grid_background", f"WITH {_NODES} SELECT i, j, n, {rs(bkg='bkg', rms='rms')} FROM nodes")
def d03(spark, d):
    px, s = image(spark, d)
    return out(B.grid_background(px, *s, BOX, GRIDSTEP), "i", "j", "n", bkg="bkg", rms="rms")


@query("w21_bilinear", f"WITH {_MAPS} SELECT ix, iy, {rs(bkg='bkg', rms='rms')} FROM maps")
def w21(spark, d):
    px, s = image(spark, d)
    return out(B.local_background(px, *s, BOX, GRIDSTEP), "ix", "iy", bkg="bkg", rms="rms")


@query("d01_local_significance", f"WITH {_MAPS} SELECT ix, iy, {r('CASE WHEN w <> 0 AND rms > 0 THEN (w - bkg) / rms ELSE 0 END')} AS z FROM maps")
def d01(spark, d):
    px, s = image(spark, d)
    return out(B.significance(B.local_background(px, *s, BOX, GRIDSTEP)), "ix", "iy", z="z")


def again(src: str) -> str:
    """CTEs of `_MAPS` on another image, all names with a 2."""
    return re.sub(r"\b(xs|ys|sm|s|nodes|mx|u|v|maps)\b", r"\g<1>2", _MAPS[_MAPS.index("xs AS") :]).replace("img", src)


@query("d02_second_pass", f"WITH {_MAPS}, rest AS (SELECT ix, iy, w - bkg AS w FROM maps), {again('rest')} SELECT ix, iy, {r('maps.bkg')} AS bkg, {r('maps2.rms')} AS rms FROM maps JOIN maps2 USING (ix, iy)")
def d02(spark, d):
    px, s = image(spark, d)
    return out(B.local_background(px, *s, BOX, GRIDSTEP, second_pass=True), "ix", "iy", bkg="bkg", rms="rms")


def comp_sql(x: str, seed: float, merge: float, least: int, z: str = "zmap") -> str:
    """CTEs: blobs{x} (source_id, ix, iy, z, w) of the map `z` by recursive reachability."""
    return (
        f"m{x} AS (SELECT ix * {NY} + iy AS id, ix, iy, z, w FROM {z} WHERE z >= {merge}), e{x} AS (SELECT a.id AS a, b.id AS b FROM m{x} a JOIN m{x} b ON a.ix = b.ix AND b.iy = a.iy + 1 UNION ALL SELECT b.id, a.id FROM m{x} a JOIN m{x} b ON a.ix = b.ix AND b.iy = a.iy + 1 "
        f"UNION ALL SELECT a.id, b.id FROM m{x} a JOIN m{x} b ON a.iy = b.iy AND b.ix = a.ix + 1 UNION ALL SELECT b.id, a.id FROM m{x} a JOIN m{x} b ON a.iy = b.iy AND b.ix = a.ix + 1), "
        f"r{x} AS (SELECT id, id AS root FROM m{x} UNION SELECT e.b, r.root FROM r{x} r JOIN e{x} e ON e.a = r.id), c{x} AS (SELECT id, min(root) AS comp FROM r{x} GROUP BY id), "
        f"g{x} AS (SELECT comp, count(*) AS n, min(CASE WHEN z >= {seed} THEN id END) AS source_id FROM c{x} JOIN m{x} USING (id) GROUP BY comp), "
        f"blobs{x} AS (SELECT g.source_id, m.ix, m.iy, m.z, m.w FROM m{x} m JOIN c{x} c USING (id) JOIN g{x} g USING (comp) WHERE g.n >= {least} AND g.source_id IS NOT NULL)"
    )


ZMAP = f"WITH RECURSIVE {GLOBAL}, zmap AS (SELECT ix, iy, w, (w - med) / rms AS z FROM img, g)"
TRUE, REC = comp_sql("t", 2.5, 1.5, 2), comp_sql("f", 3.0, 2.0, 1)


def zmap(spark, d):
    px, s = image(spark, d)
    m, sd = S.median_mad(px)
    return px.withColumn("z", (F.col("w") - m) / sd), s


def blobs(spark, d, seed=2.5, merge=1.5, least=2):
    z, s = zmap(spark, d)
    return D.find_blobs(z, s, seed, merge, least).join(z.select("ix", "iy", "w"), ["ix", "iy"]), s


@query("d05_components", f"{ZMAP}, {TRUE} SELECT ix, iy, comp AS component FROM mt JOIN ct USING (id)")
def d05(spark, d):
    z, s = zmap(spark, d)
    return D.label_mask(z.where("z >= 1.5").select("ix", "iy"), s, tile=32)


@query("d04_blobs", f"{ZMAP}, {TRUE} SELECT source_id, ix, iy, {r('z')} AS z FROM blobst")
def d04(spark, d):
    return out(blobs(spark, d)[0], "source_id", "ix", "iy", z="z")


@query("d06_compact_sources", f"WITH RECURSIVE {_MAPS}, zmap AS (SELECT ix, iy, w, CASE WHEN w <> 0 AND rms > 0 THEN (w - bkg) / rms ELSE 0 END AS z FROM maps), {comp_sql('t', 2.5, 1.5, 3)} SELECT source_id, ix, iy, {rs(w='w', z='z')} FROM blobst")
def d06(spark, d):
    px, s = image(spark, d)
    return out(D.find_compact(px, s, 2.5, 1.5, 3, BOX, GRIDSTEP), "source_id", "ix", "iy", w="w", z="z")


_NESTED = f"""{ZMAP}, {comp_sql("t", 2.5, 0.8, 4)}, {conv("curv", "img", -ST.LAPLACE)}, dims AS (SELECT count(*) AS ny FROM embeddings), cm AS (SELECT median(w) AS med FROM curv), cn AS (SELECT 1.4826 * median(abs(w - med)) AS rms FROM curv, cm),
inner_map AS (SELECT ix, iy, curv.w / rms AS z, curv.w, source_id AS mother FROM curv JOIN blobst USING (ix, iy), cn WHERE curv.w >= rms), {comp_sql("i", 1, 1, 1, "inner_map")},
held AS (SELECT source_id, ix, iy, mother FROM blobsi JOIN inner_map USING (ix, iy)), one AS (SELECT source_id, min(mother) AS mother_id, count(*) AS n, avg(ix) AS x, avg(iy) AS y FROM held GROUP BY 1),
big AS (SELECT source_id AS mother_id, count(*) AS mn, avg(ix) AS mx, avg(iy) AS my FROM blobst GROUP BY 1), q AS (SELECT *, count(*) OVER (PARTITION BY mother_id) AS sisters FROM one JOIN big USING (mother_id))
SELECT mother_id, source_id, ix, iy FROM held JOIN q USING (source_id) WHERE sisters > 1 OR sqrt(pow(x - mx, 2) + pow(y - my, 2)) > 1 OR n / mn < 0.9"""


@query("d07_nested_sources", _NESTED)
def d07(spark, d):
    px, s = image(spark, d)
    mothers = blobs(spark, d, 2.5, 0.8, 4)[0].select("source_id", "ix", "iy")
    return D.nested_sources(px, mothers, s, 1.0, 1, 1.0, 0.9)


_Z = "CASE WHEN w <> 0 AND rms > 0 THEN (w - bkg) / rms ELSE 0 END AS z"
_ROUNDS = f"""WITH RECURSIVE {_MAPS}, za AS (SELECT ix, iy, w, {_Z} FROM maps), {comp_sql("a", 3.5, 1.8, 2, "za")}, masked AS (SELECT img.ix, img.iy, CASE WHEN source_id IS NULL THEN img.w ELSE 0 END AS w FROM img LEFT JOIN blobsa USING (ix, iy)),
{again("masked")}, zb AS (SELECT ix, iy, w, {_Z} FROM maps2), {comp_sql("b", 3.0, 1.8, 2, "zb")}
SELECT source_id, ix, iy, {r("z")} AS z FROM blobsa UNION ALL SELECT source_id, ix, iy, {r("z")} FROM blobsb"""


@query("d09_iterative_search", _ROUNDS)
def d09(spark, d):
    px, s = image(spark, d)
    return out(D.find_compact(px, s, 3.5, 1.8, 2, BOX, GRIDSTEP, rounds=2), "source_id", "ix", "iy", z="z")


@query(
    "d12_residual_map",
    f"{ZMAP}, {TRUE}, o AS (SELECT x.i AS dx, y.i AS dy FROM range(-1, 2) x(i), range(-1, 2) y(i) WHERE x.i * x.i + y.i * y.i <= 1), dl AS (SELECT DISTINCT source_id, ix + dx AS ix, iy + dy AS iy FROM blobst, o), md AS (SELECT source_id, median(w) AS m FROM blobst GROUP BY 1), f AS (SELECT ix, iy, arg_min(m, source_id) AS m FROM dl JOIN md USING (source_id) GROUP BY 1, 2) SELECT img.ix, img.iy, {r('coalesce(m, w)')} AS w FROM img LEFT JOIN f USING (ix, iy)",
)
def d12(spark, d):
    b, s = blobs(spark, d)
    return _w(D.residual_map(embedding_image(spark, d), b, 3, s))


_PLANES = f"""WITH RECURSIVE {DIMS}, {conv("f1", "img", ST.B3, "mirror")}, {conv("f2", "f1", ST.B3, "mirror", 2)},
planes AS (SELECT 1 AS s, ix, iy, img.w - f1.w AS w FROM img JOIN f1 USING (ix, iy) UNION ALL SELECT 2, ix, iy, f1.w - f2.w FROM f1 JOIN f2 USING (ix, iy)),
pm AS (SELECT s, median(w) AS med FROM planes GROUP BY s), pn AS (SELECT s, first(med) AS med, 1.4826 * median(abs(w - med)) AS rms FROM planes JOIN pm USING (s) GROUP BY s),
top AS (SELECT ix, iy, max((w - med) / rms) AS z, 0 AS w FROM planes JOIN pn USING (s) GROUP BY ix, iy), {comp_sql("w", 3.5, 2.0, 2, "top")} SELECT source_id, ix, iy FROM blobsw"""


@query("d22_wavelet_sources", _PLANES)
def d22(spark, d):
    px, s = image(spark, d)
    return D.wavelet_sources(px, s, range(1, 3), 3.5, 2.0, 2)


_STAT = "count(*) AS n_pix, sum(w) AS flux, max(w) AS s_max, min(w) AS s_min, median(w) AS median, avg(ix) AS x0, avg(iy) AS y0, sum(w * ix) / sum(w) AS sx, sum(w * iy) / sum(w) AS sy, sum(w * ix * ix) / sum(w) - pow(sum(w * ix) / sum(w), 2) AS sxx, sum(w * iy * iy) / sum(w) - pow(sum(w * iy) / sum(w), 2) AS syy, sum(w * ix * iy) / sum(w) - sum(w * ix) / sum(w) * (sum(w * iy) / sum(w)) AS sxy, min(ix) AS ix_min, max(ix) AS ix_max, min(iy) AS iy_min, max(iy) AS iy_max"
_FLOATS = ("flux", "s_max", "s_min", "median", "x0", "y0", "sx", "sy", "sxx", "syy", "sxy")


@query("a35_blob_stats", f"{ZMAP}, {TRUE}, st AS (SELECT source_id, {_STAT} FROM blobst GROUP BY 1) SELECT source_id, n_pix, ix_min, ix_max, iy_min, iy_max, {rs(**{c: c for c in _FLOATS})} FROM st")
def a35(spark, d):
    return out(D.blob_stats(blobs(spark, d)[0]), "source_id", "n_pix", "ix_min", "ix_max", "iy_min", "iy_max", **{c: c for c in _FLOATS})


@query("a36_blob_peaks", f"{ZMAP}, {TRUE} SELECT source_id, arg_max(ix, w) AS px, arg_max(iy, w) AS py, {r('max(w)')} AS peak FROM blobst GROUP BY 1")
def a36(spark, d):
    st = D.blob_stats(blobs(spark, d)[0])
    return st.select("source_id", F.col("peak.ix").alias("px"), F.col("peak.iy").alias("py"), R("s_max").alias("peak"))


@query(
    "a37_image_moments",
    f"{ZMAP}, {TRUE}, c AS (SELECT source_id, sum(w) AS m00, sum(w * ix) / sum(w) AS x, sum(w * iy) / sum(w) AS y FROM blobst GROUP BY 1), n AS (SELECT source_id, sum(w * pow(ix - x, 2)) / pow(first(m00), 2) AS nu20, sum(w * (ix - x) * (iy - y)) / pow(first(m00), 2) AS nu11, sum(w * pow(iy - y, 2)) / pow(first(m00), 2) AS nu02 FROM blobst JOIN c USING (source_id) GROUP BY 1) SELECT source_id, {rs(nu20='nu20', nu11='nu11', nu02='nu02', hu1='nu20 + nu02', hu2='pow(nu20 - nu02, 2) + 4 * nu11 * nu11')} FROM n",
)
def a37(spark, d):
    return out(D.image_moments(blobs(spark, d)[0]), "source_id", nu20="nu20", nu11="nu11", nu02="nu02", hu1="hu1", hu2="hu2")


_RADIAL = ", ".join(f"({n}, {m}, {n - 2 * i}, {(-1) ** i * math.comb(n - i, i) * math.comb(n - 2 * i, (n - m) // 2 - i)})" for n in range(5) for m in range(n % 2, n + 1, 2) for i in range((n - m) // 2 + 1))
_ZERNIKE = f"""{ZMAP}, {TRUE}, box AS (SELECT source_id, (min(ix) + max(ix)) / 2 AS cx, (min(iy) + max(iy)) / 2 AS cy, sqrt(pow(max(ix) - min(ix) + 1, 2) + pow(max(iy) - min(iy) + 1, 2)) / 2 AS half, sum(w) AS total FROM blobst GROUP BY 1),
polar AS (SELECT source_id, w / total AS f, sqrt(pow(ix - cx, 2) + pow(iy - cy, 2)) / half AS rho, atan2(iy - cy, ix - cx) AS phi FROM blobst JOIN box USING (source_id)), radial(n, l, p, c) AS (VALUES {_RADIAL}),
sums AS (SELECT source_id, n, l, sum(c * pow(rho, p) * f * cos(l * phi)) AS re, sum(c * pow(rho, p) * f * sin(l * phi)) AS im FROM polar, radial WHERE rho <= 1 GROUP BY 1, 2, 3) SELECT source_id, n, l, {r("(n + 1) / pi() * sqrt(re * re + im * im)")} AS modulus FROM sums"""


@query("a38_zernike", _ZERNIKE)
def a38(spark, d):
    return out(D.zernike(blobs(spark, d)[0], 4), "source_id", "n", "l", modulus="modulus")


@query("d23_select_sources", f"{ZMAP}, {TRUE}, st AS (SELECT source_id, {_STAT} FROM blobst GROUP BY 1), q AS (SELECT *, least(ix_max - ix_min, iy_max - iy_min) + 1 >= 2 AS good, sqrt((sxx + syy) / 2 + sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy)) AS a, sqrt(greatest((sxx + syy) / 2 - sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy), 0)) AS b FROM st) SELECT source_id, good, good AND n_pix <= 10 AND a <= 3 * greatest(b, 0.3) AS point_like FROM q")
def d23(spark, d):
    return D.selected(D.blob_stats(blobs(spark, d)[0])).select("source_id", "good", "point_like")


@query("d36_tiles", f"WITH x AS (SELECT 24 * i AS x0, least(24 * i + 32, 64) - 1 AS x1 FROM range(10) t(i) WHERE 24 * i < 64), y AS (SELECT 75 * i AS y0, least(75 * i + 100, {NY}) - 1 AS y1 FROM range(1000) t(i) WHERE 75 * i < {NY}), xx AS (SELECT * FROM x WHERE x1 > x0 AND NOT EXISTS (SELECT 1 FROM x q WHERE q.x0 < x.x0 AND q.x1 >= 63)), yy AS (SELECT * FROM y WHERE y1 > y0 AND NOT EXISTS (SELECT 1 FROM y q WHERE q.y0 < y.y0 AND q.y1 >= {NY} - 1)) SELECT x0, x1, y0, y1, row_number() OVER (ORDER BY y0, x0) - 1 AS tile_id FROM xx, yy")
def d36(spark, d):
    return K.tiles(spark, *image(spark, d)[1], 32, 100, 0.75, 0.75)


@query("j10_tile_neighbours", f"WITH x AS (SELECT 32 * i AS x0, 32 * i + 31 AS x1 FROM range(2) t(i)), y AS (SELECT 100 * i AS y0, least(100 * i + 100, {NY}) - 1 AS y1 FROM range(1000) t(i) WHERE 100 * i < {NY}), t AS (SELECT *, row_number() OVER (ORDER BY y0, x0) - 1 AS id FROM x, y) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id <> b.id AND a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1")
def j10(spark, d):
    return K.tile_neighbours(K.tiles(spark, *image(spark, d)[1], 32, 100))


# --- J: joins between sources ---------------------------------------------------------------------------------------------
_BOXES = "SELECT source_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1, count(*) AS n FROM {} GROUP BY 1"
PAIR = f"{ZMAP}, {TRUE}, {REC}"


def pair(spark, d):
    return blobs(spark, d)[0], blobs(spark, d, 3.0, 2.0, 1)[0]


@query("j02_pixels_of_sources", f"{ZMAP}, {TRUE} SELECT (SELECT count(*) FROM img SEMI JOIN blobst USING (ix, iy)) AS inside, (SELECT count(*) FROM img ANTI JOIN blobst USING (ix, iy)) AS outside")
def j02(spark, d):
    b, px = blobs(spark, d)[0].select("ix", "iy"), embedding_image(spark, d)
    i = px.join(b, ["ix", "iy"], "left_semi").agg(F.count("*").alias("inside"))
    return i.crossJoin(px.join(b, ["ix", "iy"], "left_anti").agg(F.count("*").alias("outside")))


@query("j03_nested_in_mother", f"{PAIR}, a AS ({_BOXES.format('blobsf')}), b AS ({_BOXES.format('blobst')}) SELECT a.source_id AS child, min(b.source_id) AS mother FROM a JOIN b ON a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND a.source_id <> b.source_id GROUP BY 1")
def j03(spark, d):
    t, f = pair(spark, d)
    return K.inside_first(K.boxes(f), K.boxes(t))


@query("j04_box_overlap", f"{PAIR}, a AS ({_BOXES.format('blobst')}), b AS ({_BOXES.format('blobst')}) SELECT a.source_id AS a, b.source_id AS b FROM a JOIN b ON a.source_id < b.source_id AND a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1")
def j04(spark, d):
    t = K.boxes(blobs(spark, d)[0])
    return K.overlapping(t, t, 1).where("source_id_a < source_id_b").select(F.col("source_id_a").alias("a"), F.col("source_id_b").alias("b"))


@query("j05_adjacent_sources", f"{PAIR} SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM blobst a JOIN blobst b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.source_id <> b.source_id")
def j05(spark, d):
    t = blobs(spark, d)[0]
    return K.adjacent(t, t)


@query("j06_shared_pixels", f"{PAIR} SELECT a.source_id AS a, b.source_id AS b, count(*) AS n FROM blobst a JOIN blobsf b USING (ix, iy) GROUP BY 1, 2")
def j06(spark, d):
    return K.shared_pixels(*pair(spark, d))


_J7 = f"{PAIR}, na AS (SELECT source_id AS a, count(*) AS na FROM blobst GROUP BY 1), nb AS (SELECT source_id AS b, count(*) AS nb FROM blobsf GROUP BY 1), sh AS (SELECT a.source_id AS a, b.source_id AS b, count(*) AS n FROM blobst a JOIN blobsf b USING (ix, iy) GROUP BY 1, 2), mt7 AS (SELECT a, b, n / na AS f, n / nb AS f_rec FROM sh JOIN na USING (a) JOIN nb USING (b) WHERE n / na >= 0.3 AND n / nb >= 0.3), best AS (SELECT * FROM mt7 QUALIFY row_number() OVER (PARTITION BY a ORDER BY f DESC, b DESC) = 1)"


@query("j07_overlap_match", f"{_J7} SELECT a, b, {rs(f='f', f_rec='f_rec')} FROM best")
def j07(spark, d):
    return out(K.match_by_overlap(*pair(spark, d), 0.3), "a", "b", f="f", f_rec="f_rec")


@query("j08_position_match", f"{PAIR}, a AS (SELECT source_id AS a, avg(ix) AS x, avg(iy) AS y FROM blobst GROUP BY 1), b AS (SELECT source_id AS b, avg(ix) AS x, avg(iy) AS y FROM blobsf GROUP BY 1), m8 AS (SELECT a, b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM a JOIN b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3) SELECT a, b, {r('d')} AS dist FROM m8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b DESC) = 1")
def j08(spark, d):
    t, f = (x.groupBy(F.col("source_id").alias("id")).agg(F.avg("ix").alias("x"), F.avg("iy").alias("y")) for x in pair(spark, d))
    return out(K.match_by_position(t, f, 3.0), "a", "b", dist="dist")


@query("j14_correlate_catalogs", f"{_J7} SELECT na.a, na AS n_pix, (best.b IS NOT NULL)::INT AS found, coalesce(best.b, -1) AS b, {rs(f='coalesce(f, -1)', f_rec='coalesce(f_rec, -1)')}, (SELECT count(*) FROM sh WHERE sh.a = na.a) AS n_candidates FROM na LEFT JOIN best USING (a)")
def j14(spark, d):
    return out(K.correlate(*pair(spark, d), 0.3).withColumn("n_candidates", F.col("n_candidates").cast("long")), "a", "n_pix", "found", "b", "n_candidates", f="f", f_rec="f_rec")


_LAB = f"{IMG}, lab AS (SELECT ix, iy, w, (iy // 50) * 8 + ix // 8 AS label FROM img)"


def labelled(spark, d):
    return embedding_image(spark, d).withColumn("label", F.floor(F.col("iy") / 50) * 8 + F.floor(F.col("ix") / 8))


_J12 = f"{_LAB}, st(dx, dy) AS (VALUES (1, 0), (0, 1), (1, 1), (1, -1)), nb AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS contacts FROM lab a, st JOIN lab b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE a.label <> b.label GROUP BY 1, 2 HAVING count(*) >= 2)"


@query("j12_superpixel_neighbours", f"WITH {_J12} SELECT * FROM nb")
def j12(spark, d):
    return K.neighbours_of_labels(labelled(spark, d))


@query("j13_second_neighbours", f"WITH {_J12}, u AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb) SELECT DISTINCT x.a, y.b FROM u x JOIN u y ON x.b = y.a WHERE x.a <> y.b AND (x.a, y.b) NOT IN (SELECT a, b FROM u)")
def j13(spark, d):
    from ..operators.graph import second_neighbours

    return second_neighbours(K.neighbours_of_labels(labelled(spark, d)))


@query("o01_merge_sources", f"{PAIR}, u AS (SELECT ix, iy, w FROM blobst UNION ALL SELECT ix, iy, w FROM blobsf), p AS (SELECT ix, iy, count(*) AS n, sum(w) AS w FROM u GROUP BY 1, 2) SELECT count(*) AS n_pix, {r('sum(w)')} AS flux, sum((n > 1)::INT)::BIGINT AS n_shared FROM p")
def o01(spark, d):
    t, f = pair(spark, d)
    both = t.select(F.lit(1).alias("source_id"), "ix", "iy", "w").unionByName(f.select(F.lit(2).alias("source_id"), "ix", "iy", "w"))
    edges = spark.createDataFrame([(1, 2)], "a int, b int")
    shared = t.join(f, ["ix", "iy"]).agg(F.count("*").alias("n_shared"))
    m = K.merge_pixels(both, edges, sum_shared=True).agg(F.count("*").alias("n_pix"), F.sum("w").alias("flux"))
    return out(m.crossJoin(shared), "n_pix", "n_shared", flux="flux")


@query("d34_merge_across_tiles", f"{ZMAP}, {comp_sql('t', 1.5, 1.5, 1)} SELECT count(DISTINCT source_id) AS n_sources, count(*) AS n_pix, max(n) AS largest FROM (SELECT source_id, count(*) OVER (PARTITION BY source_id) AS n FROM blobst)")
def d34(spark, d):
    z, s = zmap(spark, d)
    t = K.tiles(spark, *s, 32, 100)
    p = z.where("z >= 1.5").withColumn("tile_id", F.floor(F.col("iy") / 100) * 2 + F.floor(F.col("ix") / 32))
    # Each tile on its own: pixels of a tile are set apart from the others by a gap, then labelled.
    gap = p.select((F.col("ix") + F.floor(F.col("ix") / 32)).alias("ix"), (F.col("iy") + F.floor(F.col("iy") / 100)).alias("iy"), F.col("ix").alias("x"), F.col("iy").alias("y"), "tile_id", "w")
    lab = D.label_mask(gap.select("ix", "iy"), (s[0] + s[0] // 32, s[1] + s[1] // 100)).join(gap, ["ix", "iy"]).select("tile_id", F.col("component").alias("source_id"), F.col("x").alias("ix"), F.col("y").alias("iy"), "w")
    from ..operators.graph import components

    near = K.adjacent(lab, lab)
    sides = lab.select(F.col("source_id").alias("s"), "ix", "iy")
    four = sides.select(F.col("s").alias("a"), F.explode(F.array(F.struct((F.col("ix") + 1).alias("ix"), F.col("iy").alias("iy")), F.struct(F.col("ix").alias("ix"), (F.col("iy") + 1).alias("iy")))).alias("p")).select("a", "p.ix", "p.iy").join(sides.withColumnRenamed("s", "b"), ["ix", "iy"]).where("a <> b").select("a", "b")
    comp = components(near.join(four, ["a", "b"], "left_semi").union(four))
    m = lab.join(comp.withColumnRenamed("id", "source_id"), "source_id", "left").groupBy(F.coalesce("component", "source_id").alias("s")).agg(F.count("*").alias("n"))
    return m.agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_pix"), F.max("n").alias("largest"))


_TOUCHING = f"""{ZMAP}, {comp_sql("t", 1.5, 1.5, 1)}, p AS (SELECT *, ix // 32 AS tx, iy // 100 AS ty FROM blobst),
box AS (SELECT tx, ty, source_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM p GROUP BY ALL),
tiles AS (SELECT a.i AS tx, b.j AS ty, 32 * a.i AS tx0, 32 * a.i + 31 AS tx1, 100 * b.j AS ty0, least(100 * b.j + 100, {NY}) - 1 AS ty1 FROM range(2) a(i), range(1000) b(j) WHERE 100 * b.j + 1 < {NY}),
edge AS (SELECT DISTINCT box.tx, box.ty, source_id FROM box JOIN tiles n ON abs(n.tx - box.tx) <= 1 AND abs(n.ty - box.ty) <= 1 AND (n.tx, n.ty) <> (box.tx, box.ty) WHERE x0 - 1 <= tx1 AND tx0 <= x1 + 1 AND y0 - 1 <= ty1 AND ty0 <= y1 + 1),
rim AS (SELECT p.source_id, ix, iy FROM p JOIN edge USING (tx, ty, source_id)),
near AS (SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM rim a, range(-1, 2) x(dx), range(-1, 2) y(dy) JOIN rim b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE a.source_id <> b.source_id),
walk AS (SELECT a AS id, a AS root FROM near UNION SELECT near.b, walk.root FROM walk JOIN near ON near.a = walk.id), comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
SELECT coalesce(root, source_id) AS source_id, count(*) AS n_pix FROM blobst LEFT JOIN comp ON id = source_id GROUP BY 1"""


@query("d33_merge_adjacent", _TOUCHING)
def d33(spark, d):
    b, s = blobs(spark, d, 1.5, 1.5, 1)
    m = K.merge_across_tiles(b.withColumn("tile_id", F.floor(F.col("iy") / 100) * 2 + F.floor(F.col("ix") / 32)), K.tiles(spark, *s, 32, 100))
    return m.groupBy("source_id").agg(F.count("*").alias("n_pix"))


@query("o10_largest_component", f"{ZMAP}, {TRUE}, n AS (SELECT iy // 100 AS band, source_id, count(*) AS n FROM blobst GROUP BY 1, 2) SELECT band, source_id, n FROM n QUALIFY row_number() OVER (PARTITION BY band ORDER BY n DESC, source_id DESC) = 1")
def o10(spark, d):
    b = blobs(spark, d)[0].withColumn("band", F.floor(F.col("iy") / 100))
    return K.largest_component(b, "band").groupBy("band", "source_id").agg(F.count("*").alias("n"))


@query("p25_blob_images", f"{ZMAP}, {TRUE}, st AS (SELECT source_id, median(w) AS md, avg(w) AS mu FROM blobst GROUP BY 1) SELECT source_id, ix, iy, 1 AS binary, {rs(flux='w', significance='z', mean_flux='mu', pull='w - md')} FROM blobst JOIN st USING (source_id)")
def p25(spark, d):
    b = blobs(spark, d)[0]
    st = b.groupBy("source_id").agg(F.percentile("w", 0.5).alias("md"), F.avg("w").alias("mu"))
    return out(b.join(st, "source_id").withColumn("binary", F.lit(1)), "source_id", "ix", "iy", "binary", flux="w", significance="z", mean_flux="mu", pull=F.col("w") - F.col("md"))


@query("a40_median_filter", f"{ZMAP}, {TRUE} SELECT source_id, {r('avg(w)')} AS mean FROM blobst GROUP BY 1 HAVING avg(w) > 2.0 * 0.125 + (SELECT med FROM g)")
def a40(spark, d):
    m, _ = S.median_mad(embedding_image(spark, d))
    return out(blobs(spark, d)[0].groupBy("source_id").agg(F.avg("w").alias("mean")).where(F.col("mean") > 2.0 * 0.125 + m), "source_id", mean="mean")


@query("p26_segmented_image", f"WITH {TILED}, m AS (SELECT tx, ty, avg(w) AS mu FROM t GROUP BY 1, 2) SELECT ix, iy, {r('mu')} AS w FROM t JOIN m USING (tx, ty)")
def p26(spark, d):
    t = tiled(embedding_image(spark, d))
    return out(t.join(t.groupBy("tx", "ty").agg(F.avg("w").alias("mu")), ["tx", "ty"]), "ix", "iy", w="mu")


