"""Queries of the statistics (A), image math (P) and set (O) operators."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions import columns as C
from ..operators import stats as S
from ..sources.image import embedding_image, from_matrix, grid_image, table, tile, to_rows
from .registry import query

R = C.rounded
#: SQL of the test images.
IMG = "img AS (SELECT vec_id AS iy, unnest(range(64)) AS ix, unnest(embedding)::DOUBLE AS w FROM embeddings)"
GRID = "grid AS (SELECT l_partkey % 128 AS ix, l_suppkey % 100 AS iy, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
GLOBAL = f"{IMG}, m AS (SELECT median(w) AS med FROM img), g AS (SELECT med, 1.4826 * median(abs(w - med)) AS rms FROM img, m GROUP BY med)"


def r(x: str, d: int = 6) -> str:
    return f"round({x}, {d}) + 0.0"


def rs(**cols: str) -> str:
    return ", ".join(f"{r(v)} AS {k}" for k, v in cols.items())


def tiled(px, size_x=16, size_y=50):
    return px.withColumn("tx", F.floor(F.col("ix") / size_x)).withColumn("ty", F.floor(F.col("iy") / size_y))


TILED = f"{IMG}, t AS (SELECT *, ix // 16 AS tx, iy // 50 AS ty FROM img)"


def out(df, *keys, **cols):
    """keys as they are, other columns rounded."""
    return df.select(*keys, *[R(v).alias(k) for k, v in cols.items()])


# --- P: scalar image math -------------------------------------------------------------------------------------------------
@query("p01_add", f"WITH {IMG} SELECT a.ix, a.iy, {r('a.w + 0.5 * b.w')} AS w FROM img a JOIN img b ON b.iy = a.iy AND b.ix = 63 - a.ix")
def p01(spark, d):
    px = embedding_image(spark, d)
    other = px.select((63 - F.col("ix")).alias("ix"), "iy", F.col("w").alias("w2"))
    return out(px.join(other, ["ix", "iy"]), "ix", "iy", w=F.col("w") + 0.5 * F.col("w2"))


@query("p02_scale", f"WITH {IMG} SELECT ix, iy, {r('w * 2.5')} AS w FROM img")
def p02(spark, d):
    return out(embedding_image(spark, d), "ix", "iy", w=F.col("w") * 2.5)


def _ranged(px):
    r1 = px.where(C.valid("w")).agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return px.crossJoin(F.broadcast(r1))


@query("p03_normalize", f"WITH {IMG}, b AS (SELECT min(w) lo, max(w) hi FROM img WHERE w <> 0) SELECT ix, iy, {r('1 + 255.0 * (w - lo) / (hi - lo)')} AS lin, {r('1 + log10(1 + 255.0 * (w - lo) / (hi - lo)) / log10(256.0) * 255.0')} AS lg FROM img, b")
def p03(spark, d):
    w, lo, hi = F.col("w"), F.col("lo"), F.col("hi")
    return out(_ranged(embedding_image(spark, d)), "ix", "iy", lin=C.linear_norm(w, lo, hi, 1.0, 256.0), lg=C.log_norm(w, lo, hi, 1.0, 256.0))


@query("p04_sigmoid", f"WITH {IMG}, b AS (SELECT min(w) lo, max(w) hi FROM img), s AS (SELECT ix, iy, 1 / (1 + exp(-((w - lo) / (hi - lo) - 0.5) / 0.1)) AS v FROM img, b), c AS (SELECT min(v) a, max(v) z FROM s) SELECT ix, iy, {r('1 + 255.0 * (v - a) / (z - a)')} AS w FROM s, c")
def p04(spark, d):
    px = _ranged(embedding_image(spark, d))
    v = px.select("ix", "iy", C.sigmoid(C.linear_norm(F.col("w"), F.col("lo"), F.col("hi"), 0.0, 1.0), 0.5, 0.1).alias("v"))
    b = v.agg(F.min("v").alias("a"), F.max("v").alias("z"))
    return out(v.crossJoin(F.broadcast(b)), "ix", "iy", w=C.linear_norm(F.col("v"), F.col("a"), F.col("z"), 1.0, 256.0))


@query("p05_log_normalize", f"WITH {GRID}, b AS (SELECT min(w) lo, max(w) hi FROM grid) SELECT ix, iy, {r('log10(1 + 255.0 * (w - lo) / (hi - lo)) / log10(256.0) * 100')} AS w FROM grid, b")
def p05(spark, d):
    px = _ranged(grid_image(spark, d))
    return out(px, "ix", "iy", w=C.log_norm(F.col("w"), F.col("lo"), F.col("hi"), 0.0, 100.0))


def significance(px, bkg: float, rms: float):
    z = F.when((F.col("w") != 0) & F.lit(rms > 0), (F.col("w") - bkg) / (rms or 1.0)).otherwise(0.0)
    return px.withColumn("z", z)


@query("p06_significance", f"WITH {GLOBAL} SELECT ix, iy, {r('(w - med) / rms')} AS z FROM img, g")
def p06(spark, d):
    px = embedding_image(spark, d)
    return out(significance(px, *S.median_mad(px)), "ix", "iy", z="z")


@query("p07_binarize", f"WITH {GLOBAL} SELECT ix, iy, CASE WHEN (w - med) / rms >= 2.5 THEN 1 ELSE 0 END AS w FROM img, g")
def p07(spark, d):
    px = embedding_image(spark, d)
    return significance(px, *S.median_mad(px)).select("ix", "iy", F.when(F.col("z") >= 2.5, 1).otherwise(0).alias("w"))


_MASK = f"{IMG}, k AS (SELECT ix, iy FROM img WHERE abs(w) >= 0.25)"


def _mask(px):
    return px.where(F.abs("w") >= 0.25).select("ix", "iy")


@query("p08_mask", f"WITH {_MASK} SELECT img.ix, img.iy, {r('w')} AS w, 1 AS bin FROM img JOIN k USING (ix, iy)")
def p08(spark, d):
    px = embedding_image(spark, d)
    return out(px.join(_mask(px), ["ix", "iy"], "left_semi"), "ix", "iy", w="w").withColumn("bin", F.lit(1))


@query("p09_source_mask", f"WITH {_MASK} SELECT img.ix, img.iy, CASE WHEN k.ix IS NULL THEN {r('w')} ELSE 0.0 END AS inverted FROM img LEFT JOIN k USING (ix, iy)")
def p09(spark, d):
    px = embedding_image(spark, d)
    k = _mask(px).withColumn("hit", F.lit(True))
    return out(px.join(k, ["ix", "iy"], "left"), "ix", "iy", inverted=F.when(F.col("hit").isNull(), F.col("w")).otherwise(0.0))


@query("p10_mask_sources", f"WITH {_MASK}, x AS (SELECT CASE WHEN k.ix IS NULL THEN w ELSE 0 END AS w FROM img LEFT JOIN k USING (ix, iy)) SELECT count(*) AS n, {rs(mean='avg(w)', rms='stddev_samp(w)')} FROM x")
def p10(spark, d):
    px = embedding_image(spark, d)
    x = px.join(_mask(px).withColumn("hit", F.lit(True)), ["ix", "iy"], "left").withColumn("w", F.when(F.col("hit"), 0.0).otherwise(F.col("w")))
    return out(x.agg(F.count("w").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("rms")), "n", mean="mean", rms="rms")


@query(
    "p11_pixel_to_world",
    f"WITH {IMG}, u AS (SELECT ix, iy, radians((ix + 1 - 32.0) * -0.01) AS xi, radians((iy + 1 - 250.0) * 0.01) AS eta FROM img), v AS (SELECT ix, iy, atan2(xi, cos(radians(-30.0)) - eta * sin(radians(-30.0))) AS ra, cos(radians(-30.0)) - eta * sin(radians(-30.0)) AS den, eta FROM u) "
    f"SELECT ix, iy, {r('degrees(ra) + 180.0')} AS ra, {r('degrees(atan((sin(radians(-30.0)) + eta * cos(radians(-30.0))) * cos(ra) / den))')} AS dec FROM v",
)
def p11(spark, d):
    ra, dec = C.tan_world(F.col("ix"), F.col("iy"), 32.0, 250.0, 180.0, -30.0, -0.01, 0.01)
    return out(embedding_image(spark, d), "ix", "iy", ra=ra, dec=dec)


#: Unit vectors of the pixels (tangent plane about 180, -30 degrees) and their parts along the galactic axes.
_GALACTIC = f"""WITH {IMG}, t AS (SELECT ix, iy, radians((ix + 1 - 32) * -0.01) AS xi, radians((iy + 1 - 250) * 0.01) AS eta FROM img),
c AS (SELECT radians(180.0) AS a0, radians(-30.0) AS d0, radians(192.85948) AS ap, radians(27.12825) AS dp, radians(122.93192) AS lp),
v AS (SELECT ix, iy, ap, dp, lp, cos(d0) * cos(a0) - xi * sin(a0) - eta * sin(d0) * cos(a0) AS x, cos(d0) * sin(a0) + xi * cos(a0) - eta * sin(d0) * sin(a0) AS y, sin(d0) + eta * cos(d0) AS z, sqrt(1 + xi * xi + eta * eta) AS len FROM t, c),
g AS (SELECT ix, iy, degrees(lp - atan2(y * cos(ap) - x * sin(ap), z * cos(dp) - sin(dp) * (x * cos(ap) + y * sin(ap)))) AS lon, degrees(asin((z * sin(dp) + cos(dp) * (x * cos(ap) + y * sin(ap))) / len)) AS lat FROM v)
SELECT ix, iy, {r('(lon % 360 + 360) % 360')} AS l, {r('lat')} AS b FROM g"""


@query("p12_to_galactic", _GALACTIC)
def p12(spark, d):
    ra, dec = C.tan_world(F.col("ix"), F.col("iy"), 32.0, 250.0, 180.0, -30.0, -0.01, 0.01)
    lon, lat = C.galactic(ra, dec)
    return out(embedding_image(spark, d), "ix", "iy", l=lon, b=lat)


_BEAM = "SELECT s_suppkey AS id, 5 + s_suppkey % 7 AS bmaj, 3 + s_suppkey % 3 AS bmin FROM supplier"


def _beams(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (5 + F.col("s_suppkey") % 7).alias("bmaj"), (3 + F.col("s_suppkey") % 3).alias("bmin"))


@query("p13_beam_area", f"SELECT id, {r('pi() * bmaj * bmin / (4 * ln(2.0))')} AS area FROM ({_BEAM})")
def p13(spark, d):
    return out(_beams(spark, d), "id", area=C.beam_area(F.col("bmaj"), F.col("bmin")))


@query("p14_beam_pixels", f"SELECT id, {r('pi() * bmaj * bmin / (4 * ln(2.0)) / 2.0')} AS area, ceil(sqrt(bmaj * bmin) / sqrt(2.0))::BIGINT AS width FROM ({_BEAM})")
def p14(spark, d):
    a, b = F.col("bmaj"), F.col("bmin")
    return out(_beams(spark, d), "id", area=C.beam_area_pixels(a, b, F.lit(-1.0), F.lit(2.0))).join(_beams(spark, d).select("id", C.beam_width_pixels(a, b, F.lit(-1.0), F.lit(2.0)).cast("long").alias("width")), "id")


@query("p15_linear_transforms", f"WITH {IMG}, b AS (SELECT min(w) lo, max(w) hi, avg(w) mu, stddev_samp(w) s FROM img) SELECT {rs(mean='1 + 255 * (mu - lo) / (hi - lo)', rms='255 * s / (hi - lo)', diff2='(255 / (hi - lo)) * (255 / (hi - lo)) * s * s')} FROM b")
def p15(spark, d):
    b = embedding_image(spark, d).agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.avg("w").alias("mu"), F.stddev_samp("w").alias("s"))
    k = 255 / (F.col("hi") - F.col("lo"))
    return out(b, mean=C.linear_norm(F.col("mu"), F.col("lo"), F.col("hi"), 1.0, 256.0), rms=k * F.col("s"), diff2=k * k * F.col("s") * F.col("s"))


@query("p16_vector_normalize", f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, unnest(range(64)) AS pos, {r('(unnest(e) - list_min(e)) / (list_max(e) - list_min(e))')} AS v FROM e")
def p16(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return out(e.select("vec_id", F.posexplode(C.min_max_array(F.col("e"), 0.0, 1.0)).alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")), "vec_id", "pos", v="v")


#: The complementary error function as Simpson's sum of its integral, 6 wide in steps of 0.003.
_ERFC = "2 / sqrt(pi()) * 0.001 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(k / sqrt(2) + i * 0.003, 2)))"


@query("p17_contour_scales", f"SELECT k::DOUBLE AS n, {r(f'sqrt(-2 * ln({_ERFC}))')} AS sigma, {r('sqrt(2 * k * ln(10))')} AS cl FROM range(1, 6) a(k), range(0, 2001) b(i) GROUP BY k")
def p17(spark, d):
    n = spark.range(1, 6).select(F.col("id").cast("double").alias("n"))
    return out(n, "n", sigma=C.sigma_contour_scale(F.col("n")), cl=C.cl_contour_scale(1 - F.pow(F.lit(0.1), F.col("n"))))


_COV = f"{IMG}, c AS (SELECT iy // 50 AS band, sum(w * w * ix * ix) / sum(w * w) - pow(sum(w * w * ix) / sum(w * w), 2) AS sxx, sum(w * w * iy * iy) / sum(w * w) - pow(sum(w * w * iy) / sum(w * w), 2) AS syy, sum(w * w * ix * iy) / sum(w * w) - sum(w * w * ix) / sum(w * w) * (sum(w * w * iy) / sum(w * w)) AS sxy FROM img GROUP BY 1)"


@query("p18_fit_ellipse", f"WITH {_COV} SELECT band, {r('sqrt((sxx + syy) / 2 + sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy))', 5)} AS a, {r('sqrt((sxx + syy) / 2 - sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy))', 5)} AS b, {r('degrees(atan2(2 * sxy, sxx - syy) / 2)', 4)} AS theta FROM c")
def p18(spark, d):
    px = embedding_image(spark, d).withColumn("band", F.floor(F.col("iy") / 50)).withColumn("q", F.col("w") * F.col("w"))
    q, x, y = F.col("q"), F.col("ix"), F.col("iy")
    m = lambda e: F.sum(q * e) / F.sum(q)
    c = px.groupBy("band").agg((m(x * x) - m(x) * m(x)).alias("sxx"), (m(y * y) - m(y) * m(y)).alias("syy"), (m(x * y) - m(x) * m(y)).alias("sxy"))
    a, b, t = C.ellipse_of(F.col("sxx"), F.col("syy"), F.col("sxy"))
    return c.select("band", R(a, 5).alias("a"), R(b, 5).alias("b"), R(t, 4).alias("theta"))


@query("p19_mirror_index", "SELECT i, CASE WHEN i < 0 THEN -i WHEN i >= 64 THEN 126 - i ELSE i END AS m, CASE WHEN i BETWEEN 0 AND 50 THEN floor(9 * i / 50.0)::BIGINT ELSE -1 END AS bin FROM range(-5, 70) t(i)")
def p19(spark, d):
    i = F.col("id")
    return spark.range(-5, 70).select(i.alias("i"), C.mirror_index(i, F.lit(64)).alias("m"), C.find_bin(i, 0.0, 50.0, 10).alias("bin"))


@query("p20_linspace", f"SELECT i, {r('-1 + i * 0.25')} AS v FROM range(9) t(i)")
def p20(spark, d):
    return out(spark.range(1).select(F.posexplode(C.linspace(-1.0, 1.0, 9)).alias("i", "v")).withColumn("i", F.col("i").cast("long")), "i", v="v")


@query("p21_job_ids", "SELECT n_nationkey, 36 AS size FROM nation")
def p21(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.expr("uuid()").alias("u")).select("n_nationkey", F.length("u").alias("size"))


@query("p22_strings", "SELECT n_nationkey, replace(n_name, 'A', 'xx') AS replaced, split_part(n_name, 'A', 1) AS lft, CASE WHEN contains(n_name, 'A') THEN array_to_string(split(n_name, 'A')[2:], 'A') ELSE n_name END AS rgt, 'S' || n_nationkey AS source FROM nation")
def p22(spark, d):
    n = F.col("n_name")
    right = F.when(F.contains(n, F.lit("A")), F.array_join(F.slice(F.split(n, "A"), 2, 1000), "A")).otherwise(n)
    return table(spark, d, "nation").select("n_nationkey", F.replace(n, F.lit("A"), F.lit("xx")).alias("replaced"), F.substring_index(n, "A", 1).alias("lft"), right.alias("rgt"), F.format_string("S%d", F.col("n_nationkey")).alias("source"))


@query("p23_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.none') IS NULL AS missing FROM events")
def p23(spark, d):
    e = table(spark, d, "events").withColumn("j", F.from_json("props", "k long"))
    return e.select("event_id", "j.k", F.get_json_object(F.to_json("j"), "$.none").isNull().alias("missing"))


@query("p24_gauss2d", f"WITH {IMG}, k AS (SELECT cos(0.5)*cos(0.5)/18 + sin(0.5)*sin(0.5)/50 AS a, sin(1.0)/36 - sin(1.0)/100 AS b, sin(0.5)*sin(0.5)/18 + cos(0.5)*cos(0.5)/50 AS c) SELECT ix, iy, {r('2 * exp(-(a*(ix-32)*(ix-32) + 2*b*(ix-32)*(iy-100) + c*(iy-100)*(iy-100)))')} AS v FROM img, k")
def p24(spark, d):
    return out(embedding_image(spark, d), "ix", "iy", v=C.gauss2d(F.col("ix"), F.col("iy"), 2.0, 32.0, 100.0, 3.0, 5.0, F.lit(0.5)))


@query("p27_complex_contour", f"WITH {_MASK}, c AS (SELECT iy, avg(ix) AS x0 FROM k GROUP BY iy) SELECT k.ix, k.iy, {r('k.ix - x0')} AS re, {r('k.iy - 0.0')} AS im FROM k JOIN c USING (iy)")
def p27(spark, d):
    k = _mask(embedding_image(spark, d))
    return out(k.join(k.groupBy("iy").agg(F.avg("ix").alias("x0")), "iy"), "ix", "iy", re=F.col("ix") - F.col("x0"), im=F.col("iy") - 0.0)


# --- A: statistics --------------------------------------------------------------------------------------------------------
_M = "sum(pow(w - mu, 2)) AS m2, sum(pow(w - mu, 3)) AS m3, sum(pow(w - mu, 4)) AS m4"


def _moments_out(df, *keys):
    return df.select(*keys, "n", *[R(c).alias(c) for c in ("mean", "w_min", "w_max", "m2", "m3", "m4")])


_SQLM = f"count(*) AS n, {rs(mean='first(mu)', w_min='min(w)', w_max='max(w)', m2='sum(pow(w - mu, 2))', m3='sum(pow(w - mu, 3))', m4='sum(pow(w - mu, 4))')}"


@query("a01_moments", f"WITH {IMG}, c AS (SELECT avg(w) AS mu FROM img) SELECT {_SQLM} FROM img, c")
def a01(spark, d):
    return _moments_out(embedding_image(spark, d).agg(*S.moments()))


@query("a02_merged_moments", f"WITH {IMG}, c AS (SELECT avg(w) AS mu FROM img) SELECT {_SQLM} FROM img, c")
def a02(spark, d):
    return _moments_out(S.merged_moments(tiled(embedding_image(spark, d)).groupBy("tx", "ty").agg(*S.moments())))


@query("a03_positive_moments", f"WITH {IMG}, p AS (SELECT w FROM img WHERE w > 0), c AS (SELECT avg(w) AS mu FROM p) SELECT {_SQLM} FROM p, c")
def a03(spark, d):
    return _moments_out(embedding_image(spark, d).where("w > 0").agg(*S.moments()))


@query("a04_mean_rms", f"SELECT event_type, {rs(mean='avg(value)', rms='stddev_samp(value)')} FROM events GROUP BY event_type")
def a04(spark, d):
    return out(table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("rms")), "event_type", mean="mean", rms="rms")


@query("a05_median", f"WITH {IMG} SELECT {r('median(w)', 9)} AS median FROM img")
def a05(spark, d):
    return spark.range(1).select(R(F.lit(S.quantile(embedding_image(spark, d), "w", [0.5])[0]), 9).alias("median"))


@query("a06_grouped_median", f"SELECT user_id, {r('median(value)')} AS median FROM events GROUP BY user_id")
def a06(spark, d):
    return out(table(spark, d, "events").groupBy("user_id").agg(F.percentile("value", 0.5).alias("median")), "user_id", median="median")


@query("a07_range_median", f"WITH {IMG} SELECT iy, {r('median(w)')} AS median FROM img WHERE ix BETWEEN 10 AND 40 GROUP BY iy")
def a07(spark, d):
    return out(tile(embedding_image(spark, d), 10, 40, 0, 10**9).groupBy("iy").agg(F.percentile("w", 0.5).alias("median")), "iy", median="median")


@query("a09_mad", f"WITH {GLOBAL} SELECT {r('med', 9)} AS median, {r('rms', 9)} AS rms FROM g")
def a09(spark, d):
    m, s = S.median_mad(embedding_image(spark, d))
    return spark.range(1).select(R(F.lit(m), 9).alias("median"), R(F.lit(s), 9).alias("rms"))


@query("a10_grouped_mad", f"WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_type, count(*) AS n, {rs(median='first(med)', rms='1.4826 * median(abs(value - med))')} FROM events JOIN m USING (event_type) GROUP BY 1")
def a10(spark, d):
    return out(S.grouped_median_mad(table(spark, d, "events"), ["event_type"], "value"), "event_type", "n", median="median", rms="rms")


@query("a11_quartiles", f"WITH {IMG} SELECT {rs(q1='quantile_cont(w, 0.25)', q2='quantile_cont(w, 0.5)', q3='quantile_cont(w, 0.75)')} FROM img")
def a11(spark, d):
    q = S.quantile(embedding_image(spark, d), "w", [0.25, 0.5, 0.75])
    return spark.range(1).select(*[R(F.lit(v)).alias(f"q{i + 1}") for i, v in enumerate(q)])


@query("a12_box_stats", f"SELECT event_type, {rs(q1='quantile_cont(value, 0.25)', median='quantile_cont(value, 0.5)', q3='quantile_cont(value, 0.75)', lo='min(value)', hi='max(value)')} FROM events GROUP BY 1")
def a12(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return out(g, "event_type", q1=F.col("q")[0], median=F.col("q")[1], q3=F.col("q")[2], lo="lo", hi="hi")


_S0 = "SELECT tx, ty, count(w) AS n, avg(w) AS mean, median(w) AS med, stddev_samp(w) AS rms FROM t GROUP BY tx, ty"


def _clip_sql(table_sql: str, keys: str, rounds: int, k: float, tol: float, w: str) -> str:
    """Clipping unrolled: one CTE a round; a group that has stopped keeps its row."""
    on = " AND ".join(f"v.{c} = s.{c}" for c in keys.split(", "))
    names = ", ".join(f"s.{c}" for c in keys.split(", "))
    sql = f"{table_sql}, s0 AS (SELECT {keys}, count({w}) AS n, avg({w}) AS mean, median({w}) AS med, stddev_samp({w}) AS rms, false AS done FROM v GROUP BY {keys})"
    for i in range(rounds):
        sql += (
            f", c{i} AS (SELECT {names}, count({w}) AS n, avg({w}) AS mean, median({w}) AS med, stddev_samp({w}) AS rms FROM v JOIN s{i} s ON {on} WHERE NOT s.done AND abs({w} - s.med) < {k} * s.rms GROUP BY {names})"
            f", s{i + 1} AS (SELECT {names}, CASE WHEN c.n IS NULL OR s.done THEN s.n ELSE c.n END AS n, CASE WHEN c.n IS NULL OR s.done THEN s.mean ELSE c.mean END AS mean, CASE WHEN c.n IS NULL OR s.done THEN s.med ELSE c.med END AS med, "
            f"CASE WHEN c.n IS NULL OR s.done THEN s.rms ELSE c.rms END AS rms, NOT coalesce(NOT (c.n IS NULL OR s.done) AND abs(c.rms - s.rms) / s.rms > {tol}, false) AS done FROM s{i} s LEFT JOIN c{i} c USING ({keys}))"
        )
    return sql + f" SELECT {keys}, n, {rs(mean='mean', median='med', rms='rms')} FROM s{rounds}"


@query("a13_clipped_step", _clip_sql(f"WITH {IMG}, v AS (SELECT 0 AS k, w FROM img)", "k", 1, 3.0, 0.0, "w"))
def a13(spark, d):
    return out(S.clipped(embedding_image(spark, d).withColumn("k", F.lit(0)), ["k"], rounds=1, tol=0.0), "k", "n", mean="mean", median="median", rms="rms")


@query("a14_clipped", _clip_sql("WITH v AS (SELECT event_type, value FROM events)", "event_type", 5, 1.5, 0.01, "value"))
def a14(spark, d):
    return out(S.clipped(table(spark, d, "events"), ["event_type"], "value", k=1.5, rounds=5, tol=0.01), "event_type", "n", mean="mean", median="median", rms="rms")


@query("a15_clipped_pair", _clip_sql(f"WITH {IMG}, v AS (SELECT iy // 100 AS band, w FROM img)", "band", 4, 2.0, 0.001, "w"))
def a15(spark, d):
    px = embedding_image(spark, d).withColumn("band", F.floor(F.col("iy") / 100))
    return out(S.clipped(px, ["band"], k=2.0, rounds=4, tol=0.001), "band", "n", mean="mean", median="median", rms="rms")


def biweight_sql(values: str, *keys: str) -> str:
    """Tukey's biweight of x by keys of the query `values`, step by step until it settles, ten steps at most."""
    k = ", ".join(keys)
    return f"""WITH RECURSIVE v AS ({values}), m AS (SELECT {k}, count(*) AS n, median(x) AS loc FROM v GROUP BY {k}),
first_step AS (SELECT {k}, n, loc, 1.4826 * median(abs(x - loc)) AS scale FROM v JOIN m USING ({k}) GROUP BY {k}, n, loc),
steps AS (SELECT 0 AS i, {k}, n, loc, scale, scale > 0 AS moving FROM first_step UNION ALL
SELECT i + 1, {k}, n, new_loc, new_scale, abs(new_scale - scale) / scale > 1e-4 OR abs(new_loc - loc) > 1e-4 * new_scale FROM
(SELECT i, {k}, n, loc, scale, loc + sum(t * g * g) / sum(g * g) AS new_loc, CASE WHEN abs(sum(g * (5 * g - 4))) > 1 THEN sqrt(n * sum(t * t * pow(g, 4))) / abs(sum(g * (5 * g - 4))) ELSE scale END AS new_scale FROM
(SELECT i, {k}, n, loc, scale, x - loc AS t, 1 - pow((x - loc) / (6 * scale), 2) AS g FROM steps JOIN v USING ({k}) WHERE moving AND i < 10) WHERE g >= 0 GROUP BY i, {k}, n, loc, scale))
SELECT {k}, n, {rs(location="loc", scale="scale")} FROM steps QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY i DESC) = 1"""


@query("a16_biweight", biweight_sql("SELECT event_type, value AS x FROM events", "event_type"))
def a16(spark, d):
    return out(S.biweight(table(spark, d, "events"), ["event_type"], "value"), "event_type", "n", location="location", scale="scale")


@query("a17_mahalanobis", f"WITH {IMG}, p AS (SELECT a.iy, a.w AS x, b.w AS y FROM img a JOIN img b ON a.iy = b.iy WHERE a.ix = 0 AND b.ix = 1), c AS (SELECT avg(x) mx, avg(y) my, var_samp(x) sxx, var_samp(y) syy, covar_samp(x, y) sxy FROM p) SELECT iy, {r('sqrt((syy * pow(x - mx, 2) - 2 * sxy * (x - mx) * (y - my) + sxx * pow(y - my, 2)) / (sxx * syy - sxy * sxy))')} AS dist FROM p, c")
def a17(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("iy"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    c = e.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    v = F.expr("sqrt((syy * power(x - mx, 2) - 2 * sxy * (x - mx) * (y - my) + sxx * power(y - my, 2)) / (sxx * syy - sxy * sxy))")
    return out(e.crossJoin(F.broadcast(c)), "iy", dist=v)


_RANKS = f"""WITH RECURSIVE v AS (SELECT o_orderkey % 25 AS src, c_nationkey AS dst, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT src, dst, v / sum(v) OVER (PARTITION BY src) AS weight FROM v), nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e), size AS (SELECT count(*) AS n FROM nodes),
steps AS (SELECT 0 AS k, id, 1 / sqrt(n) AS rank, 1.0::DOUBLE AS moved FROM nodes, size UNION ALL
SELECT k + 1, id, flow / len, sqrt(sum(pow(flow / len - rank, 2)) OVER ()) FROM (SELECT *, sqrt(sum(flow * flow) OVER ()) AS len FROM
(SELECT k, id, rank, 0.85 * coalesce(f, 0) + 0.15 / n * sum(rank) OVER () AS flow FROM steps CROSS JOIN size LEFT JOIN (SELECT dst, sum(weight * rank) AS f FROM e JOIN steps ON src = id GROUP BY dst) ON dst = id WHERE moved >= 1e-4)))
SELECT id, {r('rank')} AS rank FROM steps WHERE k = (SELECT max(k) FROM steps)"""


@query("a18_pagerank", _RANKS)
def a18(spark, d):
    e = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy((F.col("o_orderkey") % 25).alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.sum("o_totalprice").alias("v"))
    e = e.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("src"))).select("src", "dst", "weight")
    return out(S.pagerank(e), "id", rank="rank")


@query("a19_image_stats", f"WITH {IMG} SELECT count(*) AS n, {rs(w_min='min(w)', w_max='max(w)', mean='avg(w)', mean_err='stddev_samp(w) / sqrt(count(*))', rms='stddev_samp(w)', rms_err='stddev_samp(w) / sqrt(2 * (count(*) - 1))', skewness='sqrt(count(*)) * (sum(w*w*w) - 3 * avg(w) * sum(w*w) + 3 * avg(w) * avg(w) * sum(w) - count(*) * pow(avg(w), 3)) / pow(sum(w*w) - count(*) * avg(w) * avg(w), 1.5)', skewness_err='sqrt(6.0 * count(*) * (count(*) - 1) / ((count(*) - 2.0) * (count(*) + 1) * (count(*) + 3)))', kurtosis='kurtosis_pop(w)')} FROM img")
def a19(spark, d):
    names = ("w_min", "w_max", "mean", "mean_err", "rms", "rms_err", "skewness", "skewness_err", "kurtosis")
    return out(embedding_image(spark, d).agg(*S.image_stats()), "n", **{c: c for c in names})


@query("a22_tile_mean", f"WITH {TILED} SELECT tx, ty, count(*) AS n, {rs(mean='avg(w)', rms='stddev_samp(w)')} FROM t GROUP BY tx, ty")
def a22(spark, d):
    return out(tiled(embedding_image(spark, d)).groupBy("tx", "ty").agg(F.count("w").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("rms")), "tx", "ty", "n", mean="mean", rms="rms")


@query("a23_tile_median", f"WITH {TILED}, m AS (SELECT tx, ty, median(w) AS med FROM t GROUP BY 1, 2) SELECT tx, ty, count(*) AS n, {rs(median='first(med)', rms='1.4826 * median(abs(w - med))')} FROM t JOIN m USING (tx, ty) GROUP BY 1, 2")
def a23(spark, d):
    return out(S.grouped_median_mad(tiled(embedding_image(spark, d)), ["tx", "ty"]), "tx", "ty", "n", median="median", rms="rms")


@query("a24_tile_clipped", _clip_sql(f"WITH {TILED}, v AS (SELECT * FROM t)", "tx, ty", 4, 2.5, 0.01, "w"))
def a24(spark, d):
    return out(S.clipped_tiles(tiled(embedding_image(spark, d)), ["tx", "ty"], k=2.5, rounds=4, tol=0.01), "tx", "ty", "n", mean="mean", median="median", rms="rms")


@query("a25_tile_biweight", biweight_sql(f"WITH {TILED} SELECT tx, ty, w AS x FROM t", "tx", "ty"))
def a25(spark, d):
    return out(S.biweight(tiled(embedding_image(spark, d)), ["tx", "ty"]), "tx", "ty", "n", location="location", scale="scale")


@query("a26_sample_background", f"WITH {TILED}, m AS (SELECT tx, ty, median(w) AS med FROM t GROUP BY 1, 2) SELECT tx, ty, {rs(bkg='first(med)', rms='1.4826 * median(abs(w - med))')}, count(*) >= 10 AND first(med) <> 0 AS reliable FROM t JOIN m USING (tx, ty) GROUP BY 1, 2")
def a26(spark, d):
    from ..operators.background import sample_background

    return out(sample_background(tiled(embedding_image(spark, d)), ["tx", "ty"], "median"), "tx", "ty", "reliable", bkg="bkg", rms="rms")


@query("a27_global_background", f"WITH {GLOBAL} SELECT {rs(bkg='med', rms='rms')} FROM g")
def a27(spark, d):
    m, s = S.median_mad(embedding_image(spark, d))
    return spark.range(1).select(R(F.lit(m)).alias("bkg"), R(F.lit(s)).alias("rms"))


_HIST = f"{IMG}, q AS (SELECT min(w) lo, max(w) hi FROM img WHERE w <> 0), h AS (SELECT floor((w - lo) / ((hi - lo) / 50))::BIGINT AS b, count(*) AS c FROM img, q WHERE w <> 0 AND w < hi GROUP BY 1), hist AS (SELECT i AS b, lo + (i + 0.5) * (hi - lo) / 50 AS centre, coalesce(c, 0) AS c FROM range(50) x(i) CROSS JOIN q LEFT JOIN h ON h.b = i)"
_EHIST = "q AS (SELECT min(value) lo, max(value) hi FROM events), h AS (SELECT floor((value - lo) / ((hi - lo) / 50))::BIGINT AS b, count(*) AS c FROM events, q WHERE value <> 0 AND value < hi GROUP BY 1), hist AS (SELECT i AS b, lo + (i + 0.5) * (hi - lo) / 50 AS centre, coalesce(c, 0) AS c FROM range(50) x(i) CROSS JOIN q LEFT JOIN h ON h.b = i)"
_OTSU = f"{_HIST}, u AS (SELECT b, centre, sum(c) OVER (ORDER BY b) AS wb, sum(c * centre) OVER (ORDER BY b) AS sb, sum(c) OVER () AS n, sum(c * centre) OVER () AS s FROM hist), otsu AS (SELECT centre AS thr FROM u WHERE wb > 0 AND n > wb ORDER BY round(wb / n * ((n - wb) / n) * pow(sb / wb - (s - sb) / (n - wb), 2), 12) DESC, b LIMIT 1)"
_VALLEY = f"{_EHIST}, sm AS (SELECT b, centre, -avg(c) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM hist), dl AS (SELECT *, max(v) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS d3, max(v) OVER (ORDER BY b ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS d5, max(v) OVER (ORDER BY b ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS d7 FROM sm), vly AS (SELECT centre AS thr FROM dl WHERE v = d3 AND v = d5 AND v = d7 AND b >= 3 AND b < 47 ORDER BY b LIMIT 1)"


@query("a28_histogram", f"WITH {_HIST} SELECT b, {r('centre')} AS centre, c AS n FROM hist")
def a28(spark, d):
    return out(S.histogram(embedding_image(spark, d), 50), "b", F.col("count").alias("n"), centre="centre")


@query("a29_otsu", f"WITH {_OTSU} SELECT {r('thr')} AS threshold FROM otsu")
def a29(spark, d):
    return out(S.otsu(S.histogram(embedding_image(spark, d), 50)), threshold="threshold")


@query("a30_median_threshold", f"WITH {GRID} SELECT {r('1.5 * median(w)')} AS threshold FROM grid")
def a30(spark, d):
    return spark.range(1).select(R(F.lit(1.5 * S.quantile(grid_image(spark, d), "w", [0.5])[0])).alias("threshold"))


@query("a31_valley", f"WITH {_VALLEY} SELECT {r('thr')} AS threshold FROM vly")
def a31(spark, d):
    return out(S.valley(S.histogram(table(spark, d, "events"), 50, "value")), threshold="threshold")


@query("a32_optimal_threshold", f"WITH {_OTSU.replace(_HIST, _EHIST)}, {_VALLEY[len(_EHIST) + 2:]} SELECT {r('greatest(least((SELECT thr FROM otsu), (SELECT thr FROM vly)), 1.2 * (SELECT median(value) FROM events))')} AS threshold")
def a32(spark, d):
    e = table(spark, d, "events")
    return out(S.optimal_threshold(e, 1.2, 50, "value"), threshold="threshold")


@query("a33_cumulative_threshold", f"WITH {IMG}, v AS (SELECT w, sum(w) OVER (ORDER BY w) AS u, sum(w) OVER () AS s FROM img WHERE w > 0) SELECT {r('min(w)')} AS threshold FROM v WHERE u >= 0.9 * s * (1 - 1e-12)")
def a33(spark, d):
    return out(S.cumulative_threshold(embedding_image(spark, d), 0.9), threshold="threshold")


# --- S: sources, O: sets --------------------------------------------------------------------------------------------------
#: Matrices of the whole table: eight vectors each, the first one on top.
_MATRICES = "mats AS (SELECT vec_id // 8 AS m, vec_id - min(vec_id) OVER (PARTITION BY vec_id // 8) AS top, count(*) OVER (PARTITION BY vec_id // 8) AS ny, embedding FROM embeddings)"


def _matrices(spark, d):
    rows = table(spark, d, "embeddings").withColumn("m", F.floor(F.col("vec_id") / 8))
    return rows.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("rows"))


@query("s13_from_matrix", f"WITH {_MATRICES} SELECT m, ny - 1 - top AS iy, unnest(range(64)) AS ix, {r('unnest(embedding)::DOUBLE')} AS w FROM mats")
def s13(spark, d):
    return out(from_matrix(_matrices(spark, d), "rows", "m"), "m", "iy", "ix", w="w")


@query("s16_to_rows", f"WITH {IMG} SELECT iy, count(*) AS n, {rs(first='arg_min(w, ix)', last='arg_max(w, ix)', total='sum(w)')} FROM img GROUP BY iy")
def s16(spark, d):
    rows = to_rows(embedding_image(spark, d))
    return out(rows, "iy", F.size("row").cast("long").alias("n"), first=F.col("row")[0], last=F.element_at("row", -1), total=F.aggregate("row", F.lit(0.0), lambda a, x: a + x))


@query("s19_tile", f"WITH {IMG} SELECT ix, iy, {r('w')} AS w FROM img WHERE ix BETWEEN 8 AND 23 AND iy BETWEEN 100 AND 149")
def s19(spark, d):
    return out(tile(embedding_image(spark, d), 8, 23, 100, 149), "ix", "iy", w="w")


@query("s20_tile_positive", f"WITH {IMG} SELECT ix, iy, {r('w')} AS w FROM img WHERE ix BETWEEN 8 AND 23 AND iy BETWEEN 100 AND 149 AND w >= 0")
def s20(spark, d):
    return out(tile(embedding_image(spark, d), 8, 23, 100, 149, skip_negative=True), "ix", "iy", w="w")


@query("o02_intersection", f"WITH {IMG} SELECT a.ix, a.iy FROM img a WHERE a.w > 0.2 AND EXISTS (SELECT 1 FROM img b WHERE b.ix = a.ix AND b.iy = a.iy + 1 AND b.w > 0.1)")
def o02(spark, d):
    px = embedding_image(spark, d)
    return px.where("w > 0.2").select("ix", "iy").intersect(px.where("w > 0.1").select("ix", (F.col("iy") - 1).alias("iy")))


@query("o03_find_item", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS pos FROM embeddings")
def o03(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_position("embedding", F.array_max("embedding")).alias("pos"))


@query("o04_delete_items", f"WITH {IMG} SELECT ix, iy FROM img WHERE (ix, iy) NOT IN (SELECT ix, iy FROM img WHERE w < 0)")
def o04(spark, d):
    px = embedding_image(spark, d)
    return px.join(px.where("w < 0"), ["ix", "iy"], "left_anti").select("ix", "iy")


@query("o05_argsort", f"WITH {IMG}, p AS (SELECT iy * 64 + ix AS g, iy, w FROM img) SELECT g, row_number() OVER (PARTITION BY iy ORDER BY w, g) AS rnk FROM p")
def o05(spark, d):
    p = embedding_image(spark, d).select((F.col("iy") * 64 + F.col("ix")).alias("g"), "iy", "w")
    return p.select("g", F.row_number().over(Window.partitionBy("iy").orderBy("w", "g")).cast("long").alias("rnk"))


@query("o06_argsort_descending", f"WITH {IMG}, p AS (SELECT iy * 64 + ix AS g, iy, w FROM img) SELECT g, row_number() OVER (PARTITION BY iy ORDER BY w DESC, g) AS rnk FROM p")
def o06(spark, d):
    p = embedding_image(spark, d).select((F.col("iy") * 64 + F.col("ix")).alias("g"), "iy", "w")
    return p.select("g", F.row_number().over(Window.partitionBy("iy").orderBy(F.desc("w"), "g")).cast("long").alias("rnk"))


@query("o07_union_catalogs", f"WITH {TILED} SELECT tx, ty, 'S' || row_number() OVER (PARTITION BY tx, ty ORDER BY iy, ix) AS name, ix, iy FROM t WHERE w > 0.35")
def o07(spark, d):
    parts = [tiled(embedding_image(spark, d)).where((F.col("tx") == i) & (F.col("w") > 0.35)) for i in range(4)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n = F.row_number().over(Window.partitionBy("tx", "ty").orderBy("iy", "ix"))
    return every.select("tx", "ty", F.concat(F.lit("S"), n).alias("name"), "ix", "iy")


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2))))"


@query("o08_nearest_mean", f"WITH p AS (SELECT a.vec_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT vec_id, {r('avg(d)')} AS d FROM p WHERE k <= 5 GROUP BY vec_id")
def o08(spark, d):
    """Every row whose id is divisible by 20 is a query against all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    return out(S.nearest_mean(v.where("id % 20 = 0"), v, 5), F.col("id").alias("vec_id"), d="d")


@query("o09_brightest", f"WITH {TILED}, k AS (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY w DESC, iy, ix) AS rnk FROM t) SELECT tx, ty, ix, iy, {r('w')} AS w, rnk FROM k WHERE rnk <= 3")
def o09(spark, d):
    n = F.row_number().over(Window.partitionBy("tx", "ty").orderBy(F.desc("w"), "iy", "ix"))
    return out(tiled(embedding_image(spark, d)).withColumn("rnk", n.cast("long")).where("rnk <= 3"), "tx", "ty", "ix", "iy", "rnk", w="w")


assert math.isclose(C.SIGMA2FWHM, 2.3548200450309493)
