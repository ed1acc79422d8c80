"""Queries of wrappers and supporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import background as B
from ..operators import catalog as K
from ..operators import detect as D
from ..operators import extended as X
from ..operators import graph as GR
from ..operators import segment as SG
from ..operators import stats as S
from ..operators import stencil as ST
from ..operators import supporting as U
from ..sources.config import tasks_from_json, tasks_to_json
from ..sources.image import embedding_image, from_matrix, grid_image, table, tile, to_rows
from ..streaming import workers as T
from .graph_queries import _PAIRS, _REG, _STATES, regions
from .image_queries import _MAPS, BOX, DIMS, GRIDSTEP, NY, REC, TRUE, ZMAP, _w, blobs, comp_sql, conv, image, labelled, zmap
from .registry import query
from .stats_queries import _MATRICES, _OTSU, GLOBAL, GRID, IMG, R, TILED, _matrices, out, r, rs, tiled

# --- sources --------------------------------------------------------------------------------------------------------------
@query("s14_from_matrix_scaled", f"WITH {_MATRICES} SELECT m, ny - 1 - top AS iy, unnest(range(64)) AS ix, {r('2 * unnest(embedding)::DOUBLE')} AS w FROM mats")
def s14(spark, d):
    m = _matrices(spark, d).select("m", F.transform("rows", lambda row: F.transform(row, lambda v: v.cast("double") * 2)).alias("rows"))
    return out(from_matrix(m, "rows", "m"), "m", "iy", "ix", w="w")


@query("s17_to_matrix", f"WITH {IMG} SELECT iy // 8 AS m, iy, {rs(total='sum(w)', weighted='sum(w * (ix + 1))')} FROM img GROUP BY 1, 2")
def s17(spark, d):
    rows = to_rows(embedding_image(spark, d)).withColumn("m", F.floor(F.col("iy") / 8))
    weighted = F.aggregate(F.transform("row", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out(rows, "m", "iy", total=F.aggregate("row", F.lit(0.0), lambda a, x: a + x), weighted=weighted)


@query("s18_histogram_2d", f"WITH {IMG} SELECT floor(ix / 4.0)::BIGINT AS bx, floor(iy / 10.0)::BIGINT AS by_, count(*) AS n, {r('sum(w)')} AS content FROM img GROUP BY 1, 2")
def s18(spark, d):
    g = embedding_image(spark, d).groupBy(F.floor(F.col("ix") / 4).alias("bx"), F.floor(F.col("iy") / 10).alias("by_"))
    return out(g.agg(F.count("*").alias("n"), F.sum("w").alias("w")), "bx", "by_", "n", content="w")


@query("s30_source_documents", f"{ZMAP}, {TRUE} SELECT source_id, ix, iy, {r('w')} AS w FROM blobst")
def s30(spark, d):
    return out(U.sources_from_json(U.sources_to_json(blobs(spark, d)[0])), "source_id", "ix", "iy", w="w")


@query("s31_source_document_fields", f"{ZMAP}, {TRUE} SELECT source_id, count(*) AS n, {r('sum(w)')} AS flux FROM blobst GROUP BY 1")
def s31(spark, d):
    docs = U.sources_to_json(blobs(spark, d)[0])
    j = docs.select("source_id", F.from_json("value", U.SOURCE_SCHEMA).alias("s"))
    return out(j, "source_id", F.col("s.n").alias("n"), flux=F.aggregate(F.transform("s.pixels", lambda p: p["w"]), F.lit(0.0), lambda a, x: a + x))


@query("s34_broken_source_documents", f"{ZMAP}, {TRUE}, n AS (SELECT source_id, count(*) AS n FROM blobst GROUP BY 1) SELECT source_id, ix, iy FROM blobst JOIN n USING (source_id) WHERE n < 6")
def s34(spark, d):
    """Documents of sources with six pixels or more are cut off and can't be read."""
    docs = U.sources_to_json(blobs(spark, d)[0])
    big = F.size(F.from_json("value", U.SOURCE_SCHEMA)["pixels"]) >= 6
    return U.sources_from_json(docs.withColumn("value", F.when(big, F.expr("left(value, 40)")).otherwise(F.col("value")))).select("source_id", "ix", "iy")


_TASKS = "SELECT o_orderkey AS k, 'f' || o_custkey AS filename, 'job' || (o_orderkey % 7) AS jobId, o_custkey % 50 AS ix_min FROM orders"


@query("s32_task_documents", f"WITH t AS ({_TASKS}) SELECT filename, jobId, k AS IdX, ix_min FROM t")
def s32(spark, d):
    o = table(spark, d, "orders")
    zero = F.lit(0).cast("long")
    t = o.select(F.concat(F.lit("f"), "o_custkey").alias("filename"), F.concat(F.lit("job"), F.col("o_orderkey") % 7).alias("jobId"), F.col("o_orderkey").cast("long").alias("IdX"), zero.alias("IdY"), (F.col("o_custkey") % 50).cast("long").alias("ix_min"), zero.alias("ix_max"), zero.alias("iy_min"), zero.alias("iy_max"))
    return tasks_from_json(tasks_to_json(t)).select("filename", "jobId", "IdX", "ix_min")


# --- statistics -----------------------------------------------------------------------------------------------------------
@query("a08_median_of_range", f"WITH {IMG} SELECT iy, {r('median(w)')} AS median FROM img WHERE ix BETWEEN 10 AND 40 GROUP BY iy")
def a08(spark, d):
    ny = table(spark, d, "embeddings").count()
    part = tile(embedding_image(spark, d), 10, 40, 0, ny - 1)
    return out(S.grouped_median_mad(part, ["iy"]), "iy", median="median")


@query("a20_stats_from_parts", f"WITH {IMG} SELECT count(*) AS n, {rs(mean='avg(w)', w_min='min(w)', w_max='max(w)', rms='stddev_samp(w)')} FROM img")
def a20(spark, d):
    m = S.merged_moments(tiled(embedding_image(spark, d)).groupBy("tx", "ty").agg(*S.moments()))
    return out(m, "n", mean="mean", w_min="w_min", w_max="w_max", rms=F.sqrt(F.col("m2") / (F.col("n") - 1)))


@query("a21_image_moments", f"WITH {GRID}, p AS (SELECT w, avg(w) OVER () AS mu FROM grid WHERE w > 0) SELECT count(*) AS n, {rs(mean='avg(w)')}, {r('sum(pow(w - mu, 2)) / count(*)', 4)} AS m2, {r('sum(pow(w - mu, 3)) / count(*)', 3)} AS m3 FROM p")
def a21(spark, d):
    m = grid_image(spark, d).where("w > 0").agg(*S.moments())
    return m.select("n", R("mean").alias("mean"), R(F.col("m2") / F.col("n"), 4).alias("m2"), R(F.col("m3") / F.col("n"), 3).alias("m3"))


@query("a34_cumulative_fraction", f"WITH {GRID}, v AS (SELECT w, sum(w) OVER (ORDER BY w) AS u, sum(w) OVER () AS s FROM grid WHERE w > 0) SELECT {r('min(w)')} AS threshold FROM v WHERE u >= 0.25 * s * (1 - 1e-12)")
def a34(spark, d):
    return out(S.cumulative_threshold(grid_image(spark, d), 0.25), threshold="threshold")


@query("a49_mean_background", f"WITH {TILED} SELECT tx, ty, {rs(bkg='avg(w)', rms='stddev_samp(w)')}, count(*) >= 10 AND avg(w) <> 0 AS reliable FROM t GROUP BY 1, 2")
def a49(spark, d):
    return out(B.sample_background(tiled(embedding_image(spark, d)), ["tx", "ty"], "mean"), "tx", "ty", "reliable", bkg="bkg", rms="rms")


@query("x06_otsu_of_bins", f"WITH {_OTSU.replace('/ 50', '/ 32').replace('range(50)', 'range(32)')} SELECT {r('thr')} AS threshold FROM otsu")
def x06(spark, d):
    return out(S.otsu(S.histogram(embedding_image(spark, d), 32)), threshold="threshold")


# --- pixels ---------------------------------------------------------------------------------------------------------------
_NEW = "new AS (SELECT ix + 1 AS ix, iy - 1 AS iy, w * 2 AS w FROM img WHERE w > 0.25)"
_PUT = f"WITH {IMG}, {_NEW}, ok AS (SELECT * FROM new WHERE ix BETWEEN 0 AND 63 AND iy BETWEEN 0 AND {NY} - 1), img2 AS (SELECT ix, iy, coalesce(ok.w, img.w) AS w FROM img LEFT JOIN ok USING (ix, iy))"


def _put(spark, d):
    px, s = image(spark, d)
    moved = px.where("w > 0.25").select((F.col("ix") + 1).alias("ix"), (F.col("iy") - 1).alias("iy"), (F.col("w") * 2).alias("w"))
    bad = px.where("w < -0.25").select("ix", "iy", F.when(F.col("ix") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))).alias("w"))
    return U.written_pixels(px, moved.unionByName(bad), s)


@query("x01_checked_write", f"{_PUT} SELECT ix, iy, {r('w')} AS w FROM img2")
def x01(spark, d):
    return _w(_put(spark, d))


@query("x02_moments_after_write", f"{_PUT} SELECT count(*) AS n, {rs(mean='avg(w)', rms='stddev_samp(w)')} FROM img2")
def x02(spark, d):
    return out(_put(spark, d).agg(*S.moments()), "n", mean="mean", rms=F.sqrt(F.col("m2") / (F.col("n") - 1)))


@query("x03_write_by_coordinates", "SELECT trunc(19 * l_quantity / 50)::BIGINT AS ix, CASE WHEN l_tax * 100 <= 6.5 THEN trunc(7 * (l_tax * 100) / 6.5)::BIGINT ELSE -1 END AS iy, count(*) AS n FROM lineitem GROUP BY 1, 2")
def x03(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.lit(1.0).alias("w"))
    return U.binned(p, (0.0, 50.0, 20), (0.0, 6.5, 8)).groupBy(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).agg(F.count("*").alias("n"))


@query("x04_partial_moments", f"WITH {TILED} SELECT tx, ty, count(*) AS n, {rs(mean='avg(w)', w_min='min(w)', w_max='max(w)', m2='var_pop(w) * count(*)')} FROM t GROUP BY 1, 2")
def x04(spark, d):
    m = tiled(embedding_image(spark, d)).groupBy("tx", "ty").agg(*S.moments())
    return out(m, "tx", "ty", "n", mean="mean", w_min="w_min", w_max="w_max", m2="m2")


@query("j01_image_join", f"WITH {IMG}, b AS (SELECT iy, avg(w) AS bkg, stddev_samp(w) AS rms FROM img GROUP BY iy) SELECT ix, iy, {r('(w - bkg) / rms')} AS z FROM img JOIN b USING (iy)")
def j01(spark, d):
    px = embedding_image(spark, d)
    maps = px.select("ix", "iy").join(px.groupBy("iy").agg(F.avg("w").alias("bkg"), F.stddev_samp("w").alias("rms")), "iy")
    return out(B.significance(px.join(maps, ["ix", "iy"])), "ix", "iy", z="z")


@query("x58_pixel_background", f"{'WITH ' + _MAPS} SELECT ix, iy, {rs(bkg='bkg', rms='rms')} FROM maps WHERE w > 0.3")
def x58(spark, d):
    px, s = image(spark, d)
    return out(B.local_background(px, *s, BOX, GRIDSTEP).where("w > 0.3"), "ix", "iy", bkg="bkg", rms="rms")


@query("x59_significance_from_maps", f"WITH {GLOBAL} SELECT ix, iy, {r('CASE WHEN w <> 0 THEN (w - med) / rms ELSE 0 END')} AS z FROM img, g")
def x59(spark, d):
    px = embedding_image(spark, d)
    m, s = S.median_mad(px)
    return out(B.significance(px.withColumn("bkg", F.lit(m)).withColumn("rms", F.lit(s))), "ix", "iy", z="z")


# --- stencils -------------------------------------------------------------------------------------------------------------
_GRAD = f"{conv('gx', 'img', ST.SCHARR_X, turn=False)}, {conv('gy', 'img', ST.SCHARR_X.T, turn=False)}"


@query("x07_inverted_gradient", f"WITH {DIMS}, {_GRAD} SELECT gx.ix, gx.iy, {r('-sqrt(gx.w * gx.w + gy.w * gy.w)')} AS w FROM gx JOIN gy USING (ix, iy)")
def x07(spark, d):
    px, s = image(spark, d)
    return out(ST.gradient(px, s), "ix", "iy", w=-F.col("w"))


@query("x08_inverted_laplacian", f"WITH {DIMS}, {conv('c', 'img', ST.LAPLACE)} SELECT ix, iy, {r('-w')} AS w FROM c")
def x08(spark, d):
    px, s = image(spark, d)
    return out(ST.convolve(px, ST.LAPLACE, s), "ix", "iy", w=-F.col("w"))


_NLOG9 = ST.norm_log_kernel(9, 2.0)


@query("x09_norm_log", f"WITH {DIMS}, {conv('c', 'img', _NLOG9)} SELECT ix, iy, {r('w')} AS w FROM c")
def x09(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, _NLOG9, s))


_F3 = ", ".join(conv(f"f{i}", f"f{i - 1}" if i > 1 else "img", ST.B3, "mirror", 2 ** (i - 1)) for i in (1, 2, 3))


@query("x10_wavelet_planes", f"WITH {DIMS}, {_F3} SELECT img.ix, img.iy, {rs(w1='img.w - f1.w', w2='f1.w - f2.w', w3='f2.w - f3.w', smooth='f3.w')} FROM img JOIN f1 USING (ix, iy) JOIN f2 USING (ix, iy) JOIN f3 USING (ix, iy)")
def x10(spark, d):
    px, s = image(spark, d)
    return out(ST.wavelet(px, 3, s), "ix", "iy", w1="w1", w2="w2", w3="w3", smooth="smooth")


@query("x92_mirrored_laplacian", f"WITH {DIMS}, {conv('c', 'img', ST.LAPLACE, 'mirror')} SELECT ix, iy, {r('w')} AS w FROM c")
def x92(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, ST.LAPLACE, s, "mirror"))


@query("x93_atrous_gap", f"WITH {DIMS}, {conv('c', 'img', ST.B3, 'mirror', 4)} SELECT ix, iy, {r('w')} AS w FROM c")
def x93(spark, d):
    px, s = image(spark, d)
    return _w(ST.convolve(px, ST.B3, s, "mirror", 4))


@query("x14_norm_log_kernel", "WITH k AS (SELECT x.i AS dx, y.i AS dy, (x.i * x.i + y.i * y.i) / 8.0 AS q FROM range(-4, 5) x(i), range(-4, 5) y(i)), v AS (SELECT dx, dy, -4.0 / (pi() * 16) * (1 - q) * exp(-q) AS v FROM k) SELECT dx, dy, " + r("v - avg(v) OVER ()", 9) + " AS v FROM v")
def x14(spark, d):
    rows = [(i - 4, j - 4, float(_NLOG9[j, i])) for j in range(9) for i in range(9)]
    return spark.createDataFrame(rows, "dx long, dy long, v double").select("dx", "dy", R("v", 9).alias("v"))


@query("x46_inverse_dft", f"WITH {IMG} SELECT iy AS vec_id, ix AS t, {rs(re='w', im='-w')} FROM img")
def x46(spark, d):
    p = embedding_image(spark, d).select(F.col("iy").alias("vec_id"), F.col("ix").alias("t"), F.col("w").alias("re"), (-F.col("w")).alias("im"))
    f = ST.dft(p, "vec_id", 64).select("vec_id", F.col("k").alias("t"), "re", "im")
    return out(ST.dft(f, "vec_id", 64, inverse=True).select("vec_id", F.col("k").cast("long").alias("t"), "re", "im"), "vec_id", "t", re="re", im="im")


_HAT = "e{k} AS (SELECT a.ix, a.iy, min(b.w) AS w FROM img a JOIN img b ON b.ix BETWEEN a.ix - {h} AND a.ix + {h} AND b.iy BETWEEN a.iy - {h} AND a.iy + {h} GROUP BY 1, 2), o{k} AS (SELECT a.ix, a.iy, max(b.w) AS w FROM e{k} a JOIN e{k} b ON b.ix BETWEEN a.ix - {h} AND a.ix + {h} AND b.iy BETWEEN a.iy - {h} AND a.iy + {h} GROUP BY 1, 2)"


@query("x65_morphological_peaks", f"WITH {IMG}, {_HAT.format(k=3, h=1)}, {_HAT.format(k=5, h=2)} SELECT ix, iy FROM img JOIN o3 USING (ix, iy) JOIN o5 USING (ix, iy) WHERE img.w - o3.w > 0 AND img.w - o5.w > 0")
def x65(spark, d):
    px, s = image(spark, d)
    return U.morphological_peaks(px, s, [3, 5])


# --- sources of pixels ----------------------------------------------------------------------------------------------------
_DIL = "o AS (SELECT x.i AS dx, y.i AS dy FROM range(-2, 3) x(i), range(-2, 3) y(i) WHERE x.i * x.i + y.i * y.i <= {q}), dl AS (SELECT DISTINCT source_id, ix + dx AS ix, iy + dy AS iy FROM blobst, o), md AS (SELECT source_id, {f}(w) AS m FROM blobst GROUP BY 1), f AS (SELECT ix, iy, arg_min(m, source_id) AS m FROM dl JOIN md USING (source_id) GROUP BY 1, 2)"


@query("d13_residual_of_all", f"{ZMAP}, {TRUE}, {_DIL.format(q=4, f='median')} SELECT img.ix, img.iy, {r('coalesce(m, w)')} AS w FROM img LEFT JOIN f USING (ix, iy)")
def d13(spark, d):
    b, s = blobs(spark, d)
    return _w(D.residual_map(embedding_image(spark, d), b, 5, s))


@query("x66_mean_model", f"{ZMAP}, {TRUE}, {_DIL.format(q=1, f='avg')} SELECT img.ix, img.iy, {r('coalesce(m, w)')} AS w FROM img LEFT JOIN f USING (ix, iy)")
def x66(spark, d):
    b, s = blobs(spark, d)
    return _w(D.residual_map(embedding_image(spark, d), b, 3, s, model="mean"))


@query("d51_background_model", f"{ZMAP}, {TRUE}, {_DIL.format(q=1, f='avg')} SELECT img.ix, img.iy, {r('CASE WHEN m IS NOT NULL THEN (SELECT med FROM g) ELSE w END')} AS w FROM img LEFT JOIN f USING (ix, iy)")
def d51(spark, d):
    b, s = blobs(spark, d)
    px = embedding_image(spark, d)
    return _w(D.residual_map(px.withColumn("bkg", F.lit(S.median_mad(px)[0])), b, 3, s, model="bkg"))


@query("x68_source_map", f"{ZMAP}, {TRUE}, o AS (SELECT ix, iy, min(source_id) AS s FROM blobst GROUP BY 1, 2) SELECT ix, iy, {r('coalesce(s + 1, 0)')} AS w FROM img LEFT JOIN o USING (ix, iy)")
def x68(spark, d):
    return _w(U.source_mask(embedding_image(spark, d), blobs(spark, d)[0].select("source_id", "ix", "iy"), "map"))


@query("x60_seeded_blob", f"{ZMAP}, {comp_sql('t', 1.5, 1.5, 1)}, top AS (SELECT source_id FROM blobst ORDER BY z DESC LIMIT 1) SELECT ix, iy, {r('w')} AS w FROM blobst JOIN top USING (source_id)")
def x60(spark, d):
    z, s = zmap(spark, d)
    top = z.agg(F.max("z")).collect()[0][0]
    return _w(D.find_blobs(z, s, top, 1.5, 1).join(z.select("ix", "iy", "w"), ["ix", "iy"]))


@query("x61_legacy_blobs", f"{ZMAP}, {REC} SELECT source_id, count(*) AS n, {rs(flux='sum(w)', peak='max(w)')} FROM blobsf GROUP BY 1")
def x61(spark, d):
    return out(blobs(spark, d, 3.0, 2.0, 1)[0].groupBy("source_id").agg(F.count("*").alias("n"), F.sum("w").alias("flux"), F.max("w").alias("peak")), "source_id", "n", flux="flux", peak="peak")


@query("x79_near_sources", f"{ZMAP}, {TRUE}, p AS (SELECT iy * 64 + ix AS id, ix + 0.5 AS x, iy + 0.25 AS y FROM img WHERE w < -0.3) SELECT DISTINCT id, source_id FROM p JOIN blobst ON abs(x - blobst.ix) <= 2 AND abs(y - blobst.iy) <= 2")
def x79(spark, d):
    p = embedding_image(spark, d).where("w < -0.3").select((F.col("iy") * 64 + F.col("ix")).alias("id"), (F.col("ix") + 0.5).alias("x"), (F.col("iy") + 0.25).alias("y"))
    return U.near_sources(p, blobs(spark, d)[0], 2)


@query("x27_contour_lookup", f"WITH {IMG}, c AS (SELECT ix, iy FROM img WHERE w > 0.25), p AS (SELECT ix, iy FROM img WHERE w > 0.35) SELECT iy * 64 + ix AS id, EXISTS (SELECT 1 FROM c WHERE abs(c.ix - p.ix) <= 1 AND abs(c.iy - p.iy - 1) <= 1) AS near FROM p")
def x27(spark, d):
    px = embedding_image(spark, d)
    p = px.where("w > 0.35").select((F.col("iy") * 64 + F.col("ix")).alias("id"), F.col("ix").alias("x"), (F.col("iy") + 1).alias("y"))
    return X.on_contour(p, px.where("w > 0.25").select(F.col("ix").alias("x"), F.col("iy").alias("y")), 1).select("id", F.col("on").alias("near"))


# --- regions and graphs ---------------------------------------------------------------------------------------------------
@query("x28_undirected_edges", "WITH e AS (SELECT c_nationkey AS a, c_custkey % 25 AS b FROM customer), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b) SELECT a, b FROM u")
def x28(spark, d):
    return GR.undirected(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).cast("long").alias("b"))).select("a", "b")


def _near(spark, d, r=None):
    return SG.region_pairs(regions(spark, d) if r is None else r, K.neighbours_of_labels(labelled(spark, d)).select("a", "b"))


@query("x30_colour_distance_squared", f"WITH {_PAIRS} SELECT a, b, {rs(plain='dc * dc', robust='dr * dr')} FROM nb JOIN pr USING (a, b)")
def x30(spark, d):
    return out(_near(spark, d), "a", "b", plain=F.pow(SG.colour_distance(), 2), robust=F.pow(SG.colour_distance(True), 2))


@query("x31_space_distance_squared", f"WITH {_PAIRS} SELECT a, b, {r('ds * ds')} AS d2 FROM nb JOIN pr USING (a, b)")
def x31(spark, d):
    return out(_near(spark, d), "a", "b", d2=F.pow(SG.space_distance(), 2))


_CURV = f"{_REG}, {conv('lap', 'img', ST.LAPLACE)}, cu AS (SELECT label, avg(lap.w) AS cm, stddev_samp(lap.w) AS cr FROM lab JOIN lap USING (ix, iy) GROUP BY 1)"


def _curved(spark, d):
    px = labelled(spark, d)
    return U.with_curvature(regions(spark, d), px, ST.convolve(px.select("ix", "iy", "w"), ST.LAPLACE, image(spark, d)[1]))


@query("x29_region_parameters", f"WITH {_CURV} SELECT label, {rs(p0='mean', p1='rms', p2='cm', p3='cr', p4='x', p5='y')} FROM reg JOIN cu USING (label)")
def x29(spark, d):
    v = _curved(spark, d).withColumn("p", U.parameters(curvature=True))
    return out(v, "label", **{f"p{i}": F.col("p")[i] for i in range(6)})


_CPAIR = f"{_CURV}, cp AS (SELECT nb.a, nb.b, pow(p.cm - q.cm, 2) + pow(p.cr - q.cr, 2) AS d2 FROM nb JOIN cu p ON p.label = nb.a JOIN cu q ON q.label = nb.b)"


@query("x32_curvature_distance_squared", f"WITH {_CPAIR} SELECT a, b, {r('d2')} AS d2 FROM cp")
def x32(spark, d):
    return out(_near(spark, d, _curved(spark, d)), "a", "b", d2=U.curvature_distance_squared())


@query("x33_distance_triple", f"WITH {_CPAIR}, x AS (SELECT cp.*, p.mean AS m1, p.rms AS r1, p.x AS x1, p.y AS y1, q.mean AS m2, q.rms AS r2, q.x AS x2, q.y AS y2 FROM cp JOIN reg p ON p.label = a JOIN reg q ON q.label = b) SELECT a, b, {rs(colour='sqrt(pow(m1 - m2, 2) + pow(r1 - r2, 2))', curvature='sqrt(d2)', space='sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2))')} FROM x")
def x33(spark, d):
    return out(_near(spark, d, _curved(spark, d)), "a", "b", colour=SG.colour_distance(), curvature=F.sqrt(U.curvature_distance_squared()), space=SG.space_distance())


@query("x36_without_empty", f"WITH {_REG}, z AS (SELECT label, count(*) FILTER (WHERE w > 0.3) AS n FROM lab GROUP BY 1) SELECT label, n FROM z WHERE n > 0")
def x36(spark, d):
    return U.without_empty(labelled(spark, d).groupBy("label").agg(F.count(F.when(F.col("w") > 0.3, 1)).alias("n")))


@query("x38_superpixel_check", f"WITH {_REG} SELECT 'no pixels' AS what, count(*) AS n FROM reg WHERE label % 5 = 0 HAVING count(*) > 0 UNION ALL SELECT 'wrong count', count(*) FROM reg WHERE label % 5 = 1 HAVING count(*) > 0 UNION ALL SELECT 'no region', count(*) FROM reg WHERE label % 5 = 2 HAVING count(*) > 0")
def x38(spark, d):
    """Of every five regions one has lost its pixels, one has a wrong count and one is missing."""
    px = labelled(spark, d)
    reg = px.groupBy("label").agg(F.count("*").alias("n"))
    bad = reg.where("label % 5 <> 2").withColumn("n", F.when(F.col("label") % 5 == 1, F.col("n") + 1).otherwise(F.col("n")))
    return U.checked(px.where("label % 5 <> 0"), bad)


@query("x70_robust_region_stats", f"WITH {_REG} SELECT label, n, {rs(median='median', mad='mad')} FROM reg")
def x70(spark, d):
    return out(regions(spark, d), "label", "n", median="median", mad="mad")


@query("x71_ordered_neighbours", f"WITH {_PAIRS}, e AS (SELECT a, b, round(dc, 9) AS dc FROM nb JOIN pr USING (a, b)), u AS (SELECT a, b, dc FROM e UNION ALL SELECT b, a, dc FROM e) SELECT a AS label, b AS neighbour, row_number() OVER (PARTITION BY a ORDER BY dc, b) AS place FROM u")
def x71(spark, d):
    e = _near(spark, d).select("a", "b", F.round(SG.colour_distance(), 9).alias("distance"))
    return U.ordered_neighbours(e)


@query("g12_normalised_distance", f"WITH {_PAIRS}, e AS (SELECT a, b, dc FROM nb JOIN pr USING (a, b)), m AS (SELECT min(dc) lo, max(dc) hi FROM e) SELECT a, b, {r('(dc - lo) / (hi - lo)')} AS d FROM e, m")
def g12(spark, d):
    e = _near(spark, d).select("a", "b", SG.colour_distance().alias("dc"))
    ends = e.agg(F.min("dc").alias("lo"), F.max("dc").alias("hi"))
    return out(e.crossJoin(F.broadcast(ends)), "a", "b", d=C.linear_norm(F.col("dc"), F.col("lo"), F.col("hi"), 0.0, 1.0))


@query("g09_second_order_distances", f"WITH {_PAIRS}, u AS (SELECT a, b FROM nb UNION SELECT b, a FROM nb), s2 AS (SELECT DISTINCT x.a, y.b FROM u x JOIN u y ON y.a = x.b WHERE x.a < y.b AND (x.a, y.b) NOT IN (SELECT (a, b) FROM u)) SELECT a, b, {rs(dc='dc', ds='ds')} FROM s2 JOIN pr USING (a, b)")
def g09(spark, d):
    second = GR.second_neighbours(K.neighbours_of_labels(labelled(spark, d)).select("a", "b"))
    p = SG.region_pairs(regions(spark, d), second.select("a", "b").where("a < b").distinct())
    return out(p, "a", "b", dc=SG.colour_distance(), ds=SG.space_distance())


@query("d43_conic_parameters", f"WITH c AS (SELECT s_suppkey AS id, 1.0 + s_suppkey % 7 AS a, (s_suppkey % 5 - 2) * 0.5 AS b, 2.0 + s_suppkey % 3 AS c, (s_suppkey % 11)::DOUBLE AS d, (s_suppkey % 4)::DOUBLE AS e, -5.0 AS f FROM supplier), x AS (SELECT *, (b * e - 2 * c * d) / (4 * a * c - b * b) AS x0, (b * d - 2 * a * e) / (4 * a * c - b * b) AS y0, sqrt(pow(a - c, 2) + b * b) AS q FROM c), y AS (SELECT *, f + (d * x0 + e * y0) / 2 AS f0 FROM x) SELECT id, {rs(x0='x0', y0='y0', major='sqrt(-2 * f0 / (a + c - q))', minor='sqrt(-2 * f0 / (a + c + q))')} FROM y")
def d43(spark, d):
    k = F.col("s_suppkey")
    c = [1.0 + k % 7, (k % 5 - 2) * 0.5, 2.0 + k % 3, (k % 11).cast("double"), (k % 4).cast("double"), F.lit(-5.0)]
    x0, y0, major, minor, _ = U.conic_parameters(*c)
    return out(table(spark, d, "supplier"), k.alias("id"), x0=x0, y0=y0, major=major, minor=minor)


# --- workers and jobs -----------------------------------------------------------------------------------------------------
def _events(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "ON").when(F.col("event_type") == "error", "FAULT").otherwise("RUNNING")
    return e.select(F.col("user_id").alias("worker"), state.alias("state"), F.struct("ts", "event_id").alias("ts"), "event_id")


@query("t01_register_workers", "SELECT user_id AS worker, min(ts) AS since FROM events GROUP BY 1")
def t01(spark, d):
    return T.registered(table(spark, d, "events").select(F.col("user_id").alias("worker"), "ts"))


@query("t03_list_workers", f"WITH s AS ({_STATES}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) = 1), x AS (SELECT worker, CASE state WHEN 'ON' THEN 'free' WHEN 'RUNNING' THEN 'busy' ELSE 'unknown' END AS status FROM l) SELECT status, count(*) AS n, min(worker) AS first_worker FROM x GROUP BY 1")
def t03(spark, d):
    return T.listed(T.latest_states(_events(spark, d)))


@query("t04_change_events", f"WITH s AS ({_STATES}), l AS (SELECT *, lag(state) OVER (PARTITION BY worker ORDER BY ts, event_id) AS old FROM s) SELECT worker, event_id, old, state FROM l WHERE state IS DISTINCT FROM old")
def t04(spark, d):
    return T.state_changes(_events(spark, d).drop("event_id")).select("worker", F.col("ts.event_id").alias("event_id"), "old", "state")


@query("t08_state_callback", f"WITH s AS ({_STATES}), l AS (SELECT *, lag(state) OVER (PARTITION BY worker ORDER BY ts, event_id) AS old FROM s) SELECT worker, count(*) FILTER (WHERE state = 'ON') AS freed, count(*) FILTER (WHERE state = 'RUNNING') AS started FROM l WHERE state IS DISTINCT FROM old GROUP BY 1")
def t08(spark, d):
    c = T.state_changes(_events(spark, d).drop("event_id"))
    return c.groupBy("worker").agg(F.count(F.when(F.col("state") == "ON", 1)).alias("freed"), F.count(F.when(F.col("state") == "RUNNING", 1)).alias("started"))


@query("t11_job_attributes", "WITH c AS (SELECT o_custkey AS job, o_orderpriority AS name, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS value, o_orderdate AS ts, o_orderkey AS k FROM orders), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY job, name ORDER BY ts DESC, k DESC) = 1) SELECT job, name, value FROM l WHERE value IS NOT NULL")
def t11(spark, d):
    o = table(spark, d, "orders")
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return T.job_attributes(o.select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("name"), value.alias("value"), F.struct("o_orderdate", "o_orderkey").alias("ts")))


@query("t12_typed_options", "SELECT 'opt' || (o_orderkey % 4) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE (o_orderkey % 100)::VARCHAR END AS value, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 3 <> 0 WHEN 1 THEN o_orderkey % 3 <> 0 WHEN 2 THEN true ELSE false END AS accepted FROM orders")
def t12(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("x"), k)).otherwise((k % 100).cast("string"))
    lines = table(spark, d, "orders").select(F.to_json(F.struct(F.concat(F.lit("opt"), k % 4).alias("name"), value.alias("value"))).alias("value"))
    return T.typed_options(lines, {"opt0": "bigint", "opt1": "double", "opt2": "string"})


@query("x50_valid_jobs", "SELECT o_orderkey AS id, o_orderkey % 5 = 0 OR o_orderkey % 5 = 1 AS valid FROM orders")
def x50(spark, d):
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, '{"options": [{"name": "a", "value": "1"}]}')
        .when(k == 1, '{"options": [{"name": "a", "value": 1}, {"name": "b", "value": true}], "x": 2}')
        .when(k == 2, '{"options": []}')
        .when(k == 3, '{"options": [{"name": "a"}]}')
        .otherwise('{"options": [')
    )
    return U.valid_jobs(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("value"))).select("id", "valid")
