"""Queries of the further operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalog as K
from ..operators import detect as D
from ..operators import extended as X
from ..operators import segment as SG
from ..operators import stats as S
from ..operators import stencil as ST
from ..sources.image import embedding_image, table
from .graph_queries import _PAIRS, _REG, regions
from .image_queries import _J7, _BOXES, PAIR, TRUE, ZMAP, blobs, comp_sql, image, labelled, pair
from .registry import query
from .stats_queries import GLOBAL, IMG, R, out, r, rs

# --- information ----------------------------------------------------------------------------------------------------------
#: Two samples of the whole table: the vectors' first two numbers and their next two.
_PT = "a AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT vec_id AS id, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings), c AS (SELECT count(*) AS n FROM embeddings)"


def _knn(name: str, other: str, same: bool) -> str:
    return f"{name} AS (SELECT id, d FROM (SELECT p.id, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS k FROM a p JOIN {other} q ON {'p.id <> q.id' if same else 'true'}) WHERE k = 3)"


def _points(spark, d):
    e = table(spark, d, "embeddings")
    return [e.select(F.col("vec_id").alias("id"), F.col("embedding")[i].cast("double").alias("x"), F.col("embedding")[i + 1].cast("double").alias("y")) for i in (0, 2)]


@query("a43_entropy", f"WITH {_PT}, {_knn('k', 'a', True)}, s AS (SELECT sum(1.0 / v) AS h FROM (SELECT unnest(range(1, n)) AS v FROM c)) SELECT {r(f'avg(ln(d)) * 2 + {math.log(math.pi)!r} - 0.5772156649015329 + any_value(h) - {X._digamma(3)!r}')} AS h FROM k, s")
def a43(spark, d):
    return out(X.entropy(_points(spark, d)[0], ["x", "y"]), h="h")


@query("a44_cross_entropy", f"WITH {_PT}, {_knn('k', 'b', False)} SELECT {r(f'avg(ln(d)) * 2 + {math.log(math.pi)!r} + ln(any_value(c.n)) - {X._digamma(3)!r}')} AS h FROM k, c")
def a44(spark, d):
    return out(X.cross_entropy(*_points(spark, d), ["x", "y"]), h="h")


@query("a45_divergence", f"WITH {_PT}, {_knn('k', 'a', True)}, {_knn('o', 'b', False)} SELECT {r('avg(ln(o.d / k.d)) * 2 + ln(any_value(c.n) / (any_value(c.n) - 1))')} AS kld FROM k JOIN o USING (id), c")
def a45(spark, d):
    return out(X.divergence(*_points(spark, d), ["x", "y"]), kld="kld")


@query("a42_accuracy_curves", f"WITH p AS (SELECT o_orderpriority AS cls, floor(log10(o_totalprice) * 4)::BIGINT AS bin, sum(l_extendedprice) / o_totalprice AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_totalprice) SELECT cls, bin, count(*) AS n, {rs(q16='quantile_cont(q, 0.16)', q50='quantile_cont(q, 0.5)', q84='quantile_cont(q, 0.84)')} FROM p GROUP BY 1, 2")
def a42(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    p = table(spark, d, "orders").join(li, "o_orderkey")
    g = p.groupBy(F.col("o_orderpriority").alias("cls"), F.floor(F.log10("o_totalprice") * 4).alias("bin")).agg(F.count("*").alias("n"), F.percentile(F.col("s") / F.col("o_totalprice"), [0.16, 0.5, 0.84]).alias("q"))
    return out(g, "cls", "bin", "n", q16=F.col("q")[0], q50=F.col("q")[1], q84=F.col("q")[2])


@query("a48_robust_background", f"WITH {_REG}, c AS (SELECT avg(mean) mx, avg(rms) my, var_samp(mean) sxx, var_samp(rms) syy, covar_samp(mean, rms) sxy FROM reg), ok AS (SELECT label FROM reg, c WHERE (syy * pow(mean - mx, 2) - 2 * sxy * (mean - mx) * (rms - my) + sxx * pow(rms - my, 2)) / (sxx * syy - sxy * sxy) <= 5.991), v AS (SELECT w FROM lab SEMI JOIN ok USING (label)), m AS (SELECT median(w) AS med FROM v) SELECT count(*) AS n, {rs(bkg='first(med)', rms='1.4826 * median(abs(w - med))')} FROM v, m")
def a48(spark, d):
    reg = regions(spark, d).select("label", "mean", "rms")
    c = reg.agg(F.avg("mean").alias("mx"), F.avg("rms").alias("my"), F.var_samp("mean").alias("sxx"), F.var_samp("rms").alias("syy"), F.covar_samp("mean", "rms").alias("sxy"))
    d2 = F.expr("(syy * power(mean - mx, 2) - 2 * sxy * (mean - mx) * (rms - my) + sxx * power(rms - my, 2)) / (sxx * syy - sxy * sxy)")
    inside = labelled(spark, d).join(reg.crossJoin(F.broadcast(c)).where(d2 <= 5.991).select("label"), "label", "left_semi")
    m, s = S.median_mad(inside)
    return inside.agg(F.count("*").alias("n")).select("n", R(F.lit(m)).alias("bkg"), R(F.lit(s)).alias("rms"))


# --- saliency variants, regions -------------------------------------------------------------------------------------------
@query("g26_global_saliency", f"WITH {_PAIRS}, s AS (SELECT a AS label, sum(exp(-50.0 * dc)) AS s FROM pr GROUP BY 1) SELECT label, {r('1 - (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())')} AS saliency FROM s")
def g26(spark, d):
    return out(X.saliency_global(regions(spark, d), 50.0), "label", saliency="saliency")


@query(
    "g28_two_gaussian_saliency",
    f"WITH {_REG}, p AS (SELECT a.label, b.x, b.y, sqrt(pow(a.mean - b.mean, 2) + pow(a.rms - b.rms, 2)) AS dc, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS ds FROM reg a, reg b), q AS (SELECT *, exp(-ds * ds / 20000.0) AS ws, exp(-dc * dc / 0.0002) AS wc FROM p), g AS (SELECT label, sum(dc * dc * ws) / sum(ws) AS u, sum((x * x + y * y) * wc) / sum(wc) - pow(sum(x * wc) / sum(wc), 2) - pow(sum(y * wc) / sum(wc), 2) AS dd FROM q GROUP BY 1) SELECT label, {r('(u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) * exp(-3.0 * (dd - min(dd) OVER ()) / (max(dd) OVER () - min(dd) OVER ()))', 5)} AS saliency FROM g",
)
def g28(spark, d):
    return X.saliency_two_gaussians(regions(spark, d), 100.0, 0.01, 3.0).select("label", R("saliency", 5).alias("saliency"))


@query("x75_knn_saliency", f"WITH {_PAIRS}, n AS (SELECT a, dc, row_number() OVER (PARTITION BY a ORDER BY dc) AS k FROM pr) SELECT a AS label, {r('1 - exp(-avg(dc))')} AS saliency FROM n WHERE k <= 5 GROUP BY 1")
def x75(spark, d):
    p = SG.region_pairs(regions(spark, d)).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"), SG.colour_distance().alias("total"))
    return out(X.saliency_knn(p, 5), "label", saliency="saliency")


@query("x87_similar_neighbours", f"WITH {_PAIRS} SELECT a, b, {r('dc')} AS dc FROM nb JOIN pr USING (a, b) WHERE dc > 0 AND dc <= 0.01")
def x87(spark, d):
    p = SG.region_pairs(regions(spark, d), K.neighbours_of_labels(labelled(spark, d)).select("a", "b"))
    return out(p.withColumn("dc", SG.colour_distance()).where("dc > 0 AND dc <= 0.01"), "a", "b", dc="dc")


@query("g20_region_merge", f"WITH {_REG}, m AS (SELECT label // 2 AS l2, sum(n) AS n, sum(n * mean) / sum(n) AS mean FROM reg GROUP BY 1) SELECT l2 AS label, n::BIGINT AS n, {r('mean')} AS mean FROM m")
def g20(spark, d):
    p = labelled(spark, d).withColumn("label", F.floor(F.col("label") / 2))
    return out(p.groupBy("label").agg(F.count("*").alias("n"), F.avg("w").alias("mean")), "label", "n", mean="mean")


@query("g30_edge_regions", f"WITH {_REG} SELECT label, bool_or(ix = 0 OR iy = 0 OR ix = 63 OR iy = (SELECT count(*) - 1 FROM embeddings)) AS at_edge FROM lab GROUP BY 1")
def g30(spark, d):
    return X.occluded_regions(labelled(spark, d), image(spark, d)[1])


@query("g31_interpolation", f"WITH {IMG}, p AS (SELECT ix AS x, iy AS y, w AS v FROM img WHERE w > 0.2), k AS (SELECT a.ix, a.iy, v, 1 / (pow(a.ix - x, 2) + pow(a.iy - y, 2) + 1e-9) AS k FROM p JOIN img a ON abs(a.ix - x) <= 4 AND abs(a.iy - y) <= 4) SELECT ix, iy, {r('sum(k * v) / sum(k)')} AS w FROM k GROUP BY 1, 2")
def g31(spark, d):
    px, s = image(spark, d)
    p = px.where("w > 0.2").select(F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), F.col("w").alias("v"))
    return out(X.interpolated(p, s, 4), "ix", "iy", w="w")


@query("g32_superpixel_background")
def g32(spark, d):
    px, s = image(spark, d)
    return X.superpixel_background(px, s, 20)


@query("g33_multi_scale_sources")
def g33(spark, d):
    px, s = image(spark, d)
    return X.multi_scale_sources(px, s, [1.0, 1.5, 2.0], 2, 2)


@query("g08_local_contour")
def g08(spark, d):
    px, s = image(spark, d)
    return X.local_contour(px, s, px.where("w > 0.1").select("ix", "iy"), 10, 4).groupBy("iy").agg(F.sum("w").alias("inside"))


@query("w38_spectral_residual")
def w38(spark, d):
    px, s = image(spark, d)
    return out(X.spectral_residual(px, s), "ix", "iy", w="w")


@query("w14_colour_guided_filter")
def w14(spark, d):
    px, s = image(spark, d)
    a = px.select("ix", "iy", "w", F.abs("w").alias("g1"), (F.col("w") * F.col("w")).alias("g2"))
    return out(ST.colour_guided_filter(a, 4, 0.01, s), "ix", "iy", w="w")


# --- finders --------------------------------------------------------------------------------------------------------------
@query("d19_saliency_sources")
def d19(spark, d):
    px, s = image(spark, d)
    return X.saliency_sources(px, s, [24, 40])


@query("d20_superpixel_sources")
def d20(spark, d):
    px, s = image(spark, d)
    return X.superpixel_sources(px, s, 20, 0.01)


@query("d21_contour_sources")
def d21(spark, d):
    px, s = image(spark, d)
    return X.contour_sources(px, s, 20, 3)


@query("x05_single_threshold", f"{ZMAP}, {TRUE.replace('1.5', '2.0').replace('2.5', '2.0')} SELECT source_id, ix, iy FROM blobst")
def x05(spark, d):
    return blobs(spark, d, 2.0, 2.0, 2)[0].select("source_id", "ix", "iy")


@query("d29_at_limit", f"SELECT s_suppkey AS id, abs(s_acctbal - 0) <= 1e-6 * 9000 OR abs(9000 - s_acctbal) <= 1e-6 * 9000 AS at_limit FROM supplier")  # noqa: F541
def d29(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.at_limit(F.col("s_acctbal"), F.lit(0.0), F.lit(9000.0)).alias("at_limit"))


@query("d46_bending_energy")
def d46(spark, d):
    p = embedding_image(spark, d)
    a = F.col("ix") * (2 * math.pi / 64)
    p = p.select(F.col("iy").alias("key"), F.col("ix").alias("t"), ((5 + F.col("w")) * F.cos(a)).alias("x"), ((5 + F.col("w")) * F.sin(a)).alias("y"))
    return out(X.bending_energy(p, 64, [1.0, 2.0, 4.0]), "key", "scale", energy="energy")


@query("d47_on_contour", f"WITH {IMG}, c AS (SELECT ix, iy FROM img WHERE w > 0.3), p AS (SELECT ix, iy FROM img WHERE w < -0.3) SELECT iy * 64 + ix AS id, EXISTS (SELECT 1 FROM c WHERE abs(c.ix - p.ix) <= 2 AND abs(c.iy - p.iy) <= 2) AS near FROM p")
def d47(spark, d):
    px = embedding_image(spark, d)
    p = px.where("w < -0.3").select((F.col("iy") * 64 + F.col("ix")).alias("id"), F.col("ix").alias("x"), F.col("iy").alias("y"))
    return X.on_contour(p, px.where("w > 0.3").select(F.col("ix").alias("x"), F.col("iy").alias("y")), 2).select("id", F.col("on").alias("near"))


_BEAM = ST.beam_kernel(4.0, 3.0, 0.0, 2)
_SEEN = f"""{ZMAP}, {comp_sql("t", 2.5, 1.5, 3)}, beam(dx, dy, k) AS (VALUES {", ".join(f"({i - _BEAM.shape[1] // 2}, {j - _BEAM.shape[0] // 2}, {float(_BEAM[j, i])!r}::DOUBLE)" for j in range(_BEAM.shape[0]) for i in range(_BEAM.shape[1]) if _BEAM[j, i])}),
spread AS (SELECT source_id, ix + dx AS ix, iy + dy AS iy, sum(w * k) AS w FROM blobst, beam WHERE ix + dx BETWEEN 0 AND 63 AND iy + dy BETWEEN 0 AND (SELECT count(*) FROM embeddings) - 1 GROUP BY 1, 2, 3),
bright AS (SELECT source_id, ix, iy, w, ix * 1000000 + iy AS id FROM spread QUALIFY sum(w) OVER (PARTITION BY source_id ORDER BY w DESC, ix, iy ROWS UNBOUNDED PRECEDING) - w < 0.95 * sum(w) OVER (PARTITION BY source_id)),
step AS (SELECT a.source_id, a.id AS a, b.id AS b FROM bright a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) JOIN bright b ON b.source_id = a.source_id AND b.ix = a.ix + dx AND b.iy = a.iy + dy),
walk AS (SELECT source_id, id, id AS root FROM bright UNION SELECT walk.source_id, step.b, walk.root FROM walk JOIN step ON step.source_id = walk.source_id AND step.a = walk.id),
part AS (SELECT source_id, id, min(root) AS part FROM walk GROUP BY 1, 2), chosen AS (SELECT source_id, part FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, part DESC) = 1),
best AS (SELECT bright.* FROM bright JOIN part USING (source_id, id) JOIN chosen USING (source_id, part)),
near AS (SELECT DISTINCT a.source_id AS a, b.source_id AS b FROM best a, range(-1, 2) x(dx), range(-1, 2) y(dy) JOIN best b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE a.source_id <> b.source_id),
group_walk AS (SELECT a AS id, a AS root FROM near UNION SELECT near.b, group_walk.root FROM group_walk JOIN near ON near.a = group_walk.id), groups AS (SELECT id, min(root) AS root FROM group_walk GROUP BY id)
SELECT coalesce(root, source_id) AS source_id, ix, iy, {r("sum(w)")} AS w FROM best LEFT JOIN groups ON groups.id = source_id GROUP BY 1, 2, 3"""


@query("d49_convolved_model", _SEEN)
def d49(spark, d):
    b, s = blobs(spark, d, 2.5, 1.5, 3)
    return out(X.convolved_model(b.select("source_id", "ix", "iy", "w"), s, ST.beam_kernel(4.0, 3.0, 0.0, 2)), "source_id", "ix", "iy", w="w")


@query("d55_centroid_distance", f"{PAIR}, a AS (SELECT source_id AS a, avg(ix) AS x, avg(iy) AS y FROM blobsf GROUP BY 1), b AS (SELECT source_id AS b, avg(ix) AS x, avg(iy) AS y FROM blobst GROUP BY 1) SELECT a, b, {r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))')} AS dist FROM a, b")
def d55(spark, d):
    t, f = (x.groupBy("source_id").agg(F.avg("ix").alias("x"), F.avg("iy").alias("y")) for x in pair(spark, d))
    p = f.select(F.col("source_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya")).join(F.broadcast(t.select(F.col("source_id").alias("b"), "x", "y")), F.lit(True))
    return out(p, "a", "b", dist=F.sqrt(F.pow(F.col("xa") - F.col("x"), 2) + F.pow(F.col("ya") - F.col("y"), 2)))


# --- joins ----------------------------------------------------------------------------------------------------------------
_TILES = "tl AS (SELECT y.i * 2 + x.i AS tile_id, 32 * x.i AS x0, 32 * x.i + 31 AS x1, 100 * y.i AS y0, least(100 * y.i + 100, (SELECT count(*) FROM embeddings)) - 1 AS y1 FROM range(2) x(i), range(1000) y(i) WHERE 100 * y.i < (SELECT count(*) FROM embeddings))"


@query("j09_edge_sources", f"{PAIR}, {_TILES}, b AS (SELECT min(iy) // 100 * 2 + min(ix) // 32 AS tile_id, source_id, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM blobst GROUP BY 2) SELECT source_id, EXISTS (SELECT 1 FROM tl WHERE tl.tile_id <> b.tile_id AND b.x0 - 1 <= tl.x1 AND tl.x0 <= b.x1 + 1 AND b.y0 - 1 <= tl.y1 AND tl.y0 <= b.y1 + 1) AS edge FROM b")
def j09(spark, d):
    b, s = blobs(spark, d)
    box = K.boxes(b).withColumn("tile_id", F.floor(F.col("y0") / 100) * 2 + F.floor(F.col("x0") / 32))
    return K.at_tile_edge(box, K.tiles(spark, *s, 32, 100)).select("source_id", "edge")


@query("j15_true_match_records", f"{_J7}, ft AS (SELECT source_id AS a, sum(w) AS s_true FROM blobst GROUP BY 1), fr AS (SELECT source_id AS b, sum(w) AS s_rec FROM blobsf GROUP BY 1) SELECT ft.a, coalesce(best.b, -1) AS b, {rs(s_true='s_true', s_rec='coalesce(s_rec, -1)', ratio='coalesce(s_rec / s_true, -1)')} FROM ft LEFT JOIN best USING (a) LEFT JOIN fr ON fr.b = best.b")
def j15(spark, d):
    t, f = pair(spark, d)
    return out(X.true_match_records(t, f, D.blob_stats(f), 0.3), "a", "b", s_true="s_true", s_rec="s_rec", ratio="ratio")


@query("j17_ellipse_overlap")
def j17(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), (F.col("s_suppkey") % 37 * 1.5).alias("x"), (F.col("s_suppkey") % 23 * 1.5).alias("y"), (2.0 + F.col("s_suppkey") % 3).alias("major"), F.lit(1.5).alias("minor"), (F.col("s_suppkey") * 0.3).alias("theta"))
    return out(X.ellipse_overlaps(e, e, once=True), "a", "b", area="area", fraction="fraction")


@query("j11_merge_candidates", f"{PAIR}, a AS ({_BOXES.format('blobst')}), b AS ({_BOXES.format('blobsf')}), o AS (SELECT a.source_id AS a, b.source_id AS b FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) SELECT DISTINCT o.a, o.b FROM o JOIN blobst p ON p.source_id = o.a JOIN blobsf q ON q.source_id = o.b AND abs(p.ix - q.ix) <= 1 AND abs(p.iy - q.iy) <= 1")
def j11(spark, d):
    t, f = pair(spark, d)
    near = K.overlapping(K.boxes(t), K.boxes(f)).select(F.col("source_id_a").alias("a"), F.col("source_id_b").alias("b"))
    # The same id in both catalogs is the same seed: ids are set apart while pixels are compared.
    touch = K.adjacent(t.select((F.col("source_id") * 2).alias("source_id"), "ix", "iy"), f.select((F.col("source_id") * 2 + 1).alias("source_id"), "ix", "iy"))
    return near.join(touch.select((F.col("a") / 2).cast("long").alias("a"), ((F.col("b") - 1) / 2).cast("long").alias("b")), ["a", "b"])


@query("x85_mahalanobis_threshold", f"WITH {GLOBAL} SELECT ix, iy, {r('abs(w - med) / rms')} AS dist FROM img, g WHERE pow((w - med) / rms, 2) >= 10.828")
def x85(spark, d):
    px = embedding_image(spark, d)
    m, s = S.median_mad(px)
    z = px.withColumn("dist", F.abs(F.col("w") - m) / s)
    return out(z.where("dist * dist >= 10.828"), "ix", "iy", dist="dist")


@query("x13_gaussian_kernel", "SELECT x.i AS dx, y.i AS dy, " + r("exp(-(x.i * x.i + y.i * y.i) / 4.5)", 9) + " AS v FROM range(-3, 4) x(i), range(-3, 4) y(i)")
def x13(spark, d):
    k = ST.gauss_kernel(7, 1.5, peak=True)
    return spark.createDataFrame([(int(i - 3), int(j - 3), float(k[j, i])) for j in range(7) for i in range(7)], "dx long, dy long, v double").select("dx", "dy", R("v", 9).alias("v"))


@query("x22_checkerboard", f"WITH {IMG} SELECT ix, iy, {r('sin(pi() * ix / 5) * sin(pi() * iy / 5)')} AS phi FROM img")
def x22(spark, d):
    return out(embedding_image(spark, d), "ix", "iy", phi=F.sin(F.col("ix") * math.pi / 5) * F.sin(F.col("iy") * math.pi / 5))


@query("x17_region_averages", f"WITH {IMG}, h AS (SELECT w, 0.5 * (1 + 2 / pi() * atan(sin(pi() * ix / 5) * sin(pi() * iy / 5))) AS h FROM img) SELECT {rs(c1='sum(w * h) / sum(h)', c2='sum(w * (1 - h)) / sum(1 - h)')} FROM h")
def x17(spark, d):
    phi = F.sin(F.col("ix") * math.pi / 5) * F.sin(F.col("iy") * math.pi / 5)
    h = embedding_image(spark, d).withColumn("h", 0.5 * (1 + 2 / math.pi * F.atan(phi)))
    return out(h.agg((F.sum(F.col("w") * F.col("h")) / F.sum("h")).alias("c1"), (F.sum(F.col("w") * (1 - F.col("h"))) / F.sum(1 - F.col("h"))).alias("c2")), c1="c1", c2="c2")


@query("x40_gaussian_mixture", f"WITH {IMG} SELECT ix, iy, {r('0.5 + 2 * exp(-(pow(ix - 20, 2) / 18 + pow(iy - 50, 2) / 18)) + 3 * exp(-(pow(ix - 24, 2) / 8 + pow(iy - 55, 2) / 8))')} AS v FROM img")
def x40(spark, d):
    px = embedding_image(spark, d)
    g = lambda a, x, y, s: C.gauss2d(F.col("ix"), F.col("iy"), a, x, y, s, s, F.lit(0.0))
    return out(px, "ix", "iy", v=0.5 + g(2.0, 20.0, 50.0, 3.0) + g(3.0, 24.0, 55.0, 2.0))


