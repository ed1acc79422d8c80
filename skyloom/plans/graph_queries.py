"""Queries of the segmentation (G), fit, contour, source (S) and stream (T) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import fit as FT
from ..operators import graph as GR
from ..operators import segment as SG
from ..sources import config, fits, skymodel
from ..sources.image import table
from ..streaming import workers as T
from .image_queries import _J12, _LAB, image, blobs, labelled
from .registry import query
from .stats_queries import IMG, R, out, r, rs

_REG = (
    f"{_J12}, r0 AS (SELECT label, count(*) AS n, avg(w) AS mean, stddev_samp(w) AS rms, median(w) AS median, avg(ix) AS x, avg(iy) AS y FROM lab GROUP BY 1), r1 AS (SELECT label, 1.4826 * median(abs(w - median)) AS mad FROM lab JOIN r0 USING (label) GROUP BY 1), reg AS (SELECT * FROM r0 JOIN r1 USING (label))"
)
_PAIRS = f"{_REG}, pr AS (SELECT a.label AS a, b.label AS b, sqrt(pow(a.mean - b.mean, 2) + pow(a.rms - b.rms, 2)) AS dc, sqrt(pow(a.median - b.median, 2) + pow(a.mad - b.mad, 2)) AS dr, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS ds FROM reg a JOIN reg b ON a.label <> b.label)"


def regions(spark, d):
    return SG.regions(labelled(spark, d))


@query("x35_region_stats", f"WITH {_REG} SELECT label, n, {rs(mean='mean', rms='rms', median='median', mad='mad', x='x', y='y')} FROM reg")
def x35(spark, d):
    return out(regions(spark, d), "label", "n", **{c: c for c in ("mean", "rms", "median", "mad", "x", "y")})


@query("j16_region_distances", f"WITH {_PAIRS} SELECT a, b, {rs(dc='dc', dr='dr', ds='ds')} FROM pr")
def j16(spark, d):
    p = SG.region_pairs(regions(spark, d))
    return p.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"), R(SG.colour_distance()).alias("dc"), R(SG.colour_distance(True)).alias("dr"), R(SG.space_distance()).alias("ds"))


@query("g10_neighbour_distances", f"WITH {_PAIRS} SELECT a, b, {rs(dc='dc', ds='ds')} FROM nb JOIN pr USING (a, b)")
def g10(spark, d):
    p = SG.region_pairs(regions(spark, d), K.neighbours_of_labels(labelled(spark, d)).select("a", "b"))
    return p.select("a", "b", R(SG.colour_distance()).alias("dc"), R(SG.space_distance()).alias("ds"))


@query(
    "g11_merged_distance",
    f"WITH {_REG}, q AS (SELECT a, b, x.mean AS ma, x.rms AS ra, x.n AS na, y.mean AS mb, y.rms AS rb, y.n AS nbb, (x.n * x.mean + y.n * y.mean) / (x.n + y.n) AS mu FROM nb JOIN reg x ON x.label = a JOIN reg y ON y.label = b) SELECT a, b, {r('sqrt(pow(ma - mu, 2) + pow(ra - sqrt((ra * ra * (na - 1) + rb * rb * (nbb - 1) + na * pow(ma - mu, 2) + nbb * pow(mb - mu, 2)) / (na + nbb - 1)), 2))')} AS d FROM q",
)
def g11(spark, d):
    p = SG.region_pairs(regions(spark, d), K.neighbours_of_labels(labelled(spark, d)).select("a", "b"))
    return p.select("a", "b", R(SG.merged_distance()).alias("d"))


_SAL = f"{_PAIRS}, lim AS (SELECT min(dc) c0, max(dc) c1, min(ds) s0, max(ds) s1 FROM pr), ds AS (SELECT a, b, (dc - c0) / (c1 - c0) / (1 + (ds - s0) / (s1 - s0)) AS diss FROM pr, lim), k AS (SELECT greatest(1, floor(0.1 * count(*))::INT) AS k FROM reg), nn AS (SELECT a, diss, row_number() OVER (PARTITION BY a ORDER BY diss, b) AS rn FROM ds), sv AS (SELECT a AS label, avg(exp(-100.0 * diss)) AS s FROM nn, k WHERE rn <= k GROUP BY a)"


@query("g04_saliency", f"WITH {_SAL} SELECT label, {r('1 - (s - (SELECT min(s) FROM sv)) / ((SELECT max(s) FROM sv) - (SELECT min(s) FROM sv))')} AS saliency FROM sv")
def g04(spark, d):
    return out(SG.saliency(regions(spark, d)), "label", saliency="saliency")


@query(
    "g06_similarity",
    f"WITH {_PAIRS}, q AS (SELECT a, b, dc, contacts::DOUBLE AS c FROM nb JOIN pr USING (a, b)), u AS (SELECT a, b, (dc - min(dc) OVER ()) / (max(dc) OVER () - min(dc) OVER ()) AS d, 1 - (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS e FROM q), v AS (SELECT a, b, d, e, 0.5 * d + 0.5 * e AS total FROM u UNION ALL SELECT b, a, d, e, 0.5 * d + 0.5 * e FROM u) SELECT a, b, {rs(d='d', e='e', total='total', weight='(1 / (total + 1e-3)) / sum(1 / (total + 1e-3)) OVER (PARTITION BY a)')} FROM v",
)
def g06(spark, d):
    s = SG.similarity(K.neighbours_of_labels(labelled(spark, d)), regions(spark, d))
    return out(s, "a", "b", d="d", e="e", total="total", weight="weight")


_TAG = f"{_LAB}, tg AS (SELECT label, CASE WHEN avg((w > 0.02)::INT) >= 0.45 THEN 1 WHEN avg((w < 0)::INT) >= 0.45 THEN 0 ELSE 2 END AS tag FROM lab GROUP BY 1)"


def tags(spark, d):
    return SG.tag_regions(labelled(spark, d).withColumns({"bkg": F.col("w") < 0, "sig": F.col("w") > 0.02}), 0.45)


@query("g14_tag_regions", f"WITH {_TAG} SELECT label, tag FROM tg")
def g14(spark, d):
    return tags(spark, d)


@query("g15_count_tags", f"WITH {_TAG} SELECT tag, count(*) AS n FROM tg GROUP BY 1")
def g15(spark, d):
    return tags(spark, d).groupBy("tag").agg(F.count("*").alias("n"))


@query("g01_superpixels")
def g01(spark, d):
    px, s = image(spark, d)
    return SG.superpixels(px, s, 20, 1.0, 10, 4).groupBy("label").agg(F.count("*").alias("n"), R(F.avg("w")).alias("mean"))


@query("g05_multi_saliency")
def g05(spark, d):
    px, s = image(spark, d)
    return out(SG.multi_saliency(px, s, [24, 40]), "ix", "iy", saliency="saliency")


@query("g07_chan_vese")
def g07(spark, d):
    px, s = image(spark, d)
    return SG.chan_vese(px, s, 20).groupBy("iy").agg(F.sum("w").alias("inside"))


def _nearest_sql(k: int, limit: float) -> str:
    """CTEs of a round of merging: pair{k} (neighbours of lab{k} nearer than the limit) from regions{k} and touch{k}."""
    return f"""regions{k} AS (SELECT label, avg(w) AS mean, coalesce(stddev_samp(w), 0) AS rms FROM lab{k} GROUP BY 1),
touch{k} AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b FROM lab{k} a, (VALUES (1, 0), (0, 1), (1, 1), (1, -1)) st(dx, dy) JOIN lab{k} b ON b.ix = a.ix + dx AND b.iy = a.iy + dy WHERE a.label <> b.label GROUP BY 1, 2 HAVING count(*) >= 2),
pair{k} AS (SELECT a, b, sqrt(pow(x.mean - y.mean, 2) + pow(x.rms - y.rms, 2)) AS d FROM touch{k} JOIN regions{k} x ON x.label = a JOIN regions{k} y ON y.label = b WHERE d < {limit})"""


def _best_sql(k: int, pairs: str) -> str:
    return f"best{k} AS (SELECT a, b FROM (SELECT a, b, d FROM {pairs} UNION ALL SELECT b, a, d FROM {pairs}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1)"


def _mutual_sql(k: int) -> str:
    return f"{_nearest_sql(k, 0.004)}, {_best_sql(k, f'pair{k}')}, lab{k + 1} AS (SELECT ix, iy, w, coalesce(x.a, label) AS label FROM lab{k} LEFT JOIN best{k} y ON y.a = label AND y.b < y.a LEFT JOIN best{k} x ON x.a = y.b AND x.b = label)"


def _level_sql(k: int) -> str:
    return f"""{_nearest_sql(k, 0.01)}, alike{k} AS (SELECT * FROM pair{k} WHERE d <= (SELECT quantile_disc(d, 0.3) FROM pair{k}) AND (SELECT count(*) FROM regions{k}) > 10), {_best_sql(k, f"alike{k}")},
both{k} AS (SELECT a, b FROM best{k} UNION SELECT b, a FROM best{k}), walk{k} AS (SELECT a AS id, a AS root FROM both{k} UNION SELECT both{k}.b, root FROM walk{k} JOIN both{k} ON both{k}.a = id), comp{k} AS (SELECT id, min(root) AS root FROM walk{k} GROUP BY id),
lab{k + 1} AS (SELECT ix, iy, w, coalesce(root, label) AS label FROM lab{k} LEFT JOIN comp{k} ON id = label)"""


_START = f"WITH RECURSIVE {_LAB}, lab0 AS (SELECT ix, iy, w, label FROM lab)"


@query("g18_mutual_merge", f"{_START}, {_mutual_sql(0)}, {_mutual_sql(1)} SELECT label, count(*) AS n FROM lab2 GROUP BY 1")
def g18(spark, d):
    return SG.merge_mutual(labelled(spark, d).select("ix", "iy", "w", "label"), 0.004, 2).groupBy("label").agg(F.count("*").alias("n"))


@query("g19_hierarchical_merge", f"{_START}, {_level_sql(0)}, {_level_sql(1)} SELECT label, count(*) AS n FROM lab2 GROUP BY 1")
def g19(spark, d):
    return SG.merge_hierarchical(labelled(spark, d).select("ix", "iy", "w", "label"), 0.3, 0.01, 10, 2).groupBy("label").agg(F.count("*").alias("n"))


@query("g21_components", "WITH RECURSIVE e AS (SELECT c_custkey AS a, 1000000000 + c_nationkey * 5 + ascii(c_mktsegment) % 5 AS b FROM customer UNION ALL SELECT s_suppkey + 2000000000, 1000000000 + s_nationkey * 5 + s_suppkey % 2 FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), x AS (SELECT a AS id, a AS root FROM u UNION SELECT u.b, x.root FROM x JOIN u ON u.a = x.id) SELECT id, min(root) AS component FROM x GROUP BY id")
def g21(spark, d):
    """Customers and suppliers linked with their markets, a nation's segments."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    market = lambda nation, i: (F.lit(1000000000) + F.col(nation) * 5 + i).cast("long").alias("b")
    edges = c.select(F.col("c_custkey").cast("long").alias("a"), market("c_nationkey", F.ascii("c_mktsegment") % 5))
    return GR.components(edges.unionByName(s.select((F.col("s_suppkey") + 2000000000).cast("long").alias("a"), market("s_nationkey", F.col("s_suppkey") % 2))))


@query("g22_adjacency", f"WITH {_J12}, u AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb) SELECT a, count(*) AS degree, min(b) AS first_neighbour FROM u GROUP BY a")
def g22(spark, d):
    return GR.undirected(K.neighbours_of_labels(labelled(spark, d)).select("a", "b")).groupBy("a").agg(F.count("*").alias("degree"), F.min("b").alias("first_neighbour"))


_DENSITY = f"""WITH RECURSIVE {_PAIRS}, one AS (SELECT a, b FROM nb JOIN pr USING (a, b) WHERE dc <= 0.006), two AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
core AS (SELECT a AS label FROM two GROUP BY a HAVING count(*) >= 2), link AS (SELECT a, b FROM two WHERE a IN (FROM core) AND b IN (FROM core)),
walk AS (SELECT label AS id, label AS root FROM core UNION SELECT link.b, walk.root FROM walk JOIN link ON link.a = walk.id), comp AS (SELECT id, min(root) AS cluster FROM walk GROUP BY id),
rim AS (SELECT a AS id, min(cluster) AS cluster FROM two JOIN comp ON b = id WHERE a NOT IN (FROM core) GROUP BY a)
SELECT label, coalesce(comp.cluster, rim.cluster, -1) AS cluster FROM reg LEFT JOIN comp ON comp.id = label LEFT JOIN rim ON rim.id = label"""


@query("g24_density_clusters", _DENSITY)
def g24(spark, d):
    return SG.density_clusters(regions(spark, d), K.neighbours_of_labels(labelled(spark, d)), 0.006, 2)


@query("g25_background_region", f"WITH {_REG}, c AS (SELECT avg(mean) mx, avg(rms) my, var_samp(mean) sxx, var_samp(rms) syy, covar_samp(mean, rms) sxy FROM reg) SELECT label, {r('sqrt((syy * pow(mean - mx, 2) - 2 * sxy * (mean - mx) * (rms - my) + sxx * pow(rms - my, 2)) / (sxx * syy - sxy * sxy))', 5)} AS dist FROM reg, c WHERE (syy * pow(mean - mx, 2) - 2 * sxy * (mean - mx) * (rms - my) + sxx * pow(rms - my, 2)) / (sxx * syy - sxy * sxy) <= 5.991")
def g25(spark, d):
    reg = regions(spark, d).drop("x", "y")
    c = reg.agg(F.avg("mean").alias("mx"), F.avg("rms").alias("my"), F.var_samp("mean").alias("sxx"), F.var_samp("rms").alias("syy"), F.covar_samp("mean", "rms").alias("sxy"))
    d2 = F.expr("(syy * power(mean - mx, 2) - 2 * sxy * (mean - mx) * (rms - my) + sxx * power(rms - my, 2)) / (sxx * syy - sxy * sxy)")
    return reg.crossJoin(F.broadcast(c)).withColumn("d2", d2).where("d2 <= 5.991").select("label", R(F.sqrt("d2"), 5).alias("dist"))


# --- fits and contours ----------------------------------------------------------------------------------------------------
def _sources(spark, d):
    return blobs(spark, d, 2.5, 0.5, 7)[0].select("source_id", "ix", "iy", "w")


@query("d28_fit_sources")
def d28(spark, d):
    f = FT.fit_sources(_sources(spark, d), 0.125, 2)
    return f.select("source_id", "component", "status", "ndof", R("amplitude", 3).alias("amplitude"), R("x0", 2).alias("x0"), R("y0", 2).alias("y0"))


@query("d30_flux_density", f"SELECT s_suppkey AS id, {r('2 * pi() * s_acctbal * (1 + s_suppkey % 3) * (2 + s_suppkey % 5)', 4)} AS flux FROM supplier")
def d30(spark, d):
    from ..functions.columns import flux_density

    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("id"), R(flux_density(F.col("s_acctbal"), 1 + k % 3, 2 + k % 5), 4).alias("flux"))


@query("d38_contour_shapes")
def d38(spark, d):
    c = FT.contour_shapes(_sources(spark, d))
    return out(c, "source_id", "n_points", **{k: k for k in ("area", "perimeter", "circularity", "box_min", "elongation", "rectangularity", "roundness", "cx", "cy", "eccentricity", "ellipse_area_ratio", "ellipse_chi2")})


@query("d44_centroid_distance")
def d44(spark, d):
    return out(FT.fourier_descriptors(_sources(spark, d), 6, "distance"), "source_id", "k", modulus="modulus")


@query("d45_fourier_descriptors")
def d45(spark, d):
    return out(FT.fourier_descriptors(_sources(spark, d), 6), "source_id", "k", modulus="modulus")


@query("a46_robust_outliers")
def a46(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.count("*").cast("double").alias("c"))
    return out(FT.robust_outliers(e.select("event_type", "m", "c"), "event_type", ["m", "c"]), "event_type", "outlier", m="m", distance="distance")


@query("a47_ward_clusters")
def a47(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("bal"))
    return out(FT.ward_clusters(c, "c_mktsegment", ["bal"], 1000.0), "c_mktsegment", "cluster", bal="bal")


@query("s25_ds9_regions")
def s25(spark, d):
    return FT.ds9_regions(FT.fit_sources(_sources(spark, d), 0.125, 1))


@query("s26_ds9_polygons", "WITH b AS (SELECT s_suppkey AS id, s_suppkey % 50 AS x0, s_suppkey % 40 AS y0, s_suppkey % 50 + 3 AS x1, s_suppkey % 40 + 2 AS y1 FROM supplier) SELECT id, format('polygon {} {} {} {} {} {} {} {} # text={{S{}}}', x0 + 1, y0 + 1, x1 + 1, y0 + 1, x1 + 1, y1 + 1, x0 + 1, y1 + 1, id) AS region FROM b")
def s26(spark, d):
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(k.alias("id"), F.array(*[F.struct((k % 50 + i).alias("x"), (k % 40 + j).alias("y")) for i, j in ((0, 0), (3, 0), (3, 2), (0, 2))]).alias("p"))
    pts = F.array_join(F.transform("p", lambda q: F.concat((q["x"] + 1).cast("string"), F.lit(" "), (q["y"] + 1).cast("string"))), " ")
    return b.select("id", F.concat(F.lit("polygon "), pts, F.lit(" # text={S"), F.col("id").cast("string"), F.lit("}")).alias("region"))


# --- sources, tasks, streams ----------------------------------------------------------------------------------------------
@query("s09_fits_round_trip", f"WITH {IMG} SELECT ix, iy, {r('w')} AS w FROM img")
def s09(spark, d):
    px, _ = image(spark, d)
    enc = fits.encoded_tiles(px, 1000)

    def go(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for tx, ty, c in zip(pdf["tx"], pdf["ty"], pdf["content"]):
                h = fits.header(bytes(c))
                a = np.frombuffer(bytes(c), ">f4", h[1] * h[2], h[4]).reshape(h[2], h[1])
                iy, ix = np.mgrid[0 : h[2], 0 : h[1]]
                yield pd.DataFrame({"ix": ix.ravel() + int(1 - h[8]), "iy": iy.ravel() + int(1 - h[9]), "w": a.ravel().astype(float)})

    return out(enc.mapInPandas(go, "ix long, iy long, w double"), "ix", "iy", w="w")


@query("s35_task_json", "SELECT 'img' AS filename, 'job' || n_regionkey AS \"jobId\", n_nationkey::BIGINT AS \"IdX\", 0::BIGINT AS \"IdY\", n_nationkey::BIGINT * 10 AS ix_min, n_nationkey::BIGINT * 10 + 9 AS ix_max, 0::BIGINT AS iy_min, 9::BIGINT AS iy_max FROM nation")
def s35(spark, d):
    n = F.col("n_nationkey").cast("long")
    t = table(spark, d, "nation").select(F.lit("img").alias("filename"), F.concat(F.lit("job"), F.col("n_regionkey").cast("string")).alias("jobId"), n.alias("IdX"), F.lit(0).cast("long").alias("IdY"), (n * 10).alias("ix_min"), (n * 10 + 9).alias("ix_max"), F.lit(0).cast("long").alias("iy_min"), F.lit(9).cast("long").alias("iy_max"))
    return config.tasks_from_json(config.tasks_to_json(t))


@query("s37_options")
def s37(spark, d):
    return config.as_table(spark, config.parse("# options\nseedThr = 4.5 // sigma\nunknown = 1\nsplitInTiles = true\nminNPix = 7"))


@query("s41_sky_model")
def s41(spark, d):
    c = skymodel.true_catalog(spark, 12, 96, 96)
    return out(skymodel.sky_model(c, 96, 96, 0.1), "ix", "iy", w="w")


@query("t02_assign_tasks", "SELECT x.i AS tile_id, x.i % 4 AS worker_id FROM range(CAST(ceil((SELECT count(*) FROM embeddings) / 100.0) AS BIGINT) * 2) x(i)")
def t02(spark, d):
    px, s = image(spark, d)
    return T.assign_tasks(K.tiles(spark, *s, 32, 100), 4).select("tile_id", "worker_id")


_STATES = "SELECT user_id AS worker, CASE event_type WHEN 'click' THEN 'ON' WHEN 'error' THEN 'FAULT' ELSE 'RUNNING' END AS state, ts, event_id FROM events"


@query("t05_worker_states", f"WITH s AS ({_STATES}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) = 1) SELECT worker, state, CASE state WHEN 'ON' THEN 'free' WHEN 'RUNNING' THEN 'busy' ELSE 'unknown' END AS status FROM l")
def t05(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "ON").when(F.col("event_type") == "error", "FAULT").otherwise("RUNNING")
    return T.latest_states(e.select(F.col("user_id").alias("worker"), state.alias("state"), F.struct("ts", "event_id").alias("ts"))).select("worker", "state", "status")


@query("t06_free_workers", f"WITH s AS ({_STATES}), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) = 1) SELECT worker FROM l WHERE state = 'ON' ORDER BY worker LIMIT 10")
def t06(spark, d):
    return T.free_workers(t05(spark, d), 10).select("worker")


@query("t07_windowed_stats", f"SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(value) AS n, {rs(mean='avg(value)', rms='stddev_samp(value)', top='max(value)')} FROM events GROUP BY 1, 2")
def t07(spark, d):
    e = table(spark, d, "events")
    return out(T.windowed_stats(e, "1 day", "1 day"), "start", "event_type", "n", mean="mean", rms="rms", top="top")


@query("a41_imaging_performance", f"WITH p AS (SELECT least(greatest(floor(log10(o_totalprice) * 2)::BIGINT, 0), 20) AS bin, o_totalprice AS t, sum(l_extendedprice) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice) SELECT bin, count(*) AS n, {rs(ratio='avg(s / t)', spread='stddev_samp(s / t)', median='median(s / t)')} FROM p GROUP BY bin")
def a41(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    p = table(spark, d, "orders").join(li, "o_orderkey").withColumn("q", F.col("s") / F.col("o_totalprice"))
    b = F.least(F.greatest(F.floor(F.log10("o_totalprice") * 2), F.lit(0)), F.lit(20))
    return out(p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("q").alias("ratio"), F.stddev_samp("q").alias("spread"), F.percentile("q", 0.5).alias("median")), "bin", "n", ratio="ratio", spread="spread", median="median")


