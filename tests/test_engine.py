import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import columns as C
from skyloom.operators import background as B
from skyloom.operators import catalog as K
from skyloom.operators import detect as D
from skyloom.operators import fit as FT
from skyloom.operators import graph as G
from skyloom.operators import segment as SG
from skyloom.operators import stats as S
from skyloom.operators import stencil as ST
from skyloom.sources import config, fits, skymodel
from skyloom.streaming import workers as T


def frame(spark, a):
    rows = [(int(x), int(y), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "ix long, iy long, w double")


def back(df, shape, name="w"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.iy, r.ix] = r[name]
    return out


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(S, "COLLECT", 5)
    monkeypatch.setattr(S, "ACCURACY", 50)
    rng = random.Random(0)
    for v in ([rng.gauss(0, 1) for _ in range(3001)], [float(rng.randrange(5)) for _ in range(800)], [1.5], [-1.0, 2.0]):
        df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "w double")
        got = S.quantile(df, "w", [0.0, 0.25, 0.5, 0.9, 1.0])
        assert np.allclose(got, np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=0, atol=1e-12)
    assert math.isnan(S.quantile(spark.createDataFrame([], "w double"), "w", [0.5])[0])


def test_moments_merge(spark):
    v = np.random.default_rng(1).normal(2, 3, 1000)
    df = spark.createDataFrame([(float(x), i % 7) for i, x in enumerate(v)], "w double, t int")
    a = df.agg(*S.moments()).collect()[0]
    b = S.merged_moments(df.groupBy("t").agg(*S.moments())).collect()[0]
    for k in ("n", "mean", "w_min", "w_max", "m2", "m3", "m4"):
        assert math.isclose(a[k], b[k], rel_tol=1e-9)
    assert math.isclose(a.m4, ((v - v.mean()) ** 4).sum(), rel_tol=1e-9)


def test_biweight_and_clipping_ignore_outliers(spark):
    v = [*np.random.default_rng(2).normal(10, 1, 500).tolist(), *[1000.0] * 20]
    df = spark.createDataFrame([("g", x) for x in v], "g string, w double")
    b = S.biweight(df, ["g"]).collect()[0]
    c = S.clipped(df, ["g"], rounds=10, tol=1e-3).collect()[0]
    assert abs(b.location - 10) < 0.2 and abs(b.scale - 1) < 0.2
    assert abs(c.median - 10) < 0.2 and abs(c.rms - 1) < 0.2 and c.n <= 500


def test_stencils_are_the_same_for_any_tiling(spark):
    a = np.random.default_rng(3).normal(size=(40, 53))
    px = frame(spark, a)
    k = np.arange(15, dtype=float).reshape(3, 5)
    for border, mode in (("zero", "constant"), ("mirror", "reflect")):
        p = np.pad(a, ((1, 1), (2, 2)), mode=mode)
        want = sum(k[j, i] * p[2 - j : 2 - j + 40, 4 - i : 4 - i + 53] for j in range(3) for i in range(5))
        for tile in (16, 256):
            turned = k[::-1, ::-1]
            got = ST.tiled_apply(px, 2, lambda x, t=turned: ST.correlate(x, t), (53, 40), border, tile=tile)
            assert np.allclose(back(got, a.shape), want)
    whole = back(ST.wavelet(px, 3, (53, 40)), a.shape, "smooth")
    planes = ST.wavelet(px, 3, (53, 40)).select("ix", "iy", (F.col("w1") + F.col("w2") + F.col("w3") + F.col("smooth")).alias("w"))
    assert np.allclose(back(planes, a.shape), a) and np.isfinite(whole).all()


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(4)
    m = rng.random((45, 37)) < 0.45
    seen, want = {}, {}
    for x in range(37):
        for y in range(45):
            if m[y, x] and (x, y) not in seen:
                stack, key = [(x, y)], x * 45 + y
                seen[x, y] = key
                while stack:
                    u, v = stack.pop()
                    want[u, v] = key
                    for p in ((u + 1, v), (u - 1, v), (u, v + 1), (u, v - 1)):
                        if 0 <= p[0] < 37 and 0 <= p[1] < 45 and m[p[1], p[0]] and p not in seen:
                            seen[p] = key
                            stack.append(p)
    px = spark.createDataFrame([(int(x), int(y)) for y, x in zip(*np.nonzero(m))], "ix long, iy long")
    for tile in (8, 64):
        assert {(r.ix, r.iy): r.component for r in D.label_mask(px, (37, 45), tile=tile).collect()} == want


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (5, 5), (400, 400)]
    got = {r.id: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(400,), (7,)], "id long")).collect()}
    assert got == {400: 400, 7: 0}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_finder_recovers_sky_model(spark):
    cat = spark.createDataFrame([(i, "point", 15.0 + 25 * (i % 4), 15.0 + 25 * (i // 4), 10.0, 3.0, 0.0) for i in range(16)], "source_id long, shape string, x0 double, y0 double, amp double, size double, theta double")
    px = skymodel.sky_model(cat, 108, 108, 0.1)
    found = D.find_compact(px, (108, 108), 5.0, 2.6, 5, (54, 54), (27, 27))
    st = D.blob_stats(found).withColumnRenamed("source_id", "id")
    assert st.count() == 16
    pos = st.select("id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    m = K.match_by_position(cat.select(F.col("source_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), pos, 2.0)
    assert m.count() == 16 and m.agg(F.max("dist")).collect()[0][0] < 0.5
    f = FT.fit_sources(found.select("source_id", "ix", "iy", "w"), 0.1, 1).collect()
    good = [r for r in f if r.status in (FT.CONVERGED, FT.AT_LIMIT)]
    assert len(good) == 16 and all(abs(r.amplitude - 10) < 1 and abs(r.sigma_x - 1.2) < 0.2 for r in good)


def test_background_grid(spark):
    y, x = np.mgrid[0:60, 0:60]
    a = 5 + 0.1 * x + 0.05 * y + np.random.default_rng(5).normal(0, 0.01, (60, 60))
    out = B.local_background(frame(spark, a), 60, 60, (20, 20), (10, 10), "mean")
    b = back(out, a.shape, "bkg")
    assert np.abs(b - a)[15:40, 15:40].max() < 0.15
    assert B.tile_starts(100, 30, 1.0) == [(0, 29), (30, 59), (60, 89), (90, 99)]


def test_contours_and_ellipses():
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    p = np.stack([3 + 5 * np.cos(t), 7 + 2 * np.sin(t)], axis=1)
    cx, cy, a, b, _ = FT.fit_ellipse(p)
    assert np.allclose([cx, cy, max(a, b), min(a, b)], [3, 7, 5, 2], atol=1e-6)
    s = FT.shape_of(p)
    assert abs(s[0] - np.pi * 10) < 0.2 and np.allclose(s[6:8], [3, 7])


def polygon_pixels(mask):
    yy, xx = np.nonzero(mask)
    return xx, yy


def test_outlines_follow_concave_sources():
    m = np.zeros((9, 9), bool)
    m[1:8, 1:3] = m[1:3, 1:8] = True  # an L of two pixels' width
    p = FT.contour_of(*polygon_pixels(m))
    s = dict(zip([c.split()[0] for c in FT.SHAPE_SCHEMA.split(", ")][2:], FT.shape_of(p)))
    # Through the centres: 6 x 6 less the notch, whose corner is cut by one diagonal step.
    assert s["area"] == 6 * 1 + 5 * 1 + 0.5 and np.isclose(s["perimeter"], 6 + 1 + 4 + np.sqrt(2) + 4 + 1 + 6)
    assert s["circularity"] < 0.3 and np.isclose(s["box_area"], s["box_min"] * s["box_min"] / (1 - s["elongation"]))
    assert {(1.0, 1.0), (7.0, 1.0), (1.0, 7.0)} <= set(map(tuple, p.tolist())) and (7.0, 7.0) not in set(map(tuple, p.tolist()))


def test_outlines_of_odd_sources():
    assert FT.contour_of(np.array([4]), np.array([7])).tolist() == [[4, 7]]
    assert sorted(FT.contour_of(np.array([4, 5]), np.array([7, 8])).tolist()) == [[4, 7], [5, 8]]
    assert len(FT.contour_of(np.arange(6), np.zeros(6, int))) == 10
    ring = np.ones((7, 7), bool)
    ring[2:5, 2:5] = False
    assert FT._area(FT.contour_of(*polygon_pixels(ring))) == 36 and len(FT.contour_of(*polygon_pixels(ring))) == 24
    two = np.zeros((5, 12), bool)
    two[0:2, 0:2] = two[1:5, 6:12] = True
    assert FT.contour_of(*polygon_pixels(two)).min(axis=0).tolist() == [6, 1]
    eight = np.zeros((5, 5), bool)
    eight[0:3, 0:3] = eight[2:5, 2:5] = True  # two squares that share a corner pixel
    assert FT._area(FT.contour_of(*polygon_pixels(eight))) == 9
    rng = np.random.default_rng(3)
    for _ in range(200):  # each border pixel of the largest part that touches the outside is on the outline, and no other
        m = rng.random((8, 9)) < 0.55
        if not m.any():
            continue
        lab = np.pad(D._runs(m, True), 1)
        big = lab == np.bincount(lab[lab > 0]).argmax()
        outside = D._runs(~big, False)
        outside = outside == outside[0, 0]
        near = np.zeros_like(big)
        for dx, dy in FT.AROUND[::2]:
            near |= np.roll(outside, (dy, dx), (0, 1))
        want = {(int(x) - 1, int(y) - 1) for y, x in zip(*np.nonzero(big & near))}
        assert {(int(x), int(y)) for x, y in FT.contour_of(*polygon_pixels(m))} == want


def test_shapes_and_descriptors(spark):
    yy, xx = np.mgrid[0:41, 0:41]
    disc, bar = (xx - 20) ** 2 + (yy - 20) ** 2 <= 225, (abs(yy - 20) <= 2) & (abs(xx - 20) <= 15)
    rows = [(k, int(x), int(y)) for k, m in enumerate((disc, bar)) for x, y in zip(*polygon_pixels(m))] + [(2, 0, 0), (2, 1, 0)]
    px = spark.createDataFrame(rows, "source_id long, ix long, iy long")
    s = {r.source_id: r for r in FT.contour_shapes(px).collect()}
    assert s[2].area is None and (s[2].n_points, s[2].box_min) == (2, 0)
    assert abs(s[0].cx - 20) < 1e-9 and s[0].circularity > 0.8 and abs(s[0].ellipse_area_ratio - 1) < 0.03 and s[0].ellipse_chi2 < 0.5
    assert (s[1].area, s[1].perimeter, s[1].box_min) == (120, 68, 4) and np.isclose(s[1].elongation, 1 - 4 / 30) and s[1].rectangularity == 1
    wedge = px.where("source_id = 0 AND (ix < 20 OR abs(iy - 20) < 4)").unionByName(px.where("source_id = 2"))
    both = px.unionByName(wedge.where("source_id = 0").withColumn("source_id", F.lit(3).cast("long")))
    position = FT.fourier_descriptors(both, 6).collect()
    assert sorted((r.source_id, r.k) for r in position) == [(i, k) for i in (0, 1, 3) for k in range(2, 8)]
    assert max(r.modulus for r in position if r.source_id == 0) < 0.05  # a disc is its first harmonic
    distance = FT.fourier_descriptors(both, 6, "distance").collect()
    assert [r.k for r in sorted(distance, key=lambda r: r.k) if r.source_id == 3] == list(range(6)) and {r.source_id for r in distance} == {3}
    assert [r.modulus for r in distance if r.k == 1] == [1.0]


def test_fits_round_trip(spark, tmp_path):
    a = np.random.default_rng(6).normal(size=(12, 17)).astype(np.float32)
    (tmp_path / "a.fits").write_bytes(fits.encode(a, {"CRPIX1": 3.5, "BUNIT": "Jy/beam"}))
    h = fits.read_headers(spark, str(tmp_path)).collect()[0]
    assert (h.nx, h.ny, h.cx, h.bunit, h.epoch) == (17, 12, 3.5, "Jy/beam", 2000.0)
    assert np.allclose(back(fits.read_image(spark, str(tmp_path)), a.shape), a)
    part = fits.read_image(spark, str(tmp_path), (2, 4), (5, 6))
    assert part.count() == 6 and part.agg(F.min("ix"), F.max("iy")).collect()[0][:] == (2, 6)
    with pytest.raises(ValueError):
        fits.header(b"SIMPLE  =                    T".ljust(80) + b"NAXIS   =                    1".ljust(80) + b"END".ljust(80))


def test_options_and_jobs():
    with pytest.warns(UserWarning, match="no option nope"):
        o = config.parse("seedThr = 7\n# minNPix = 1\nsplitInTiles=T\nnope = 3\noutputFile = a.root // where")
    assert (o.seedThr, o.minNPix, o.splitInTiles, o.outputFile, o.inputImage) == (7.0, 10, True, "a.root", "img")
    for bad in ("bkgEstimator = 9", "seedThr = 0", "spSize = 5", "spSize = many"):  # bounds are exclusive
        with pytest.warns(UserWarning):
            assert config.parse(bad) == config.Options()
    assert len(config.fields(o)) == 182 and all(lo < hi for lo, hi in config.LIMITS.values())
    assert config.valid_job('{"options": [{"name": "a", "value": 1}]}') and not config.valid_job('{"options": []}') and not config.valid_job("x")


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "a" if i % 2 else "b", float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.windowed_stats(stream, "10 minutes", "1 hour").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("win")
    assert got.agg(F.sum("n")).collect()[0][0] == 120 and got.count() == 12
    q = T.run_tasks(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [60, 60]


def test_superpixels_follow_values(spark):
    a = np.zeros((40, 40))
    a[:, 20:] = 10
    px = frame(spark, a)
    lab = SG.superpixels(px, (40, 40), 20, 0.1, 5, 4)
    mixed = lab.groupBy("label").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo <> hi")
    assert mixed.count() == 0
    one = SG.merge_mutual(lab, 1.0)
    assert one.select("label").distinct().count() == 2


def test_expressions(spark):
    r = spark.range(1).select(*[C.erfc(F.lit(x)).alias(f"e{i}") for i, x in enumerate((0.0, 0.5, 1.9, 2.5, 5.0))]).collect()[0]
    assert np.allclose(list(r), [math.erfc(x) for x in (0.0, 0.5, 1.9, 2.5, 5.0)], rtol=1e-9)


def test_finder_writes_its_tables(spark, tmp_path):
    from skyloom.plans import finder

    cat = spark.createDataFrame([(i, "point", 20.0 + 30 * i, 30.0, 10.0, 3.0, 0.0) for i in range(3)], "source_id long, shape string, x0 double, y0 double, amp double, size double, theta double")
    px = skymodel.sky_model(cat, 100, 60, 0.1)
    px.write.parquet(str(tmp_path / "img"))
    o = config.parse("boxSizeX = 30\nboxSizeY = 30\ngridSizeX = 0.5\ngridSizeY = 0.5\ncompactSourceSearchNIters = 1")
    got = finder.run(spark, finder.open_image(spark, str(tmp_path / "img")), o, str(tmp_path / "out"), beam_pixels=9.0)
    assert sorted(r.name for r in got["SourceInfo"].collect()) == ["S1", "S2", "S3"]
    assert {r.type for r in got["SourceInfo"].collect()} == {2} and got["FitInfo"].where("amplitude IS NOT NULL").count() == 3
    assert spark.read.text(str(tmp_path / "out/ds9")).count() == 3 and got["Maps"].count() == 6000


def test_finder_follows_its_options(spark, tmp_path):
    from skyloom.plans import finder

    cat = spark.createDataFrame([(0, "gauss", 48.0, 32.0, 10.0, 8.0, 0.0)], "source_id long, shape string, x0 double, y0 double, amp double, size double, theta double")
    px = skymodel.sky_model(cat, 96, 64, 0.1)
    px.write.parquet(str(tmp_path / "img"))
    px = finder.open_image(spark, str(tmp_path / "img"))
    same = finder.smoothed(px, (96, 64), config.parse("usePreSmoothing = false"))
    assert same is px
    top = {k: finder.smoothed(px, (96, 64), config.Options(smoothFilter=k)).agg(F.max("w")).collect()[0][0] for k in (1, 2)}
    whole = px.agg(F.max("w")).collect()[0][0]
    assert 0 < top[1] <= whole and 0 < top[2] <= whole and top[1] != top[2]
    o = config.parse("searchExtendedSources = true\nextendedSearchMethod = 1\nwtScaleSearchMin = 3\nwtScaleSearchMax = 4\nuseResidualInExtendedSearch = false\nseedThr = 3\ncompactSourceSearchNIters = 1")
    got = finder.run(spark, px, o, str(tmp_path / "out"), beam_pixels=9.0)
    assert got["ConfigInfo"].where("name = 'searchExtendedSources'").collect()[0].value == "True"
    assert got["PixelInfo"].where("extended").count() > 0
