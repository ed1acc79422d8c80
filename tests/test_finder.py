"""The finder does what its options say."""

import warnings

import numpy as np
from pyspark.sql import functions as F

from skyloom.plans import finder
from skyloom.sources import config, skymodel


def sky(spark, rows, nx=96, ny=64):
    cat = spark.createDataFrame(rows, "source_id long, shape string, x0 double, y0 double, amp double, size double, theta double")
    return skymodel.sky_model(cat, nx, ny, 0.1)


BASE = "boxSizeX = 32\nboxSizeY = 32\ngridSizeX = 0.5\ngridSizeY = 0.5\ncompactSourceSearchNIters = 1\n"


def test_background_options(spark):
    o = config.Options()
    assert finder.background_boxes((400, 300), o, 2.0) == ((40, 40), (8, 8)) and finder.background_boxes((10, 300), o, 2.0)[0] == (10, 40)
    o.useBeamInfoInBkg, o.boxSizeX, o.boxSizeY = False, 0.1, 0.5
    assert finder.background_boxes((400, 300), o)[0] == (40, 150)
    px = sky(spark, [(0, "point", 20.0, 30.0, 10.0, 3.0, 0.0)]).cache()
    flat = {}
    for k in finder.ESTIMATORS:
        one = finder.with_background(px, (96, 64), config.Options(useLocalBkg=False, bkgEstimator=k), (32, 32), (16, 16)).select("bkg", "rms").distinct().collect()
        assert len(one) == 1 and 0 < one[0].rms < 1
        flat[k] = one[0].rms
    assert flat[1] > flat[4]  # the source widens the plain rms only
    twice = [finder.with_background(px, (96, 64), config.Options(use2ndPassInLocalBkg=k), (32, 32), (16, 16)).agg(F.sum("rms")).collect()[0][0] for k in (False, True)]
    assert twice[0] != twice[1]


def test_selection_cuts(spark, tmp_path):
    yy, xx = np.mgrid[0:40, 0:60]
    a = np.random.default_rng(7).normal(0, 0.1, (40, 60))
    a[10:15, 10:15] += 10  # a square
    a[25:28, 10:40] += 10  # a bar
    a[33, 45:57] += 10  # a line
    px = spark.createDataFrame([(int(x), int(y), float(a[y, x])) for y in range(40) for x in range(60)], "ix long, iy long, w double")

    quick = "useLocalBkg = false\ncompactSourceSearchNIters = 1\nsaveConfig = false\n"
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="option .* changes nothing here")
        got = finder.run(spark, px, config.parse(quick + "useMinBoundingBoxCut = true"), str(tmp_path / "out"))
    assert "ConfigInfo" not in got and got["SourceInfo"].count() == 2 and got["PixelInfo"].count() == 25 + 90 + 12

    def kinds(more=""):
        rows = finder.catalog_of(got["PixelInfo"], config.parse(more), 1.0)[0].where("good").collect()
        return {(r.ix_min, r.iy_min): (r.type, r.fittable) for r in rows}

    square, bar, line = (10, 10), (10, 25), (45, 33)
    assert kinds() == {square: (2, True), bar: (2, True), line: (2, True)}
    assert kinds("useMinBoundingBoxCut = true").keys() == {square, bar}
    assert kinds("useElongCut = true") == {square: (2, True), bar: (1, False), line: (2, True)}
    assert kinds("useCircRatioCut = true\nuseMinBoundingBoxCut = true") == {square: (2, True), bar: (1, False)}
    assert kinds("useMaxNPixCut = true\npsMaxNPix = 30")[bar] == (1, False) and kinds("useNBeamsCut = true\npsNBeamsThr = 20")[line] == (2, True)
    assert {k[0] for k in kinds("applySourceSelection = false").values()} == {1}
    assert finder.run(spark, px, config.parse(quick + "searchCompactSources = false"), str(tmp_path / "none"))["SourceInfo"].count() == 0


def test_nested_negative_and_merged_sources(spark, tmp_path):
    px = sky(spark, [(0, "gauss", 48.0, 32.0, 10.0, 8.0, 0.0), (1, "point", 54.0, 32.0, 30.0, 1.5, 0.0)])
    flat = BASE + "useLocalBkg = false\nmergeThr = 2.6\nminNPix = 5\nuseMaxNPixCut = true\npsMaxNPix = 50\n"
    got = finder.run(spark, px, config.parse(flat), str(tmp_path / "a"), nested=True)
    inner = got["NestedInfo"].collect()
    mothers = {r.source_id for r in got["SourceInfo"].collect()}
    assert inner and {r.mother_id for r in inner} <= mothers and any(abs(r.sx - 54) < 2 and abs(r.sy - 32) < 2 for r in inner)
    assert got["FitInfo"].where("nested").count() > 0 and got["FitInfo"].where("NOT nested").count() == 0  # the mother is too large for a fit
    assert "NestedInfo" not in finder.run(spark, px, config.parse(flat + "saveBkgMap = false"), str(tmp_path / "b"))
    low = px.select("ix", "iy", F.when(F.col("ix").between(5, 9) & F.col("iy").between(5, 9), F.col("w") - 20).otherwise(F.col("w")).alias("w"))
    count = lambda more: finder.run(spark, low, config.parse(flat + more), str(tmp_path / "c"))["SourceInfo"].where("ix_max < 12 AND iy_max < 12 AND flux < 0").count()
    assert (count(""), count("searchNegativeExcess = true")) == (0, 1)


def test_touching_sources_merge_by_kind(spark):
    rows = [(1, 0, 0, False), (1, 1, 0, False), (2, 2, 1, False), (3, 3, 2, True), (3, 3, 1, True), (4, 9, 9, True), (5, 10, 9, True), (6, 30, 3, False), (7, 30, 3, True), (7, 31, 3, True)]
    found = spark.createDataFrame([(s, x, y, 1.0, 2.0, e) for s, x, y, e in rows], "source_id long, ix long, iy long, w double, z double, extended boolean")

    def groups(**kinds):
        out = {}
        for r in finder.merged(found, config.Options(**kinds)).collect():
            out.setdefault(r.source_id, []).append((r.ix, r.iy))
        return {k: len(v) for k, v in out.items()}

    assert groups(mergeCompactSources=True) == {1: 3, 3: 2, 4: 1, 5: 1, 6: 1, 7: 2}
    assert groups(mergeExtendedSources=True) == {1: 2, 2: 3, 4: 2, 6: 2}
    assert groups(mergeCompactSources=True, mergeExtendedSources=True) == {1: 5, 4: 2, 6: 2}
    assert groups() == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 2}
    both = finder.merged(found, config.Options(mergeExtendedSources=True))
    types = {r.source_id: (r.type, r.point_like) for r in finder.catalog_of(both, config.Options(), 1.0)[0].collect()}
    assert types == {1: (2, True), 2: (4, False), 4: (3, False), 6: (4, False)}
