"""Results of stencils don't depend on the tiles, and passes with margins give what one array gives."""

import numpy as np
import pytest

from skyloom.operators import segment as SG
from skyloom.operators import stencil as ST
from skyloom.plans import finder
from skyloom.sources import config

NX, NY = 96, 64


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:NY, :NX]
    return rng.normal(size=(NY, NX)) * 0.3 + 3 * np.exp(-((x - 40) ** 2 + (y - 30) ** 2) / 300.0)


@pytest.fixture(scope="module")
def px(spark, image):
    return spark.createDataFrame([(i, j, float(image[j, i])) for j in range(NY) for i in range(NX)], "ix long, iy long, w double")


def array(df, w="w"):
    out = np.zeros((NY, NX))
    for r in df.collect():
        out[r.iy, r.ix] = r[w]
    return out


def test_skeleton_of_a_thick_mask(spark, px, image):
    el, m, want = ST.element("cross", 3), (image >= 0.5).astype(float), np.zeros((NY, NX))
    pad = np.pad(m, 80)
    out = np.zeros_like(pad)
    while pad.any():
        e = ST._rank(pad, el, False)
        out = np.maximum(out, pad - ST._rank(e, el, True))
        pad = e
    want = {(i, j) for j, i in zip(*np.nonzero(out[80:-80, 80:-80]))}
    solid = spark.range(NX * NY).selectExpr("id % 96 AS ix", "id div 96 AS iy", "1D AS w")
    for tile, rounds in ((256, 20), (32, 2)):
        assert {(r.ix, r.iy) for r in ST.skeleton(px, 0.5, 3, (NX, NY), rounds, tile).collect()} == want
    assert {(r.ix, r.iy) for r in ST.skeleton(solid, 0.5, 3, (NX, NY), 5, 32).collect()} == {(r.ix, r.iy) for r in ST.skeleton(solid, 0.5, 3, (NX, NY), 40).collect()}


def test_multi_scale_mask(px):
    a, b = (array(ST.multi_scale_mask(px, (NX, NY), [1.0, 2.0], tile=t), "n_scales") for t in (32, 256))
    assert (a == b).all() and a.sum() > 50


def test_level_set(px):
    a, b = (array(SG.chan_vese(px, (NX, NY), 25, tile=t)) for t in (32, 256))
    assert (a == b).all() and 100 < a.sum() < NX * NY - 100


def test_nine_wavelet_scales(px, image):
    got = ST.wavelet(px, 9, (NX, NY))
    f = np.pad(image, 1100, mode="reflect")
    total = np.zeros((NY, NX))
    for s in range(9):
        g = ST.correlate(f, ST.B3, 2**s)
        plane = (f - g)[1100:-1100, 1100:-1100]
        f = g
        if s in (0, 6, 7, 8):
            assert np.abs(array(got, f"w{s + 1}") - plane).max() < 1e-9
        total += plane
    assert np.abs(array(got, "smooth") + total - image).max() < 1e-9


def test_changed_options_that_do_nothing_are_named():
    o = config.parse("seedThr = 4\nmergeThr = 2\nsearchNestedSources = false")
    assert finder.ignored(o) == ["searchNestedSources"] and finder.ignored(config.Options()) == []
