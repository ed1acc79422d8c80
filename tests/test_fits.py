"""FITS files are read by bands of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import fits

NX, NY = 50, 40


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(9).normal(size=(NY, NX)).astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, image):
    d = tmp_path_factory.mktemp("fits")
    (d / "a.fits").write_bytes(fits.encode(image, {f"KEY{i}": float(i) for i in range(100)}))  # a header of several blocks
    (d / "b.fits").write_bytes(fits.encode(image * 2))
    (d / "_note").write_text("no image")
    return d


def array(df, shape=(NY, NX)):
    out = np.full(shape, np.nan)
    rows = df.collect()
    for r in rows:
        out[r.iy, r.ix] = r.w
    assert len({(r.ix, r.iy) for r in rows}) == len(rows)
    return out


def test_bands_make_up_the_image(spark, folder, image):
    got = fits.read_image(spark, str(folder / "a.fits"), band=NX * 4 * 3)
    assert got.rdd.getNumPartitions() == 14 and np.array_equal(array(got), image)
    both = fits.read_image(spark, str(folder))
    assert both.count() == 2 * NX * NY and np.array_equal(array(both.where(F.col("path").endswith("b.fits"))), image * 2)
    assert sorted(r.nx for r in fits.read_headers(spark, str(folder / "*.fits")).collect()) == [NX, NX]
    with pytest.raises(FileNotFoundError):
        fits.read_image(spark, str(folder / "c*.fits"))


@pytest.mark.parametrize("seek", [True, False])
def test_ranges(spark, folder, image, monkeypatch, seek):
    if not seek:
        monkeypatch.setattr(fits, "can_seek", lambda p: False)
    for x, y in (((3, 45), (5, 30)), ((7, 9), (0, 39)), ((-5, 200), (38, 99))):
        got = array(fits.read_image(spark, str(folder / "a.fits"), x, y, band=600))
        want = np.full((NY, NX), np.nan)
        part = np.s_[max(0, y[0]) : y[1] + 1, max(0, x[0]) : x[1] + 1]
        want[part] = image[part]
        assert np.array_equal(got, want, equal_nan=True)
    assert fits.read_image(spark, str(folder / "a.fits"), (60, 70)).count() == 0


def test_only_the_bytes_of_a_range_are_read(folder):
    raw = (folder / "a.fits").read_bytes()
    h = dict(zip([c.split()[0] for c in fits.HEADER_SCHEMA.split(", ")], fits.header(raw, "a"))) | {"blank": None}
    read = []

    def reader(n, at):
        read.append(n)
        return raw[at : at + n]

    assert sum(len(f) for f in fits._decoded(reader, h, 7, 9, 10, 19)) == 30 and read == [12] * 10
    read.clear()
    assert sum(len(f) for f in fits._decoded(reader, h, 0, NX - 1, 10, 19)) == 10 * NX and read == [10 * NX * 4]


def test_scaled_integers_with_blanks(spark, tmp_path):
    v = np.array([[1, -9, 3], [4, 5, -9]], ">i2")
    cards = [("SIMPLE", "T"), ("BITPIX", "16"), ("NAXIS", "2"), ("NAXIS1", "3"), ("NAXIS2", "2"), ("BLANK", "-9"), ("BSCALE", "0.5"), ("BZERO", "10.0")]
    head = "".join(f"{k:<8}= {x:>20}".ljust(80) for k, x in cards) + "END".ljust(80)
    data = v.tobytes()
    (tmp_path / "i.fits").write_bytes(head.ljust(2880).encode() + data + bytes(-len(data) % 2880))
    assert array(fits.read_image(spark, str(tmp_path / "i.fits")), (2, 3)).tolist() == [[10.5, 0.0, 11.5], [12.0, 12.5, 0.0]]


def test_a_file_that_ends_early_is_an_error(spark, folder, tmp_path):
    (tmp_path / "short.fits").write_bytes((folder / "b.fits").read_bytes()[:6000])
    with pytest.raises(Exception, match="ends within its pixels"):
        fits.read_image(spark, str(tmp_path / "short.fits")).count()
