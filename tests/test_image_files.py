import struct

import numpy as np
import pytest

from skyloom.sources import image


def bitmap(grey):
    """A BMP file of an array of grey values, its first row at the bottom."""
    rows = b"".join(np.repeat(r, 3).astype(np.uint8).tobytes().ljust(-(-3 * len(r) // 4) * 4, b"\0") for r in grey)
    h, w = grey.shape
    return struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_unreadable_files_are_an_error_unless_skipped(spark, tmp_path):
    a = np.array([[10, 20, 30], [200, 100, 0]])
    (tmp_path / "a.bmp").write_bytes(bitmap(a))
    assert sorted((r.iy, r.ix, r.w) for r in image.image_files(spark, str(tmp_path)).collect()) == [(y, x, a[y, x]) for y in range(2) for x in range(3)]
    assert [r.ix for r in image.image_files(spark, str(tmp_path), True).where("w = 10").collect()] == [2]
    (tmp_path / "b.bmp").write_bytes(b"no picture")
    with pytest.raises(Exception, match="not an image"):
        image.image_files(spark, str(tmp_path)).collect()
    assert image.image_files(spark, str(tmp_path), skip_unreadable=True).count() == 6
