"""FITS images: reader and writer in plain Python.

The driver lists files and reads their headers through Hadoop's file systems, so any store that Spark reads will do.
Pixels are read by bands of rows: a task opens the file, and reads only the bytes of its band and of the columns
asked for. Stores that Python can't open by ranges (`can_seek`) are read whole through Spark's binary file source.
"""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK, CARD = 2880, 80
_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
HEADER_SCHEMA = "path string, nx long, ny long, bitpix int, data_at long, bunit string, ctypex string, ctypey string, cx double, cy double, xc double, yc double, dx double, dy double, rotx double, roty double, bmaj double, bmin double, bpa double, epoch double, bscale double, bzero double"


def cards(raw: bytes) -> tuple[dict[str, str], int]:
    """Keywords of the first header and where its data begin."""
    out: dict[str, str] = {}
    for at in range(0, len(raw), CARD):
        card = raw[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return out, -(-(at + CARD) // BLOCK) * BLOCK
        if card[8:10] == "= ":
            value = card[10:].strip()
            if value.startswith("'"):
                value = value[1:].split("'")[0].strip()
            else:
                value = value.split("/")[0].strip()
            out.setdefault(key, value)
    raise ValueError("a FITS header without END")


def header(raw: bytes, path: str = "") -> tuple:
    """A row of HEADER_SCHEMA. Needs two axes; further ones must have one pixel."""
    k, at = cards(raw)
    axes = int(k.get("NAXIS", 0))
    if axes < 2 or "NAXIS1" not in k or "NAXIS2" not in k:
        raise ValueError("not an image of two axes")
    if any(int(k.get(f"NAXIS{i}", 1)) != 1 for i in range(3, axes + 1)):
        raise ValueError("further axes must have one pixel")
    num = lambda name, default: float(k[name].replace("D", "E")) if k.get(name) else default
    return (
        path, int(k["NAXIS1"]), int(k["NAXIS2"]), int(k["BITPIX"]), at, k.get("BUNIT", ""), k.get("CTYPE1", ""), k.get("CTYPE2", ""), num("CRPIX1", 0.0), num("CRPIX2", 0.0), num("CRVAL1", 0.0), num("CRVAL2", 0.0),
        num("CDELT1", 0.0), num("CDELT2", 0.0), num("CROTA1", 0.0), num("CROTA2", 0.0), num("BMAJ", 0.0), num("BMIN", 0.0), num("BPA", 0.0), num("EPOCH", 2000.0), num("BSCALE", 1.0), num("BZERO", 0.0),
    )


#: Bytes of a band of rows that one task reads at once.
BAND = 32 << 20
#: Tasks at most; further bands go to the same tasks.
TASKS = 20_000


def _paths(spark: SparkSession, path: str) -> list[str]:
    """Files under a path (a file, a folder or a pattern), without hidden ones."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store, out = at.getFileSystem(conf), []
    for found in store.globStatus(at) or []:
        inside = store.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [f.getPath().toString() for f in inside if not f.isDirectory() and not f.getPath().getName().startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def _head(spark: SparkSession, path: str) -> bytes:
    """The file's beginning up to the end of its header, read on the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, raw = jvm.org.apache.hadoop.fs.Path(path), b""
    stream = at.getFileSystem(conf).open(at)
    try:
        while True:
            block = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, BLOCK)))
            raw += block
            if len(block) < BLOCK or any(block[i : i + CARD].rstrip() == b"END" for i in range(0, BLOCK, CARD)):
                return raw
    finally:
        stream.close()


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row of HEADER_SCHEMA a file; only headers are read."""
    return spark.createDataFrame([header(_head(spark, p), p) for p in _paths(spark, path)], HEADER_SCHEMA)


def _open(path: str):
    from pyarrow import fs

    u = urlparse(path)
    if (u.scheme or "file") == "file":
        return fs.LocalFileSystem().open_input_file(u.path)
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def can_seek(path: str) -> bool:
    """Whether Python can read ranges of the file, tried on the driver."""
    try:
        _open(path).close()
    except (OSError, ValueError):
        return False
    return True


def _decoded(read, h: dict, x0: int, x1: int, y0: int, y1: int):
    """Frames of pixels of rows y0 .. y1 and columns x0 .. x1. read(n, at) gives n bytes from a place; whole rows are read at once where most of them is wanted."""
    import pandas as pd

    kind = np.dtype(_TYPES[h["bitpix"]])
    nx, n, size, at = h["nx"], x1 - x0 + 1, kind.itemsize, h["data_at"]
    many = max(1, (BAND // 8) // max(1, nx * size)) if 2 * n >= nx else 1
    for lo in range(y0, y1 + 1, many):
        hi = min(y1, lo + many - 1)
        # From the first wanted pixel of the first row to the last one of the last row.
        length = ((hi - lo) * nx + n) * size
        raw = read(length, at + (lo * nx + x0) * size)
        if len(raw) != length:
            raise ValueError(f"{h['path']} ends within its pixels")
        v = np.frombuffer(raw + bytes((nx - n) * size), kind).reshape(hi - lo + 1, nx)[:, :n]
        w = v.astype(float) * h["bscale"] + h["bzero"]
        if h["blank"] is not None:
            w[v == h["blank"]] = 0.0
        yield pd.DataFrame({"path": h["path"], "ix": np.tile(np.arange(x0, x1 + 1), hi - lo + 1), "iy": np.repeat(np.arange(lo, hi + 1), n), "w": w.ravel()})


def read_image(spark: SparkSession, path: str, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None, band: int = BAND) -> DataFrame:
    """(path, ix, iy, w) of the pixel range (inclusive); nulls of the file are 0, other values are read as they are.

    A file of any size is dealt to as many tasks as it has bands of so many bytes, at least one row each. Only the
    bytes of the range are read. A range beyond the image has no pixels.
    """
    names, bands, whole = [c.split()[0] for c in HEADER_SCHEMA.split(", ")], [], []
    for p in _paths(spark, path):
        raw = _head(spark, p)
        h = dict(zip(names, header(raw, p)))
        h = {k: h[k] for k in ("path", "nx", "ny", "bitpix", "data_at", "bscale", "bzero")}
        blank = cards(raw)[0].get("BLANK")
        h["blank"] = None if blank is None else int(blank)
        x0, x1 = (0, h["nx"] - 1) if x is None else (max(0, x[0]), min(h["nx"] - 1, x[1]))
        y0, y1 = (0, h["ny"] - 1) if y is None else (max(0, y[0]), min(h["ny"] - 1, y[1]))
        if x0 > x1 or y0 > y1:
            continue
        if not can_seek(p):
            whole.append((h, x0, x1, y0, y1))
            continue
        rows = max(1, band // max(1, (x1 - x0 + 1) * abs(h["bitpix"]) // 8))
        bands += [(*h.values(), x0, x1, lo, min(y1, lo + rows - 1)) for lo in range(y0, y1 + 1, rows)]
    schema = "path string, nx long, ny long, bitpix int, data_at long, bscale double, bzero double, blank long, x0 long, x1 long, y0 long, y1 long"
    out_schema = "path string, ix long, iy long, w double"

    def by_bands(batches):
        for pdf in batches:
            for r in pdf.astype(object).to_dict("records"):
                r["blank"] = None if r["blank"] is None or r["blank"] != r["blank"] else int(r["blank"])
                with _open(r["path"]) as f:
                    yield from _decoded(lambda n, at: f.read_at(n, at), r, r["x0"], r["x1"], r["y0"], r["y1"])  # noqa: B023

    def by_files(batches):
        wanted = {h["path"]: (h, *box) for h, *box in whole}
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                h, *box = wanted[p]
                yield from _decoded(lambda n, at: bytes(c[at : at + n]), h, *box)  # noqa: B023

    out = spark.createDataFrame(spark.sparkContext.parallelize(bands, max(1, min(len(bands), TASKS))), schema).mapInPandas(by_bands, out_schema)
    if whole:
        files = spark.read.format("binaryFile").load([h["path"] for h, *_ in whole]).select("path", "content")
        out = out.unionByName(files.mapInPandas(by_files, out_schema))
    return out


def encode(image: np.ndarray, keywords: dict[str, float | str] | None = None) -> bytes:
    """A FITS file of a 2-D array [iy, ix] of floats."""
    rows = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", image.shape[1]), ("NAXIS2", image.shape[0]), *(keywords or {}).items()]
    text = ""
    for key, v in rows:
        value = ("T" if v else "F").rjust(20) if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else repr(v).rjust(20)
        text += f"{key:<8}= {value}"[:CARD].ljust(CARD)
    text += "END".ljust(CARD)
    head = text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")
    data = image.astype(">f4").tobytes()
    return head + data + b"\0" * (-len(data) % BLOCK)


def encoded_tiles(px: DataFrame, tile: int = 1000, keywords: dict | None = None) -> DataFrame:
    """(tx, ty, content): one FITS file a tile, each built by one task; missing pixels are 0."""

    def one(pdf):
        import pandas as pd

        x0, y0 = pdf["ix"].min(), pdf["iy"].min()
        a = np.zeros((pdf["iy"].max() - y0 + 1, pdf["ix"].max() - x0 + 1))
        a[pdf["iy"] - y0, pdf["ix"] - x0] = pdf["w"]
        head = {"CRPIX1": float(1 - x0), "CRPIX2": float(1 - y0), **(keywords or {})}
        return pd.DataFrame({"tx": [pdf["tx"].iloc[0]], "ty": [pdf["ty"].iloc[0]], "content": [encode(a, head)]})

    t = px.select("ix", "iy", "w", F.floor(F.col("ix") / tile).alias("tx"), F.floor(F.col("iy") / tile).alias("ty"))
    return t.groupBy("tx", "ty").applyInPandas(one, "tx long, ty long, content binary")
