"""Supporting operators: checked writes of pixels, masks, peaks of morphology, region parameters, source documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as C
from . import stencil as ST


# --- pixels ---------------------------------------------------------------------------------------------------------------
def written_pixels(px: DataFrame, new: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """`px` with the pixels of `new` (ix, iy, w) in it: those out of range, null, NaN or infinite are rejected, the others overwrite.

    Of several writes of one pixel the greatest value stays, whatever their order.
    """
    inside = F.col("ix").between(0, shape[0] - 1) & F.col("iy").between(0, shape[1] - 1)
    good = new.where(inside & F.col("w").isNotNull() & ~F.isnan("w") & (F.abs("w") < float("inf"))).groupBy("ix", "iy").agg(F.max("w").alias("w"))
    return px.join(good.select("ix", "iy"), ["ix", "iy"], "left_anti").select("ix", "iy", "w").unionByName(good.select("ix", "iy", "w"))


def binned(points: DataFrame, x_range: tuple[float, float, int], y_range: tuple[float, float, int]) -> DataFrame:
    """(ix, iy, w) of points (x, y, w): (least, greatest, bins) of each axis; -1 for points outside."""
    return points.select(C.find_bin(F.col("x"), *x_range).alias("ix"), C.find_bin(F.col("y"), *y_range).alias("iy"), "w")


def source_mask(px: DataFrame, pixels: DataFrame, mode: str = "binary") -> DataFrame:
    """`px` with 0 outside of sources (source_id, ix, iy) and inside 1 (binary), the flux (flux), the source's id + 1 (map) or its mean (mean). A pixel of several sources counts as the least one's."""
    own = pixels.groupBy("ix", "iy").agg(F.min("source_id").alias("source_id"))
    j = px.select("ix", "iy", "w").join(own, ["ix", "iy"], "left")
    if mode == "mean":
        mean = pixels.join(px.select("ix", "iy", "w"), ["ix", "iy"]).groupBy("source_id").agg(F.avg("w").alias("m"))
        j = j.join(mean, "source_id", "left")
    value = {"binary": F.lit(1.0), "flux": F.col("w"), "map": (F.col("source_id") + 1).cast("double"), "mean": F.col("m") if mode == "mean" else None}[mode]
    return j.select("ix", "iy", F.when(F.col("source_id").isNotNull(), value).otherwise(0.0).alias("w"))


def morphological_peaks(px: DataFrame, shape: tuple[int, int], sizes: list[int], valleys: bool = False) -> DataFrame:
    """(ix, iy) of pixels whose top-hat (for valleys the black-hat) is positive under every kernel of `sizes`."""
    out = None
    for size in sizes:
        one = ST.morphology(px, "blackhat" if valleys else "tophat", size, shape).where("w > 0").select("ix", "iy")
        out = one if out is None else out.join(one, ["ix", "iy"], "left_semi")
    return out


def near_sources(points: DataFrame, pixels: DataFrame, tol: float) -> DataFrame:
    """(id, source_id) of points (id, x, y) no further than tol, along each axis, from a pixel of a source: an equi-join on cells as wide as the tolerance."""
    wide = max(1.0, float(tol))
    p = points.select("id", "x", "y", F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> named_struct('i', i, 'j', j))))")).alias("s"))
    p = p.select("id", "x", "y", (F.floor(F.col("x") / wide) + F.col("s.i")).alias("cx"), (F.floor(F.col("y") / wide) + F.col("s.j")).alias("cy"))
    q = pixels.select("source_id", "ix", "iy", F.floor(F.col("ix") / wide).alias("cx"), F.floor(F.col("iy") / wide).alias("cy"))
    return p.join(q, ["cx", "cy"]).where((F.abs(F.col("x") - F.col("ix")) <= tol) & (F.abs(F.col("y") - F.col("iy")) <= tol)).select("id", "source_id").distinct()


# --- regions --------------------------------------------------------------------------------------------------------------
def with_curvature(regions: DataFrame, px: DataFrame, curvature: DataFrame) -> DataFrame:
    """`regions` with mean and rms of a curvature map (ix, iy, w) over the labelled pixels."""
    c = px.select("ix", "iy", "label").join(curvature.select("ix", "iy", F.col("w").alias("_c")), ["ix", "iy"])
    return regions.join(c.groupBy("label").agg(F.avg("_c").alias("curv_mean"), F.coalesce(F.stddev_samp("_c"), F.lit(0.0)).alias("curv_rms")), "label")


def parameters(robust: bool = False, curvature: bool = False) -> Column:
    """A region's vector: location and spread of its values, then of its curvature, if wanted, and the centroid."""
    names = (["median", "mad"] if robust else ["mean", "rms"]) + (["curv_mean", "curv_rms"] if curvature else []) + ["x", "y"]
    return F.array(*[F.col(n).cast("double") for n in names])


def curvature_distance_squared() -> Column:
    return F.pow(F.col("curv_mean_a") - F.col("curv_mean_b"), 2) + F.pow(F.col("curv_rms_a") - F.col("curv_rms_b"), 2)


def without_empty(regions: DataFrame) -> DataFrame:
    return regions.where("n > 0")


def checked(px: DataFrame, regions: DataFrame) -> DataFrame:
    """(what, n): faults of superpixel data: pixels without a region, regions without pixels, regions whose count is wrong."""
    have = px.groupBy("label").agg(F.count("*").alias("have"))
    j = have.join(regions.select("label", "n"), "label", "full")
    fault = F.when(F.col("n").isNull(), "no region").when(F.col("have").isNull() | (F.col("n") == 0), "no pixels").when(F.col("n") != F.col("have"), "wrong count")
    return j.select(fault.alias("what")).where("what IS NOT NULL").groupBy("what").agg(F.count("*").alias("n"))


def ordered_neighbours(edges: DataFrame, by: str = "distance") -> DataFrame:
    """(label, neighbour, place): the neighbours of each region of edges (a, b, distance) both ways, the nearest first."""
    both = edges.select("a", "b", by).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), by))
    place = F.row_number().over(Window.partitionBy("a").orderBy(by, "b"))
    return both.select(F.col("a").alias("label"), F.col("b").alias("neighbour"), place.cast("long").alias("place"))


def conic_parameters(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> list[Column]:
    """Centre, semi-axes and angle (radians, of the longer one) of the ellipse a x^2 + b x y + c y^2 + d x + e y + f = 0; null where it is none."""
    disc = 4 * a * c - b * b
    x0, y0 = (b * e - 2 * c * d) / disc, (b * d - 2 * a * e) / disc
    rest = -(a * x0 * x0 + b * x0 * y0 + c * y0 * y0 + d * x0 + e * y0 + f)
    root = F.sqrt((a - c) * (a - c) + b * b)
    l1, l2 = (a + c - root) / 2, (a + c + root) / 2  # the eigenvalues, the lesser one belongs to the longer axis
    real = (disc > 0) & (rest / l1 > 0) & (rest / l2 > 0)
    theta = F.atan2(-b, c - a) / 2
    return [F.when(real, v) for v in (x0, y0, F.sqrt(rest / l1), F.sqrt(rest / l2), theta)]


# --- documents ------------------------------------------------------------------------------------------------------------
PIXEL_SCHEMA = "array<struct<ix: bigint, iy: bigint, w: double>>"
SOURCE_SCHEMA = f"source_id long, n long, parent_id long, pixels {PIXEL_SCHEMA}"


def sources_to_json(pixels: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(source_id, value): each source of (source_id, ix, iy, w) as one JSON document with its pixels and, from parents (source_id, parent_id), its mother."""
    s = pixels.groupBy("source_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ix", "iy", "w"))).alias("pixels"))
    s = s.join(parents, "source_id", "left") if parents is not None else s.withColumn("parent_id", F.lit(None).cast("long"))
    return s.select("source_id", F.to_json(F.struct("source_id", "n", "parent_id", "pixels")).alias("value"))


def sources_from_json(lines: DataFrame) -> DataFrame:
    """(source_id, parent_id, ix, iy, w) of JSON documents `value`; those that can't be read, or whose pixels aren't as many as they say, are left out."""
    s = lines.select(F.from_json("value", SOURCE_SCHEMA).alias("s")).select("s.*").where("source_id IS NOT NULL AND size(pixels) = n")
    return s.select("source_id", "parent_id", F.explode("pixels").alias("p")).select("source_id", "parent_id", "p.*")


def valid_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """`lines` with `valid`: the JSON has a non-empty array `options` of objects with a name and a value."""
    opts = F.from_json(column, "options array<struct<name: string, value: string>>")["options"]
    return lines.withColumn("valid", F.coalesce((F.size(opts) > 0) & F.forall(opts, lambda o: o["name"].isNotNull() & o["value"].isNotNull()), F.lit(False)))
