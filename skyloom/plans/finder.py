"""The source finder: from an image to catalogs, maps and their tables."""

from __future__ import annotations

import math
import time
import warnings
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import background as B
from ..operators import catalog as K
from ..operators import detect as D
from ..operators import extended as X
from ..operators import fit as FT
from ..operators import segment as SG
from ..operators import stencil as ST
from ..operators.graph import components, written
from ..operators.stats import image_stats, median_mad
from ..sources import config, fits
from ..sources.image import shape, tile

#: Estimator names by the option's number.
ESTIMATORS = {1: "mean", 2: "median", 3: "biweight", 4: "clipped"}
#: What takes the place of sources in residual maps, by the option's number.
RESIDUAL = {1: "bkg", 2: "median"}
#: Searches for extended sources by the number in option extendedSearchMethod.
EXTENDED = {1: "wavelet", 2: "superpixels", 3: "contour", 4: "saliency"}
#: The options that change what `run` does.
HONOURED = frozenset(
    "applySourceSelection bkgEstimator boxSizeX boxSizeY compactSourceSearchNIters cvNIters dilateKernelSize dilateRandomize dilateSourceModel extendedSearchMethod fitMaxNComponents gausFilterKernSize "
    "gausFilterSigma gridSizeX gridSizeY guidedFilterColorEps guidedFilterRadius mergeBelowSeed mergeCompactSources mergeExtendedSources mergeSources mergeThr minNPix psCircRatioThr psElongThr "
    "psEllipseAreaRatioMaxThr psEllipseAreaRatioMinThr psMaxNPix psNBeamsThr saliencyResoMax saliencyResoMin saliencyResoStep saveBkgMap saveConfig saveDS9Region saveInputMap saveNoiseMap "
    "saveSignificanceMap saveToFITSFile searchCompactSources searchExtendedSources searchNegativeExcess seedThr seedThrStep smoothFilter sourceMinBoundingBox spSize tileSizeX tileSizeY "
    "use2ndPassInLocalBkg useBeamInfoInBkg useCircRatioCut useElongCut useEllipseAreaRatioCut useLocalBkg useMaxNPixCut useMinBoundingBoxCut useNBeamsCut usePreSmoothing "
    "useResidualInExtendedSearch wtScaleSearchMax wtScaleSearchMin".split()
)
#: Options of the nested search, read where `run` is told to make one.
NESTED = frozenset("maxMatchingPixFraction minNestedMotherDist nestedBlobThrFactor sourceToBeamAreaThrToSearchNested".split())


def open_image(spark: SparkSession, path: str, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None) -> DataFrame:
    """(ix, iy, w) of a FITS file or a Parquet pixel table, whole or a pixel range."""
    if path.lower().endswith((".fits", ".fit")):
        return fits.read_image(spark, path, x, y).select("ix", "iy", "w")
    px = spark.read.parquet(path).select("ix", "iy", "w")
    return px if x is None or y is None else tile(px, *x, *y)


def smoothed(px: DataFrame, size: tuple[int, int], o: config.Options) -> DataFrame:
    """The image smoothed as the options say: not at all, by a Gaussian (smoothFilter 1) or a guided filter (2)."""
    if not o.usePreSmoothing:
        return px
    if o.smoothFilter == 2:
        return ST.guided_filter(px, int(o.guidedFilterRadius), o.guidedFilterColorEps, size)
    return ST.convolve(px, ST.gauss_kernel(o.gausFilterKernSize, o.gausFilterSigma), size, "mirror")


def edge_image(px: DataFrame, size: tuple[int, int], model: str = "kirsch", rounds: int = 20) -> DataFrame:
    """Kirsch responses, or 1 on the border of a level set."""
    if model == "kirsch":
        return ST.kirsch(px, size)
    inside = SG.chan_vese(px, size, rounds)
    rim = ST.zero_crossings(inside.select("ix", "iy", (F.col("w") - 0.5).alias("w")), size).withColumn("e", F.lit(1.0))
    return px.select("ix", "iy").join(rim, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("e", F.lit(0.0)).alias("w"))


def segmented(px: DataFrame, size: tuple[int, int], region: int, regularisation: float, least: int, limit: float, rounds: int = 5) -> DataFrame:
    """(ix, iy, w, label): superpixels, merged while mutually nearest, then level by level. `rounds` bounds each of the three steps, which stop before if nothing moves."""
    sp = SG.superpixels(px, size, region, regularisation, least, rounds)
    return SG.merge_hierarchical(SG.merge_mutual(sp, limit, rounds), 0.3, limit, 2, rounds)


def ignored(o: config.Options, nested: bool = False) -> list[str]:
    """Options that were changed and that `run` does not read."""
    return [f.name for f in fields(o) if f.name not in (HONOURED | NESTED if nested else HONOURED) and getattr(o, f.name) != f.default]


def background_boxes(size: tuple[int, int], o: config.Options, beam_width: float = 1.0) -> tuple[tuple[int, int], tuple[int, int]]:
    """Sampling boxes and grid steps in pixels: multiples of the beam's width, or fractions of the image without beam information; boxes of 8 pixels at least and of the image at most."""
    unit = (beam_width, beam_width) if o.useBeamInfoInBkg else size
    box = tuple(max(8, min(int(b * u), max(8, n))) for b, u, n in zip((o.boxSizeX, o.boxSizeY), unit, size))
    return box, tuple(max(1, int(g * b)) for g, b in zip((o.gridSizeX, o.gridSizeY), box))


def with_background(px: DataFrame, size: tuple[int, int], o: config.Options, box: tuple[int, int], grid: tuple[int, int]) -> DataFrame:
    """`px` with bkg and rms: maps of local samples, or one pair of values of the whole image."""
    if o.useLocalBkg:
        return B.local_background(px, *size, box, grid, ESTIMATORS[o.bkgEstimator], o.use2ndPassInLocalBkg)
    bkg, rms = B.global_background(px, ESTIMATORS[o.bkgEstimator])
    return px.withColumns({"bkg": F.lit(bkg), "rms": F.lit(rms)})


def merged(found: DataFrame, o: config.Options) -> DataFrame:
    """Sources (source_id, ix, iy, w, z, extended) that touch or overlap as one, of the kinds that the options name.

    Two compact sources merge by mergeCompactSources, an extended source with any other by mergeExtendedSources. The
    least id stays; a pixel of several sources counts once, as a compact source's where it is one's.
    """
    kind = found.groupBy("source_id").agg(F.max("extended").alias("e"))
    pairs = K.adjacent(found, found).where("a < b")
    for side in ("a", "b"):
        pairs = pairs.join(kind.select(F.col("source_id").alias(side), F.col("e").alias(f"e_{side}")), side)
    any_extended = F.col("e_a") | F.col("e_b")
    pairs = pairs.where((F.lit(o.mergeCompactSources) & ~any_extended) | (F.lit(o.mergeExtendedSources) & any_extended))
    label = components(pairs.select("a", "b")).withColumnRenamed("id", "source_id")
    one = found.join(label, "source_id", "left").withColumn("source_id", F.coalesce("component", "source_id"))
    return one.groupBy("source_id", "ix", "iy").agg(F.first("w").alias("w"), F.max("z").alias("z"), F.min("extended").alias("extended"))


def cuts(o: config.Options) -> dict:
    """Arguments of `selected_by_shape` that the options switch on."""
    return {
        "min_box": o.sourceMinBoundingBox if o.useMinBoundingBoxCut else None,
        "circularity": o.psCircRatioThr if o.useCircRatioCut else None,
        "elongation": o.psElongThr if o.useElongCut else None,
        "ellipse_ratio": (o.psEllipseAreaRatioMinThr, o.psEllipseAreaRatioMaxThr) if o.useEllipseAreaRatioCut else None,
        "n_beams": o.psNBeamsThr if o.useNBeamsCut else None,
        "max_pixels": o.psMaxNPix if o.useMaxNPixCut else None,
    }


def catalog_of(pixels: DataFrame, o: config.Options, beam_pixels: float) -> tuple[DataFrame, DataFrame]:
    """Catalog and outline shapes of sources (source_id, ix, iy, w, extended). Without source selection all are good and compact.

    Type: 1 compact, 2 point-like, 3 extended, 4 merged from compact and extended ones. The last two are not point-like
    and not fitted as a whole.
    """
    shapes = written(FT.contour_shapes(pixels.select("source_id", "ix", "iy")), "shapes")
    kind = pixels.groupBy("source_id").agg(F.max("extended").alias("extended"), F.min("extended").alias("_only"))
    stats = D.blob_stats(pixels).join(shapes.select("source_id", "box_min", "circularity", "elongation", "ellipse_area_ratio"), "source_id").join(kind, "source_id")
    c = D.selected_by_shape(stats, beam_pixels, **cuts(o))
    if not o.applySourceSelection:
        c = c.withColumns({"good": F.lit(True), "point_like": F.lit(False), "type": F.lit(1), "fittable": F.col("n_pix") / beam_pixels <= 20.0})
    c = c.withColumns({"type": F.when(F.col("_only"), 3).when(F.col("extended"), 4).otherwise(F.col("type")), "point_like": F.col("point_like") & ~F.col("extended"), "fittable": F.col("fittable") & ~F.col("extended")})
    return c.drop("_only"), shapes


def find_extended(px: DataFrame, size: tuple[int, int], o: config.Options, method: str) -> DataFrame:
    """(source_id, ix, iy) of extended sources by one of EXTENDED."""
    if method == "saliency":
        return X.saliency_sources(px, size, list(range(o.saliencyResoMin, o.saliencyResoMax + 1, o.saliencyResoStep)), 1.0, o.minNPix)
    if method == "superpixels":
        return X.superpixel_sources(px, size, o.spSize, 0.5, o.mergeThr)
    if method == "contour":
        return X.contour_sources(px, size, o.cvNIters, o.minNPix)
    if method == "wavelet":
        return D.wavelet_sources(px, size, range(o.wtScaleSearchMin, o.wtScaleSearchMax + 1), o.seedThr, o.mergeThr, o.minNPix)
    raise ValueError(f"unknown method {method!r}: {', '.join(EXTENDED.values())}")


def run(spark: SparkSession, px: DataFrame, o: config.Options, sink: str, extended: str | None = None, beam_pixels: float = 1.0, beam_width: float = 1.0, nested: bool = False) -> dict[str, DataFrame]:
    """Find, select, fit and save: tables SourceInfo, PixelInfo, FitInfo, ShapeInfo, ConfigInfo, PerformanceInfo, TaskInfo and maps under `sink`.

    nested: sources inside the found ones are searched as well: tables NestedInfo (with mother_id) and NestedPixelInfo;
    where a source is not fitted as a whole, its good nested ones are. Boxes of the background are multiples of
    beam_width, counts of beams those of beam_pixels. Ids of nested sources are places, as those of sources are, so
    FitInfo says by `nested` whose they are.
    """
    took, began = {}, time.time()
    for name in ignored(o, nested):
        warnings.warn(f"option {name} changes nothing here")

    def done(stage: str) -> None:
        nonlocal began
        took[stage], began = (time.time() - began) * 1000, time.time()

    size = shape(px)
    box, grid = background_boxes(size, o, beam_width)
    stats = written(px.agg(*image_stats()), "stats")
    done("read")
    background = lambda p: with_background(p, size, o, box, grid)
    maps = written(B.significance(background(px)), "maps")
    done("background")
    found = spark.createDataFrame([], "source_id long, ix long, iy long, w double, z double, extended boolean")
    if o.searchCompactSources:
        compact = D.find_compact(px, size, o.seedThr, o.mergeThr, o.minNPix, box, grid, o.compactSourceSearchNIters, o.seedThrStep, o.searchNegativeExcess, o.mergeBelowSeed, background)
        found = written(compact.withColumn("extended", F.lit(False)), "compact")
    done("search")
    extended = extended or (EXTENDED.get(o.extendedSearchMethod) if o.searchExtendedSources else None)
    if extended:
        rest = px
        if o.useResidualInExtendedSearch:
            # Noise is that of the map, where sources are replaced by the background and by chance.
            rest = D.residual_map(maps.select("ix", "iy", "w", "bkg", "rms"), found.select("source_id", "ix", "iy", "w"), o.dilateKernelSize, size, RESIDUAL[o.dilateSourceModel], o.dilateRandomize)
        rest = written(smoothed(written(rest, "residual"), size, o), "smoothed")
        more = find_extended(rest, size, o, extended).join(px, ["ix", "iy"])
        more = more.select((-F.col("source_id") - 1).alias("source_id"), "ix", "iy", "w", F.lit(0.0).alias("z"), F.lit(True).alias("extended"))
        found = written(found.unionByName(more), "all")
    done("extended")
    if o.mergeSources and (o.mergeCompactSources or o.mergeExtendedSources):
        found = written(merged(found, o), "merged")
    done("merging")
    catalog, shapes = catalog_of(found, o, beam_pixels)
    catalog = written(D.numbered(catalog.where("good").drop("peak")), "catalog")
    shapes = shapes.join(catalog.select("source_id"), "source_id", "left_semi")
    done("selection")
    tables = {}
    whole = found.join(catalog.where("fittable").select("source_id"), "source_id", "left_semi")
    noise = median_mad(px)[1] or 1.0
    fitted = FT.fit_sources(whole.select("source_id", "ix", "iy", "w"), noise, o.fitMaxNComponents).withColumn("nested", F.lit(False))
    if nested:
        mothers = found.join(catalog.select("source_id"), "source_id", "left_semi").select("source_id", "ix", "iy")
        inner = D.nested_sources(px, mothers, size, o.nestedBlobThrFactor, o.minNPix, o.minNestedMotherDist, o.maxMatchingPixFraction, math.ceil(o.sourceToBeamAreaThrToSearchNested * beam_pixels))
        inner = written(inner.join(px.select("ix", "iy", "w"), ["ix", "iy"]).withColumn("extended", F.lit(False)), "nested")
        inside, _ = catalog_of(inner, o, beam_pixels)
        inside = written(inside.drop("peak", "extended").join(inner.select("source_id", "mother_id").distinct(), "source_id"), "nested-catalog")
        parts = inside.where("good").join(catalog.where("NOT fittable").select(F.col("source_id").alias("mother_id")), "mother_id", "left_semi")
        single = FT.fit_sources(inner.join(parts.select("source_id"), "source_id", "left_semi").select("source_id", "ix", "iy", "w"), noise, o.fitMaxNComponents)
        fitted = fitted.unionByName(single.withColumn("nested", F.lit(True)))
        tables |= {"NestedInfo": inside, "NestedPixelInfo": inner.drop("extended")}
    left_out = [c for c, keep in (("w", o.saveInputMap), ("bkg", o.saveBkgMap), ("rms", o.saveNoiseMap), ("z", o.saveSignificanceMap)) if not keep]
    tables |= {"SourceInfo": catalog, "PixelInfo": found, "FitInfo": fitted, "ShapeInfo": shapes, "StatsInfo": stats, "Maps": maps.drop(*left_out), "TaskInfo": K.tiles(spark, *size, o.tileSizeX, o.tileSizeY)}
    if o.saveConfig:
        tables["ConfigInfo"] = config.as_table(spark, o)
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{sink}/{name}")
    if o.saveToFITSFile:
        for column in [c for c in ("w", "bkg", "rms", "z") if c not in left_out]:
            fits.encoded_tiles(maps.select("ix", "iy", F.col(column).alias("w"))).write.mode("overwrite").parquet(f"{sink}/fits/{column}")
    done("fit and save")
    spark.createDataFrame(list(took.items()), "stage string, ms double").write.mode("overwrite").parquet(f"{sink}/PerformanceInfo")
    if o.saveDS9Region:
        FT.ds9_regions(spark.read.parquet(f"{sink}/FitInfo")).write.mode("overwrite").text(f"{sink}/ds9")
    return {name: spark.read.parquet(f"{sink}/{name}") for name in tables}
