"""Pixel frames: (ix, iy, w). Images are tables of pixels; a tile is a range of both indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_rows(rows: DataFrame, iy: str, values: str) -> DataFrame:
    """One image row per record, as an array."""
    return rows.select(F.col(iy).cast("long").alias("iy"), F.posexplode(values).alias("ix", "w")).select(F.col("ix").cast("long"), "iy", F.col("w").cast("double"))


def from_matrix(df: DataFrame, values: str, *keys: str) -> DataFrame:
    """A matrix per record (array of rows, the top row first): iy counts from the bottom. `keys` tell several matrices apart."""
    r = df.select(*keys, F.size(values).alias("ny"), F.posexplode(values).alias("r", "row"))
    return r.select(*keys, (F.col("ny") - 1 - F.col("r")).cast("long").alias("iy"), F.posexplode("row").alias("ix", "w")).select(*keys, F.col("ix").cast("long"), "iy", F.col("w").cast("double"))


def to_rows(px: DataFrame) -> DataFrame:
    """(iy, row): one array per image row, from left to right."""
    return px.groupBy("iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "w"))), lambda x: x["w"]).alias("row"))


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense test image: a vector is a row of pixels."""
    return from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def grid_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test image with missing cells."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 128).cast("long").alias("ix"), (F.col("l_suppkey") % 100).cast("long").alias("iy")).agg(F.sum("l_quantity").alias("w"))


def tile(px: DataFrame, x0: int, x1: int, y0: int, y1: int, skip_negative: bool = False) -> DataFrame:
    """A sub-image, bounds inclusive; the origin stays that of the whole image."""
    if x0 >= x1 or y0 >= y1:
        raise ValueError("a tile needs x0 < x1 and y0 < y1")
    out = px.where(F.col("ix").between(x0, x1) & F.col("iy").between(y0, y1))
    return out.where("w >= 0") if skip_negative else out


def shape(px: DataFrame) -> tuple[int, int]:
    """(nx, ny) of a frame that starts at 0."""
    r = px.agg(F.max("ix"), F.max("iy")).collect()[0]
    return (r[0] + 1, r[1] + 1) if r[0] is not None else (0, 0)


def image_files(spark: SparkSession, path: str, flip_x: bool = False, skip_unreadable: bool = False) -> DataFrame:
    """png, jpg, bmp or gif as grey pixels, rows counted from the bottom. Files that can't be decoded are an error, or left out by skip_unreadable."""
    im = spark.read.format("image").option("dropInvalid", skip_unreadable).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    im = im.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.coalesce("origin", F.lit("?")))).cast("int")))

    def at(c, n):
        return F.conv(F.hex(F.substring(F.col("data"), (c + 1).cast("int"), F.lit(n))), 16, 10).cast("double")

    px = im.select("*", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k"))
    first = F.col("k") * F.col("nChannels")
    grey = F.when(F.col("nChannels") >= 3, 0.114 * at(first, 1) + 0.587 * at(first + 1, 1) + 0.299 * at(first + 2, 1)).otherwise(at(first, 1))
    x, y = F.col("k") % F.col("width"), F.col("height") - 1 - F.floor(F.col("k") / F.col("width"))
    return px.select("origin", (F.col("width") - 1 - x if flip_x else x).cast("long").alias("ix"), y.cast("long").alias("iy"), F.round(grey).alias("w"))
