"""Catalogs: joins between sources, merging, tiles, correlation of two catalogs.

Joins on boxes and distances are equi-joins on cells: a box or search square goes to the few cells that it meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .graph import components

CELL = 64


def boxes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("source_id").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"), F.count("*").alias("n"))


def _celled(b: DataFrame, cell: int, margin: int = 0) -> DataFrame:
    rng = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - margin) / cell), F.floor((F.col(hi) + margin) / cell)))
    return b.withColumn("_cx", rng("x0", "x1")).withColumn("_cy", rng("y0", "y1"))


def _renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c.startswith("_c") else f"{c}_{suffix}") for c in df.columns])


def overlapping(a: DataFrame, b: DataFrame, margin: int = 0, cell: float = CELL, tasks: int | None = None) -> DataFrame:
    """Pairs of boxes (columns _a and _b) that overlap, or come within a margin; tasks: that many, however few the boxes."""
    left, right = _renamed(_celled(a, cell, margin), "a"), _renamed(_celled(b, cell), "b")
    if tasks:
        left, right = left.repartition(tasks, "_cx", "_cy"), right.repartition(tasks, "_cx", "_cy").hint("shuffle_hash")
    j = left.join(right, ["_cx", "_cy"])
    meet = (F.col("x0_a") - margin <= F.col("x1_b")) & (F.col("x0_b") <= F.col("x1_a") + margin) & (F.col("y0_a") - margin <= F.col("y1_b")) & (F.col("y0_b") <= F.col("y1_a") + margin)
    # A pair is taken in the first cell that both have.
    first = (F.col("_cx") == F.greatest(F.floor((F.col("x0_a") - margin) / cell), F.floor(F.col("x0_b") / cell))) & (F.col("_cy") == F.greatest(F.floor((F.col("y0_a") - margin) / cell), F.floor(F.col("y0_b") / cell)))
    return j.where(meet & first).drop("_cx", "_cy")


def inside_first(children: DataFrame, mothers: DataFrame, cell: int = CELL) -> DataFrame:
    """(child, mother): the first mother, by id, whose box holds the child's box."""
    p = overlapping(children, mothers, 0, cell).where("x0_a >= x0_b AND x1_a <= x1_b AND y0_a >= y0_b AND y1_a <= y1_b AND source_id_a <> source_id_b")
    return p.groupBy(F.col("source_id_a").alias("child")).agg(F.min("source_id_b").alias("mother"))


def adjacent(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): ids of sources with pixels that touch, corners included, or coincide; an equi-join on the 9 neighbours."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    p = a.select(F.col("source_id").alias("a"), "ix", "iy", F.explode(steps).alias("d")).select("a", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"))
    return p.join(b.select(F.col("source_id").alias("b"), "ix", "iy"), ["ix", "iy"]).where("a <> b").select("a", "b").distinct()


def shared_pixels(true: DataFrame, rec: DataFrame) -> DataFrame:
    """(a, b, n): number of common pixels of a true and a found source."""
    return true.select(F.col("source_id").alias("a"), "ix", "iy").join(rec.select(F.col("source_id").alias("b"), "ix", "iy"), ["ix", "iy"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def match_by_overlap(true: DataFrame, rec: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, f, f_rec): the best found source of each true one, both shared fractions at least `least`; ties go to the last."""
    na, nb = (d.groupBy(F.col("source_id").alias(k)).agg(F.count("*").alias(f"n_{k}")) for d, k in ((true, "a"), (rec, "b")))
    m = shared_pixels(true, rec).join(na, "a").join(nb, "b").select("a", "b", (F.col("n") / F.col("n_a")).alias("f"), (F.col("n") / F.col("n_b")).alias("f_rec"))
    m = m.where((F.col("f") >= least) & (F.col("f_rec") >= least))
    return m.groupBy("a").agg(F.max(F.struct("f", "b", "f_rec")).alias("m")).select("a", "m.b", "m.f", "m.f_rec")


def match_by_position(true: DataFrame, rec: DataFrame, within: float) -> DataFrame:
    """(a, b, dist): the nearest found position (id, x, y) within a square of half-width `within`; ties go to the last."""
    cx, cy = F.floor(F.col("x") / within), F.floor(F.col("y") / within)
    t = true.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.explode(F.sequence(cx - 1, cx + 1)).alias("_cx"), cy.alias("_c"))
    t = t.select("a", "xa", "ya", "_cx", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1)).alias("_cy"))
    r = rec.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cx.alias("_cx"), cy.alias("_cy"))
    j = t.join(r, ["_cx", "_cy"]).where((F.abs(F.col("xa") - F.col("xb")) <= within) & (F.abs(F.col("ya") - F.col("yb")) <= within))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return j.groupBy("a").agg(F.min(F.struct(d.alias("dist"), (-F.col("b")).alias("last"))).alias("m")).select("a", (-F.col("m.last")).alias("b"), F.col("m.dist").alias("dist"))


def correlate(true: DataFrame, rec: DataFrame, least: float = 0.5) -> DataFrame:
    """One row a true source: found (0/1), the best match and all found sources that share pixels with it; -1 where none."""
    ids = true.groupBy(F.col("source_id").alias("a")).agg(F.count("*").alias("n_pix"))
    many = shared_pixels(true, rec).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("candidates"))
    best = match_by_overlap(true, rec, least)
    out = ids.join(best, "a", "left").join(many, "a", "left")
    return out.select("a", "n_pix", F.col("b").isNotNull().cast("int").alias("found"), F.coalesce("b", F.lit(-1)).alias("b"), F.coalesce("f", F.lit(-1.0)).alias("f"), F.coalesce("f_rec", F.lit(-1.0)).alias("f_rec"), F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"))


def merge_pixels(pixels: DataFrame, edges: DataFrame, sum_shared: bool = False) -> DataFrame:
    """Pixels (source_id, ix, iy, w) with linked sources merged: the least id stays, shared pixels once (or summed)."""
    label = components(edges)
    m = pixels.join(label.withColumnRenamed("id", "source_id"), "source_id", "left").withColumn("source_id", F.coalesce("component", "source_id")).drop("component")
    w = F.sum("w") if sum_shared else F.first("w")
    return m.groupBy("source_id", "ix", "iy").agg(w.alias("w"))


#: Types: 1 compact, 2 point-like, 3 extended, 4 compact and extended.
def merged_type(a, b):
    """Type of two merged sources: a point becomes compact, compact with extended becomes both."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when((lo <= 2) & (hi <= 2), 1).when((lo == 3) & (hi == 3), 3).otherwise(4)


def tiles(spark, nx: int, ny: int, box_x: int, box_y: int, step_x: float = 1.0, step_y: float = 1.0) -> DataFrame:
    """(tile_id, x0, x1, y0, y1), x fastest."""
    from .background import tile_starts

    rows = [(x0, x1, y0, y1) for y0, y1 in tile_starts(ny, box_y, step_y) for x0, x1 in tile_starts(nx, box_x, step_x)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tile_id long, x0 long, x1 long, y0 long, y1 long")


def tile_neighbours(t: DataFrame) -> DataFrame:
    """(a, b): tiles that touch or overlap."""
    cell = max(1, t.agg(F.max(F.greatest(F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1))).collect()[0][0] or 1)
    s = t.withColumnRenamed("tile_id", "source_id")
    return overlapping(s, s, 1, cell).where("source_id_a <> source_id_b").select(F.col("source_id_a").alias("a"), F.col("source_id_b").alias("b"))


def at_tile_edge(sources: DataFrame, t: DataFrame) -> DataFrame:
    """Boxes (source_id, tile_id, x0, x1, y0, y1) with edge: touches its tile's border where a neighbour tile is, or overlaps the neighbour."""
    n = tile_neighbours(t).join(t.select(F.col("tile_id").alias("b"), *[F.col(c).alias(f"t{c}") for c in ("x0", "x1", "y0", "y1")]), "b")
    hit = sources.join(n, sources.tile_id == n.a).where("x0 - 1 <= tx1 AND tx0 <= x1 + 1 AND y0 - 1 <= ty1 AND ty0 <= y1 + 1").select("source_id", "tile_id").distinct()
    return sources.join(hit.withColumn("edge", F.lit(True)), ["source_id", "tile_id"], "left").withColumn("edge", F.coalesce("edge", F.lit(False)))


def merge_across_tiles(pixels: DataFrame, t: DataFrame) -> DataFrame:
    """Pixels (tile_id, source_id, ix, iy, w) of sources found tile by tile, merged where they touch in neighbouring tiles.

    Only sources at tile borders are compared.
    """
    b = pixels.groupBy("tile_id", "source_id").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"))
    edge = at_tile_edge(b, t).where("edge").select("source_id", "tile_id")
    rim = pixels.join(edge, ["source_id", "tile_id"], "left_semi")
    near = adjacent(rim, rim)
    return merge_pixels(pixels.select("source_id", "ix", "iy", "w"), near)


def neighbours_of_labels(px: DataFrame, label: str = "label", least: int = 2) -> DataFrame:
    """(a, b, contacts): labels of (ix, iy, label) that share a border of at least so many 8-neighbour contacts, a < b."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))])
    p = px.select(F.col(label).alias("a"), "ix", "iy", F.explode(steps).alias("d")).select("a", (F.col("ix") + F.col("d.dx")).alias("ix"), (F.col("iy") + F.col("d.dy")).alias("iy"))
    e = p.join(px.select(F.col(label).alias("b"), "ix", "iy"), ["ix", "iy"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return e.groupBy("a", "b").agg(F.count("*").alias("contacts")).where(F.col("contacts") >= least)


def largest_component(pixels: DataFrame, key: str) -> DataFrame:
    """Pixels of the largest source of each key; ties go to the last."""
    n = pixels.groupBy(key, "source_id").agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.max(F.struct("n", "source_id"))["source_id"].alias("source_id"))
    return pixels.join(best, [key, "source_id"], "left_semi")


def ranked(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
