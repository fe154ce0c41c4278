"""Ground points, terrain raster and height above terrain.

The raster is a table of cells, never a dense array: of the empty cells only
those that points ask for are filled, by a join with the occupied ones, and
points look up the four cells around them by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.spatial import finite, nearest
from pointloom.scratch import stored


def _frame(cloud: DataFrame, resolution: float) -> DataFrame:
    """(x0, y0, nx, ny): origin and size of the raster, one row."""
    res = max(float(resolution), 0.1)
    one = cloud.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    size = lambda a, b: F.greatest(F.lit(1).cast("long"), F.ceil((F.col(b) - F.col(a)) / res))
    return one.select("x0", "y0", size("x0", "x1").alias("nx"), size("y0", "y1").alias("ny"))


def _cell(res: float) -> tuple[Column, Column]:
    at = lambda c, o, n: F.greatest(F.lit(0).cast("long"), F.least(F.col(n) - 1, F.floor((F.col(c) - F.col(o)) / res)))
    return at("x", "x0", "nx").alias("ix"), at("y", "y0", "ny").alias("iy")


def candidates(cloud: DataFrame, resolution: float) -> DataFrame:
    """The lowest points of each cell: a twentieth of its points, one at least and five at most."""
    res = max(float(resolution), 0.1)
    cells = cloud.join(F.broadcast(_frame(cloud, res))).select("pid", "x", "y", "z", *_cell(res))
    cell = Window.partitionBy("ix", "iy")
    ranked = cells.withColumn("rank", F.row_number().over(cell.orderBy("z", "pid"))).withColumn("cnt", F.count("*").over(cell))
    take = F.least(F.col("cnt"), F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("cnt") * 0.05)))
    return ranked.where(F.col("rank") <= take).select("pid", "x", "y", "z", "ix", "iy")


def ground_points(cloud: DataFrame, resolution: float) -> DataFrame:
    """(pid, x, y, z): candidates less than 3 m from the median height of their six nearest candidates, themselves among them; the lowest hundredth if there are under three candidates."""
    cand = stored(candidates(cloud, resolution).select("pid", "x", "y", "z"), "candidates")
    n = cand.count()
    if n < 3:
        lowest = max(3, -(-cloud.count() // 100))
        return cloud.select("pid", "x", "y", "z").orderBy("z", "pid").limit(lowest)
    near = nearest(cand, cand, min(6, n), ("x", "y"))
    med = near.join(cand.select(F.col("pid").alias("other"), F.col("z").alias("oz")), "other").groupBy("pid").agg(F.percentile("oz", 0.5).alias("med"))
    kept = stored(cand.join(med, "pid").where(F.abs(F.col("z") - F.col("med")) < 3.0).select("pid", "x", "y", "z"), "ground")
    return kept if kept.count() >= 3 else cand


def terrain(ground: DataFrame, cloud: DataFrame, resolution: float, asked: DataFrame | None = None) -> DataFrame:
    """(ix, iy, z): lowest ground height per cell; of the asked (ix, iy), empty ones are added with the value of the nearest occupied cell, ties to the least (ix, iy)."""
    res = max(float(resolution), 0.1)
    cells = ground.join(F.broadcast(_frame(cloud, res))).select(*_cell(res), "z").groupBy("ix", "iy").agg(F.min("z").alias("z"))
    if asked is None:
        return cells
    cells = stored(cells, "terrain")
    number = lambda df: df.withColumn("pid", F.col("ix") * (1 << 31) + F.col("iy")).withColumns({"x": F.col("ix").cast("double"), "y": F.col("iy").cast("double")})
    holes = stored(number(asked.select("ix", "iy").distinct().join(cells, ["ix", "iy"], "left_anti")), "holes")
    full = number(cells)
    near = nearest(holes, full, 1, ("x", "y"), radius=2.0)
    filled = near.join(full.select(F.col("pid").alias("other"), "z"), "other").join(holes.select("pid", "ix", "iy"), "pid").select("ix", "iy", "z")
    return cells.unionByName(filled)


def corners(cloud: DataFrame, frame: DataFrame, resolution: float) -> DataFrame:
    """(pid, asked): the four raster cells around each point, as an array of (ix, iy, w), the weights of bilinear interpolation; cells' lower corners are the nodes."""
    res = max(float(resolution), 0.1)
    ix, iy = _cell(res)
    at = cloud.join(F.broadcast(frame)).select("pid", ix, iy, ((F.col("x") - F.col("x0")) / res).alias("fx"), ((F.col("y") - F.col("y0")) / res).alias("fy"), "nx", "ny")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    at = at.withColumns({"fx": clip(F.col("fx") - F.col("ix")), "fy": clip(F.col("fy") - F.col("iy"))})
    nextx, nexty = F.least(F.col("nx") - 1, F.col("ix") + 1), F.least(F.col("ny") - 1, F.col("iy") + 1)
    four = [(F.col("ix"), F.col("iy"), (1 - F.col("fx")) * (1 - F.col("fy"))), (F.col("ix"), nexty, (1 - F.col("fx")) * F.col("fy")), (nextx, F.col("iy"), F.col("fx") * (1 - F.col("fy"))), (nextx, nexty, F.col("fx") * F.col("fy"))]
    return at.select("pid", F.array(*[F.struct(a.alias("ix"), b.alias("iy"), w.alias("w")) for a, b, w in four]).alias("asked"))


def bilinear(asking: DataFrame, raster: DataFrame) -> DataFrame:
    """(pid, terrain): the raster at each point of corners(): the sum of the weighted answers of its four cells."""
    got = asking.select("pid", F.posexplode("asked").alias("k", "at")).select("pid", "k", "at.*").hint("merge").join(raster, ["ix", "iy"])
    part = lambda k: F.sum(F.when(F.col("k") == k, F.col("w") * F.col("z")))
    return got.groupBy("pid").agg((part(0) + part(1) + part(2) + part(3)).alias("terrain"))


def inverse_distance(cloud: DataFrame, ground: DataFrame, k: int = 8) -> DataFrame:
    """(pid, terrain): mean of the k nearest ground heights by inverse square distance, distances of at least 1e-6."""
    near = nearest(cloud, ground, k, ("x", "y")).join(ground.select(F.col("pid").alias("other"), F.col("z").alias("gz")), "other")
    d = F.greatest(F.sqrt("d2"), F.lit(1e-6))
    w = 1 / (d * d)
    return near.groupBy("pid").agg((F.sum(w * F.col("gz")) / F.sum(w)).alias("terrain"))


def normalize_height(cloud: DataFrame, resolution: float = 1.0, ground: DataFrame | None = None) -> DataFrame:
    """The cloud with z above terrain, and its old z as z_original."""
    points = cloud.where(finite("x", "y", "z"))
    ground = stored(ground if ground is not None else ground_points(points, resolution), "ground")
    frame = stored(_frame(points, max(float(resolution), 0.1)), "frame")
    asking = corners(points, frame, resolution)
    asked = asking.select(F.inline("asked")).select("ix", "iy")
    raster = stored(terrain(ground, points, resolution, asked), "raster")
    height = bilinear(asking, raster)
    return points.join(height, "pid").withColumn("z_original", F.col("z")).withColumn("z", F.col("z_original") - F.col("terrain")).drop("terrain")


def report(normalized: DataFrame, ground: DataFrame) -> DataFrame:
    """One row: point count, height ranges before and after, ground count and its range after."""
    mark = normalized.join(ground.select("pid", F.lit(True).alias("is_ground")), "pid", "left")
    g = F.when(F.col("is_ground"), F.col("z"))
    return mark.agg(F.count("*").alias("points"), F.min("z_original").alias("original_min"), F.max("z_original").alias("original_max"), F.min("z").alias("normalized_min"), F.max("z").alias("normalized_max"), F.count("is_ground").alias("ground_points"), F.min(g).alias("ground_min"), F.max(g).alias("ground_max"))
