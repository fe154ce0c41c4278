"""Queries over the proxy clouds, one or more per operator, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom import sources
from pointloom.functions import colour, transforms
from pointloom.operators import classify, cloth, features, filters, ground, inference, octree, sampling, segment, spatial, stats
from pointloom.operators.graph import component_of, dbscan, dense_ids, eps_components, with_labels
from pointloom.plans.proxy import EMBED_SQL, EVENTS_SQL, cloud_embed, cloud_events
from pointloom.schema import PLANE_CLUSTERS, SPACE_CLUSTERS
from pointloom.scratch import new_path
from pointloom.sources import instances
from pointloom.sources.laz import CHUNK_POINTS
from pointloom.sources.ranges import MOST_TASKS, catalogue, read_ranges
from pointloom.sources.formats import RawXyz

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, cloud: Callable[[SparkSession, str], DataFrame] | None = None):
    """Registers a function of a cloud, or of (spark, sf_dir) if there is none."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf: f(cloud(spark, sf))) if cloud else f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(sql: str | None = None):
    return query(sql and f"WITH RECURSIVE {EVENTS_SQL}, {sql}", cloud_events)


def embed(sql: str | None = None):
    return query(sql and f"WITH RECURSIVE {EMBED_SQL}, {sql}", cloud_embed)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql_rounded(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c.split('.')[-1]}" for c in cols)


# ground: the flagship pipeline

_FRAME = "f AS (SELECT min(x) AS x0, min(y) AS y0, greatest(1, ceil((max(x) - min(x)) / 10.0))::BIGINT AS nx, greatest(1, ceil((max(y) - min(y)) / 10.0))::BIGINT AS ny FROM cloud)"
_CELL = "greatest(0, least(nx - 1, floor((x - x0) / 10.0)))::BIGINT AS ix, greatest(0, least(ny - 1, floor((y - y0) / 10.0)))::BIGINT AS iy"
_CAND = f"""{_FRAME}, c AS (SELECT pid, x, y, z, {_CELL} FROM cloud, f),
    k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY z, pid) AS rank, count(*) OVER (PARTITION BY ix, iy) AS cnt FROM c),
    cand AS (SELECT pid, x, y, z, ix, iy FROM k WHERE rank <= least(cnt, 5, greatest(1, ceil(cnt * 0.05))))"""


@events(f"{_CAND} SELECT pid, ix, iy FROM cand")
def ground_candidates(cloud):
    return ground.candidates(cloud, 10.0).select("pid", "ix", "iy")


@events(f"{_CAND} SELECT ix, iy, min(z) AS z FROM cand GROUP BY ix, iy")
def dtm_grid(cloud):
    return ground.terrain(ground.candidates(cloud, 10.0), cloud, 10.0)


_RASTER = f"""{_CAND}, occ AS (SELECT ix, iy, min(z) AS z FROM cand GROUP BY ix, iy),
    every AS (SELECT a.ix, b.iy FROM f, range(nx) a(ix), range(ny) b(iy)),
    hole AS (SELECT ix, iy FROM every ANTI JOIN occ USING (ix, iy)),
    near AS (SELECT h.ix, h.iy, o.z, row_number() OVER (PARTITION BY h.ix, h.iy ORDER BY (h.ix - o.ix) * (h.ix - o.ix) + (h.iy - o.iy) * (h.iy - o.iy), o.ix, o.iy) AS k FROM hole h, occ o),
    raster AS (SELECT ix, iy, z FROM occ UNION ALL SELECT ix, iy, z FROM near WHERE k = 1)"""


@events(f"""{_RASTER},
    q AS (SELECT pid, z, ix, iy, least(1, greatest(0, (x - x0) / 10.0 - ix)) AS fx, least(1, greatest(0, (y - y0) / 10.0 - iy)) AS fy, least(nx - 1, ix + 1) AS jx, least(ny - 1, iy + 1) AS jy FROM (SELECT *, {_CELL} FROM cloud, f)),
    t AS (SELECT pid, q.z, (1 - fx) * (1 - fy) * a.z + (1 - fx) * fy * b.z + fx * (1 - fy) * c.z + fx * fy * d.z AS terrain
          FROM q JOIN raster a ON a.ix = q.ix AND a.iy = q.iy JOIN raster b ON b.ix = q.ix AND b.iy = q.jy JOIN raster c ON c.ix = q.jx AND c.iy = q.iy JOIN raster d ON d.ix = q.jx AND d.iy = q.jy)
    SELECT pid, round(z - terrain, 6) AS z, z AS z_original FROM t""")
def height_normalized(cloud):
    df = ground.normalize_height(cloud, 10.0, ground=ground.candidates(cloud, 10.0))
    return df.select("pid", F.round("z", 6).alias("z"), "z_original")


@events(f"""{_CAND}, n AS (SELECT a.pid, a.z, b.z AS oz, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pid) AS k FROM cand a, cand b),
    m AS (SELECT pid, any_value(z) AS z, median(oz) AS med FROM n WHERE k <= 6 GROUP BY pid)
    SELECT pid FROM m WHERE abs(z - med) < 3.0""")
def ground_kept(cloud):
    return ground.ground_points(cloud, 10.0).select("pid")


@embed("""g AS (SELECT * FROM cloud WHERE classification < 5), q AS (SELECT * FROM cloud WHERE classification >= 5),
    n AS (SELECT q.pid, g.z, (q.x - g.x) * (q.x - g.x) + (q.y - g.y) * (q.y - g.y) AS d2, row_number() OVER (PARTITION BY q.pid ORDER BY (q.x - g.x) * (q.x - g.x) + (q.y - g.y) * (q.y - g.y), g.pid) AS k FROM q, g)
    SELECT pid, round(sum(z / greatest(d2, 1e-12)) / sum(1 / greatest(d2, 1e-12)), 6) AS terrain FROM n WHERE k <= 8 GROUP BY pid""")
def idw_terrain(cloud):
    return rounded(ground.inverse_distance(cloud.where("classification >= 5"), cloud.where("classification < 5")))


@events()
def height_report(cloud):
    g = ground.candidates(cloud, 10.0)
    return rounded(ground.report(ground.normalize_height(cloud, 10.0, ground=g), g))


ORACLE_SQL["height_report"] = ORACLE_SQL["height_normalized"].rpartition("SELECT pid, round(z - terrain")[0].rstrip() + """, m AS (SELECT z, z - terrain AS h, CASE WHEN pid IN (SELECT pid FROM cand) THEN z - terrain END AS g FROM t)
    SELECT count(*) AS points, round(min(z), 6) AS original_min, round(max(z), 6) AS original_max, round(min(h), 6) AS normalized_min, round(max(h), 6) AS normalized_max, count(g) AS ground_points, round(min(g), 6) AS ground_min, round(max(g), 6) AS ground_max FROM m"""


@events()
def cloth_ground(cloud):
    return cloth.classified(cloud, 5.0, 10.0, 200).select("pid", "is_ground")


# statistics

@events("""s AS (SELECT count(*) AS n, min(x) a, max(x) b, avg(x) c, min(y) d, max(y) e, avg(y) f, min(z) g, max(z) h, avg(z) i, min(intensity) j, max(intensity) k, avg(intensity) l FROM cloud)
    SELECT n, round(a, 2) AS min_x, round(b, 2) AS max_x, round(c, 2) AS avg_x, round(d, 2) AS min_y, round(e, 2) AS max_y, round(f, 2) AS avg_y, round(g, 2) AS min_z, round(h, 2) AS max_z, round(i, 2) AS avg_z,
           floor(j)::BIGINT AS min_intensity, floor(k)::BIGINT AS max_intensity, floor(l)::BIGINT AS avg_intensity, round(b - a, 2) AS extent_x, round(e - d, 2) AS extent_y, round(h - g, 2) AS extent_z, round(n / ((b - a) * (e - d)), 2) AS density FROM s""")
def stats_global(cloud):
    return stats.statistics(cloud)


@events("s AS (SELECT 1) SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM cloud")
def bbox(cloud):
    return stats.bbox(cloud)


@events("""u AS (SELECT 'x' AS field, x AS v FROM cloud UNION ALL SELECT 'y', y FROM cloud UNION ALL SELECT 'z', z FROM cloud UNION ALL SELECT 'intensity', intensity FROM cloud)
    SELECT field, min(v) AS min, max(v) AS max, round(avg(v), 6) AS avg FROM u GROUP BY field""")
def scalar_fields(cloud):
    return stats.scalar_fields(cloud).withColumn("avg", F.round("avg", 6))


@embed("""n AS (SELECT a.pid, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM cloud a JOIN cloud b ON a.pid <> b.pid GROUP BY a.pid)
    SELECT round(median(sqrt(d2)), 9) AS spacing FROM n""")
def point_spacing(cloud):
    return rounded(stats.spacing(cloud), 9)


@events("s AS (SELECT count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS d FROM cloud) SELECT round(greatest(0.01, greatest(w, d) / sqrt(n)), 6) AS by_extent, round(greatest(0.02, sqrt(w * d / n)), 6) AS by_area FROM s")
def extent_spacing(cloud):
    return rounded(stats.extent_spacing(cloud))


@events("s AS (SELECT 1) SELECT classification, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cloud GROUP BY classification")
def class_histogram(cloud):
    return rounded(stats.class_histogram(cloud))


@events("""s AS (SELECT classification AS category, pid % 7 AS instance_id, z FROM cloud)
    SELECT category, count(*) AS points, count(DISTINCT (category, instance_id)) AS instances FROM s GROUP BY ROLLUP (category)""")
def category_summary(cloud):
    return stats.category_summary(cloud.select(F.col("classification").alias("category"), (F.col("pid") % 7).alias("instance_id"), "z"))


@events("s AS (SELECT 1) SELECT classification, pid % 7 AS instance_id, count(*) AS count, min(z) AS z_min, max(z) AS z_max, round(avg(z), 6) AS z_mean FROM cloud GROUP BY ALL")
def instance_stats(cloud):
    return rounded(stats.instance_stats(cloud.withColumn("instance_id", F.col("pid") % 7), "classification", "instance_id"))


@events("s AS (SELECT min(z) AS lo, max(z) AS hi FROM cloud) SELECT least(floor((z - lo) / (hi - lo) * 32), 31)::BIGINT AS bin, count(*) AS n FROM cloud, s GROUP BY 1")
def histogram(cloud):
    return stats.histogram(cloud, "z", 32)


@events("s AS (SELECT 1) SELECT floor(x / 8)::BIGINT AS ix, floor(y / 8)::BIGINT AS iy, count(*) AS n, count(*) / 64.0::DOUBLE AS density FROM cloud GROUP BY 1, 2")
def density_grid(cloud):
    return stats.density_grid(cloud, 8.0)


@events("""v AS (SELECT x AS poly, x, y, z, pid, lead(x) OVER w AS bx, lead(y) OVER w AS vy, lead(z) OVER w AS bz, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, y + z AS u, lead(y + z) OVER w AS bu, first_value(y + z) OVER w AS fu
         FROM cloud WINDOW w AS (PARTITION BY x ORDER BY pid))
    SELECT poly, count(*) AS n, round(coalesce(sum(sqrt((bu - u) * (bu - u) + (vy - y) * (vy - y) + (bz - z) * (bz - z))), 0), 4) AS length,
           CASE WHEN count(*) >= 3 THEN round(abs(sum(u * coalesce(vy, fy) - coalesce(bu, fu) * y)) / 2, 4) ELSE 0 END AS area FROM v GROUP BY poly""")
def measure_polyline(cloud):
    return rounded(stats.polygon_areas(cloud.select(F.col("x").alias("poly"), (F.col("y") + F.col("z")).alias("x"), "y", "z", F.col("pid").alias("ord")), "poly"), 4)


@events("p AS (SELECT *, row_number() OVER (ORDER BY pid) AS k FROM cloud ORDER BY pid LIMIT 2) SELECT round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS distance, round(abs(a.z - b.z), 6) AS height FROM p a, p b WHERE a.k = 1 AND b.k = 2")
def measure_distance(cloud):
    return rounded(stats.distance_and_height(cloud.withColumnRenamed("pid", "ord")))


# filters and crops

@events("s AS (SELECT 1) SELECT pid, x, y, z FROM cloud WHERE x BETWEEN 10 AND 60 AND y BETWEEN 100 AND 500 AND z BETWEEN 5 AND 200")
def crop_aabb(cloud):
    return cloud.where(filters.in_box((10, 100, 5), (60, 500, 200))).select("pid", "x", "y", "z")


@events("d AS (SELECT pid, x - 50 AS dx, y - 300 AS dy, z - 100 AS dz FROM cloud) SELECT pid FROM d WHERE abs(dx * 0.8775825618903728 + dy * 0.479425538604203) <= 40 AND abs(dy * 0.8775825618903728 - dx * 0.479425538604203) <= 150 AND abs(dz) <= 90")
def crop_obb(cloud):
    return cloud.where(filters.in_oriented_box((50, 300, 100), (40, 150, 90), 0.5)).select("pid")


@events("s AS (SELECT 1) SELECT (x BETWEEN 10 AND 60 AND y BETWEEN 100 AND 500 AND z BETWEEN 5 AND 200) AS inside, count(*) AS n FROM cloud GROUP BY 1")
def crop_split_counts(cloud):
    inner, outer = filters.split(cloud, filters.in_box((10, 100, 5), (60, 500, 200)))
    return inner.agg(F.lit(True).alias("inside"), F.count("*").alias("n")).unionByName(outer.agg(F.lit(False).alias("inside"), F.count("*").alias("n")))


@events("s AS (SELECT 1) SELECT pid FROM cloud WHERE (x - 50) * (x - 50) + (y - 300) * (y - 300) <= 900")
def crop_circle(cloud):
    return cloud.where(filters.in_circle(50, 300, 30)).select("pid")


@events("s AS (SELECT 1) SELECT pid FROM cloud WHERE y >= 100 AND y < 400 AND x < (100.0 - 10.0) * (y - 400) / (100.0 - 400.0) + 10.0 AND NOT x < (0.0 - 10.0) * (y - 400) / (100.0 - 400.0) + 10.0")
def crop_polygon(cloud):
    return cloud.where(filters.in_polygon([(0.0, 100.0), (100.0, 100.0), (10.0, 400.0)])).select("pid")


@events("s AS (SELECT 1) SELECT pid FROM cloud WHERE z BETWEEN 20 AND 80")
def height_slice(cloud):
    return cloud.where(F.col("z").between(20, 80)).select("pid")


@events("s AS (SELECT 1) SELECT -2 * (x - 10) - 3 * (y - 100) + 40 * (z - 30) >= 0 AS above, count(*) AS n FROM cloud GROUP BY 1")
def plane_split(cloud):
    # three points of the plane 2x + 3y - 40z = const; the cross product of their sides points up
    return cloud.groupBy(filters.above_plane((10, 100, 30), (10, 140, 33), (-10, 100, 29)).alias("above")).agg(F.count("*").alias("n"))


@events("p AS (SELECT pid, (2 * x / (0.01 * z + 1) / 100 - 1 + 1) / 2 * 800 AS px, (1 - (y / 400 - 1) / (0.01 * z + 1)) / 2 * 600 AS py FROM cloud) SELECT pid FROM p WHERE px BETWEEN 100 AND 500 AND py BETWEEN 50 AND 400")
def crop_screen(cloud):
    matrix = [0.02, 0, 0, 0, 0, 1 / 400, 0, -1, 0, 0, 0, 0, 0, 0, 0.01, 1]
    moved = cloud.withColumn("x", F.col("x") - 0.0)
    return moved.where(filters.on_screen([0.02, 0, -0.01, -1, *matrix[4:]], 800, 600, (100, 50, 500, 400))).select("pid")


@events("""s AS (SELECT count(*) AS n, list_sort(list(x)) AS xs, list_sort(list(y)) AS ys, list_sort(list(z)) AS zs FROM cloud),
    b AS (SELECT xs[floor(n * .005)::BIGINT + 1] AS xl, xs[floor(n * (1 - .005))::BIGINT + 1] AS xh, ys[floor(n * .005)::BIGINT + 1] AS yl, ys[floor(n * (1 - .005))::BIGINT + 1] AS yh, zs[floor(n * .005)::BIGINT + 1] AS zl, zs[floor(n * (1 - .005))::BIGINT + 1] AS zh FROM s)
    SELECT pid FROM cloud, b WHERE x BETWEEN xl - (xh - xl) * .1 AND xh + (xh - xl) * .1 AND y BETWEEN yl - (yh - yl) * .1 AND yh + (yh - yl) * .1 AND z BETWEEN zl - (zh - zl) * .1 AND zh + (zh - zl) * .1""")
def percentile_box(cloud):
    return filters.percentile_box(cloud).select("pid")


@events("s AS (SELECT 1) SELECT a.pid, count(*) AS n FROM cloud a JOIN cloud b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 AND b.x BETWEEN a.x - 3 AND a.x + 3 GROUP BY a.pid")
def radius_counts(cloud):
    return spatial.radius_counts(cloud, 3.0)


@events("s AS (SELECT 1) SELECT a.pid FROM cloud a JOIN cloud b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 100 AND b.x BETWEEN a.x - 10 AND a.x + 10 GROUP BY a.pid HAVING count(*) >= 5")
def radius_filter(cloud):
    return filters.radius(cloud, 10.0, 5).select("pid")


@embed("""w AS (SELECT a.pid, b.x, b.y, b.z, exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 0.5) AS w FROM cloud a, cloud b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1)
    SELECT pid, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y, round(sum(w * z) / sum(w), 6) AS z FROM w GROUP BY pid""")
def gaussian_smooth(cloud):
    return rounded(filters.gaussian(cloud, 0.5, 1.0).select("pid", "x", "y", "z"))


_KNN = "n AS (SELECT a.pid, b.pid AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM cloud a, cloud b), k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, other) AS rank FROM n)"


@embed(f"{_KNN} SELECT pid, other, rank::INT AS rank FROM k WHERE rank <= 5")
def knn(cloud):
    return spatial.nearest(cloud, cloud, 5, ("x", "y", "z")).select("pid", "other", "rank")


@embed(f"{_KNN}, m AS (SELECT pid, avg(sqrt(d2)) AS m FROM k WHERE rank <= 20 GROUP BY pid) SELECT pid, round(m, 6) AS mean_distance FROM m")
def knn_mean_distance(cloud):
    return rounded(filters.knn_mean_distance(cloud, 20))


@embed(f"{_KNN}, m AS (SELECT pid, avg(sqrt(d2)) AS m FROM k WHERE rank <= 20 GROUP BY pid), s AS (SELECT avg(m) AS a, stddev_pop(m) AS s FROM m) SELECT pid FROM m, s WHERE abs(m - a) <= s.s")
def statistical_filter(cloud):
    return filters.statistical(cloud, 20, 1.0).select("pid")


@embed(f"{_KNN}, m AS (SELECT pid, avg(sqrt(d2)) AS m FROM k WHERE rank <= 5 GROUP BY pid), s AS (SELECT avg(m) AS a, stddev_samp(m) AS s FROM m) SELECT pid FROM m, s WHERE m < a + 2 * s.s")
def sor_filter(cloud):
    return filters.outlier_removal(cloud, 2.0, 5).select("pid")


@embed("s AS (SELECT pid, x * x + (y - 1) * (y - 1) + z * z AS d2 FROM cloud) SELECT pid FROM s ORDER BY d2, pid LIMIT 10")
def nearest_points(cloud):
    d2 = F.col("x") * F.col("x") + (F.col("y") - 1) * (F.col("y") - 1) + F.col("z") * F.col("z")
    return cloud.orderBy(d2, "pid").limit(10).select("pid")


# sampling

@events("s AS (SELECT count(*) AS n FROM cloud) SELECT pid FROM cloud, s WHERE pid % (n // 100) = 0 AND pid // (n // 100) < 100")
def stride_sample(cloud):
    return sampling.stride(cloud, cloud.count(), 100).select("pid")


@events("s AS (SELECT count(*) / 300.0::DOUBLE AS step FROM cloud) SELECT pid FROM cloud, s WHERE floor(ceil(pid / step) * step)::BIGINT = pid")
def lod_sample(cloud):
    return sampling.level_of_detail(cloud, cloud.count(), 300).select("pid")


@events("s AS (SELECT 1) SELECT floor(x / 10)::BIGINT AS ix, floor(y / 10)::BIGINT AS iy, floor(z / 10)::BIGINT AS iz, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM cloud GROUP BY 1, 2, 3")
def voxel_downsample(cloud):
    return rounded(sampling.voxels(cloud, 10.0))


@events()
def random_sample(cloud):
    return sampling.random(cloud, 0.1).select("pid")


# projections and colours

@events("s AS (SELECT 1) SELECT pid, x, y, z, intensity FROM cloud")
def field_projection(cloud):
    return transforms.fields(cloud, ["Intensity", "no_such_field"])


@events("s AS (SELECT 1) SELECT round(-(min(x) + max(x)) / 2, 6) AS shift_x, round(-(min(y) + max(y)) / 2, 6) AS shift_y, round(-(min(z) + max(z)) / 2, 6) AS shift_z FROM cloud")
def suggested_shift(cloud):
    return rounded(transforms.suggested_shift(cloud))


@events("s AS (SELECT 1) SELECT pid, x + 1.5 AS x, y - 2.5 AS y, z AS z FROM cloud")
def coordinate_shift(cloud):
    return transforms.shifted(cloud, (1.5, -2.5, 0.0)).select("pid", "x", "y", "z")


@events("s AS (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM cloud) SELECT pid, x - a AS x, y - b AS y, z - c AS z FROM cloud, s")
def from_minimum(cloud):
    return transforms.from_minimum(cloud).select("pid", "x", "y", "z")


@events("v AS (SELECT pid, y AS a, z AS b, -x AS c FROM cloud), s AS (SELECT (min(a) + max(a)) / 2 AS a0, (min(b) + max(b)) / 2 AS b0, (min(c) + max(c)) / 2 AS c0 FROM v) SELECT pid, a - a0 AS vx, b - b0 AS vy, c - c0 AS vz FROM v, s")
def viewer_axes(cloud):
    return transforms.viewer(cloud).select("pid", "vx", "vy", "vz")


@events("s AS (SELECT *, CASE WHEN pid % 3 <> 1 THEN x END AS gx FROM cloud) SELECT pid, last_value(gx IGNORE NULLS) OVER (PARTITION BY classification ORDER BY pid ROWS UNBOUNDED PRECEDING) AS x FROM s")
def carry_forward(cloud):
    broken = cloud.withColumn("x", F.when(F.col("pid") % 3 != 1, F.col("x")).otherwise(F.lit(float("nan"))))
    df = transforms.carried_forward(broken, "classification")
    return df.select("pid", F.nanvl("x", F.lit(None).cast("double")).alias("x"))


@events("c AS (SELECT pid, intensity * 5 AS r, z AS g, x AS b FROM cloud), m AS (SELECT max(r) AS mr, max(g) AS mg, max(b) AS mb FROM c) SELECT pid, CASE WHEN mr > 255 THEN r / 256 ELSE r END AS r, CASE WHEN mg > 255 THEN g / 256 ELSE g END AS g, CASE WHEN mb > 255 THEN b / 256 ELSE b END AS b FROM c, m")
def colours_8_bit(cloud):
    return transforms.colours_to_8_bit(cloud.select("pid", (F.col("intensity") * 5).alias("r"), F.col("z").alias("g"), F.col("x").alias("b")))


@events("c AS (SELECT pid, z - 10 AS r, z * 2 AS g, x AS b FROM cloud) SELECT pid, least(greatest(r, 0), 255) AS r, least(greatest(g, 0), 255) AS g, least(greatest(b, 0), 255) AS b FROM c")
def colours_clipped(cloud):
    return transforms.clipped_to_8_bit(cloud.select("pid", (F.col("z") - 10).alias("r"), (F.col("z") * 2).alias("g"), F.col("x").alias("b")))


@events("c AS (SELECT pid, z / 490 AS r, x / 2e3 AS g, intensity / 200 AS b, intensity, classification FROM cloud), m AS (SELECT greatest(max(r), max(g), max(b)) AS c, max(intensity) AS i FROM c) SELECT pid, round(least(greatest(r * k, 0), 65535), 6) AS r, round(least(greatest(g * k, 0), 65535), 6) AS g, round(least(greatest(b * k, 0), 65535), 6) AS b, round(least(greatest(intensity * j, 0), 65535), 6) AS intensity, classification FROM (SELECT c.*, CASE WHEN m.c <= 1 THEN 65535 WHEN m.c <= 255 THEN 257 ELSE 1 END AS k, CASE WHEN i <= 1 THEN 65535 WHEN i <= 255 THEN 257 ELSE 1 END AS j FROM c, m)")
def las_rescaled(cloud):
    return rounded(transforms.las_scaled(cloud.select("pid", (F.col("z") / 490).alias("r"), (F.col("x") / 2e3).alias("g"), (F.col("intensity") / 200).alias("b"), "intensity", "classification")))


_UNIT = """p AS (SELECT quantile_cont(intensity, 0.01) AS lo, quantile_cont(intensity, 0.99) AS hi, min(z) AS z0, max(z) AS z1 FROM cloud),
    u AS (SELECT pid, x, y, z, CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE least(1, greatest(0, (intensity - lo) / (hi - lo))) END AS ni, (z - z0) / (z1 - z0) AS nz FROM cloud, p)"""
_CUTS = ", ".join([f"quantile_cont(ni, {p / 100}) AS i{p}" for p in (5, 10, 20, 30, 50, 60, 70, 85, 95)] + [f"quantile_cont(nz, {p / 100}) AS z{p}" for p in (5, 10, 20, 30, 40, 50)])


@events(f"{_UNIT} SELECT pid, round(ni, 9) AS ni, round(nz, 9) AS nz FROM u")
def intensity_norm(cloud):
    return rounded(transforms.unit_height(transforms.unit_intensity(cloud)).select("pid", "ni", "nz"), 9)


_NAMES = [f"i{p}" for p in (5, 10, 20, 30, 50, 60, 70, 85, 95)] + [f"z{p}" for p in (5, 10, 20, 30, 40, 50)]


@events(f"{_UNIT}, t AS (SELECT {_CUTS} FROM u) SELECT {_sql_rounded(*_NAMES, places=9)} FROM t")
def adaptive_thresholds(cloud):
    return rounded(classify.intensity_thresholds(transforms.unit_height(transforms.unit_intensity(cloud))), 9)


_INTENSITY = f"""{_UNIT}, t AS (SELECT {_CUTS} FROM u), cat AS (
    SELECT pid, CASE WHEN nz < z20 AND ni < i30 THEN 'ground' WHEN nz >= z5 AND nz < z40 AND ni >= i5 AND ni < i50 THEN 'low_vegetation' WHEN nz >= z40 AND ni >= i60 THEN 'building'
        WHEN nz >= z20 AND ni >= i20 AND ni < i85 THEN 'tree' WHEN ni >= i95 THEN 'high_reflectivity' WHEN nz >= z20 THEN 'tree' WHEN nz >= z5 THEN 'low_vegetation' ELSE 'ground' END AS category FROM u, t)"""


@events(f"{_INTENSITY} SELECT pid, category FROM cat")
def intensity_labels(cloud):
    return classify.intensity_labels(cloud).select("pid", "category")


def _ramp_sql(t: str, stops: list[tuple[float, ...]]) -> str:
    n = len(stops) - 1
    lists = [f"[{', '.join(repr(float(s[c])) for s in stops)}]" for c in range(3)]
    mixed = [f"round({a}[k + 1] + ({a}[k + 2] - {a}[k + 1]) * (s - k), 6) AS {c}" for a, c in zip(lists, "rgb", strict=True)]
    return f"q AS (SELECT pid, greatest(0, least(1, {t})) * {n} AS s FROM cloud, m), w AS (SELECT pid, s, least(floor(s), {n - 1})::BIGINT AS k FROM q) SELECT pid, {', '.join(mixed)} FROM w"


def _rgb(df: DataFrame) -> DataFrame:
    return df.select("pid", *[F.round(F.col(f"colour.{c}"), 6).alias(c) for c in "rgb"])


@events("m AS (SELECT min(z) AS lo, max(z) AS hi FROM cloud), " + _ramp_sql("(z - lo) / (hi - lo)", colour.stops("rainbow")))
def color_elevation(cloud):
    return _rgb(colour.coloured(cloud, "elevation", "rainbow"))


@events("m AS (SELECT min(intensity) AS lo, max(intensity) AS hi FROM cloud), " + _ramp_sql("(intensity - lo) / (hi - lo)", colour.stops("hot")))
def color_intensity(cloud):
    return _rgb(colour.coloured(cloud, "intensity", "hot"))


@events("m AS (SELECT min(z) AS lo, max(z) AS hi FROM cloud), " + _ramp_sql("(z - lo) / (hi - lo)", colour.ELEVATION_RAMP))
def color_rgb_fallback(cloud):
    return _rgb(colour.coloured(cloud, "rgb"))


@events("m AS (SELECT min(sqrt(x * x + y * y + z * z)) AS lo, max(sqrt(x * x + y * y + z * z)) AS hi FROM cloud), " + _ramp_sql("(sqrt(x * x + y * y + z * z) - lo) / (hi - lo)", colour.stops("cool")))
def colour_radial(cloud):
    return _rgb(colour.coloured(cloud.withColumn("radial_distance", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))), "radial_distance", "cool"))


@events("""b AS (SELECT greatest(0.01, greatest(max(x) - min(x), max(y) - min(y)) / sqrt(count(*))) AS s, greatest(0.02, sqrt((max(x) - min(x)) * (max(y) - min(y)) / count(*))) AS a FROM cloud)
    SELECT s AS spacing, greatest(0.3, 15 * s) AS eps, greatest(3, floor(1 / (s + 1e-6))::BIGINT) AS least, least(30, greatest(10, floor(1 / s)::BIGINT)) AS k, greatest(0.2, 8 * s) AS intensity_eps,
           greatest(3, floor(1.5 / (s + 1e-6))::BIGINT) AS intensity_least, least(1.2, greatest(0.3, 6 * a)) AS cluster_eps FROM b""")
def derived_parameters(cloud):
    return classify.derived_parameters(cloud)


@events(f"s AS (SELECT {colour.INSTANCE_COLOURS!r} AS p) SELECT pid, p[pid % 30 + 1] AS by_instance, CASE WHEN classification BETWEEN 1 AND 30 THEN p[classification] ELSE '#808080' END AS by_label FROM cloud, s")
def palette_map(cloud):
    return cloud.select("pid", colour.instance_colour(F.col("pid")).alias("by_instance"), colour.label_colour(F.col("classification")).alias("by_label"))


@events("h AS (SELECT pid, '#' || lpad(lower(to_hex(pid % 16777216)), 6, '0') AS h FROM cloud) SELECT pid, h, round((pid // 65536 % 256) / 255.0, 9) AS r, round((pid // 256 % 256) / 255.0, 9) AS g, round((pid % 256) / 255.0, 9) AS b FROM h")
def hex_colours(cloud):
    df = cloud.select("pid", F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("pid") % 16777216)), 6, "0")).alias("h")).withColumn("colour", colour.of_hex(F.col("h")))
    return df.select("pid", "h", *[F.round(F.col(f"colour.{c}"), 9).alias(c) for c in "rgb"])


@events("s AS (SELECT 1) SELECT pid, [2, 3, 5, 6, 7, 1][least(greatest(pid % 8, 0), 5) + 1]::INT AS las_code FROM cloud")
def las_code_map(cloud):
    return cloud.select("pid", transforms.las_code(F.col("pid") % 8).alias("las_code"))


# shape

_COV = """kn AS (SELECT a.pid, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pid) AS k FROM cloud a, cloud b),
    cv AS (SELECT pid, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz, max(z) - min(z) AS rise FROM kn WHERE k <= {k} GROUP BY pid)"""


@embed(_COV.format(k=20) + """, q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv), d AS (SELECT *, xx - q AS a, yy - q AS b, zz - q AS c FROM q),
    p AS (SELECT *, sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p, a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz) AS det FROM d),
    l AS (SELECT *, q + 2 * p * cos(acos(least(1, greatest(-1, det / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS l FROM p)
    SELECT pid, round(abs(l) / (xx + yy + zz), 6) AS curvature, round(1 - abs(l) / (xx + yy + zz), 6) AS planarity FROM l""")
def planarity(cloud):
    return rounded(features.shape(cloud, 20).select("pid", "curvature", "planarity"))


@embed(_COV.format(k=10) + ", s AS (SELECT max(z) - min(z) AS span FROM cloud) SELECT pid, round(rise / span, 6) AS curvature, round(least(1, rise / 2), 6) AS verticality FROM cv, s")
def height_features(cloud):
    return rounded(features.height_proxy(cloud))


@embed("""o AS (SELECT a.pid, sum(b.x - a.x) AS x, sum(b.y - a.y) AS y, sum(b.z - a.z) AS z FROM cloud a, cloud b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1 GROUP BY a.pid), l AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM o)
    SELECT pid, CASE WHEN l > 1e-12 THEN round(x / l, 6) ELSE 0 END AS nx, CASE WHEN l > 1e-12 THEN round(y / l, 6) ELSE 1 END AS ny, CASE WHEN l > 1e-12 THEN round(z / l, 6) ELSE 0 END AS nz FROM l""")
def pseudo_normals(cloud):
    return rounded(features.mean_offsets(cloud, 1.0))


# graphs and classes

_EDGES = "e AS (SELECT a.pid AS a, b.pid AS b FROM cloud a, cloud b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r2})"
_REACH = "r AS (SELECT pid AS a, pid AS b FROM cloud UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), comp AS (SELECT a AS pid, min(b) AS comp FROM r GROUP BY a)"


@embed(f"{_EDGES.format(r2=0.0064)}, {_REACH} SELECT pid, comp FROM comp")
def components(cloud):
    return eps_components(cloud, 0.08)


@embed(f"""c0 AS (SELECT pid, floor(x / 0.2)::BIGINT AS ix, floor(y / 0.2)::BIGINT AS iy FROM cloud), c AS (SELECT ix, iy, min(pid) AS pid FROM c0 GROUP BY ix, iy),
    e AS (SELECT a.pid AS a, b.pid AS b FROM c a, c b WHERE abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1), r AS (SELECT pid AS a, pid AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    k AS (SELECT a AS pid, min(b) AS comp FROM r GROUP BY a), l AS (SELECT c0.pid, k.comp FROM c0 JOIN c USING (ix, iy) JOIN k ON k.pid = c.pid)
    SELECT pid, comp, count(*) OVER (PARTITION BY comp) AS size FROM l QUALIFY count(*) OVER (PARTITION BY comp) >= 2""")
def grid_components(cloud):
    return classify.grid_clustered(cloud, 0.2).select("pid", "comp", "size")


_DBSCAN = """n AS (SELECT a.pid, a.classification AS c, b.pid AS other FROM cloud a JOIN cloud b ON a.classification = b.classification AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r2}),
    core AS (SELECT pid FROM n GROUP BY pid HAVING count(*) >= {least}), e AS (SELECT pid AS a, other AS b FROM n WHERE pid IN (FROM core) AND other IN (FROM core)),
    r AS (SELECT pid AS a, pid AS b FROM core UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), k AS (SELECT a AS pid, min(b) AS cluster FROM r GROUP BY a),
    border AS (SELECT n.pid, min(k.cluster) AS cluster FROM n JOIN k ON k.pid = n.other GROUP BY n.pid),
    db AS (SELECT cloud.pid, classification, x, y, z, coalesce(k.cluster, border.cluster, -1) AS cluster FROM cloud LEFT JOIN k ON k.pid = cloud.pid LEFT JOIN border ON border.pid = cloud.pid)"""


@embed(f"{_DBSCAN.format(r2=0.09, least=4)} SELECT pid, classification, cluster FROM db")
def dbscan_by_class(cloud):
    return dbscan(cloud, 0.3, 4, ("x", "y"), ("classification",))


@embed(f"{_DBSCAN.format(r2=0.09, least=4)}, g AS (SELECT cluster, classification, min(pid) AS first FROM db WHERE cluster >= 0 GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY first) AS instance_id FROM g) SELECT db.pid, db.classification, d.instance_id FROM db JOIN d USING (cluster, classification)")
def dense_instances(cloud):
    return dense_ids(dbscan(cloud, 0.3, 4, ("x", "y"), ("classification",)).where("cluster >= 0"), ("classification",), "cluster").select("pid", "classification", "instance_id")


@embed(f"{_EDGES.format(r2=0.04)}, r AS (SELECT 0::BIGINT AS pid UNION SELECT e.b FROM r JOIN e ON e.a = r.pid) SELECT pid FROM r")
def region_growing(cloud):
    return component_of(eps_components(cloud, 0.2), 0)


_RULE = "CASE WHEN w < 0.8 AND h < 1.2 THEN 'low_vegetation' WHEN w <= 5 AND h > 1 THEN 'tree' WHEN w <= 5 AND h > 0.3 THEN 'low_vegetation' WHEN w > 5 THEN 'building' ELSE 'other' END"
_ALONE = "CASE WHEN z < 0.5 THEN 'low_vegetation' WHEN z > 3 THEN 'building' WHEN z > 0.5 THEN 'tree' ELSE 'other' END"


_LABELS = f"""{_EDGES.format(r2=0.0064)}, {_REACH}, s AS (SELECT cloud.*, comp, count(*) OVER (PARTITION BY comp) AS k FROM cloud JOIN comp USING (pid)),
    t AS (SELECT comp, greatest(max(x) - min(x), max(y) - min(y)) AS w, max(z) AS h FROM s WHERE k >= 2 GROUP BY comp),
    cat AS (SELECT pid, CASE WHEN k >= 2 THEN {_RULE} ELSE {_ALONE} END AS category FROM s LEFT JOIN t USING (comp))"""


@embed(f"{_LABELS} SELECT pid, category FROM cat")
def cluster_rule_labels(cloud):
    return classify.geometric_labels(cloud, 0.08).select("pid", "category")


@embed(f"""{_EDGES.format(r2=0.0064)}, {_REACH}, s AS (SELECT cloud.*, comp FROM cloud JOIN comp USING (pid))
    SELECT comp, count(*) AS n, round(max(x) - min(x), 9) AS x_ext, round(max(y) - min(y), 9) AS y_ext, round(max(z) - min(z), 9) AS z_ext, max(z) AS height FROM s GROUP BY comp HAVING count(*) >= 2""")
def cluster_extents(cloud):
    df = classify.cluster_extents(cloud.join(classify.clustered(cloud, 0.08), "pid"))
    return df.withColumns({c: F.round(c, 9) for c in ("x_ext", "y_ext", "z_ext")})


def _instances_sql(table: dict[str, tuple[float, int]], space: bool) -> str:
    """SQL of classify.instances() from a view lab (pid, x, y, z, category): views up to inst (pid, category, instance_id)."""
    rows = ", ".join(f"('{k}', {e}::DOUBLE, {n if space else max(3, n)})" for k, (e, n) in table.items())
    third = " + (a.z - b.z) * (a.z - b.z)" if space else ""
    return f"""cfg(category, eps, least) AS (VALUES {rows}),
    pts AS MATERIALIZED (SELECT lab.pid, x, y, z, category, eps, least, count(*) OVER (PARTITION BY category) AS total FROM lab JOIN cfg USING (category) QUALIFY total >= 3),
    alone AS (SELECT pid, category FROM pts WHERE total < least{"" if space else " OR category = 'ground'"}), q AS MATERIALIZED (SELECT * FROM pts WHERE pid NOT IN (SELECT pid FROM alone)),
    nb AS MATERIALIZED (SELECT a.pid, b.pid AS other, a.least FROM q a JOIN q b ON a.category = b.category AND abs(a.x - b.x) <= a.eps AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y){third} <= a.eps * a.eps),
    core AS MATERIALIZED (SELECT pid FROM nb GROUP BY pid HAVING count(*) >= any_value(least)), lk AS MATERIALIZED (SELECT pid AS a, other AS b FROM nb WHERE pid IN (FROM core) AND other IN (FROM core)),
    rch AS (SELECT pid AS a, pid AS b FROM core UNION SELECT rch.a, lk.b FROM rch JOIN lk ON lk.a = rch.b), cl AS MATERIALIZED (SELECT a AS pid, min(b) AS cluster FROM rch GROUP BY a),
    border AS (SELECT nb.pid, min(cl.cluster) AS cluster FROM nb JOIN cl ON cl.pid = nb.other GROUP BY nb.pid),
    db AS MATERIALIZED (SELECT q.pid, category, least, coalesce(cl.cluster, border.cluster, -1) AS cluster FROM q LEFT JOIN cl ON cl.pid = q.pid LEFT JOIN border ON border.pid = q.pid),
    big AS (SELECT category, cluster, min(pid) AS first, count(*) AS n FROM db WHERE cluster >= 0 GROUP BY category, cluster HAVING count(*) >= any_value(least)),
    ids AS MATERIALIZED (SELECT category, cluster, n, row_number() OVER (PARTITION BY category ORDER BY first) AS instance_id FROM big),
    noise AS (SELECT pid, category, least, count(*) OVER (PARTITION BY category) AS n FROM db WHERE cluster < 0),
    per AS (SELECT category, max(instance_id) AS last, arg_max(instance_id, (n, -instance_id)) AS largest FROM ids GROUP BY category),
    extra AS (SELECT pid, category, CASE WHEN noise.n >= least THEN coalesce(last, 0) + 1 ELSE {"NULL" if space else "largest"} END AS instance_id FROM noise LEFT JOIN per USING (category)),
    inst AS (SELECT pid, category, 1::BIGINT AS instance_id FROM alone UNION ALL SELECT db.pid, db.category, ids.instance_id FROM db JOIN ids USING (category, cluster) UNION ALL FROM extra WHERE instance_id IS NOT NULL)"""


@embed(f"lab AS (SELECT pid, x, y, z, ['tree', 'building', 'low_vegetation', 'other'][classification % 4 + 1] AS category FROM cloud), {_instances_sql(SPACE_CLUSTERS, True)} SELECT pid, category, instance_id FROM inst")
def geometric_instances(cloud):
    return classify.instances(cloud.withColumn("category", F.element_at(F.array(*map(F.lit, ("tree", "building", "low_vegetation", "other"))), (F.col("classification") % 4 + 1).cast("int"))))


# the plane is drawn five times smaller, dense enough for clusters, border points and noise
_BY_INTENSITY = f"{_INTENSITY}, lab AS (SELECT pid, x / 5 AS x, y / 5 AS y, z, category FROM cloud JOIN cat USING (pid)), {_instances_sql(PLANE_CLUSTERS, False)}"


def _smaller(cloud: DataFrame) -> DataFrame:
    return cloud.withColumns({c: F.col(c) / 5 for c in "xy"})


@events(f"{_BY_INTENSITY} SELECT pid, category, instance_id FROM inst")
def intensity_instances(cloud):
    return classify.classified(_smaller(cloud), "intensity").select("pid", "category", "instance_id")


@events(f"{_BY_INTENSITY} SELECT category, instance_id, count(*) AS n FROM inst GROUP BY ALL")
def hybrid_instances(cloud):
    return classify.classified(_smaller(cloud), "hybrid").groupBy("category", "instance_id").agg(F.count("*").alias("n"))


@embed(f"{_LABELS}, lab AS (SELECT pid, x, y, z, category FROM cloud JOIN cat USING (pid)), {_instances_sql(SPACE_CLUSTERS, True)} SELECT category, instance_id, count(*) AS n FROM inst GROUP BY ALL")
def geometric_classes(cloud):
    return classify.classified(cloud, eps=0.08).groupBy("category", "instance_id").agg(F.count("*").alias("n"))


# windows and votes

_WIN = "g AS (SELECT count(*) AS n FROM cloud), l AS (SELECT n, CASE WHEN n > 4096 THEN ceil((n - 4096) / 3584.0)::BIGINT ELSE 0 END AS last FROM g), w AS (SELECT pid, x, y, z, intensity, unnest(range(greatest(0, ceil((pid - 4095) / 3584.0))::BIGINT, least(last, pid // 3584) + 1)) AS win FROM cloud, l)"


@events(f"{_WIN}, s AS (SELECT win, avg(z) AS m, stddev_pop(z) AS s FROM w GROUP BY win) SELECT pid, win AS \"window\", round((z - m) / (s + 1e-8), 6) AS z FROM w JOIN s USING (win)")
def window_standardised(cloud):
    df = inference.standardised(sampling.windows(cloud.select("pid", "x", "y", "z", "intensity"), cloud.count(), 4096, 512))
    return rounded(df.select("pid", "window", "z"))


def _linear(cloud: DataFrame) -> DataFrame:
    w = sampling.windows(cloud.select("pid", "z", "intensity"), cloud.count(), 4096, 512)
    scores = F.array(*[F.struct(F.lit(k).alias("class"), (F.col("z") * a + F.col("intensity") * b + F.col("window") * c).alias("logit")) for k, (a, b, c) in enumerate(((1.0, 0.0, 0.5), (0.0, 3.0, -0.5), (0.5, 1.5, 0.0)))])
    return w.select("pid", F.inline(scores))


@events(f"""{_WIN}, v AS (SELECT pid, 0 AS class, z + win * 0.5 AS l FROM w UNION ALL SELECT pid, 1, intensity * 3 - win * 0.5 FROM w UNION ALL SELECT pid, 2, z * 0.5 + intensity * 1.5 FROM w),
    a AS (SELECT pid, class, avg(l) AS l FROM v GROUP BY ALL) SELECT pid, class FROM a QUALIFY row_number() OVER (PARTITION BY pid ORDER BY l DESC, class) = 1""")
def window_votes(cloud):
    return inference.votes(_linear(cloud))


@embed()
def model_inference(cloud):
    return inference.infer(cloud, inference.RandomFeatures(), 6, 128, 16).select("pid", "las_code", "tree_id", "building_id")


@events()
def inference_summary(cloud):
    coded = cloud.select("pid", F.col("classification").alias("las_code"), (F.col("pid") % 5).alias("tree_id"), (F.col("pid") % 3).alias("building_id"))
    return inference.summary(coded)


ORACLE_SQL["inference_summary"] = f"WITH {EVENTS_SQL} SELECT classification AS las_code, count(*) AS points, count(DISTINCT nullif(pid % 5, 0)) AS trees, count(DISTINCT nullif(pid % 3, 0)) AS buildings FROM cloud GROUP BY 1"


@events("s AS (SELECT pid, classification, pid % 5 AS t, pid % 3 AS b FROM cloud) SELECT 'class' AS kind, classification::BIGINT AS id, pid FROM s UNION ALL SELECT 'tree', t, pid FROM s WHERE t > 0 UNION ALL SELECT 'building', b, pid FROM s WHERE b > 0")
def inference_expanded(cloud):
    return inference.expanded(cloud.select("pid", F.col("classification").alias("las_code"), (F.col("pid") % 5).alias("tree_id"), (F.col("pid") % 3).alias("building_id")))


@events()
def tree_layers(cloud):
    return inference.tree_layers(cloud, layer=20.0, eps=20.0, reach=15.0, max_height=500.0)


@embed()
def building_normals(cloud):
    return inference.building_instances(cloud, least=5, eps=1.0)


# trees and buildings

@events()
def tree_segments(cloud):
    return segment.segment_trees(cloud, point_spacing=0.5, min_tree_spacing=2.0, max_crown_width=3.0)[0]


@events()
def building_segments(cloud):
    return segment.segment_buildings(cloud, point_spacing=0.5, building_eps=3.0, min_building_area=20.0)[0]


_TREES = "t AS (SELECT pid % 11 AS tree_id, x, y, z, 5.0::DOUBLE AS base, 40.0::DOUBLE AS top FROM cloud)"


@events(f"""{_TREES} SELECT tree_id, count(*) AS point_count, round(max(z) - min(z), 3) AS tree_height, round(max(z) FILTER (z > top) - min(z) FILTER (z > top), 3) AS crown_height, round(count(*) FILTER (z > top) / count(*), 3) AS crown_ratio,
    count(*) FILTER (z > top) AS crown_points, count(*) FILTER (z <= top) AS trunk_points FROM t GROUP BY tree_id""")
def tree_metrics(cloud):
    rows = cloud.select((F.col("pid") % 11).alias("tree_id"), "x", "y", "z", F.lit(5.0).alias("base"), F.lit(40.0).alias("top"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    return segment.tree_metrics(rows).select("tree_id", "point_count", "tree_height", "crown_height", "crown_ratio", "crown_points", "trunk_points")


@events("""b AS (SELECT pid % 11 AS rank, x, y, z, (pid % 97) / 97.0::DOUBLE AS planarity FROM cloud), l AS (SELECT rank, quantile_cont(z, 0.8) AS level, count(*) AS n FROM b GROUP BY rank),
    s AS (SELECT rank, max(x) - min(x) AS w, max(y) - min(y) AS d, max(z) - min(z) AS h FROM b GROUP BY rank)
    SELECT rank AS building_id, any_value(n) AS point_count, round(any_value(w), 3) AS width, round(any_value(d), 3) AS depth, round(any_value(w / greatest(d, 0.1)), 3) AS aspect_ratio, round(avg(planarity) FILTER (z >= level), 3) AS roof_planarity
    FROM b JOIN l USING (rank) JOIN s USING (rank) GROUP BY rank""")
def building_metrics(cloud):
    rows = cloud.select((F.col("pid") % 11).alias("rank"), "x", "y", "z", ((F.col("pid") % 97) / 97.0).alias("planarity"))
    box = rows.groupBy("rank").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    box = box.withColumns({"width": F.col("hix") - F.col("lox"), "depth": F.col("hiy") - F.col("loy"), "height": F.col("hiz") - F.col("loz")}).withColumn("area", F.col("width") * F.col("depth"))
    return segment.building_metrics(rows, box).select("building_id", "point_count", "width", "depth", "aspect_ratio", "roof_planarity")


# layers

@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 3 END AS parent FROM nation), r AS (SELECT id FROM f WHERE id = 1 UNION ALL SELECT f.id FROM f JOIN r ON f.parent = r.id) SELECT id FROM r""")
def folder_closure(spark: SparkSession, sf: str) -> DataFrame:
    from pointloom.plans.layers import descendants

    folders = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.expr("CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) div 3 END").alias("parent"))
    return descendants(folders, 1)


@query("SELECT n_name AS category, r_name AS label, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def dimension_lookup(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    return t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("n_name").alias("category"), F.col("r_name").alias("label")).agg(F.count("*").alias("n"))


_OCTREE = """b AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) + 0.001 AS side, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM cloud),
    i AS (SELECT pid, x, y, z, least(greatest(ceil((x - (cx - side / 2)) * (256 / side))::BIGINT - 1, 0), 255) AS ix, least(greatest(ceil((y - (cy - side / 2)) * (256 / side))::BIGINT - 1, 0), 255) AS iy,
                 least(greatest(ceil((z - (cz - side / 2)) * (256 / side))::BIGINT - 1, 0), 255) AS iz FROM cloud, b),
    l AS (SELECT d AS depth, ix >> (8 - d) AS jx, iy >> (8 - d) AS jy, iz >> (8 - d) AS jz, count(*) AS n FROM i, range(0, 9) t(d) GROUP BY ALL),
    t AS (SELECT c.*, c.n <= 10 OR c.depth = 8 AS leaf FROM l c LEFT JOIN l p ON p.depth = c.depth - 1 AND p.jx = c.jx >> 1 AND p.jy = c.jy >> 1 AND p.jz = c.jz >> 1 WHERE c.depth = 0 OR p.n > 10)"""


@events(f"{_OCTREE} SELECT depth::INTEGER AS depth, count(*) AS nodes, count(*) FILTER (leaf) AS leaves, (sum(n))::BIGINT AS points, max(n) AS most FROM t GROUP BY depth")
def octree_nodes(cloud):
    """Nodes, leaves and points of each depth of the octree."""
    return octree.built(cloud).nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if("leaf").alias("leaves"), F.sum("n").cast("long").alias("points"), F.max("n").alias("most"))


@events("SELECT pid, round((x - 100) * (x - 100) + (y - 300) * (y - 300) + (z - 40) * (z - 40), 6) AS d2 FROM cloud WHERE (x - 100) * (x - 100) + (y - 300) * (y - 300) + (z - 40) * (z - 40) <= 3600")
def octree_within(cloud):
    return octree.within(octree.built(cloud), (100.0, 300.0, 40.0), 60.0).select("pid", F.round("d2", 6).alias("d2"))


@events("SELECT pid, rank, round(d2, 6) AS d2 FROM (SELECT pid, d2, (row_number() OVER (ORDER BY d2, pid))::INTEGER AS rank FROM (SELECT pid, (x - 7) * (x - 7) + (y - 20) * (y - 20) + (z - 3) * (z - 3) AS d2 FROM cloud)) WHERE rank <= 25")
def octree_nearest(cloud):
    return octree.nearest_to(octree.built(cloud), (7.0, 20.0, 3.0), 25).select("pid", "rank", F.round("d2", 6).alias("d2"))


@events(f"{_OCTREE} SELECT n, pid, x, y, z FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY pid) AS nth FROM i WINDOW w AS (PARTITION BY ix >> 3, iy >> 3, iz >> 3)) WHERE nth = 1")
def octree_level(cloud):
    """A level of detail: a point for each node of depth 5."""
    return octree.level(octree.built(cloud), 5).select("n", "pid", "x", "y", "z")


# files: clouds written in a format to the shared folder and read back; values that 32-bit floats and millimetres hold exactly

_EXACT = "pid, x, floor(y) AS y, floor(z * 4) / 4 AS z, intensity, classification"


def _through(cloud: DataFrame, kind: str, columns: list[str], **options: str) -> DataFrame:
    """The cloud's columns as read back from files of the format; pids are the files' own."""
    spark = cloud.sparkSession
    sources.register(spark)
    path = new_path(spark, kind)
    exact = cloud.select("pid", "x", F.floor("y").cast("double").alias("y"), (F.floor(F.col("z") * 4) / 4).alias("z"), "intensity", "classification")
    exact.select("pid", *columns).write.format(kind).options(**options).mode("append").save(path)
    back = sources.read_points(spark, path, kind=kind, **options)
    return back.select(*[F.round(F.col(c).cast("double"), 3).alias(c) for c in columns])


def _files(*columns: str):
    return events(f"e AS (SELECT {_EXACT} FROM cloud) SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in columns)} FROM e")


@_files("x", "y", "z")
def file_rawxyz(cloud):
    return _through(cloud, "rawxyz", ["x", "y", "z"], layout="xyz")


@_files("x", "y", "z", "intensity")
def file_xyzi(cloud):
    return _through(cloud, "rawxyz", ["x", "y", "z", "intensity"], layout="xyzi")


@_files("x", "y", "z", "intensity")
def file_xyz_then_i(cloud):
    return _through(cloud, "rawxyz", ["x", "y", "z", "intensity"], layout="xyz_then_i")


@_files("x", "y", "z", "intensity")
def file_lasd_planar(cloud):
    return _through(cloud, "lasd", ["x", "y", "z", "intensity"], layout="planar", fields="Intensity")


@_files("x", "y", "z", "intensity")
def file_lasd_interleaved(cloud):
    return _through(cloud, "lasd", ["x", "y", "z", "intensity"], layout="interleaved")


@_files("x", "y", "z", "intensity", "classification")
def file_pcbn(cloud):
    return _through(cloud, "pcbn", ["x", "y", "z", "intensity", "classification"])


@_files("x", "y", "z", "intensity", "classification")
def file_las(cloud):
    return _through(cloud, "las", ["x", "y", "z", "intensity", "classification"])


@_files("x", "y", "z", "intensity")
def file_ply(cloud):
    """Lines of a PLY file, read by ranges of bytes."""
    return _through(cloud, "ply", ["x", "y", "z", "intensity"], ascii="true")


@_files("x", "y", "z", "intensity")
def file_ply_binary(cloud):
    return _through(cloud, "ply", ["x", "y", "z", "intensity"])


@_files("x", "y", "z", "intensity")
def file_pcd(cloud):
    """Lines of a PCD file, read by ranges of bytes."""
    return _through(cloud, "pcd", ["x", "y", "z", "intensity"], ascii="true")


def _coding_tasks(points: int) -> int:
    """Tasks that code compressed points: coding is slow, so a chunk each, that every core has some."""
    return max(8, min(MOST_TASKS, -(-points // CHUNK_POINTS)))


@events(f"e AS (SELECT {_EXACT} FROM cloud) SELECT x, y, z, intensity, classification::INTEGER AS classification, pid % 7 AS tree_id, pid % 5 AS building_id, (count(*) OVER ())::BIGINT AS n_pids FROM e")
def file_laz(cloud):
    """Compressed points with tree and building ids; their pids are 0, 1, ... whatever the files."""
    spark = cloud.sparkSession
    sources.register(spark)
    path = new_path(spark, "laz")
    exact = cloud.select("pid", "x", F.floor("y").cast("double").alias("y"), (F.floor(F.col("z") * 4) / 4).alias("z"), "intensity", "classification", (F.col("pid") % 7).alias("tree_id"), (F.col("pid") % 5).alias("building_id"))
    exact.repartition(_coding_tasks(cloud.count())).write.format("las").option("compress", "true").mode("append").save(path)
    back = sources.read_points(spark, path, kind="las")
    pids = back.agg((F.max("pid") + 1).alias("n_pids"))
    return back.join(F.broadcast(pids)).select(*[F.round(F.col(c), 3).alias(c) for c in ("x", "y", "z", "intensity")], "classification", "tree_id", "building_id", "n_pids")


@events(f"""e AS (SELECT {_EXACT} FROM cloud), n AS (SELECT *, CASE WHEN x < 120 THEN 'Other_points' ELSE 'Kind' || classification || '_' || floor(x / 120)::BIGINT END AS name FROM e)
    SELECT name, count(*) AS points, count(*) AS listed, round(min(x), 3) AS x_min, round(max(x), 3) AS x_max, round(avg(y), 4) AS y_mean, round(min(z), 3) AS z_min, round(max(z), 3) AS z_max, round(avg(z), 4) AS z_mean FROM n GROUP BY name""")
def instance_files(cloud):
    """A file for each instance and one for the rest, read back, beside the list of them."""
    spark = cloud.sparkSession
    path = new_path(spark, "instances")
    exact = cloud.select("pid", "x", F.floor("y").cast("double").alias("y"), (F.floor(F.col("z") * 4) / 4).alias("z"), F.concat(F.lit("Kind"), "classification").alias("prefix"), F.floor(F.col("x") / 120).alias("instance_id"))
    instances.write_instance_files(exact, path, piece=2000)
    files = f"{path}/files"
    source = RawXyz({"path": files})
    back = read_ranges(catalogue(spark, source, files), source, files, file_column="file")
    back = back.withColumn("name", F.regexp_replace("file", r"(\.\d{5})?\.bin$", "")).groupBy("name").agg(F.count("*").alias("points"), *[F.round(f(c), 3).alias(f"{c}_{n}") for c in "xz" for n, f in (("min", F.min), ("max", F.max))], F.round(F.avg("y"), 4).alias("y_mean"))
    listed = spark.read.json(f"{path}/instances.json").select("name", F.col("count").alias("listed"), F.round("z_mean", 4).alias("z_mean"))
    return back.join(listed, "name", "full")


@events("SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, classification AS label FROM cloud")
def labels_file(cloud):
    """Labels written in pid order by ranges, and read back."""
    spark = cloud.sparkSession
    path = new_path(spark, "labels")
    instances.write_labels(sources.with_pids(cloud.withColumn("at", F.col("pid")), ["at"]).select("pid", F.col("classification").alias("label")), path)
    return spark.read.format("labels").load(path)


@events(f"e AS (SELECT {_EXACT} FROM cloud) SELECT pid % 4 AS file, x, y, z FROM e WHERE x BETWEEN 10 AND 200 AND y BETWEEN 3 AND 400 AND z BETWEEN 2 AND 60")
def crop_of_files(cloud):
    """A box cut from files; those whose head misses the box aren't read."""
    spark = cloud.sparkSession
    sources.register(spark)
    path = new_path(spark, "tiles")
    exact = cloud.select("pid", "x", F.floor("y").cast("double").alias("y"), (F.floor(F.col("z") * 4) / 4).alias("z"), (F.col("pid") % 4).cast("int").alias("classification"))
    exact.repartitionByRange(6, "x").write.format("las").mode("append").save(path)
    back = sources.read_points(spark, path, box=((10, 3, 2), (200, 400, 60)))
    return back.select(F.col("classification").cast("long").alias("file"), *[F.round(c, 3).alias(c) for c in "xyz"])


@events("SELECT sum(1)::BIGINT AS points, min(x) AS x0, max(x) AS x1, min(floor(z * 4) / 4) AS z0, max(floor(z * 4) / 4) AS z1 FROM cloud")
def file_las_header(cloud):
    """What the headers of all files of a cloud say together."""
    spark = cloud.sparkSession
    sources.register(spark)
    path = new_path(spark, "las")
    cloud.select("pid", "x", "y", (F.floor(F.col("z") * 4) / 4).alias("z")).write.format("las").mode("append").save(path)
    heads = spark.read.format("las_header").load(path)
    least, most = (lambda c, k: F.round(F.min(F.col(c)[k]), 3)), (lambda c, k: F.round(F.max(F.col(c)[k]), 3))
    return heads.agg(F.sum("point_count").cast("long").alias("points"), least("mins", 0).alias("x0"), most("maxs", 0).alias("x1"), least("mins", 2).alias("z0"), most("maxs", 2).alias("z1"))


@_files("x", "y", "z", "intensity")
def file_text(cloud):
    spark = cloud.sparkSession
    path = new_path(spark, "text")
    cloud.select(F.concat_ws(" ", "x", F.floor("y"), F.floor(F.col("z") * 4) / 4, "intensity")).write.text(path)
    return sources.read_text(spark, path).select("x", "y", "z", "intensity")


@_files("x", "y", "z")
def file_obj(cloud):
    spark = cloud.sparkSession
    path = new_path(spark, "obj")
    cloud.select(F.concat_ws(" ", F.lit("v"), "x", F.floor("y"), F.floor(F.col("z") * 4) / 4)).write.text(path)
    return sources.read_obj(spark, path).select("x", "y", "z")


_OFFSETS = """n AS (SELECT a.pid, b.pid AS other, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM cloud a, cloud b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1),
    s AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM (SELECT pid, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz FROM n GROUP BY pid)),
    v AS (SELECT pid, CASE WHEN l > 1e-12 THEN sx / l ELSE 0 END AS nx, CASE WHEN l > 1e-12 THEN sy / l ELSE 1 END AS ny, CASE WHEN l > 1e-12 THEN sz / l ELSE 0 END AS nz FROM s),
    e AS (SELECT n.pid AS a, n.other AS b FROM n JOIN v p ON p.pid = n.pid JOIN v q ON q.pid = n.other WHERE abs(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz) > 0.9),
    seed AS (SELECT pid FROM cloud ORDER BY (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) + (z - 0.5) * (z - 0.5), pid LIMIT 1)"""


@embed(f"{_OFFSETS}, r AS (SELECT pid FROM seed UNION SELECT e.b FROM r JOIN e ON e.a = r.pid) SELECT pid FROM r")
def region_by_angle(cloud):
    return segment.region(cloud, (0.5, 0.5, 0.5), 1.0, 0.9).select("pid")


@events("t AS (SELECT *, (x - 1) * 0.6 + (z - 5) * 0.8 AS d FROM cloud) SELECT pid, round(d, 6) AS distance FROM t WHERE d >= 0 AND (x - 1) * (x - 1) + (y - 100) * (y - 100) + (z - 5) * (z - 5) - d * d <= 400 ORDER BY d, pid LIMIT 1")
def ray_pick(cloud):
    return rounded(filters.picked(cloud, (1.0, 100.0, 5.0), (3.0, 0.0, 4.0), 20.0).select("pid", "distance"))


@events("SELECT pid FROM cloud WHERE intensity BETWEEN 20 AND 60")
def scalar_range(cloud):
    return cloud.where(filters.within_range("intensity", 20, 60)).select("pid")


_VIEW = [0.0134, 0, 0, -1, 0, 0.0028, 0, -1, 0, 0, 0.001, 0, 0, 0, 0.005, 1]  # a view from above, smaller with height


@events("""m AS (SELECT 1 + 0.005 * avg(z) AS w, min(z) - (max(z) - min(z)) / 20 AS low, max(z) + (max(z) - min(z)) / 20 AS top FROM cloud)
    SELECT pid FROM cloud, m WHERE x BETWEEN (1 - 0.5 * w) / 0.0134 AND (1 + 0.25 * w) / 0.0134 AND y BETWEEN (1 - 0.5 * w) / 0.0028 AND (1 + 0.5 * w) / 0.0028 AND z BETWEEN low AND top""")
def screen_bounds(cloud):
    box = filters.screen_bounds(cloud, _VIEW, 800, 600, (200, 150, 500, 450))
    return cloud.where(filters.in_box(box["lo"], box["hi"])).select("pid")


@events("SELECT pid, CASE WHEN classification = 2 THEN 34 ELSE 220 END AS r, CASE WHEN classification = 2 THEN 139 ELSE 20 END AS g, CASE WHEN classification = 2 THEN 34 ELSE 60 END AS b FROM cloud")
def cloth_colours(cloud):
    c = colour.cloth_colour(F.col("classification") == 2)
    return cloud.select("pid", *[F.round(c[k] * 255).cast("int").alias(k) for k in "rgb"])


@events("""s AS (SELECT classification AS c, pid % 5 AS t, pid % 3 AS b FROM cloud)
    SELECT c::BIGINT AS las_code, count(*) AS points, count(DISTINCT t) FILTER (t > 0) AS trees, count(DISTINCT b) FILTER (b > 0) AS buildings,
           (SELECT count(*) FROM s) AS total_points, (SELECT count(*) FROM s WHERE t > 0) AS tree_points, (SELECT count(*) FROM s WHERE b > 0) AS building_points FROM s GROUP BY c""")
def metadata_file(cloud):
    """The metadata of labelled points, as read back from their JSON file."""
    spark = cloud.sparkSession
    path = new_path(spark, "metadata")
    sources.write_metadata(cloud.select(F.col("classification").alias("las_code"), (F.col("pid") % 5).alias("tree_id"), (F.col("pid") % 3).alias("building_id")), path, num_classes=6)
    back = spark.read.json(path)
    return back.select("total_points", "instance_summary.tree_points", "instance_summary.building_points", F.inline("category_summary"))


@events("SELECT pid FROM cloud WHERE z BETWEEN 5 AND 60 AND (z > 7.5 OR pid % 10 > 4)")
def building_candidates(cloud):
    flat = cloud.withColumn("planarity", (F.col("pid") % 10) / 10)
    return flat.where(filters.building_candidate(5.0, 60.0, 0.4)).select("pid")


@events("SELECT pid FROM cloud WHERE z BETWEEN 1.5 AND 15")
def trunk_candidates(cloud):
    return cloud.where(filters.trunk_height(0.5)).select("pid")


@events("SELECT pid FROM cloud WHERE x BETWEEN 20 AND 90 AND y BETWEEN 100 AND 500 AND z BETWEEN 10 AND 80")
def crop_after_height(cloud):
    """A crop region whose heights were set anew, and its check."""
    box = filters.set_height({"lo": (20.0, 100.0, 0.0), "hi": (90.0, 500.0, 1.0)}, 10.0, 80.0)
    inside = filters.in_box(box["lo"], box["hi"])
    if problem := filters.check_split(cloud, inside):
        raise ValueError(problem)
    return cloud.where(inside).select("pid")
