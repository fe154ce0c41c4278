import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import sources
from pointloom.operators import filters, prefix
from pointloom.operators.prefix import numbered


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    n = 500
    rows = [(i, *map(float, rng.normal(size=3) * 50), float(rng.integers(0, 65536)), *map(float, rng.integers(0, 65536, 3)), int(rng.integers(0, 10)), int(rng.integers(0, 5)), int(rng.integers(0, 2**32))) for i in range(n)]
    sources.register(spark)
    return spark.createDataFrame(rows, "pid bigint, x double, y double, z double, intensity double, r double, g double, b double, classification int, tree_id bigint, building_id bigint").coalesce(1)


def same(a, b, columns, places=2):
    key = lambda r: tuple(round(float(r[c]), places) for c in columns)
    x, y = (np.array(sorted(key(r) for r in df.collect())) for df in (a, b))
    assert x.shape == y.shape and np.abs(x - y).max() < 2 * 10**-places


@pytest.mark.parametrize(("layout", "columns"), [("xyz", "xyz"), ("xyzrgb", "xyzrgb"), ("xyz_intensity", ["x", "y", "z", "intensity"]), ("xyzi", ["x", "y", "z", "intensity"]), ("xyz_then_i", ["x", "y", "z", "intensity"])])
def test_rawxyz(spark, cloud, tmp_path, layout, columns):
    cloud.write.format("rawxyz").option("layout", layout).mode("append").save(str(tmp_path))
    same(spark.read.format("rawxyz").option("layout", layout).load(str(tmp_path)), cloud, columns)
    moved = spark.read.format("rawxyz").options(layout=layout, shift="10,0,-5").load(str(tmp_path))
    same(moved.selectExpr("x - 10 AS x", "y", "z + 5 AS z"), cloud, "xyz")


def test_rawxyz_trailing_bytes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.arange(7, dtype="<f4").tobytes())
    sources.register(spark)
    assert spark.read.format("rawxyz").load(str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("rawxyz").option("strict", "true").load(str(tmp_path)).count()


def test_many_files_have_running_pids(spark, cloud, tmp_path):
    cloud.repartition(3).write.format("rawxyz").mode("append").save(str(tmp_path))
    pids = sorted(r.pid for r in spark.read.format("rawxyz").load(str(tmp_path)).collect())
    assert pids == list(range(500))


@pytest.mark.parametrize("layout", ["planar", "interleaved"])
def test_lasd(spark, cloud, tmp_path, layout):
    cloud.select("pid", "x", "y", "z", "r", "g", "b", "intensity").write.format("lasd").option("layout", layout).mode("append").save(str(tmp_path))
    same(spark.read.format("lasd").options(layout=layout, fields="Red,Green,Blue,Intensity" if layout == "planar" else "").load(str(tmp_path)), cloud, ["x", "y", "z", "r", "g", "b", "intensity"])
    with pytest.raises(Exception, match="layout"):
        spark.read.format("lasd").load(str(tmp_path)).count()


def test_lasd_errors(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "short.lasd").write_bytes(struct.pack("<4sIBB6x", b"LASD", 5, 0, 0))
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("lasd").option("layout", "planar").load(str(tmp_path)).count()
    (tmp_path / "short.lasd").write_bytes(b"XXXX" + bytes(12))
    with pytest.raises(Exception, match="no LASD"):
        spark.read.format("lasd").option("layout", "planar").load(str(tmp_path)).count()
    (tmp_path / "short.lasd").write_bytes(struct.pack("<4sIBB6x", b"LASD", 0, 0, 0))
    assert spark.read.format("lasd").option("layout", "planar").load(str(tmp_path)).count() == 0


def test_pcbn(spark, cloud, tmp_path):
    data = cloud.select("pid", "x", "y", "z", "r", "g", "b", "intensity", "classification").withColumn("radial_distance", cloud["x"])
    data.write.format("pcbn").mode("append").save(str(tmp_path))
    same(spark.read.format("pcbn").load(str(tmp_path)), data, ["x", "y", "z", "r", "g", "b", "intensity", "classification", "radial_distance"])
    assert sources.format_of(str(tmp_path)) == "pcbn"


def test_pcbn_partial_colour_and_missing_axis(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "a.pcbn").write_bytes(struct.pack("<4sIHxx", b"PCBN", 1, 1 | 2 | 4 | 8 | 64) + np.array([1, 2, 3, 9, 7], "<f4").tobytes())
    row = spark.read.format("pcbn").load(str(tmp_path)).first()
    assert row.asDict() == {"pid": 0, "x": 1.0, "y": 2.0, "z": 3.0, "intensity": 7.0}
    (tmp_path / "a.pcbn").write_bytes(struct.pack("<4sIHxx", b"PCBN", 1, 3) + bytes(8))
    with pytest.raises(Exception, match="coordinate"):
        spark.read.format("pcbn").load(str(tmp_path)).count()


@pytest.mark.parametrize("columns", [["intensity"], ["r", "g", "b", "intensity", "classification"], ["r", "g", "b", "intensity", "classification", "tree_id", "building_id"]])
def test_las(spark, cloud, tmp_path, columns):
    cloud.select("pid", "x", "y", "z", *columns).write.format("las").mode("append").save(str(tmp_path))
    same(spark.read.format("las").load(str(tmp_path)), cloud, ["x", "y", "z", *columns])
    head = spark.read.format("las_header").load(str(tmp_path)).first()
    assert head.point_count == 500 and head.version == ("1.4" if "tree_id" in columns else "1.2") and head.point_format == (3 if "tree_id" in columns else 2 if "r" in columns else 0)
    assert [e.name for e in head.extra_dimensions] == (["TreeID", "BuildingID"] if "tree_id" in columns else [])
    assert spark.read.format("las").option("fields", "Intensity").load(str(tmp_path)).columns == ["pid", "x", "y", "z", "intensity"]
    assert sources.read_points(spark, str(tmp_path)).count() == 500


def test_las_cut_short_and_compressed(spark, cloud, tmp_path):
    cloud.select("pid", "x", "y", "z").write.format("las").mode("append").save(str(tmp_path))
    file = next(tmp_path.glob("*.las"))
    data = bytearray(file.read_bytes())
    file.write_bytes(data[:-30])
    assert spark.read.format("las").load(str(tmp_path)).count() == 498
    data[104] |= 0x80
    file.write_bytes(data)
    with pytest.raises(Exception, match="record of their coding"):
        spark.read.format("las").load(str(tmp_path)).count()


def test_ply(spark, tmp_path):
    head = "ply\nformat {}\ncomment c\nelement vertex 2\nproperty double x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    sources.register(spark)
    (tmp_path / "a.ply").write_bytes(head.format("ascii 1.0").encode() + b"1 2 3 4 5 6\n7 8 9 10 11 12\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + struct.pack("<dffBBBdffBBB", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12))
    rows = sorted(map(tuple, sources.read_points(spark, str(tmp_path)).collect()))
    assert rows == [(0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 128.0), (1, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 128.0), (2, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 128.0), (3, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 128.0)]


def test_pcd(spark, tmp_path):
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS intensity x y z\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA {}\n"
    sources.register(spark)
    (tmp_path / "a.pcd").write_bytes(head.format("ascii").encode() + b"9 1 2 3\n8 4 5 6\n")
    (tmp_path / "b.pcd").write_bytes(head.format("binary").encode() + np.array([9, 1, 2, 3, 8, 4, 5, 6], "<f4").tobytes())
    rows = [(r.x, r.y, r.z, r.intensity) for r in sources.read_points(spark, str(tmp_path)).orderBy("pid").collect()]
    assert rows == [(1.0, 2.0, 3.0, 9.0), (4.0, 5.0, 6.0, 8.0)] * 2
    assert sources.format_of(str(tmp_path)) == "pcd"


def test_text_and_obj(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# head\n\n1 2 3\n4,5,6,7\n8\t9\nx y z\n1 2 3 n/a\n")
    rows = sorted((r.x, r.y, r.z, r.intensity) for r in sources.read_points(spark, str(tmp_path)).collect())
    assert rows == [(1.0, 2.0, 3.0, 128.0), (1.0, 2.0, 3.0, 128.0), (4.0, 5.0, 6.0, 7.0)]
    (tmp_path / "a.xyz").unlink()
    (tmp_path / "b.obj").write_text("o thing\nv 1 2 3\nvn 0 0 1\nf 1 1 1\n")
    assert [(r.x, r.y, r.z) for r in sources.read_points(spark, str(tmp_path)).collect()] == [(1.0, 2.0, 3.0)]
    assert [r.path.rsplit("/", 1)[-1] for r in sources.local_files(spark, str(tmp_path)).collect()] == ["b.obj"]


def test_numbered(spark):
    rows = numbered(spark.createDataFrame([(v,) for v in (5, 3, 9, 1, 7)], "v int").repartition(4), ["v"], "n").collect()
    assert sorted((r.n, r.v) for r in rows) == [(1, 1), (2, 3), (3, 5), (4, 7), (5, 9)]


def test_with_pids_and_instances(spark, cloud, tmp_path):
    again = sources.with_pids(cloud.select("x", "y", "z", "pid"), ["x"]).orderBy("pid").collect()
    assert [r.pid for r in again] == list(range(500)) and [r.x for r in again] == sorted(r.x for r in again)
    sources.write_instances(cloud.selectExpr("*", "'tree' AS category", "tree_id AS instance_id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("category = 'tree' AND instance_id = 3").count() == cloud.where("tree_id = 3").count()


def test_ranks_against_numpy(spark):
    """Quantiles of two names, with repeated values and nulls, are those of numpy; a name without values has a null."""
    rng = np.random.default_rng(2)
    a, b = np.r_[rng.normal(size=333), np.full(500, 0.25), 1e12], rng.integers(0, 7, 834).astype(float)
    rows = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(None, None, None)], "a double, b double, c double").repartition(3)
    at = [0.0, 0.01, 0.5, 0.99, 1.0]
    one = prefix.one_row(prefix.quantiles(prefix.named(rows, {c: F.col(c) for c in "abc"}), at), "abc").first()
    assert np.allclose(one.a, np.quantile(a, at)) and np.allclose(one.b, np.quantile(b, at)) and one.c is None


def test_fields_like(spark, cloud, tmp_path):
    cloud.write.format("las").mode("append").save(str(tmp_path))
    names = lambda word: [r["name"] for r in sources.fields_like(spark.read.format("las_header").load(str(tmp_path)), word).collect()]
    assert names(" ID") == ["PointSourceId", "TreeID", "BuildingID"] and names("gps") == ["GpsTime"] and names("nothing") == [] and len(names("  ")) > 10


def test_header_of_compressed_files(spark, cloud, tmp_path):
    """The header of a LAZ file is plain and can be read; its points can't."""
    cloud.drop("tree_id", "building_id").write.format("las").mode("append").save(str(tmp_path / "a"))
    data = bytearray(next((tmp_path / "a").glob("*.las")).read_bytes())
    data[104] |= 0x80
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.laz").write_bytes(data)
    head = spark.read.format("las_header").load(str(tmp_path / "b")).first()
    assert (head.point_format, head.point_count, head.version) == (2, 500, "1.2")
    with pytest.raises(Exception, match="LAZ"):
        spark.read.format("las").load(str(tmp_path / "b")).count()
    with pytest.raises(Exception, match="LAZ"):
        sources.read_points(spark, str(tmp_path / "b")).count()


def test_screen_bounds(spark, cloud):
    """Unprojecting undoes the projection; the box holds the crop's corners on the plane of the mean height."""
    m = np.array([[0.02, 0.003, 0.001, -0.1], [0, 0.03, 0.004, 0.2], [0.001, 0, 0.02, 0], [0.0005, 0, 0.004, 1]])
    place = np.array([3.0, -7.0, 11.0, 1.0])
    c = m @ place
    x, y, d = (c[0] / c[3] + 1) * 400, (1 - c[1] / c[3]) * 300, (c[2] / c[3] + 1) / 2
    assert np.allclose(filters.unprojected(m.ravel().tolist(), 800, 600, (x, y), d), place[:3])
    box = filters.screen_bounds(cloud, m.ravel().tolist(), 800, 600, (300, 200, 500, 400), (1.0, 2.0))
    z = np.mean([r.z for r in cloud.collect()])
    px = lambda p: (lambda q: ((q[0] / q[3] + 1) * 400, (1 - q[1] / q[3]) * 300))(m @ [*p, z, 1])
    corners = [px((a, b)) for a in (box["lo"][0], box["hi"][0]) for b in (box["lo"][1], box["hi"][1])]
    assert min(p[0] for p in corners) <= 300 + 1e-6 and max(p[0] for p in corners) >= 500 - 1e-6 and (box["lo"][2], box["hi"][2]) == (1.0, 2.0)
