"""Compressed points, files of lines by ranges of bytes, and the catalogue of a folder's files."""

import io
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import sources
from pointloom.operators import sampling
from pointloom.sources import files, instances, laz, ranges
from pointloom.sources.formats import Las, Ply, Text

RECORDS = {0: 20, 1: 28, 2: 26, 3: 34}


def records(fmt, n, extra=0, seed=0):
    """Points that use every path of the coding: small and huge steps, changes of each field, times in several sequences."""
    rng, items, out = random.Random(seed), laz.items_of(fmt, RECORDS[fmt] + extra), bytearray()
    x = y = 0
    t = 1e5
    for i in range(n):
        x, y = (rng.randint(-(2**31), 2**31 - 1) if i % 97 == 5 else (v + rng.randint(-40, 90) + 2**31) % 2**32 - 2**31 for v in (x, y))
        of = rng.randint(1, 7)
        row = [(x, y, rng.randint(-(2**31), 2**31 - 1) if i % 89 == 7 else rng.randint(0, 500), rng.choice([0, 7, rng.randint(0, 65535)]), of << 3 | rng.randint(0, 7) | (i // 50 % 4) << 6, rng.choice([2, 2, 5, 200]), rng.randint(-128, 127) if i % 3 else 4, i // 40 % 256, i // 70)]
        if fmt in (1, 3):
            t = rng.choice([t, t + 1e-5, t + 2e-5, t + 1e-3, t + 3.0, t - 1e-5, t - 2e-4]) if i % 31 else rng.choice([t + 1e6, t - 1e6, 0.0, 1e300])
            row.append((int(np.float64(t).view(np.int64)),))
        if fmt in (2, 3):
            grey = rng.randint(0, 65535)
            row.append(rng.choice([(grey, grey, grey), (grey & 0xFF00, 0, 0x1200), tuple(rng.randint(0, 65535) for _ in range(3)), (1, 2, 3)]))
        if extra:
            row.append((bytes(rng.choice([0, 0, rng.randint(0, 255)]) for _ in range(extra)),))
        for (_, layout), values in zip(items, row, strict=True):
            out += layout.pack(*values)
    return bytes(out), items


@pytest.mark.parametrize(("fmt", "extra"), [(0, 0), (1, 0), (2, 0), (3, 0), (0, 3), (3, 8)])
@pytest.mark.parametrize("n", [1, 2, 3000])
def test_chunks_decode_to_what_was_encoded(fmt, extra, n):
    rows, items = records(fmt, n, extra, seed=n)
    code = laz.encode_chunk(rows, items)
    assert laz.decode_chunk(code, n, items) == rows
    assert n < 1000 or len(code) < 0.95 * len(rows)


def test_bits_of_the_coder_by_hand():
    """The first symbols of a fresh model and bit, worked out by hand: intervals of the range 0xFFFFFFFF."""
    w = laz.Writer()
    w.symbol(laz.Model(4), 2)  # each symbol has 8192 of 32768; unit 0x1FFFF: low 16384 * 0x1FFFF = 0x7FFFC000
    assert (w.base, w.length) == (0x7FFFC000, 8192 * 0x1FFFF)
    w.bit(laz.BitModel(), 1)  # half of 8192 parts: 4096 * (length >> 13)
    assert (w.base, w.length) == (0x7FFFC000 + 4096 * 0x1FFFF, 8192 * 0x1FFFF - 4096 * 0x1FFFF)
    w.raw(4, 9)
    r = laz.Reader(w.end())
    assert (r.symbol(laz.Model(4)), r.bit(laz.BitModel()), r.raw(4)) == (2, 1, 9)


def test_numbers_keep_their_range():
    for bits, values in ((16, [0, 65535, 1, 40000, 3, 65535, 0]), (32, [0, -(2**31), 2**31 - 1, 5, -1, 2**30, -(2**31)])):
        w, number, guess = laz.Writer(), laz.Number(bits, 2), 0
        for k, v in enumerate(values):
            assert number.code(w, guess, v, k % 2) == v
            guess = v
        r, number, guess = laz.Reader(w.end()), laz.Number(bits, 2), 0
        for k, v in enumerate(values):
            guess = number.code(r, guess, context=k % 2)
            assert guess == v


def test_running_median():
    """Against the rule step by step: the half that a value may enter changes when it falls into the other."""
    rng = random.Random(3)
    for top in (2, 10, 1000):
        m, low, seen = laz.Median(), [0] * 5, True
        for _ in range(3000):
            v = rng.randint(-top, top)
            m.add(v)
            if seen:
                seen, low = v < low[2], sorted([*low[:4], v])
            else:
                seen, low = not low[2] < v, sorted([*low[1:], v])
            assert (m.values, m.upper) == (low, seen)


@pytest.mark.parametrize("variable", [False, True])
def test_chunk_table(variable):
    rows, items = records(0, 250)
    if not variable:
        data = laz.packed(rows, items, 40, chunk_points=100)
        sizes = [100, 100, 50]
    else:
        sizes = [10, 200, 40]
        cuts = np.cumsum([0, *sizes]) * 20
        chunks = [laz.encode_chunk(rows[a:b], items) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        coder, number, last = laz.Writer(), laz.Number(32, 2), (0, 0)
        for n, chunk in zip(sizes, chunks, strict=True):
            number.code(coder, last[0], n, 0)
            number.code(coder, last[1], len(chunk), 1)
            last = (n, len(chunk))
        # place of the table unknown at the start, so at the end
        data = struct.pack("<q", -1) + b"".join(chunks) + struct.pack("<II", 0, 3) + coder.end()
        data += struct.pack("<q", 40 + 8 + sum(map(len, chunks)))

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    f = File(b"h" * 40 + data)
    table = laz.chunk_table(f, 40, 250, laz.VARIABLE if variable else 100)
    assert [n for *_, n in table] == sizes
    out = b""
    for place, size, n in table:
        f.seek(place)
        out += laz.decode_chunk(f.read(size), n, items)
    assert out == rows


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *(float(v) for v in np.round(rng.normal(size=3) * 50, 3)), float(rng.integers(0, 65536)), *(float(v) for v in rng.integers(0, 65536, 3)), int(rng.integers(0, 10)), int(rng.integers(0, 5)), int(rng.integers(0, 2**32))) for i in range(900)]
    sources.register(spark)
    return spark.createDataFrame(rows, "pid bigint, x double, y double, z double, intensity double, r double, g double, b double, classification int, tree_id bigint, building_id bigint").repartition(3)


@pytest.mark.parametrize("columns", [["intensity"], ["r", "g", "b", "intensity", "classification"], ["r", "g", "b", "intensity", "classification", "tree_id", "building_id"]])
def test_laz_reads_as_las(spark, points, tmp_path, monkeypatch, columns):
    """Both ways of reading give the rows of the same points uncompressed, from files of several chunks."""
    monkeypatch.setattr(laz, "CHUNK_POINTS", 128)
    data = points.select("pid", "x", "y", "z", *columns).coalesce(1).cache()
    data.write.format("las").mode("append").save(str(tmp_path / "las"))
    encode = Las({"path": "", "compress": "true"}).encode
    made = {c: np.array([r[c] for r in data.collect()]) for c in data.columns}
    (tmp_path / "laz").mkdir()
    (tmp_path / "laz" / "a.laz").write_bytes(_small_chunks(encode, made, 900))
    want = sorted(map(tuple, spark.read.format("las").load(str(tmp_path / "las")).collect()))
    assert sorted(map(tuple, spark.read.format("las").load(str(tmp_path / "laz")).collect())) == want
    assert sorted(map(tuple, sources.read_points(spark, str(tmp_path / "laz")).collect())) == want
    assert spark.read.format("las").load(str(tmp_path / "laz")).rdd.getNumPartitions() == 8
    head = spark.read.format("las_header").load(str(tmp_path / "laz")).first()
    assert head.point_count == 900 and head.point_format == (3 if "tree_id" in columns else 2 if "r" in columns else 0)


def _small_chunks(encode, made, n):
    import functools

    whole_item, whole_packed = laz.item_record, laz.packed
    laz.item_record, laz.packed = functools.partial(whole_item, chunk_points=128), functools.partial(whole_packed, chunk_points=128)
    try:
        return encode(made, n)
    finally:
        laz.item_record, laz.packed = whole_item, whole_packed


def test_laz_written_by_tasks(spark, points, tmp_path):
    points.write.format("las").option("compress", "true").mode("append").save(str(tmp_path))
    files = sorted(tmp_path.glob("*.laz"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < 900 * 42
    back = sources.read_points(spark, str(tmp_path))
    assert sorted(r.pid for r in back.select("pid").collect()) == list(range(900))
    key = lambda r: (round(r.x, 3), round(r.y, 3), round(r.z, 3), r.intensity, r.r, r.g, r.b, r.classification, r.tree_id, r.building_id)
    assert sorted(map(key, back.collect())) == sorted(map(key, points.collect()))


def test_laz_that_cannot_be_read(spark, points, tmp_path):
    points.select("pid", "x", "y", "z").coalesce(1).write.format("las").option("compress", "true").mode("append").save(str(tmp_path))
    file = next(tmp_path.glob("*.laz"))
    data = bytearray(file.read_bytes())
    at = data.index(laz.VLR_USER) + 52
    layered = bytearray(data)
    layered[at] = 3
    file.write_bytes(layered)
    with pytest.raises(Exception, match="coding isn't supported"):
        spark.read.format("las").load(str(tmp_path)).count()
    file.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="table of chunks"):
        spark.read.format("las").load(str(tmp_path)).count()


LINES = [b"# head", b"", b"1 2 3", b"4,5,6,7", b"8\t9", b"x y z", b"  ", b"1 2 3 n/a", b"1e3, -2.5 , .5", b"9 9 9 9 9 9", b"7 7 7"]


@pytest.mark.parametrize("ending", [b"", b"\n", b"\r\n"])
@pytest.mark.parametrize("body", [0, 7])
def test_every_cut_of_lines(ending, body):
    """Wherever ranges begin, and however little is read at once, each line comes once, in order."""

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    joint = b"\r\n" if ending == b"\r\n" else b"\n"
    data = joint.join(LINES) + ending
    f = File(b"h" * body + data)
    for step in (1, 2, 3, 5, 8, 13, 1000):
        for block in (1, 4, 1000):
            got = b"".join(part for begin in range(body, f.size(), step) for part in ranges.blocks_of_lines(f, body, begin, min(begin + step, f.size()), block))
            assert got == data, (step, block)


@pytest.mark.parametrize("kind", ["ply", "pcd", "text", "obj"])
def test_lines_by_ranges(spark, points, tmp_path, monkeypatch, kind):
    """Files of lines, cut into many ranges, have dense pids in the order of files and lines, and the points of one read."""
    rows = points.select("pid", "x", "y", "z", "intensity").orderBy("pid").collect()
    for k in range(3):
        own = rows[k * 300 : (k + 1) * 300]
        lines = [" ".join(map(repr, r[1:])) for r in own]
        if kind == "ply":  # faces behind the vertices are no points
            text = f"ply\nformat ascii 1.0\nelement vertex {len(own)}\nproperty double x\nproperty double y\nproperty double z\nproperty float intensity\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n" + "\n".join(lines) + "\n3 0 1 2\n3 1 2 3\n"
        elif kind == "pcd":
            text = f"# .PCD v0.7\nFIELDS x y z intensity\nSIZE 8 8 8 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {len(own)}\nHEIGHT 1\nPOINTS {len(own)}\nDATA ascii\n" + "\n\n".join(lines)
        elif kind == "text":
            text = "# points\n" + "\n".join(f"{x}\nno point" for x in lines)
        else:
            text = "o thing\n" + "\n".join(f"v {x}\nvn 0 0 1" for x in lines) + "\nf 1 1 1\n"
        (tmp_path / f"{k}.{ {'text': 'xyz'}.get(kind, kind) }").write_text(text)
    monkeypatch.setattr(ranges, "SPLIT_BYTES", 1000)  # by the driver: not seen by tasks, so set there too
    source = {"ply": Ply, "text": Text}.get(kind)
    got = sources.read_points(spark, str(tmp_path)).orderBy("pid").collect()
    assert [r.pid for r in got] == list(range(900))
    assert [(r.x, r.y, r.z) for r in got] == [(r.x, r.y, r.z) for r in rows]
    assert source is None or [r.intensity for r in got] == [r.intensity for r in rows]


def test_ranges_of_large_lines(spark, tmp_path):
    """More bytes than one range has: several ranges, dense pids, and samples and windows that rest on them."""
    n = 1_500_000
    with open(tmp_path / "a.xyz", "w") as f:
        f.writelines(f"{i} {i * 0.5} 123456.25 7\n" for i in range(n))
    cat = ranges.catalogue(spark, Text({"path": str(tmp_path)}), str(tmp_path))
    assert cat.count() == -(-(tmp_path / "a.xyz").stat().st_size // ranges.SPLIT_BYTES) == 2
    cloud = sources.read_text(spark, str(tmp_path)).cache()
    assert cloud.where(F.col("pid") != F.col("x")).count() == 0 and cloud.count() == n
    assert [r.pid for r in sampling.stride(cloud, n, 100).orderBy("pid").collect()] == list(range(0, n, n // 100))[:100]
    per = sampling.windows(cloud, n, 400_000, 20_000).groupBy("window").agg(F.min("pid").alias("lo"), F.count("*").alias("n")).orderBy("window").collect()
    assert [(r.lo, r.n) for r in per] == [(0, 400_000), (380_000, 400_000), (760_000, 400_000), (1_140_000, 360_000)]
    with pytest.raises(Exception, match="pid beyond"):
        sampling.windows(cloud, 1000, 400, 20).count()


def test_box_opens_only_files_that_meet_it(spark, points, tmp_path):
    points.select("pid", "x", "y", "z").repartitionByRange(4, "x").write.format("las").mode("append").save(str(tmp_path))
    source = Las({"path": str(tmp_path)})
    cat = ranges.catalogue(spark, source, str(tmp_path))
    box = ((20.0, -30.0, -1000.0), (60.0, 30.0, 1000.0))
    want = sorted((r.x, r.y) for r in points.collect() if 20 <= r.x <= 60 and -30 <= r.y <= 30)
    assert sorted((round(r.x, 3), round(r.y, 3)) for r in ranges.read_ranges(cat, source, str(tmp_path), box).collect()) == want
    for row in cat.collect():  # files off the box may as well not be there
        if row.hi[0] < 20 or row.lo[0] > 60:
            (tmp_path / row.path.rsplit("/", 1)[-1]).unlink()
    assert len(list(tmp_path.glob("*.las"))) < 4
    assert ranges.read_ranges(cat, source, str(tmp_path), box).count() == len(want)


def test_files_of_other_columns_are_refused(spark, points, tmp_path):
    points.select("pid", "x", "y", "z").coalesce(1).write.format("las").mode("append").save(str(tmp_path))
    next(tmp_path.glob("*.las")).rename(tmp_path / "a.las")
    points.select("pid", "x", "y", "z", "r", "g", "b").coalesce(1).write.format("las").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="first file has"):
        sources.read_points(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="first file has"):
        spark.read.format("las").load(str(tmp_path)).count()


def test_instance_files(spark, tmp_path):
    """A file of raw coordinates for each instance, in pid order, a large one in pieces; the rest, corners, and what the list says."""
    rng = np.random.default_rng(4)
    n, xyz = 5000, rng.normal(size=(5000, 3)).astype("<f4").astype(float)
    ids = np.where(np.arange(n) % 3 == 0, 1, rng.integers(0, 6, n))
    rows = [(i, *map(float, xyz[i]), "Tree" if i % 2 else "Building", None if ids[i] == 5 else int(ids[i])) for i in range(n)]
    cloud = spark.createDataFrame(rows, "pid bigint, x double, y double, z double, prefix string, instance_id bigint").repartition(5)
    boxes = spark.createDataFrame([(7, k, float(k), 1.0, 2.0) for k in range(8)], "building_id bigint, corner int, x double, y double, z double")
    instances.write_instance_files(cloud, str(tmp_path), boxes, piece=400)
    want = {}
    for i, *_, prefix, k in rows:
        want.setdefault(f"{prefix}_{k}" if k else "Other_points", []).append(i)
    listed = {r["name"]: r for r in spark.read.json(f"{tmp_path}/instances.json").collect()}
    assert set(listed) == set(want)
    for name, own in want.items():
        r = listed[name]
        data = np.concatenate([np.fromfile(tmp_path / "files" / f, "<f4") for f in r["files"]]).reshape(-1, 3)
        assert (data == xyz[own].astype("<f4")).all() and r["count"] == len(own)
        assert len(r["files"]) == -(-len(own) // 400) and (r.z_min, r.z_max) == (xyz[own, 2].min(), xyz[own, 2].max())
        assert r.z_mean == pytest.approx(xyz[own, 2].mean())
    assert np.fromfile(tmp_path / "files" / "Building_7_footprint.bin", "<f4").reshape(-1, 3)[:, 0].tolist() == list(range(8))
    assert len(list((tmp_path / "files").iterdir())) == sum(len(r["files"]) for r in listed.values()) + 1  # no attempts are left


def test_labels(spark, tmp_path):
    labels = spark.range(10_000).select(F.col("id").alias("pid"), F.when(F.col("id") % 7 > 0, F.col("id") * 3 % 11).alias("label")).repartition(6)
    instances.write_labels(labels, str(tmp_path / "a"))
    assert [f.name for f in (tmp_path / "a").iterdir()] == ["labels.bin"]
    want = [i * 3 % 11 if i % 7 else 0 for i in range(10_000)]
    assert np.fromfile(tmp_path / "a" / "labels.bin", "<i4").tolist() == want
    assert [tuple(r) for r in spark.read.format("labels").load(str(tmp_path / "a")).orderBy("pid").collect()] == list(enumerate(want))
    for bad in (labels.where("pid <> 5000"), labels.unionByName(labels.where("pid = 77"))):
        with pytest.raises(Exception, match="without gaps"):
            instances.write_labels(bad, str(tmp_path / "b"))


def test_lines_come_in_blocks_of_a_megabyte(tmp_path):
    """What a task parses at once stays small however long its range is."""
    data = b"".join(b"%d.25 7.5 8.5 9\n" % k for k in range(200_000))
    (tmp_path / "cloud.txt").write_bytes(data)
    with files.filesystem(str(tmp_path))[0].open_input_file(f"{tmp_path}/cloud.txt") as f:
        blocks = list(ranges.blocks_of_lines(f, 0, 0, len(data)))
    assert b"".join(blocks) == data and max(map(len, blocks)) <= (1 << 20) + 100


def test_a_task_holds_few_points(spark, tmp_path):
    """A task writes its points in several files, so that it never holds all of them."""
    sources.register(spark)
    spark.range(600_000).coalesce(1).selectExpr("id AS pid", "id * 1D AS x", "0D AS y", "0D AS z").write.format("rawxyz").mode("append").save(f"{tmp_path}/cloud")
    sizes = [p.stat().st_size // 12 for p in sorted((tmp_path / "cloud").glob("part-*"))]
    assert sum(sizes) == 600_000 and max(sizes) <= 250_000


def test_every_core_codes_points():
    from pointloom.plans.queries import _coding_tasks

    assert _coding_tasks(10) == 8 and _coding_tasks(36_000_000) == 720
