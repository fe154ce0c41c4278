"""Point file formats as Spark data sources: rawxyz, lasd, pcbn, las, las_header, ply and pcd.

    pointloom.sources.register(spark)
    spark.read.format("las").load(path)
    cloud.write.format("las").mode("append").save(path)

Formats that share a magic or have none need the option `layout`; nothing is guessed.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter
from pyspark.sql.types import StructType

from pointloom.sources import laz
from pointloom.sources.files import Points, PointWriter, RangeReader, filesystem, floats, listing, records

#: Canonical field names of LAS files and their columns.
FIELD_COLUMNS = {
    "Intensity": "intensity", "ReturnNumber": "return_number", "NumberOfReturns": "number_of_returns", "ScanDirectionFlag": "scan_direction_flag", "EdgeOfFlightLine": "edge_of_flight_line",
    "Classification": "classification", "ScanAngleRank": "scan_angle_rank", "UserData": "user_data", "PointSourceId": "point_source_id", "GpsTime": "gps_time",
    "Red": "r", "Green": "g", "Blue": "b", "Alpha": "alpha", "Infrared": "infrared",
}
#: Columns with other types than double.
INTEGERS = {"classification", "return_number", "number_of_returns", "scan_direction_flag", "edge_of_flight_line", "scan_angle_rank", "user_data", "point_source_id", "tree_id", "building_id"}


def ddl(columns: list[str]) -> str:
    return ", ".join(["pid BIGINT", *[f"`{c}` {'BIGINT' if c in ('tree_id', 'building_id') else 'INT' if c in INTEGERS else 'DOUBLE'}" for c in columns]])


class PointSource(DataSource):
    """look(file) finds the points; columns(file, points, first, n) reads some; encode(columns, n) makes a file. Of formats of lines, count(points, lines) and parsed(points, lines) take some whole lines."""

    suffix = "bin"
    of_lines = False  # whether a file's points may be lines

    def look(self, f) -> Points:
        raise NotImplementedError

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def encode(self, data: dict[str, np.ndarray], n: int) -> bytes:
        raise ValueError(f"{self.name()} is read only")

    def found(self) -> list[str]:
        """Columns of the first file."""
        fs, _ = filesystem(self.options["path"])
        names = listing(self.options["path"])
        if not names:
            raise ValueError("no file to read a schema from")
        with fs.open_input_file(names[0]) as f:
            return self.look(f).more["columns"]

    def schema(self) -> str:
        return ddl(self.found())

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options["path"], schema, self.look, self.columns)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PointWriter(self.options["path"], "laz" if self.options.get("compress", "false") == "true" else self.suffix, self.encode)


class RawXyz(PointSource):
    """Headerless float32: layout xyz, xyzrgb, xyz_intensity (or xyzi), xyz_then_i. Option strict=true refuses trailing bytes; shift="dx,dy,dz" is added."""

    kinds = {"xyz": ["x", "y", "z"], "xyzrgb": ["x", "y", "z", "r", "g", "b"], "xyz_intensity": ["x", "y", "z", "intensity"], "xyzi": ["x", "y", "z", "intensity"], "xyz_then_i": ["x", "y", "z", "intensity"]}

    @classmethod
    def name(cls) -> str:
        return "rawxyz"

    def layout(self) -> str:
        layout = self.options.get("layout", "xyz")
        if layout not in self.kinds:
            raise ValueError(f"layout {layout!r} is none of {', '.join(self.kinds)}")
        return layout

    def found(self) -> list[str]:
        return self.kinds[self.layout()]

    def look(self, f) -> Points:
        names = self.kinds[self.layout()]
        n, rest = divmod(f.size(), 4 * len(names))
        if rest and self.options.get("strict", "false") == "true":
            raise ValueError(f"{f.size()} bytes are no whole number of points of {4 * len(names)} bytes")
        return Points(n, np.dtype([(c, "<f4") for c in names]), 0, {"columns": names})

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        shift = [float(s) for s in self.options.get("shift", "0,0,0").split(",")]
        if self.layout() == "xyz_then_i":
            xyz = floats(f, 12 * first, 3 * n).reshape(-1, 3)
            out = dict(zip("xyz", xyz.T, strict=True)) | {"intensity": floats(f, 12 * points.n + 4 * first, n)}
        else:
            rows = records(f, points, first, n)
            out = {c: rows[c].astype(np.float64) for c in rows.dtype.names}
        return out | {c: out[c] + s for c, s in zip("xyz", shift, strict=True)}

    def encode(self, data, n) -> bytes:
        names = self.kinds[self.layout()]
        if self.layout() == "xyz_then_i":
            return np.column_stack([data[c] for c in "xyz"]).astype("<f4").tobytes() + np.asarray(data["intensity"], "<f4").tobytes()
        return np.column_stack([data[c] for c in names]).astype("<f4").tobytes()


class Lasd(PointSource):
    """16-byte header (magic, count, has colours, number of extras), then layout planar (x, y, z and each field of the option `fields` as float32 arrays) or interleaved (xyz rows, then r, g, b, intensity arrays)."""

    suffix = "lasd"

    @classmethod
    def name(cls) -> str:
        return "lasd"

    def _planar(self) -> bool:
        layout = self.options.get("layout")
        if layout not in ("planar", "interleaved"):
            raise ValueError("say layout planar or interleaved: both have one magic")
        return layout == "planar"

    def look(self, f) -> Points:
        head = f.read(16) if f.size() >= 16 else b""
        if len(head) < 16 or head[:4] != b"LASD":
            raise ValueError("no LASD header")
        n, colours, extra = struct.unpack_from("<IBB", head, 4)
        if not self._planar():
            names = [*"xyz", *("rgb" if colours else ""), *(["intensity"] if extra else [])]
        else:
            named = [x.strip() for x in self.options.get("fields", "").split(",") if x.strip()]
            # without names, extras are colours, then intensity, then class
            plain = [*(["Red", "Green", "Blue"] if colours else []), "Intensity", "Classification"]
            names = [*"xyz", *[FIELD_COLUMNS.get(x, x) for x in (named or plain)[:extra]]]
        if f.size() < 16 + 4 * n * len(names):
            raise ValueError("the file is shorter than its header says")
        return Points(n, np.dtype("<f4"), 16, {"columns": names})

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        names, out = points.more["columns"], {}
        if not self._planar():
            out |= dict(zip("xyz", floats(f, 16 + 12 * first, 3 * n).reshape(-1, 3).T, strict=True))
        for k, c in enumerate(names):
            if c not in out:
                out[c] = floats(f, 16 + 4 * (points.n * k + first), n)
        return out

    def encode(self, data, n) -> bytes:
        rgb = all(c in data for c in "rgb")
        if self._planar():
            named = [FIELD_COLUMNS.get(x.strip(), x.strip()) for x in self.options.get("fields", "").split(",") if x.strip()]
            extra = [c for c in named or [*("rgb" if rgb else ""), *[c for c in ("intensity", "classification") if c in data]] if c in data]
            body = [data[c] for c in ("x", "y", "z", *extra)]
            return struct.pack("<4sIBB6x", b"LASD", n, rgb, len(extra)) + b"".join(np.asarray(c, "<f4").tobytes() for c in body)
        i = "intensity" in data
        rows = np.column_stack([data[c] for c in "xyz"]).astype("<f4").tobytes()
        return struct.pack("<4sIBB6x", b"LASD", n, rgb, i) + rows + b"".join(np.asarray(data[c], "<f4").tobytes() for c in [*("rgb" if rgb else ""), *(["intensity"] if i else [])])


class Pcbn(PointSource):
    """12-byte header (magic, count, field bits), then interleaved float32 of the set bits."""

    suffix = "pcbn"
    #: Bit of each field; fields stand in this order.
    BITS = {"x": 1, "y": 2, "z": 4, "r": 8, "g": 16, "b": 32, "intensity": 64, "classification": 128, "radial_distance": 256}

    @classmethod
    def name(cls) -> str:
        return "pcbn"

    def look(self, f) -> Points:
        head = f.read(12) if f.size() >= 12 else b""
        if len(head) < 12 or head[:4] != b"PCBN":
            raise ValueError("no PCBN header")
        n, bitmap = struct.unpack_from("<IH", head, 4)
        names = [c for c, b in self.BITS.items() if bitmap & b]
        if not {"x", "y", "z"} <= set(names):
            raise ValueError("a coordinate is missing")
        record = np.dtype([(c, "<f4") for c in names])
        if f.size() < 12 + n * record.itemsize:
            raise ValueError("the file is shorter than its header says")
        # colours count only if all three are there
        return Points(n, record, 12, {"columns": [c for c in names if c not in "rgb" or {"r", "g", "b"} <= set(names)]})

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        rows = records(f, points, first, n)
        return {c: rows[c].astype(np.float64) for c in points.more["columns"]}

    def encode(self, data, n) -> bytes:
        names = [c for c in self.BITS if c in data]
        return struct.pack("<4sIHxx", b"PCBN", n, sum(self.BITS[c] for c in names)) + np.column_stack([data[c] for c in names]).astype("<f4").tobytes()


#: Fields of LAS point formats 0 to 5 and 6 to 8 before colours.
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("flags2", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle_rank", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_GPS, _RGB, _NIR = [("gps_time", "<f8")], [("r", "<u2"), ("g", "<u2"), ("b", "<u2")], [("infrared", "<u2")]
_FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR}
#: Numpy kinds of extra-bytes types 1 to 10.
_EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
_EXTRA_COLUMNS = {"TreeID": "tree_id", "BuildingID": "building_id"}


def las_header(f) -> dict:
    """The public header block, and the extra dimensions that a variable-length record names."""
    f.seek(0)
    h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError("no LAS file")
    major, minor = h[24], h[25]
    day, year, size, offset, n_vlr, fmt, length, n = struct.unpack_from("<HHHIIBHI", h, 90)
    scale, origin = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    bounds = struct.unpack_from("<6d", h, 179)
    if minor >= 4 and size >= 375:
        n = struct.unpack_from("<Q", h, 247)[0] or n
    extra, at, coding = [], size, None
    for _ in range(n_vlr):
        f.seek(at)
        v = f.read(54)
        user, record, length_after = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
        if user == b"LASF_Spec" and record == 4:
            body = f.read(length_after)
            extra += [(body[k + 4 : k + 36].rstrip(b"\0").decode(), body[k + 2]) for k in range(0, len(body) - 191, 192)]
        elif user == laz.VLR_USER and record == laz.VLR_RECORD:
            coding = f.read(length_after)
        at += 54 + length_after
    return {
        "version": f"{major}.{minor}", "point_format": fmt & 0x3F, "compressed": fmt & 0x80 != 0, "point_count": n, "mins": [bounds[1], bounds[3], bounds[5]], "maxs": [bounds[0], bounds[2], bounds[4]], "scale": list(scale), "offset": list(origin),
        "generating_software": h[58:90].rstrip(b"\0").decode("latin-1"), "creation_date": f"{year}-{day:03d}" if year else "", "data_offset": offset, "record_length": length, "extra": extra, "coding": coding,
    }


class Las(PointSource):
    """LAS 1.2 to 1.4, point formats 0 to 3 and 6 to 8, and LAZ of formats 0 to 3, with extra bytes. Option fields= limits the columns; compress=true writes LAZ."""

    suffix = "las"

    @classmethod
    def name(cls) -> str:
        return "las"

    def look(self, f) -> Points:
        h = las_header(f)
        if h["compressed"] and (h["point_format"] > 3 or not h["coding"]):
            raise ValueError(f"LAZ of point format {h['point_format']} isn't supported" if h["coding"] else "LAZ points without a record of their coding")
        if h["point_format"] not in _FORMATS:
            raise ValueError(f"point format {h['point_format']} isn't supported")
        kinds = list(_FORMATS[h["point_format"]])
        used = np.dtype(kinds).itemsize
        for name, kind in h["extra"]:
            if kind in _EXTRA and used + np.dtype(_EXTRA[kind]).itemsize <= h["record_length"]:
                kinds.append((_EXTRA_COLUMNS.get(name, name), _EXTRA[kind]))
                used += np.dtype(_EXTRA[kind]).itemsize
        if used < h["record_length"]:
            kinds.append(("_rest", f"V{h['record_length'] - used}"))
        n = h["point_count"] if h["compressed"] else min(h["point_count"], max(0, (f.size() - h["data_offset"]) // h["record_length"]))
        chunks = laz.chunk_table(f, h["data_offset"], n, laz.coding(h["coding"])) if h["compressed"] else None
        names = ["x", "y", "z", *[c for c, _ in kinds if c not in ("X", "Y", "Z", "flags", "flags2", "_rest")], "return_number", "number_of_returns"]
        if wanted := {x.strip().lower() for x in self.options.get("fields", "").split(",") if x.strip()}:
            known = {v: k.lower() for k, v in FIELD_COLUMNS.items()}
            names = [c for c in names if c in "xyz" or c.lower() in wanted or known.get(c) in wanted]
        return Points(n, np.dtype(kinds), h["data_offset"], {"columns": names, "scale": h["scale"], "offset": h["offset"], "format": h["point_format"], "bounds": (h["mins"], h["maxs"])}, chunks)

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        new = points.more["format"] >= 6
        if points.chunks is None:
            rows = records(f, points, first, n)
        else:  # a chunk, from its first point on
            starts = np.cumsum([0, *(m for *_, m in points.chunks)])
            at, size, held = points.chunks[int(np.searchsorted(starts, first, side="right")) - 1]
            f.seek(at)
            rows = np.frombuffer(laz.decode_chunk(f.read(size), held, laz.items_of(points.more["format"], points.record.itemsize)), points.record)
        out = {c: rows[C] * s + o for c, C, s, o in zip("xyz", "XYZ", points.more["scale"], points.more["offset"], strict=True)}
        for c in points.more["columns"]:
            if c == "return_number":
                out[c] = (rows["flags"] & (15 if new else 7)).astype(np.int32)
            elif c == "number_of_returns":
                out[c] = (rows["flags"] >> 4 if new else rows["flags"] >> 3 & 7).astype(np.int32)
            elif c == "classification" and not new:
                out[c] = (rows[c] & 31).astype(np.int32)
            elif c not in out:
                out[c] = rows[c].astype(np.int64 if c in INTEGERS else np.float64)
        return out

    def encode(self, data, n) -> bytes:
        """LAS 1.2 of format 2 with colours, else 0; with tree or building ids LAS 1.4 of format 3 with extra bytes, offset at whole metres. The same compressed, if asked for."""
        extra = [(name, c) for name, c in (("TreeID", "tree_id"), ("BuildingID", "building_id")) if c in data]
        rgb = all(c in data for c in "rgb")
        fmt = 3 if extra else 2 if rgb else 0
        kinds = [*_FORMATS[fmt], *[(c, "<u4") for _, c in extra]]
        rows = np.zeros(n, kinds)
        xyz = np.column_stack([data[c] for c in "xyz"]).astype(np.float64)
        low, high = xyz.min(0), xyz.max(0)
        origin = np.floor(low) if extra else low
        for c, k in zip("XYZ", range(3), strict=True):
            rows[c] = np.round((xyz[:, k] - origin[k]) / 1e-3)
        rows["flags"] = 0b001001
        for c in ("intensity", "classification", *("rgb" if rgb and fmt in (2, 3) else ""), *[c for _, c in extra], *(["gps_time"] if "gps_time" in data and fmt == 3 else [])):
            if c in data:
                top = np.iinfo(rows[c].dtype).max if rows[c].dtype.kind == "u" else np.inf
                rows[c] = np.clip(np.nan_to_num(np.asarray(data[c], np.float64)), 0, top)
        vlr = b""
        if extra:
            body = b"".join(struct.pack("<2xBB32s4x24x24x24x24x24x32s", 5, 0, name.encode(), b"") for name, _ in extra)
            vlr = struct.pack("<2x16sHH32s", b"LASF_Spec", 4, len(body), b"extra bytes") + body
        items = laz.items_of(fmt, rows.dtype.itemsize) if self.options.get("compress", "false") == "true" else []
        n_vlr = bool(vlr) + bool(items)
        vlr += laz.item_record(items) if items else b""
        size, minor = (375, 4) if extra else (227, 2)
        head = bytearray(size)
        head[:4], head[24], head[25] = b"LASF", 1, minor
        head[26:58], head[58:90] = b"pointloom".ljust(32, b"\0"), b"pointloom".ljust(32, b"\0")
        struct.pack_into("<HHHIIBHI", head, 90, 1, 2024, size, size + len(vlr), n_vlr, fmt | (0x80 if items else 0), rows.dtype.itemsize, n)
        struct.pack_into("<I", head, 111, n)
        struct.pack_into("<3d3d", head, 131, 1e-3, 1e-3, 1e-3, *origin)
        struct.pack_into("<6d", head, 179, *(v for k in range(3) for v in (high[k], low[k])))
        if extra:
            struct.pack_into("<QQ", head, 247, n, n)
        body = laz.packed(rows.tobytes(), items, size + len(vlr)) if items else rows.tobytes()
        return bytes(head) + vlr + body


class LasHeader(DataSource):
    """One row per LAS or LAZ file: version, format, count, bounds, scale and the fields it has. Only headers are read."""

    @classmethod
    def name(cls) -> str:
        return "las_header"

    def schema(self) -> str:
        named = "ARRAY<STRUCT<name: STRING, internal_name: STRING>>"
        return f"path STRING, version STRING, point_format INT, point_count BIGINT, mins ARRAY<DOUBLE>, maxs ARRAY<DOUBLE>, scale ARRAY<DOUBLE>, offset ARRAY<DOUBLE>, available_fields {named}, extra_dimensions {named}, generating_software STRING, creation_date STRING"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeaderReader(self.options["path"])


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pointloom.sources.files import Range

        return [Range(p, 0, 1, 0, Points(1)) for p in listing(self.path)] or [Range("", 0, 0, 0, Points(0))]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            h = las_header(f)
        has = {c for c, _ in _FORMATS.get(h["point_format"], [])} | {"return_number", "number_of_returns"}
        available = [(n, n) for n in "XYZ"] + [(n, c) for n, c in FIELD_COLUMNS.items() if c in has]
        yield (partition.path, h["version"], h["point_format"], h["point_count"], h["mins"], h["maxs"], h["scale"], h["offset"], available, [(n, _EXTRA_COLUMNS.get(n, n)) for n, _ in h["extra"]], h["generating_software"], h["creation_date"])


#: PLY property types.
_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
_RENAMED = {"red": "r", "green": "g", "blue": "b", "scalar_intensity": "intensity"}


def _lines(f, last: str) -> tuple[list[str], int]:
    """Header lines up to the one that begins with `last`, and where the body begins."""
    f.seek(0)
    data = f.read(65536)
    at, lines = 0, []
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        lines.append(data[at:end].decode("latin-1").strip())
        at = end + 1
        if lines[-1].split(" ")[0].lower() == last:
            return lines, min(at, f.size())
    raise ValueError(f"no {last} line in the header")


def numbers(lines: bytes, columns: int) -> np.ndarray:
    """A row for each line that isn't blank, of its first numbers."""
    rows = [x.split(None, columns)[:columns] for x in lines.splitlines() if x.strip()]
    return np.array(rows, np.float64).reshape(-1, columns)


class _Table(PointSource):
    """Files with a text header and rows in text or binary. Intensity is 128 where a file has none. Written binary, or as text with the option ascii=true."""

    of_lines = True
    named = ("x", "y", "z", "r", "g", "b", "intensity")

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        rows = records(f, points, first, n)
        return self._with_intensity({c: rows[c].astype(np.float64) for c in points.more["columns"] if c in points.more["fields"]})

    def count(self, points: Points, lines: bytes) -> int:
        return sum(1 for x in lines.splitlines() if x.strip())

    def parsed(self, points: Points, lines: bytes) -> dict[str, np.ndarray]:
        names = points.more["fields"]
        table = numbers(lines, len(names))
        return self._with_intensity({c: table[:, names.index(c)] for c in points.more["columns"] if c in names})

    @staticmethod
    def _with_intensity(made: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return made if "intensity" in made else made | {"intensity": np.full(len(made["x"]), 128.0)}

    @staticmethod
    def _points(f, at: int, names: list[str], kinds: list[str], n: int, binary: bool) -> Points:
        if not {"x", "y", "z"} <= set(names):
            raise ValueError("a coordinate is missing")
        record = np.dtype(list(zip(names, kinds, strict=True))) if binary else None
        n = min(n, (f.size() - at) // record.itemsize) if binary else n
        kept = [c for c in names if c in _Table.named]
        return Points(n, record, at, {"fields": names, "columns": kept if "intensity" in kept else [*kept, "intensity"]}, lines=not binary)

    def head(self, names: list[str], n: int, ascii_: bool) -> str:
        raise NotImplementedError

    def encode(self, data, n) -> bytes:
        names, ascii_ = [c for c in self.named if c in data], self.options.get("ascii", "false") == "true"
        table = np.column_stack([np.asarray(data[c], "<f8") for c in names])
        body = "".join(" ".join(map(repr, row)) + "\n" for row in table.tolist()).encode() if ascii_ else table.tobytes()
        return self.head(names, n, ascii_).encode() + body


class Ply(_Table):
    suffix = "ply"

    @classmethod
    def name(cls) -> str:
        return "ply"

    def look(self, f) -> Points:
        lines, at = _lines(f, "end_header")
        if lines[0] != "ply":
            raise ValueError("no PLY file")
        kind, n, names, kinds, element = "", 0, [], [], ""
        for words in (x.split() for x in lines if x and not x.startswith("comment")):
            if words[0] == "format":
                kind = words[1]
            elif words[0] == "element":
                element = words[1]
                n = int(words[2]) if element == "vertex" else n
            elif words[0] == "property" and element == "vertex":
                names.append(_RENAMED.get(words[-1], words[-1]))
                kinds.append(_PLY[words[1]])
        if kind not in ("ascii", "binary_little_endian"):
            raise ValueError(f"PLY format {kind!r} isn't supported")
        return self._points(f, at, names, kinds, n, kind != "ascii")


    def head(self, names, n, ascii_) -> str:
        given = {v: k for k, v in _RENAMED.items() if v in "rgb"}
        properties = "".join(f"property double {given.get(c, c)}\n" for c in names)
        return f"ply\nformat {'ascii' if ascii_ else 'binary_little_endian'} 1.0\nelement vertex {n}\n{properties}end_header\n"


class Pcd(_Table):
    suffix = "pcd"

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def look(self, f) -> Points:
        lines, at = _lines(f, "data")
        said = {w[0].upper(): w[1:] for w in (x.split() for x in lines) if w and not w[0].startswith("#")}
        if "FIELDS" not in said:
            raise ValueError("no PCD file")
        counts = [int(c) for c in said.get("COUNT", ["1"] * len(said["FIELDS"]))]
        signs = {"F": "f", "U": "u", "I": "i"}
        names, kinds = [], []
        for name, size, sign, count in zip(said["FIELDS"], said.get("SIZE", ["4"] * len(counts)), said.get("TYPE", ["F"] * len(counts)), counts, strict=True):
            names += [name] if count == 1 else [f"{name}_{k}" for k in range(count)]
            kinds += [f"<{signs[sign]}{size}"] * count
        n = int(said["POINTS"][0]) if "POINTS" in said else int(said["WIDTH"][0]) * int(said["HEIGHT"][0])
        if (kind := said["DATA"][0].lower()) not in ("ascii", "binary"):
            raise ValueError(f"PCD data {kind!r} isn't supported")
        return self._points(f, at, names, kinds, n, kind == "binary")

    def head(self, names, n, ascii_) -> str:
        each = lambda x: " ".join([x] * len(names))
        return f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE {each('8')}\nTYPE {each('F')}\nCOUNT {each('1')}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {'ascii' if ascii_ else 'binary'}\n"


class _Lines(PointSource):
    """Files of nothing but lines."""

    of_lines = True
    fields: tuple[str, ...] = ("x", "y", "z")

    def found(self) -> list[str]:
        return [*self.fields]

    def look(self, f) -> Points:
        return Points(None, None, 0, {"columns": [*self.fields]}, lines=True)

    def count(self, points: Points, lines: bytes) -> int:
        return len(self.parsed(points, lines)["x"])


def _number(word: bytes) -> float | None:
    try:
        return float(word)
    except ValueError:
        return None


class Text(_Lines):
    """Lines of numbers split by commas or white space: x, y, z and, if there is a fourth number, intensity, else 128. Blank lines, # comments and lines without three numbers are skipped."""

    fields = ("x", "y", "z", "intensity")

    @classmethod
    def name(cls) -> str:
        return "point_text"

    def parsed(self, points: Points, lines: bytes) -> dict[str, np.ndarray]:
        rows = []
        for line in lines.splitlines():
            words = line.replace(b",", b" ").split(None, 4)
            if len(words) < 3 or words[0].startswith(b"#"):
                continue
            row = [_number(w) for w in words[:4]]
            if None not in row[:3]:
                rows.append([*row[:3], 128.0 if len(row) < 4 or row[3] is None else row[3]])
        return dict(zip(self.fields, np.array(rows, np.float64).reshape(-1, 4).T, strict=True))


class Obj(_Lines):
    """Vertices of OBJ files; what is no number is NaN."""

    @classmethod
    def name(cls) -> str:
        return "point_obj"

    def parsed(self, points: Points, lines: bytes) -> dict[str, np.ndarray]:
        rows = [x.split()[1:4] for x in lines.splitlines() if x.lstrip()[:2] in (b"v ", b"v\t")]
        table = [[_number(w) for w in r] + [None] * (3 - len(r)) for r in rows]
        return dict(zip(self.fields, np.array(table, np.float64).reshape(-1, 3).T, strict=True))
