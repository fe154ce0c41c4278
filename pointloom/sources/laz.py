"""Compressed points of LAZ files, formats 0 to 3: an adaptive range coder, and models of each field given the point before.

One description of each field serves both directions: a Reader's methods take a value
and ignore it, a Writer's encode it, and both return what stands in the file. Chunks
are coded apart from one another, so they are what tasks read; the table at the file's
end says where they are. Format: LASzip's pointwise chunked coding, item versions 2.
"""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np

CHUNK_POINTS = 50_000
VARIABLE = 0xFFFFFFFF  # as a chunk size: chunks of different sizes

#: The coder's least interval, and precision and limits of its models.
_LEAST = 1 << 24
_SYMBOL_BITS, _BIT_BITS = 15, 13
#: Context of (number of returns, return number).
_RETURN_MAP = [
    [15, 14, 13, 12, 11, 10, 9, 8], [14, 0, 1, 3, 6, 10, 10, 9], [13, 1, 2, 4, 7, 11, 11, 10], [12, 3, 4, 5, 8, 12, 12, 11],
    [11, 6, 7, 8, 9, 13, 13, 12], [10, 10, 11, 12, 13, 14, 14, 13], [9, 10, 11, 12, 13, 14, 15, 14], [8, 9, 10, 11, 12, 13, 14, 15],
]
#: Limits and codes of multiples of the last time step.
_MOST, _LEAST_MULTIPLE, _SAME, _NEW, _CODES = 500, -10, 511, 512, 516
#: Numbers and sizes of the items of a point, and the record that lists them.
ITEM_BYTES, ITEM_POINT, ITEM_TIME, ITEM_COLOUR = 0, 6, 7, 8
VLR_USER, VLR_RECORD = b"laszip encoded", 22204


class Model:
    """Adaptive frequencies of symbols."""

    __slots__ = ("count", "cumulative", "cycle", "last", "left", "total")

    def __init__(self, symbols: int):
        self.count, self.total, self.cycle, self.last = [1] * symbols, 0, symbols, symbols - 1
        self.update()
        self.left = self.cycle = (symbols + 6) >> 1

    def update(self) -> None:
        self.total += self.cycle
        if self.total > 1 << _SYMBOL_BITS:
            self.count = [(n + 1) >> 1 for n in self.count]
            self.total = sum(self.count)
        scale, before, out = (1 << 31) // self.total, 0, []
        for n in self.count:
            out.append(scale * before >> 31 - _SYMBOL_BITS)
            before += n
        self.cumulative = out
        self.left = self.cycle = min(5 * self.cycle >> 2, (len(self.count) + 6) << 3)


class BitModel:
    __slots__ = ("all", "cycle", "left", "share", "zeros")

    def __init__(self):
        self.zeros, self.all, self.share, self.cycle, self.left = 1, 2, 1 << _BIT_BITS - 1, 4, 4

    def update(self) -> None:
        self.all += self.cycle
        if self.all > 1 << _BIT_BITS:
            self.all, self.zeros = (self.all + 1) >> 1, (self.zeros + 1) >> 1
            self.all += self.zeros == self.all
        self.share = self.zeros * ((1 << 31) // self.all) >> 31 - _BIT_BITS
        self.left = self.cycle = min(5 * self.cycle >> 2, 64)


class Reader:
    """Decodes from bytes; what lies beyond their end reads as zeros."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at + 4
        self.value, self.length = int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big"), 0xFFFFFFFF

    def _widen(self) -> None:
        while self.length < _LEAST:
            self.value = self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.length <<= 8

    def symbol(self, model: Model, _: int = 0) -> int:
        unit, table = self.length >> _SYMBOL_BITS, model.cumulative
        s = bisect_right(table, self.value // unit) - 1
        low = table[s] * unit
        self.value -= low
        self.length = (self.length if s == model.last else table[s + 1] * unit) - low
        if self.length < _LEAST:
            self._widen()
        model.count[s] += 1
        model.left -= 1
        if not model.left:
            model.update()
        return s

    def bit(self, model: BitModel, _: int = 0) -> int:
        zero = model.share * (self.length >> _BIT_BITS)
        if one := self.value >= zero:
            self.value -= zero
            self.length -= zero
        else:
            self.length = zero
            model.zeros += 1
        self._widen()
        model.left -= 1
        if not model.left:
            model.update()
        return int(one)

    def raw(self, bits: int, _: int = 0) -> int:
        if bits > 19:
            low = self.raw(16)
            return self.raw(bits - 16) << 16 | low
        self.length >>= bits
        v = self.value // self.length
        self.value -= v * self.length
        self._widen()
        return v


class Writer:
    """Encodes into out."""

    def __init__(self):
        self.out, self.base, self.length = bytearray(), 0, 0xFFFFFFFF

    def _narrow(self, low: int, length: int) -> None:
        self.base += low
        self.length = length
        if self.base >> 32:  # carry into the bytes that are out
            self.base &= 0xFFFFFFFF
            k = len(self.out) - 1
            while self.out[k] == 0xFF:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        while self.length < _LEAST:
            self.out.append(self.base >> 24)
            self.base = self.base << 8 & 0xFFFFFFFF
            self.length <<= 8

    def symbol(self, model: Model, s: int) -> int:
        unit, table = self.length >> _SYMBOL_BITS, model.cumulative
        low = table[s] * unit
        self._narrow(low, (self.length if s == model.last else table[s + 1] * unit) - low)
        model.count[s] += 1
        model.left -= 1
        if not model.left:
            model.update()
        return s

    def bit(self, model: BitModel, one: int) -> int:
        zero = model.share * (self.length >> _BIT_BITS)
        if one:
            self._narrow(zero, self.length - zero)
        else:
            model.zeros += 1
            self._narrow(0, zero)
        model.left -= 1
        if not model.left:
            model.update()
        return one

    def raw(self, bits: int, v: int) -> int:
        if bits > 19:
            self.raw(16, v & 0xFFFF)
            self.raw(bits - 16, v >> 16)
            return v
        unit = self.length >> bits
        self._narrow(v * unit, unit)
        return v

    def end(self) -> bytes:
        more = self.length > 2 * _LEAST
        self._narrow(_LEAST if more else _LEAST >> 1, _LEAST >> 1 if more else _LEAST >> 9)
        return bytes(self.out) + b"\0" * (3 if more else 2)


class Number:
    """Numbers of so many bits, as corrections of a prediction: the size of the correction first, then its upper 8 bits by a model, the rest as they are."""

    def __init__(self, bits: int, contexts: int = 1):
        self.half, self.sizes, self.k = 1 << bits - 1, [Model(bits + 1) for _ in range(contexts)], 0
        self.zero, self.upper = BitModel(), [None, *(Model(1 << min(k, 8)) for k in range(1, min(bits, 31) + 1))]
        self.signed = bits == 32

    def code(self, coder, guess: int, value: int = 0, context: int = 0) -> int:
        half = self.half
        c = (value - guess + half) % (2 * half) - half
        k = self.k = coder.symbol(self.sizes[context], (c - 1 if c > 0 else -c).bit_length())
        if k == 0:
            c = coder.bit(self.zero, c)
        elif k < 32:
            v = c - 1 if c > 0 else c + (1 << k) - 1
            if k <= 8:
                v = coder.symbol(self.upper[k], v)
            else:
                rest = k - 8
                v = coder.symbol(self.upper[k], v >> rest) << rest | coder.raw(rest, v & (1 << rest) - 1)
            c = v + 1 if v >> k - 1 else v - (1 << k) + 1
        else:
            c = -half
        return (guess + c + half) % (2 * half) - half if self.signed else (guess + c) % (2 * half)


class Median:
    """A running median of five, in whose upper and lower half values are let in by turns."""

    def __init__(self):
        self.values, self.upper = [0] * 5, True

    def add(self, v: int) -> None:
        a = self.values
        if self.upper:
            if v >= a[2]:
                self.upper = False
            a.pop()
        else:
            if v <= a[2]:
                self.upper = True
            a.pop(0)
        a.insert(bisect_right(a, v), v)


class PointItem:
    """X, Y, Z, intensity, flags, classification, scan angle, user data, source: 20 bytes."""

    kind, size, layout = ITEM_POINT, 20, struct.Struct("<iiiHBBbBH")

    def __init__(self, first: tuple):
        self.last = list(first)
        self.changed, self.flags, self.classes, self.users = Model(64), {}, {}, {}
        self.angles, self.intensity, self.source = [Model(256), Model(256)], Number(16, 4), Number(16)
        self.dx, self.dy, self.z = Number(32, 2), Number(32, 22), Number(32, 20)
        self.steps = [(Median(), Median()) for _ in range(16)]
        self.intensities, self.heights = [0] * 16, [0] * 8

    @staticmethod
    def _given(models: dict, last: int) -> Model:
        if last not in models:
            models[last] = Model(256)
        return models[last]

    def code(self, c, point: tuple | None) -> tuple:
        x0, y0, _, _, flags0, class0, angle0, user0, source0 = self.last
        x, y, z, light, flags, klass, angle, user, source = point or (0,) * 9
        change = 0
        if point:
            was = self.intensities[_RETURN_MAP[flags >> 3 & 7][flags & 7]]
            change = (flags != flags0) << 5 | (light != was) << 4 | (klass != class0) << 3 | (angle != angle0) << 2 | (user != user0) << 1 | (source != source0)
        change = c.symbol(self.changed, change)
        flags = c.symbol(self._given(self.flags, flags0), flags) if change & 32 else flags0
        nth, n = flags & 7, flags >> 3 & 7
        m, level, single = _RETURN_MAP[n][nth], abs(n - nth), int(n == 1)
        if change & 16:
            self.intensities[m] = self.intensity.code(c, self.intensities[m], light, min(m, 3))
        klass = c.symbol(self._given(self.classes, class0), klass) if change & 8 else class0
        if change & 4:
            angle = (angle0 + c.symbol(self.angles[flags >> 6 & 1], (angle - angle0) & 255) + 128) % 256 - 128
        else:
            angle = angle0
        user = c.symbol(self._given(self.users, user0), user) if change & 2 else user0
        source = self.source.code(c, source0, source) if change & 1 else source0
        across, along = self.steps[m]
        step = self.dx.code(c, across.values[2], x - x0, single)
        across.add(step)
        x, k = x0 + step, self.dx.k
        step = self.dy.code(c, along.values[2], y - y0, single + (k & ~1 if k < 20 else 20))
        along.add(step)
        y, k = y0 + step, (self.dx.k + self.dy.k) // 2
        z = self.heights[level] = self.z.code(c, self.heights[level], z, single + (k & ~1 if k < 18 else 18))
        x, y = ((v + (1 << 31)) % (1 << 32) - (1 << 31) for v in (x, y))
        self.last = [x, y, z, self.intensities[m], flags, klass, angle, user, source]
        return tuple(self.last)


def _wrap(v: int, bits: int = 32) -> int:
    return (v + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


class TimeItem:
    """The bits of a double, as up to four sequences of steps that are multiples of the last one."""

    kind, size, layout = ITEM_TIME, 8, struct.Struct("<q")

    def __init__(self, first: tuple):
        self.at, self.newest = 0, 0
        self.times, self.steps, self.odd = [first[0], 0, 0, 0], [0] * 4, [0] * 4
        self.multiple, self.first, self.number = Model(_CODES), Model(6), Number(32, 9)

    def _fits(self, t: int | None, k: int) -> bool:
        return t is not None and -(1 << 31) <= t - self.times[k] < 1 << 31

    def _far(self, t: int | None) -> int:
        """Which of the next three sequences is near a time that this one isn't near; 0 for none."""
        return next((i for i in (1, 2, 3) if self._fits(t, (self.at + i) & 3)), 0)

    def _start(self, c, t: int | None) -> None:
        """A new sequence, with the time written out."""
        bits = (t or 0) & 0xFFFFFFFFFFFFFFFF
        high = self.number.code(c, _wrap(self.times[self.at] >> 32), _wrap(bits >> 32), 8)
        low = c.raw(16, bits & 0xFFFF)
        low |= c.raw(16, bits >> 16 & 0xFFFF) << 16
        self.newest = self.at = (self.newest + 1) & 3
        self.times[self.at], self.steps[self.at], self.odd[self.at] = _wrap((high & 0xFFFFFFFF) << 32 | low, 64), 0, 0

    def code(self, c, item: tuple | None) -> tuple:
        t = item[0] if item else None
        k = self.at
        move = (t or 0) - self.times[k]
        near, step = self._fits(t, k), self.steps[k]
        if step == 0:
            what = c.symbol(self.first, 0 if t is None or not move else 1 if near else (self._far(t) + 2))
            if what == 1:
                self.steps[k] = self.number.code(c, 0, move, 0)
                self.times[k] = _wrap(self.times[k] + self.steps[k], 64)
                self.odd[k] = 0
            elif what == 2:
                self._start(c, t)
            elif what > 2:
                self.at = (k + what - 2) & 3
                return self.code(c, item)
            return (self.times[self.at],)
        code = 0
        if t is not None:
            if not move:
                code = _SAME
            elif near:
                times = int(abs(move / step) + 0.5) * (1 if move * step > 0 else -1)
                code = min(times, _MOST) if times >= 0 else _MOST - max(times, _LEAST_MULTIPLE)
            else:
                code = _NEW + self._far(t)
        code = c.symbol(self.multiple, code)
        if code < _SAME:
            times = code if code <= _MOST else _MOST - code
            context = 7 if times == 0 else 1 if times == 1 else 6 if times <= _LEAST_MULTIPLE else 5 if times < 0 else 4 if times == _MOST else 2 if times < 10 else 3
            moved = self.number.code(c, _wrap(times * step), move, context)
            if context == 1:
                self.odd[k] = 0
            elif context in (4, 6, 7):  # steps that the last one says nothing about; the fourth takes its place
                self.odd[k] += 1
                if self.odd[k] > 3:
                    self.steps[k], self.odd[k] = moved, 0
            self.times[k] = _wrap(self.times[k] + moved, 64)
        elif code == _NEW:
            self._start(c, t)
        elif code > _NEW:
            self.at = (k + code - _NEW) & 3
            return self.code(c, item)
        return (self.times[self.at],)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


class ColourItem:
    """Three 16-bit colours, byte by byte; green and blue are guessed from the step of red."""

    kind, size, layout = ITEM_COLOUR, 6, struct.Struct("<HHH")

    def __init__(self, first: tuple):
        self.last, self.used, self.steps = first, Model(128), [Model(256) for _ in range(6)]

    def code(self, c, colour: tuple | None) -> tuple:
        old = [(v & 255, v >> 8) for v in self.last]
        new = [[v & 255, v >> 8] for v in colour or self.last]
        used = sum((new[i // 2][i % 2] != old[i // 2][i % 2]) << i for i in range(6)) | (len(set(colour or ())) > 1) << 6
        used = c.symbol(self.used, used)

        def part(i: int, move: int) -> None:
            """Byte i, guessed as the old one moved."""
            guess = _clamp(move + old[i // 2][i % 2])
            new[i // 2][i % 2] = (guess + c.symbol(self.steps[i], (new[i // 2][i % 2] - guess) & 255)) & 255 if used >> i & 1 else old[i // 2][i % 2]

        part(0, 0)
        part(1, 0)
        if used >> 6 & 1:
            for half in (0, 1):
                move = new[0][half] - old[0][half]
                part(2 + half, move)
                part(4 + half, int((move + new[1][half] - old[1][half]) / 2))
        else:
            new[1] = new[2] = new[0]
        self.last = tuple(low | high << 8 for low, high in new)
        return self.last


class BytesItem:
    kind = ITEM_BYTES

    def __init__(self, first: tuple):
        self.last, self.steps = first[0], [Model(256) for _ in first[0]]

    def code(self, c, item: tuple | None) -> tuple:
        own = item[0] if item else self.last
        self.last = bytes((o + c.symbol(m, (v - o) & 255)) & 255 for m, o, v in zip(self.steps, self.last, own, strict=True))
        return (self.last,)


def items_of(point_format: int, record_length: int) -> list[tuple[type, struct.Struct]]:
    """The items of a point of the format: what they are and how they lie in the record."""
    kinds = [PointItem, *([TimeItem] if point_format in (1, 3) else []), *([ColourItem] if point_format in (2, 3) else [])]
    rest = record_length - sum(k.size for k in kinds)
    return [*((k, k.layout) for k in kinds), *([(BytesItem, struct.Struct(f"{rest}s"))] if rest else [])]


def decode_chunk(data: bytes, n: int, items: list[tuple[type, struct.Struct]]) -> bytes:
    """The records of a chunk of n points."""
    at, codecs, out = 0, [], bytearray()
    for kind, layout in items:  # the first point stands as it is
        codecs.append((kind(layout.unpack_from(data, at)), layout))
        at += layout.size
    out += data[:at]
    coder = Reader(data, at)
    for _ in range(n - 1):
        for codec, layout in codecs:
            out += layout.pack(*codec.code(coder, None))
    return bytes(out)


def encode_chunk(records: bytes, items: list[tuple[type, struct.Struct]]) -> bytes:
    length = sum(layout.size for _, layout in items)
    offsets = np.cumsum([0, *(layout.size for _, layout in items)]).tolist()
    codecs = [kind(layout.unpack_from(records, o)) for (kind, layout), o in zip(items, offsets[:-1], strict=True)]
    coder = Writer()
    for at in range(length, len(records), length):
        for codec, (_, layout), o in zip(codecs, items, offsets[:-1], strict=True):
            codec.code(coder, layout.unpack_from(records, at + o))
    return records[:length] + coder.end()


def item_record(items: list[tuple[type, struct.Struct]], chunk_points: int = CHUNK_POINTS) -> bytes:
    """The variable-length record that says how points are coded."""
    body = struct.pack("<HHBBHIIqqH", 2, 0, 2, 2, 0, 0, chunk_points, -1, -1, len(items))
    body += b"".join(struct.pack("<HHH", kind.kind, layout.size, 2) for kind, layout in items)
    return struct.pack("<2x16sHH32s", VLR_USER, VLR_RECORD, len(body), b"compressed points") + body


def coding(body: bytes) -> int:
    """The chunk size that such a record's body names; codings that can't be read are refused."""
    compressor, coder = struct.unpack_from("<HH", body)
    chunk, n = struct.unpack_from("<I", body, 12)[0], struct.unpack_from("<H", body, 32)[0]
    items = [struct.unpack_from("<HHH", body, 34 + 6 * k) for k in range(n)]
    if compressor != 2 or coder != 0 or any(kind not in (ITEM_BYTES, ITEM_POINT, ITEM_TIME, ITEM_COLOUR) or version != 2 for kind, _, version in items):
        raise ValueError(f"this LAZ coding isn't supported: compressor {compressor}, items {items}")
    return chunk


def chunk_table(f, data_offset: int, n: int, chunk_points: int) -> list[tuple[int, int, int]]:
    """(place, bytes, points) of each chunk, from the table at the end of the file."""
    f.seek(data_offset)
    at = struct.unpack("<q", f.read(8))[0]
    if at < 0:  # written to a stream: the place stands at the end
        f.seek(f.size() - 8)
        at = struct.unpack("<q", f.read(8))[0]
    if not data_offset + 8 <= at < f.size():
        raise ValueError("the file has no table of chunks, it may be cut short")
    f.seek(at)
    data = f.read()
    chunks = struct.unpack_from("<I", data, 4)[0]
    coder, number = Reader(data, 8), Number(32, 2)
    out, place, size, points = [], data_offset + 8, 0, chunk_points
    for k in range(chunks):
        if chunk_points == VARIABLE:
            points = number.code(coder, points if k else 0, context=0)
        size = number.code(coder, size, context=1)
        held = points if chunk_points == VARIABLE else min(points, n - k * chunk_points)
        out.append((place, size, held))
        place += size
    return out


def packed(records: bytes, items: list[tuple[type, struct.Struct]], data_offset: int, chunk_points: int = CHUNK_POINTS) -> bytes:
    """What follows a file's header: chunks, and the table of them."""
    step = chunk_points * sum(layout.size for _, layout in items)
    chunks = [encode_chunk(records[k : k + step], items) for k in range(0, len(records), step)]
    coder, number, size = Writer(), Number(32, 2), 0
    for chunk in chunks:
        number.code(coder, size, len(chunk), 1)
        size = len(chunk)
    table = struct.pack("<II", 0, len(chunks)) + (coder.end() if chunks else b"")
    return struct.pack("<q", data_offset + 8 + sum(map(len, chunks))) + b"".join(chunks) + table
