"""Ground by cloth simulation (Zhang et al. 2016), in tiles that exchange their borders.

Points fold to the highest inverted height per cell. One cloth, dropped from above
the highest of all, covers the blocks of BLOCK cells with points and those around
them; blocks lie on a grid of their own, so the cloth is the same whatever the tiles.
It is relaxed in tiles of TILE cells, a tile a row. In an iteration a knot feels
others at most 2 * rigidness cells away, so with HALO cells around it a tile can go
HALO // (2 * rigidness) iterations alone; then tiles send one another their borders.
Tiles say how far the cloth moved in each iteration, and the driver ends the rounds
at the first in which it moved less than `settled` anywhere. So a task holds one
tile, and the cloth is that of one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.scratch import stored

TILE, HALO, BLOCK = 256, 64, 16  # a halo is no wider than a tile, a tile is whole blocks
LAYERS = 5  # of a tile: floor, cloth, cloth before, whether a knot is free, whether there is one


def _drop(layers: np.ndarray, iterations: int, rigidness: int, step: float) -> Iterator[np.ndarray]:
    """The layers after each iteration."""
    floor, cloth, before, free, knot = layers
    free, knot = free > 0, knot > 0
    joint = [knot[:-1] & knot[1:], knot[:, :-1] & knot[:, 1:]]
    for _ in range(iterations):
        moved = np.where(free, cloth + (cloth - before) * 0.99 - 0.2 * step * step, cloth)
        before, cloth = cloth, moved
        for _ in range(rigidness):
            for axis in (0, 1):
                first = (slice(None, -1), slice(None)) if axis == 0 else (slice(None), slice(None, -1))
                second = (slice(1, None), slice(None)) if axis == 0 else (slice(None), slice(1, None))
                a, b = free[first], free[second]
                pull = np.diff(cloth, axis=axis) * np.where(joint[axis], np.where(a & b, 0.25, np.where(a | b, 0.5, 0.0)), 0.0)
                cloth = cloth.copy()
                cloth[first], up = cloth[first] + np.where(a, pull, 0), np.zeros_like(cloth)
                up[second] = np.where(b, pull, 0)
                cloth = cloth - up
        hit = cloth <= floor
        cloth, free = np.where(hit, floor, cloth), free & ~hit
        yield np.stack([floor, cloth, before, free, knot])


def _moved(layers: np.ndarray) -> float:
    return float(np.where(layers[4] > 0, np.abs(layers[1] - layers[2]), 0).max(initial=0))


def _laid(surface: np.ndarray, knot: np.ndarray, top: float) -> np.ndarray:
    """Layers of a cloth above a surface (NaN: nothing underneath)."""
    cloth = np.full(surface.shape, top + 0.05)
    return np.stack([np.where(np.isnan(surface), -np.inf, surface), cloth, cloth, knot, knot])


def relaxed(surface: np.ndarray, iterations: int = 500, rigidness: int = 2, step: float = 0.65, settled: float = 0.005, knot: np.ndarray | None = None) -> np.ndarray:
    """Height of a cloth that sinks onto the surface (NaN: nothing underneath) and is pulled straight by its springs."""
    top = np.nanmax(surface) if np.isfinite(surface).any() else 0.0
    layers = _laid(surface, np.ones(surface.shape, bool) if knot is None else knot, top)
    for layers in _drop(layers, iterations, rigidness, step):  # noqa: B020
        if _moved(layers) < settled:
            break
    return layers[1]


_STATE = "tx bigint, ty bigint, layers binary, moved array<double>"


def _array(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(LAYERS, *shape)


def _tiles(surface: DataFrame, top: float) -> DataFrame:
    """A row for each tile of the cloth, from the occupied cells (__ix, __iy, s)."""
    size = TILE
    block = [F.floor(F.col(f"__i{d}") / BLOCK).alias(f"b{d}") for d in "xy"]
    around = F.array(*[F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    blocks = surface.select(*block).distinct().select(F.inline(around)).distinct()
    of_tile = lambda c, n: F.floor(F.col(c) * n / size)
    cells = surface.withColumns({"tx": of_tile("__ix", 1), "ty": of_tile("__iy", 1)})
    blocks = blocks.withColumns({"tx": of_tile("bx", BLOCK), "ty": of_tile("by", BLOCK)})

    def lay(key: tuple, cells: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        tx, ty = map(int, key)
        height, knot = np.full((size, size), np.nan), np.zeros((size // BLOCK, size // BLOCK), bool)
        height[cells["__ix"] - tx * size, cells["__iy"] - ty * size] = cells["s"]
        knot[blocks["bx"] - tx * size // BLOCK, blocks["by"] - ty * size // BLOCK] = True
        return pd.DataFrame({"tx": [tx], "ty": [ty], "layers": [_laid(height, knot.repeat(BLOCK, 0).repeat(BLOCK, 1), top).tobytes()], "moved": [[]]})

    return cells.groupBy("tx", "ty").cogroup(blocks.groupBy("tx", "ty")).applyInPandas(lay, _STATE)


def _advanced(tiles: DataFrame, iterations: int, rigidness: int, step: float) -> DataFrame:
    """The tiles so many iterations on; each has its own rows and the borders of the eight around it."""
    size, halo = TILE, min(HALO, TILE)
    cut = {-1: slice(0, halo), 0: slice(None), 1: slice(size - halo, None)}
    place = {-1: slice(0, halo), 0: slice(halo, halo + size), 1: slice(halo + size, None)}

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tx, ty, data in zip(frame["tx"], frame["ty"], frame["layers"], strict=True):
                layers = _array(data, size, size)
                out = [(tx + i, ty + j, -i, -j, np.ascontiguousarray(layers[:, cut[i], cut[j]]).tobytes()) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                yield pd.DataFrame(out, columns=["tx", "ty", "i", "j", "layers"])

    def relax(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if not ((frame["i"] == 0) & (frame["j"] == 0)).any():  # no tile: the cloth ends here
            return pd.DataFrame(columns=["tx", "ty", "layers", "moved"], dtype=object)
        whole = np.zeros((LAYERS, size + 2 * halo, size + 2 * halo))
        for i, j, data in zip(frame["i"], frame["j"], frame["layers"], strict=True):
            whole[:, place[i], place[j]] = _array(data, halo if i else size, halo if j else size)
        moved = []
        for whole in _drop(whole, iterations, rigidness, step):  # noqa: B020
            moved.append(_moved(whole[:, place[0], place[0]]))
        return pd.DataFrame({"tx": [key[0]], "ty": [key[1]], "layers": [np.ascontiguousarray(whole[:, place[0], place[0]]).tobytes()], "moved": [moved]})

    sent = tiles.select("tx", "ty", "layers").mapInPandas(send, "tx bigint, ty bigint, i int, j int, layers binary")
    return sent.groupBy("tx", "ty").applyInPandas(relax, _STATE)


def heights(surface: DataFrame, iterations: int = 500, rigidness: int = 2, step: float = 0.65, settled: float = 0.005) -> DataFrame:
    """(__ix, __iy, cloth) from occupied cells (__ix, __iy, s)."""
    size, top = TILE, surface.agg(F.max("s")).first()[0]
    if top is None:
        return surface.select("__ix", "__iy", F.col("s").alias("cloth"))
    tiles, done = stored(_tiles(surface, top), "cloth"), 0
    alone = max(1, min(HALO, TILE) // (2 * rigidness)) if tiles.count() > 1 else iterations  # a single tile has no border
    while done < iterations:
        now = min(alone, iterations - done)
        after = stored(_advanced(tiles, now, rigidness, step), "cloth")
        far = after.select(F.posexplode("moved")).groupBy("pos").agg(F.max("col").alias("far")).where(F.col("far") < settled)
        end = far.agg(F.min("pos")).first()[0]
        if end is not None:
            tiles = after if end + 1 == now else _advanced(tiles, end + 1, rigidness, step)
            break
        tiles, done = after, done + now

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tx, ty, data in zip(frame["tx"], frame["ty"], frame["layers"], strict=True):
                floor, cloth, *_ = _array(data, size, size)
                x, y = np.nonzero(np.isfinite(floor))
                yield pd.DataFrame({"__ix": x + tx * size, "__iy": y + ty * size, "cloth": cloth[x, y]})

    return tiles.select("tx", "ty", "layers").mapInPandas(cells, "__ix bigint, __iy bigint, cloth double")


def classified(cloud: DataFrame, resolution: float = 0.5, threshold: float = 0.5, iterations: int = 500) -> DataFrame:
    """The cloud with is_ground: within threshold of the cloth. Under two points all are ground."""
    cells = cloud.withColumns({"__ix": F.floor(F.col("x") / resolution), "__iy": F.floor(F.col("y") / resolution)})
    surface = stored(cells.groupBy("__ix", "__iy").agg(F.max(-F.col("z")).alias("s")), "surface")
    flag = F.abs(-F.col("z") - F.col("cloth")) < threshold
    return cells.join(heights(surface, iterations), ["__ix", "__iy"]).select(*cloud.columns, flag.alias("is_ground"))
