"""Projections of a cloud: fields, shifts, scales and colour depth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.prefix import last_known, named, one_row, quantiles
from pointloom.operators.spatial import finite
from pointloom.schema import FIVE_CLASSES, LAS_CODES, SIX_CLASSES


def fields(cloud: DataFrame, names: Sequence[str]) -> DataFrame:
    """pid, coordinates and the named fields that exist; unknown names are left out."""
    have = {c.lower(): c for c in cloud.columns}
    return cloud.select("pid", "x", "y", "z", *[have[n.lower()] for n in names if n.lower() in have and n.lower() not in ("pid", "x", "y", "z")])


def shifted(cloud: DataFrame, shift: Sequence[float], compat: str = "add") -> DataFrame:
    """Local coordinates: original plus shift, or minus it with compat="subtract"."""
    sign = -1.0 if compat == "subtract" else 1.0
    return cloud.withColumns({c: F.col(c) + sign * float(s) for c, s in zip("xyz", shift, strict=True)})


def suggested_shift(cloud: DataFrame) -> DataFrame:
    """One row with the shift that centres the bounds at the origin."""
    return cloud.agg(*[(-(F.min(c) + F.max(c)) / 2).alias(f"shift_{c}") for c in "xyz"])


def from_minimum(cloud: DataFrame) -> DataFrame:
    """Coordinates from the least of each axis, which is kept as x0, y0, z0."""
    one = cloud.agg(*[F.min(c).alias(f"{c}0") for c in "xyz"])
    return cloud.join(F.broadcast(one)).withColumns({c: F.col(c) - F.col(f"{c}0") for c in "xyz"})


def viewer(layers: DataFrame) -> DataFrame:
    """Viewer axes (y, z, -x), centred on the bounds of all layers together, as vx, vy, vz."""
    v = layers.withColumns({"vx": F.col("y"), "vy": F.col("z"), "vz": -F.col("x")})
    one = v.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"{c}0") for c in ("vx", "vy", "vz")])
    return v.join(F.broadcast(one)).withColumns({c: F.col(c) - F.col(f"{c}0") for c in ("vx", "vy", "vz")}).drop("vx0", "vy0", "vz0")


def carried_forward(points: DataFrame, by: str, order: str = "pid") -> DataFrame:
    """A point that isn't finite takes the position of the last one in its chunk `by` that is."""
    good = F.when(finite("x", "y", "z"), F.struct("x", "y", "z"))
    p = last_known(points, [by], [order], good, "__p")
    return p.withColumns({c: F.col(f"__p.{c}") for c in "xyz"}).drop("__p")


def colours_to_8_bit(cloud: DataFrame) -> DataFrame:
    """Each channel whose greatest value is over 255 is divided by 256."""
    one = cloud.agg(*[F.max(c).alias(f"__{c}") for c in "rgb"])
    return cloud.join(F.broadcast(one)).withColumns({c: F.when(F.col(f"__{c}") > 255, F.col(c) / 256).otherwise(F.col(c)) for c in "rgb"}).drop("__r", "__g", "__b")


def clipped_to_8_bit(cloud: DataFrame) -> DataFrame:
    return cloud.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(255.0)) for c in "rgb"})


def las_scaled(cloud: DataFrame) -> DataFrame:
    """Colours and intensity as 16 bits by the greatest colour and the greatest intensity: up to 1 times 65535, up to 255 times 257, else as they are; class clipped to a byte."""
    has = set(cloud.columns)
    rgb = [c for c in "rgb" if c in has]
    scale = lambda m: F.when(m <= 1, F.lit(65535.0)).when(m <= 255, F.lit(257.0)).otherwise(F.lit(1.0))
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(top)))
    new: dict[str, Column] = {}
    one = cloud.agg(F.greatest(*[F.max(c) for c in rgb]).alias("__rgb") if len(rgb) == 3 else F.lit(None).alias("__rgb"), (F.max("intensity") if "intensity" in has else F.lit(None)).alias("__i"))
    if len(rgb) == 3:
        new |= {c: clip(F.col(c) * scale(F.col("__rgb")), 65535) for c in rgb}
    if "intensity" in has:
        new["intensity"] = clip(F.col("intensity") * scale(F.col("__i")), 65535)
    if "classification" in has:
        new["classification"] = F.least(F.greatest(F.col("classification"), F.lit(0)), F.lit(255))
    return cloud.join(F.broadcast(one)).withColumns(new).drop("__rgb", "__i")


def unit_intensity(cloud: DataFrame, column: str = "intensity", into: str = "ni") -> DataFrame:
    """Intensity between its 1st and 99th percentile as 0..1, clamped; 0.5 if they agree."""
    one = one_row(quantiles(named(cloud, {"__p": F.col(column)}), [0.01, 0.99]), ["__p"])
    lo, span = F.col("__p")[0], F.col("__p")[1] - F.col("__p")[0]
    t = F.when(span < 1e-8, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - lo) / F.nullif(span, F.lit(0.0)))))
    return cloud.join(F.broadcast(one)).withColumn(into, t).drop("__p")


def unit_height(cloud: DataFrame, into: str = "nz") -> DataFrame:
    """Height as 0..1 of its range; 0.5 if there is none."""
    one = cloud.agg(F.min("z").alias("__lo"), F.max("z").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return cloud.join(F.broadcast(one)).withColumn(into, F.when(span < 1e-8, F.lit(0.5)).otherwise((F.col("z") - F.col("__lo")) / F.nullif(span, F.lit(0.0)))).drop("__lo", "__hi")


def las_code(index: Column, classes: int = 6) -> Column:
    """LAS code of a model's output index, clipped to the model's classes."""
    keys = {6: SIX_CLASSES, 5: FIVE_CLASSES}.get(classes)
    if keys is None:
        raise ValueError(f"models of 5 or 6 classes are known, not {classes}")
    at = F.least(F.greatest(index, F.lit(0)), F.lit(classes - 1)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(LAS_CODES[k]) for k in keys]), at)


def labelled(cloud: DataFrame, key: str, table: Mapping[str, Sequence], columns: Sequence[str]) -> DataFrame:
    """Joins a small fixed table on a key column."""
    rows = cloud.sparkSession.createDataFrame([(k, *v) for k, v in table.items()], [key, *columns])
    return cloud.join(F.broadcast(rows), key, "left")
