"""Colours of points as column expressions; each colour is a struct of r, g, b in 0..1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.schema import ELEVATION_RAMP, GROUND_RGB, INSTANCE_COLOURS, OTHER_RGB, PLAIN, RAMPS


def rgb(r: Column | float, g: Column | float, b: Column | float) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for n, x in zip("rgb", (r, g, b), strict=True)])


def of_hex(text: Column) -> Column:
    """#rrggbb, with or without #; anything else is grey."""
    digits = F.regexp_extract(text, "^#?([a-fA-F0-9]{6})$", 1)
    part = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double") / 255
    return F.when(digits != "", rgb(part(0), part(1), part(2))).otherwise(rgb(0.5, 0.5, 0.5))


def _hex(text: str) -> tuple[float, ...]:
    return tuple(int(text[k : k + 2], 16) / 255 for k in (1, 3, 5))


def ramp(t: Column, stops: Sequence[tuple[float, ...]]) -> Column:
    """Piecewise linear over equally spaced stops, t clamped to 0..1."""
    n = len(stops) - 1
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * n
    k = F.least(F.floor(s), F.lit(n - 1)).cast("int")
    mix = lambda c: (lambda a: F.element_at(a, k + 1) + (F.element_at(a, k + 2) - F.element_at(a, k + 1)) * (s - k))(F.array(*[F.lit(float(x[c])) for x in stops]))
    return rgb(mix(0), mix(1), mix(2))


def stops(scale: str) -> list[tuple[float, ...]]:
    """The stops of a named ramp; grey for an unknown name."""
    return [_hex(h) for h in RAMPS[scale]] if scale in RAMPS else [(0.5, 0.5, 0.5)] * 2


def coloured(cloud: DataFrame, mode: str = "default", scale: str = "hot") -> DataFrame:
    """The cloud with a column `colour`, by elevation, intensity, rgb, radial_distance or plain.

    Ranges come from the whole cloud. Without intensities the mean of r, g, b stands
    in, or the middle of 0..255; a missing radial distance leaves the colour null.
    """
    has, column = set(cloud.columns), {"elevation": "z", "intensity": "intensity", "radial_distance": "radial_distance"}.get(mode)
    if mode == "rgb" and {"r", "g", "b"} <= has:
        known = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
        t, one = _unit("z"), cloud.agg(F.min("z").alias("__lo"), F.max("z").alias("__hi"))
        return cloud.join(F.broadcast(one)).withColumn("colour", F.when(known, rgb(F.col("r"), F.col("g"), F.col("b"))).otherwise(ramp(t, ELEVATION_RAMP))).drop("__lo", "__hi")
    if mode == "rgb":
        one = cloud.agg(F.min("z").alias("__lo"), F.max("z").alias("__hi"))
        return cloud.join(F.broadcast(one)).withColumn("colour", ramp(_unit("z"), ELEVATION_RAMP)).drop("__lo", "__hi")
    if column is None:
        return cloud.withColumn("colour", rgb(*PLAIN))
    value = F.col(column) if column in has else F.lit(None).cast("double")
    one = cloud.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    if mode == "intensity":
        one = one.select(F.coalesce("__lo", F.lit(0.0)).alias("__lo"), F.coalesce("__hi", F.lit(255.0)).alias("__hi"))
        mean = (F.col("r") + F.col("g") + F.col("b")) / 3 if {"r", "g", "b"} <= has else F.lit(None).cast("double")
        value = F.coalesce(value, F.when(mean <= 1, mean * 255).otherwise(mean), (F.col("__lo") + F.col("__hi")) / 2)
    t = (value - F.col("__lo")) / F.coalesce(F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(1.0))
    return cloud.join(F.broadcast(one)).withColumn("colour", F.when(t.isNotNull(), ramp(t, stops(scale)))).drop("__lo", "__hi")


def _unit(column: str) -> Column:
    return (F.col(column) - F.col("__lo")) / F.coalesce(F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(1.0))


def _palette(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in INSTANCE_COLOURS]), index.cast("int"))


def label_colour(label: Column) -> Column:
    """Hex colour of a tree label: label k has colour k, others are grey."""
    return F.when(label.between(1, len(INSTANCE_COLOURS)), _palette(F.greatest(F.lit(1), F.least(F.lit(len(INSTANCE_COLOURS)), label)))).otherwise(F.lit("#808080"))


def instance_colour(instance: Column) -> Column:
    """Hex colour of an instance id, in turns."""
    return _palette(F.pmod(instance, F.lit(len(INSTANCE_COLOURS))) + 1)


def tinted(colour: Column, ordinal: Column, hue: float = 0.0) -> Column:
    """A colour that varies a little from point to point of an instance."""
    wave = 1 + 0.03 * F.sin(0.1 * ordinal)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * wave + hue))
    return rgb(clamp(colour["r"]), clamp(colour["g"]), clamp(colour["b"]))


def cloth_colour(is_ground: Column) -> Column:
    """Channels of 0..1 of ground and of other points after cloth simulation; points without a flag count as other."""
    return F.when(is_ground, rgb(*[F.lit(c / 255) for c in GROUND_RGB])).otherwise(rgb(*[F.lit(c / 255) for c in OTHER_RGB]))
