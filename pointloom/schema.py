"""The shape of a cloud and its fixed categories.

A cloud is a DataFrame with one row per point: `pid` identifies the point, x, y, z
are its coordinates, other attributes are columns that may be absent or null.
"""

from __future__ import annotations

POINT_SCHEMA = (
    "pid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, intensity DOUBLE, r DOUBLE, g DOUBLE, b DOUBLE, "
    "classification INT, radial_distance DOUBLE, return_number INT, number_of_returns INT, gps_time DOUBLE"
)
XYZ = ("x", "y", "z")

#: Categories of the geometric classifier, (key, label, colour).
CATEGORIES = [
    ("ground", "Ground", "#D97706"),
    ("tree", "Tree", "#22C55E"),
    ("building", "Building", "#EF4444"),
    ("low_vegetation", "LowVegetation", "#34D399"),
    ("other", "Other", "#6B7280"),
]
#: DBSCAN radius and least points of each category in space.
SPACE_CLUSTERS = {"tree": (1.2, 5), "building": (2.0, 8), "low_vegetation": (0.5, 3), "other": (1.0, 3)}
#: The same for the intensity classifier, in the plane.
PLANE_CLUSTERS = {"ground": (0.3, 5), "low_vegetation": (0.5, 5), "tree": (0.8, 5), "building": (2.0, 5), "high_reflectivity": (1.0, 3), "other": (1.0, 3)}
#: Model output index -> key, for models of six and five classes.
SIX_CLASSES = ["ground", "low_vegetation", "tree", "building", "high_reflectivity", "other"]
FIVE_CLASSES = ["ground", "low_vegetation", "tree", "building", "other"]
#: Key -> LAS classification code.
LAS_CODES = {"ground": 2, "low_vegetation": 3, "tree": 5, "building": 6, "high_reflectivity": 7, "other": 1}
#: LAS classification code -> colour.
LAS_COLOURS = {2: "#D97706", 3: "#34D399", 5: "#22C55E", 6: "#EF4444", 7: "#F59E0B", 1: "#6B7280"}
#: Colours of instances, by id.
INSTANCE_COLOURS = [
    "#EF4444", "#3B82F6", "#10B981", "#F59E0B", "#8B5CF6", "#EC4899", "#06B6D4", "#84CC16", "#F97316", "#6366F1",
    "#14B8A6", "#EAB308", "#A855F7", "#0EA5E9", "#22C55E", "#DC2626", "#2563EB", "#059669", "#D97706", "#7C3AED",
    "#DB2777", "#0891B2", "#65A30D", "#EA580C", "#4F46E5", "#0D9488", "#CA8A04", "#9333EA", "#0284C7", "#16A34A",
]
#: Colour ramps.
RAMPS = {
    "blue-green-yellow-red": ["#3B82F6", "#10B981", "#F59E0B", "#EF4444"],
    "rainbow": ["#FF0000", "#FF7F00", "#FFFF00", "#00FF00", "#0000FF", "#4B0082", "#9400D3"],
    "greyscale": ["#1a1a1a", "#4a4a4a", "#7a7a7a", "#aaaaaa", "#ffffff"],
    "hot": ["#000000", "#FF0000", "#FFFF00", "#FFFFFF"],
    "cool": ["#0000FF", "#00FFFF", "#FFFFFF"],
}
#: The ramp of plain colouring without colours, and the plain colour.
ELEVATION_RAMP = [(0.2, 0.3, 0.8), (0.2, 0.6, 0.8), (0.2, 0.8, 0.6), (0.8, 0.8, 0.2), (0.8, 0.4, 0.2)]
PLAIN = (0.47, 0.55, 0.65)
#: Colours of ground and other points after cloth simulation.
GROUND_RGB, OTHER_RGB = (34, 139, 34), (220, 20, 60)
