"""Field geometry of one player-frame as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardgrid.functions.nulls import choose, larger, smaller

# Fixed values of the field and of the influence model.
FIELD_LENGTH = 120.0
FIELD_WIDTH = 160.0 / 3.0
END_ZONE = 10.0
RADIUS_GROWTH = 0.1144653
RADIUS_BASE = 3.0
RADIUS_FAR = 10.0
RADIUS_KNEE = 17.0
TOP_SPEED = 15.0
REACH = 5

# Yard cells a player can reach, and the cells of the dense grid.
REACH_X = (0, 120)
REACH_Y = (0, 54)
GRID_X = (0, 100)
GRID_Y = (0, 54)


def standardize(df: DataFrame) -> DataFrame:
    """Turn every play to the same direction and take off the end zone; ``dir`` is left as it is."""
    to_left = F.col("playDirection") == "left"
    return (
        df.withColumn("ToLeft", to_left)
        .withColumn("x", choose(F.col("ToLeft"), FIELD_LENGTH - F.col("x"), F.col("x")) - END_ZONE)
        .withColumn("y", choose(F.col("ToLeft"), FIELD_WIDTH - F.col("y"), F.col("y")))
    )


def heading(direction: str = "reference") -> Column:
    """Radians of ``dir``; ``corrected`` also turns the direction of plays that go right.

    The projection ``x - s*sin`` fits mirrored (left) plays. The default applies it to all
    plays; ``corrected`` adds half a turn to the plays that were not mirrored.
    """
    radians = F.col("dir") * F.lit(3.141592653589793) / 180.0
    if direction == "reference":
        return radians
    if direction == "corrected":
        return choose(F.col("ToLeft"), radians, radians + 3.141592653589793)
    raise ValueError(f"unknown direction rule {direction!r}")


def add_velocity(df: DataFrame, direction: str = "reference") -> DataFrame:
    """Tip of the velocity vector (``vector_x``, ``vector_y``) and the heading ``rad_dir``."""
    return df.withColumn("rad_dir", heading(direction)).withColumns(
        {
            "vector_x": -F.col("s") * F.sin("rad_dir") + F.col("x"),
            "vector_y": -F.col("s") * F.cos("rad_dir") + F.col("y"),
        }
    )


def raw_velocity(df: DataFrame) -> DataFrame:
    """Velocity components and angle in the frame of the recording; a still player has angle 0."""
    half_turn = 3.141592653589793 / 2
    v_x, v_y = F.col("v_x"), F.col("v_y")
    angle = (
        F.when((v_x == 0) & (v_y == 0), 0.0)
        .when((v_x == 0) & (v_y > 0), half_turn)
        .when((v_x == 0) & (v_y < 0), -half_turn)
        .otherwise(F.atan(v_y / F.when(v_x != 0, v_x)))
    )
    return (
        df.withColumn("dir_rad", F.col("dir") * 3.141592653589793 / 180.0)
        .withColumns({"v_x": F.sin("dir_rad") * F.col("s"), "v_y": F.cos("dir_rad") * F.col("s")})
        .withColumn("v_theta", angle)
    )


def radius(distance: Column) -> Column:
    """Influence radius by distance to the carrier: exponential up to the knee, constant beyond."""
    return F.when(
        distance <= RADIUS_KNEE, F.exp(distance * RADIUS_GROWTH) + RADIUS_BASE
    ).when(distance > RADIUS_KNEE, RADIUS_FAR)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0)))


def add_scales(df: DataFrame, vmax: float = TOP_SPEED) -> DataFrame:
    """Radius, scales along and across the heading, and the centre half a second ahead."""
    speed = F.col("s")
    return (
        df.withColumns(
            {
                "radio": radius(F.col("distance_to_ball")),
                "speed_ratio": speed * speed / (vmax * vmax),
            }
        )
        .withColumns(
            {
                "scal_x": (F.col("radio") + F.col("radio") * F.col("speed_ratio")) / 2,
                "scal_y": (F.col("radio") - F.col("radio") * F.col("speed_ratio")) / 2,
                "mu_x": -speed * F.sin("rad_dir") * 0.5 + F.col("x"),
                "mu_y": -speed * F.cos("rad_dir") * 0.5 + F.col("y"),
            }
        )
    )


def focal_distance() -> Column:
    """Distance from the centre to each focus of the two-sigma ellipse."""
    long = 2 * larger(F.col("scal_x"), F.col("scal_y"))
    short = 2 * smaller(F.col("scal_x"), F.col("scal_y"))
    return F.sqrt(long * long - short * short)


def add_foci(df: DataFrame) -> DataFrame:
    """Foci ``(f1_1, f1_2)`` and ``(f2_1, f2_2)`` on the heading, either side of the centre."""
    along_x = F.col("focal") * F.sin("rad_dir")
    along_y = F.col("focal") * F.cos("rad_dir")
    return (
        df.withColumn("focal", focal_distance())
        .withColumns(
            {
                "f1_1": F.col("mu_x") - along_x,
                "f1_2": F.col("mu_y") - along_y,
                "f2_1": F.col("mu_x") + along_x,
                "f2_2": F.col("mu_y") + along_y,
            }
        )
        .drop("focal")
    )


def in_ellipse(x: Column, y: Column, k: float = REACH) -> Column:
    """Whether the cell's distances to the two foci add up to at most ``k`` times the long scale."""
    to_foci = distance(x, y, F.col("f1_1"), F.col("f1_2")) + distance(
        x, y, F.col("f2_1"), F.col("f2_2")
    )
    return to_foci <= k * larger(F.col("scal_x"), F.col("scal_y"))


def ellipse_axes(df: DataFrame) -> DataFrame:
    """End points of the short and the long axis, relative to the centre."""
    sin, cos = F.sin("rad_dir"), F.cos("rad_dir")
    return df.withColumns(
        {
            "eigen_v1_1": cos * F.col("scal_y"),
            "eigen_v1_2": -sin * F.col("scal_y"),
            "eigen_v2_1": -sin * F.col("scal_x"),
            "eigen_v2_2": -cos * F.col("scal_x"),
        }
    )
