"""Small tracking tables and a plain NumPy version of the surfaces to test against."""

from __future__ import annotations

import math

import numpy as np

CLEAN = (
    "gameId bigint, playId bigint, frameId int, nflId bigint, club string, event string, "
    "playDirection string, x double, y double, s double, a double, o double, dir double, dis double, "
    "rad_dir double, distance_to_ball double, radio double, speed_ratio double, scal_x double, "
    "scal_y double, mu_x double, mu_y double"
)


def shape(x, y, s, direction, distance, vmax=15.0):
    """Scales and centre of one player-frame."""
    r = math.exp(distance * 0.1144653) + 3 if distance <= 17 else 10.0
    q = s * s / (vmax * vmax)
    t = direction * math.pi / 180
    return {
        "rad_dir": t,
        "radio": r,
        "speed_ratio": q,
        "scal_x": (r + r * q) / 2,
        "scal_y": (r - r * q) / 2,
        "mu_x": x - s * math.sin(t) * 0.5,
        "mu_y": y - s * math.cos(t) * 0.5,
    }


def clean_row(player, club, x, y, s, direction, distance, frame=1, play=1, game=1, event=None):
    """A cleaned tracking row."""
    f = shape(x, y, s, direction, distance)
    return (
        game, play, frame, player, club, event, "right", float(x), float(y), float(s), 0.0, 0.0,
        float(direction), 0.5, f["rad_dir"], float(distance), f["radio"], f["speed_ratio"],
        f["scal_x"], f["scal_y"], f["mu_x"], f["mu_y"],
    )


def clean_frame(spark, rows):
    return spark.createDataFrame(rows, CLEAN)


def counting(a, b):
    """Whole numbers from a to b, downwards when a is larger."""
    a, b = int(a), int(b)
    return range(a, b + 1) if a <= b else range(a, b - 1, -1)


def cells(f):
    """Cells of a player-frame with their influence, by the matrix form of the normal."""
    sx, sy, t = f["scal_x"], f["scal_y"], f["rad_dir"]
    c = math.sqrt((2 * max(sx, sy)) ** 2 - (2 * min(sx, sy)) ** 2)
    f1 = (f["mu_x"] - c * math.sin(t), f["mu_y"] - c * math.cos(t))
    f2 = (f["mu_x"] + c * math.sin(t), f["mu_y"] + c * math.cos(t))
    rotation = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    scale = np.diag([sy, sx])
    inverse = np.linalg.inv(rotation @ scale @ scale @ rotation.T)
    out = {}
    xs = counting(max(round(f["mu_x"]) - round(5 * sx), 0), min(round(f["mu_x"]) + round(5 * sx), 120))
    ys = counting(
        max(round(f["mu_y"]) - math.ceil(5 * sy), 0), min(round(f["mu_y"]) + math.ceil(5 * sy), 54)
    )
    for x in xs:
        for y in ys:
            if math.dist((x, y), f1) + math.dist((x, y), f2) <= 5 * max(sx, sy):
                d = np.array([x - f["mu_x"], y - f["mu_y"]])
                out[(x, y)] = math.exp(-0.5 * d @ inverse @ d)
    return out


def logistic(z):
    return 1 / (1 + math.exp(-z))
