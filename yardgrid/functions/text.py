"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_number(number: Column, width: int = 3) -> Column:
    """Zero-pad on the left; longer numbers stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def play_frame_key(play: Column, frame: Column) -> Column:
    """Play number followed by the three-digit frame number, as one integer."""
    return F.concat(play.cast("string"), pad_number(frame)).cast("bigint")


def height_yards(height: Column) -> Column:
    """``feet-inches`` text in yards; null when a part is missing."""
    parts = F.split(height, "-", 2)
    feet = F.try_element_at(parts, F.lit(1)).try_cast("double")
    inches = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return feet / 3 + inches / 36
