"""Stage coordinates, distances, calibration and binning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres per pixel of the two magnifications.
PIXEL_10X = 0.841792491782224
PIXEL_40X = 0.14949402023919043


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """F9. A square root rather than hypot, whose last bit differs between engines."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def shift_to_stage(site_x: Column, site_y: Column, shift_x: Column, shift_y: Column, size: Column, pixel: float = PIXEL_10X) -> tuple[Column, Column]:
    """the row shift drives y, the column shift drives x."""
    return site_x + shift_y * pixel, site_y + (size - shift_x) * pixel


def centroid_to_stage(origin_x: Column, origin_y: Column, row: Column, col: Column, height: Column, pixel: float = PIXEL_10X) -> tuple[Column, Column]:
    """F7."""
    return origin_x + col * pixel, origin_y + (height - row) * pixel


def field_centroid_to_stage(origin_x: Column, origin_y: Column, shift_x: Column, shift_y: Column, row: Column, col: Column, height_10x: Column, height_40x: Column, pixel_10x: float = PIXEL_10X, pixel_40x: float = PIXEL_40X) -> tuple[Column, Column]:
    """F8: the field's origin on the tile, then the centroid within the field."""
    x = origin_x + shift_y * pixel_10x
    y = origin_y + (height_10x - shift_x) * pixel_10x - height_40x * pixel_40x
    return centroid_to_stage(x, y, row, col, height_40x, pixel_40x)


def calibrated(x: Column, slope: Column, offset: Column) -> Column:
    """unchanged where there are no parameters."""
    return F.when(slope.isNotNull(), slope * (x - offset) + offset).otherwise(x)


def floor_bin(x: Column, size: float) -> Column:
    """F11."""
    return F.floor(x / F.lit(size)) * F.lit(size)


def condensate_fraction(condensate: Column, mean: Column, area: Column) -> Column:
    """null for an empty total."""
    return F.try_divide(condensate, mean * area)


def clean(x: Column) -> Column:
    """NaN becomes null: the library holds one kind of missing value."""
    return F.nanvl(x, F.lit(None).cast("double"))
