"""Names and addresses as column expressions: wells, tiles, fields, image keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def well_10x(path: Column) -> Column:
    """F1: ``.../Well_B2-tile7.tif`` style names: first underscore part of the name, without the word Well."""
    return F.replace(F.element_at(F.split(base_name(path), "_"), 1), F.lit("Well"), F.lit(""))


def tile_10x(path: Column) -> Column:
    """the number behind the last dash."""
    return F.regexp_extract(base_name(path), r"-(?:tile)?(\d+)\.tif$", 1).try_cast("int")


def field_40x(path: Column) -> Column:
    """digits between the first f and max, mean or p; null where there are none."""
    return F.regexp_extract(base_name(path), r"^[^f]*f(\d+)(max|mean|p)", 1).try_cast("int")


def well_code(well: Column) -> Column:
    """A-D and a digit to r01-r04 and c0n; null for other rows."""
    row = F.ascii(F.substring(well, 1, 1)) - 64
    column = F.substring(well, 2, 10).try_cast("int")
    return F.when(row.between(1, 4) & column.isNotNull(), F.format_string("r%02dc%02d", row, column))


def image_key(path: Column) -> Column:
    """projection name to first plane, .tif to .tiff at the end."""
    return F.regexp_replace(F.replace(path, F.lit("max"), F.lit("p01")), r"\.tif$", ".tiff")


def partner_channel(path: Column, own: str = "-ch1", other: str = "-ch2") -> Column:
    """F5."""
    return F.replace(path, F.lit(own), F.lit(other))


def track_id(tile: Column, track: Column) -> Column:
    """F13."""
    return F.concat_ws("_", tile.cast("string"), track.cast("string"))


def export_name(barcode: Column, sublib: Column, intensity: Column, path: Column) -> Column:
    """barcode, sub-library, intensity rounded half to even, path with slashes replaced."""
    return F.concat_ws("_", barcode, sublib, F.bround(intensity, 0).cast("long").cast("string"), F.replace(path, F.lit("/"), F.lit("_")))
