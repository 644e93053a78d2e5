"""Column functions for the image-to-board mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def projected(px: Column, py: Column, h: Column) -> Column:
    """Struct (x, y): the pixel under the 3x3 mapping `h`, null on its horizon."""
    depth = h[6] * px + h[7] * py + h[8]
    safe = F.when(depth != 0.0, depth)
    return F.struct(
        ((h[0] * px + h[1] * py + h[2]) / safe).alias("x"),
        ((h[3] * px + h[4] * py + h[5]) / safe).alias("y"),
    )
