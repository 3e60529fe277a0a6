"""Column expressions on pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(z: Column) -> Column:
    return z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))


def valid(z: Column, nodata: Column | float | None = None) -> Column:
    """Finite, and not the declared nodata value (null: none declared)."""
    if nodata is None:
        return finite(z)
    nodata = nodata if isinstance(nodata, Column) else F.lit(nodata)
    return finite(z) & F.coalesce(z != nodata, F.lit(True))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Correlation from sums; NaN where a side does not vary."""
    vx, vy = xx - x * x / n, yy - y * y / n
    return F.when((vx > 1e-10 * xx) & (vy > 1e-10 * yy), (xy - x * y / n) / F.sqrt(vx * vy)).otherwise(F.lit(float("nan")))
