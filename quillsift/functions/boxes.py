"""Box algebra on Columns; a box is four columns x0, y0, x1, y1 under a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def area(a) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def intersection(a, b) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def contains(a, b, slack: float = 5) -> Column:
    return (b[0] >= a[0] - slack) & (b[1] >= a[1] - slack) & (b[2] <= a[2] + slack) & (b[3] <= a[3] + slack)


def merge(a, b) -> tuple[Column, ...]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def clamp(a, width: float, height: float) -> tuple[Column, ...]:
    """Rounded half up and kept inside the frame."""
    up = lambda c: F.floor(c + 0.5).cast("double")
    inside = lambda c, top: F.least(F.greatest(up(c), F.lit(0.0)), F.lit(float(top)))
    return inside(a[0], width), inside(a[1], height), inside(a[2], width), inside(a[3], height)


def expand(a, by: float, width: float | Column, height: float | Column) -> tuple[Column, ...]:
    edge = lambda top: (top if isinstance(top, Column) else F.lit(top)).cast("double")
    low, high = lambda c: F.greatest(c - by, F.lit(0.0)), lambda c, top: F.least(c + by, edge(top))
    return low(a[0]), low(a[1]), high(a[2], width), high(a[3], height)
