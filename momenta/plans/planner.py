"""Plan choice: generated sums for few columns, Arrow batches for many, long form for sparse data."""

from __future__ import annotations

#: Columns (without the constant) up to which (w+1)(w+2)/2 generated sums are faster than Arrow batches.
SQL_WIDTH = 12
#: Density under which the long form visits fewer cells than the dense plans save.
SPARSE_DENSITY = 0.05


def choose(width: int, density: float = 1.0) -> str:
    """`sql`, `arrow` or `long`."""
    if width < 1:
        raise ValueError("width must be positive")
    if density < SPARSE_DENSITY and width > SQL_WIDTH:
        return "long"
    return "sql" if width <= SQL_WIDTH else "arrow"
