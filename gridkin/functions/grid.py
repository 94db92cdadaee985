"""Row-major arithmetic between grid coordinates and flat cell ids (all LONG)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def total_cells(shape: Sequence[int]) -> int:
    """Number of cells of a grid; the flat id of its last cell must fit a LONG."""
    if not shape or any(int(n) < 1 for n in shape):
        raise ValueError(f"shape needs positive axis lengths, got {tuple(shape)}")
    total = prod(int(n) for n in shape)
    if total - 1 > LONG_MAX:
        raise ValueError(f"shape {tuple(shape)} has more cells than a LONG can number")
    return total


def bucket(col: Column | str, n: int) -> Column:
    """Fold a number into ``0..n-1`` (never negative)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.pmod(col.cast("long"), F.lit(n).cast("long"))


def flatten(coords: Sequence[Column | str], shape: Sequence[int]) -> Column:
    """Flat cell id of d coordinates."""
    total_cells(shape)
    if len(coords) != len(shape):
        raise ValueError(f"{len(coords)} coordinates for a {len(shape)}-d grid")
    cols = [(F.col(c) if isinstance(c, str) else c).cast("long") for c in coords]
    return reduce(
        lambda acc, axis: acc * F.lit(int(axis[1])) + axis[0],
        zip(cols[1:], shape[1:], strict=True),
        cols[0],
    )


def unflatten(cell: Column | str, shape: Sequence[int]) -> list[Column]:
    """The d coordinates of a flat cell id, first axis first."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    out = []
    stride = total_cells(shape)
    for n in shape:
        stride //= int(n)
        quotient = F.call_function("div", cell, F.lit(stride).cast("long")) if stride > 1 else cell
        out.append(quotient % F.lit(int(n)))
    return out
