"""Flow logs to sets: filter, cut into windows or halves, place on the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.operators.cells import grid_cells
from gridkin.operators.filters import frequency_filter
from gridkin.operators.windows import count_windows, halves, split_windows

FLOW_COORDS = ("src_ip", "dst_ip", "port")


def flow_sets(
    flows: DataFrame,
    shape: Sequence[int],
    order_by: Sequence[Column | str],
    *,
    window_size: int | None = None,
    n_windows: int | None = None,
    coords: Sequence[Column | str] = FLOW_COORDS,
    min_port: int | None = 10,
    min_dst: int | None = 100,
) -> DataFrame:
    """Deduplicated cells ``(set_id, cell)`` of count windows, or of two halves by default.

    File order is not an order in a distributed scan, so ``order_by`` must name a total one.
    Windows are named ``w000``, ``w001``, ...; halves ``a`` and ``b``.
    """
    kept = flows
    if min_port is not None and min_dst is not None:
        kept = frequency_filter(flows, min_port=min_port, min_dst=min_dst)
    if window_size is not None:
        placed = count_windows(kept, order_by, window_size)
    elif n_windows is not None:
        placed = split_windows(kept, order_by, n_windows)
    else:
        return grid_cells(halves(kept, order_by), "half", coords, shape).distinct()
    # Three digits at least; longer numbers keep all of theirs.
    number = F.col("window_no").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return grid_cells(placed, F.concat(F.lit("w"), padded), coords, shape).distinct()


def filtered_shape(flows: DataFrame, coords: Sequence[str] = FLOW_COORDS) -> tuple[int, ...]:
    """Distinct values per axis: the grid on which no two values share a bucket by count."""
    row = flows.agg(*[F.count_distinct(F.col(c)).alias(c) for c in coords]).first()
    return tuple(row[c] for c in coords)
