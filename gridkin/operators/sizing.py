"""What a sketch costs, by hash family and grid shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(col: Column) -> Column:
    return col.cast("long")


def parameter_sizes(shapes: DataFrame, k: int = 128, rank: int = 4) -> DataFrame:
    """Parameter counts, bytes and ratios for each row's ``shape ARRAY<INT>``.

    Stored widths differ: 8 bytes for the additive factors, 4 for cores and full matrix.
    """
    zero, one = _long(F.lit(0)), _long(F.lit(1))
    last = F.size("shape") - 1
    cells = F.aggregate("shape", one, lambda acc, n: acc * _long(n))
    axes = F.aggregate("shape", zero, lambda acc, n: acc + _long(n))
    bonds = F.transform(
        "shape",
        lambda n, i: _long(n)
        * F.when(i == 0, one).otherwise(_long(F.lit(rank)))
        * F.when(i == last, one).otherwise(_long(F.lit(rank))),
    )
    cores = F.aggregate(bonds, zero, lambda acc, n: acc + n)
    prefix = F.aggregate(
        F.slice("shape", 1, F.greatest(last, F.lit(1))), one, lambda acc, n: acc * _long(n)
    )
    sized = shapes.select(
        "*",
        cells.alias("total_cells"),
        (axes * k).alias("kron_params"),
        (cores * k).alias("tt_params"),
        (cells * k).alias("full_params"),
        F.when(last > 0, prefix * k * rank).otherwise(zero).alias("tt_prefix_params"),
    )
    floor_div = lambda x, y: F.call_function("div", F.col(x), F.greatest(F.col(y), one))
    ratio = lambda x, y: F.col(x) / F.greatest(F.col(y), one)
    return (
        sized.withColumns(
            {
                "kron_bytes": F.col("kron_params") * 8,
                "tt_bytes": F.col("tt_params") * 4,
                "full_bytes": F.col("full_params") * 4,
                "compression_ratio": floor_div("full_params", "kron_params"),
                "tt_compression_ratio": floor_div("full_params", "tt_params"),
            }
        )
        .withColumns(
            {
                "kron_vs_full": ratio("full_bytes", "kron_bytes"),
                "tt_vs_full": ratio("full_bytes", "tt_bytes"),
                "kron_vs_tt": ratio("tt_bytes", "kron_bytes"),
            }
        )
    )


def sketch_cost(sizes: DataFrame, k: int = 128) -> DataFrame:
    """Raw against signature bytes per set, from ``(set_id, n_cells)``; a cell or value is 8 bytes."""
    raw = F.col("n_cells") * 8
    return sizes.select(
        "set_id",
        "n_cells",
        raw.alias("raw_bytes"),
        F.lit(k * 8).cast("long").alias("signature_bytes"),
        (raw / F.lit(k * 8)).alias("raw_per_signature"),
    )
