"""Sketch cost over real sets and candidate shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators.cells import set_sizes
from gridkin.operators.sizing import parameter_sizes, sketch_cost


def sketch_sizing(
    cells: DataFrame, shapes: Sequence[Sequence[int]], k: int = 128, rank: int = 4
) -> DataFrame:
    """Total raw and signature bytes of a cell table beside the parameter bytes of each shape.

    ``cells`` is deduplicated.  The few shapes are a literal list, so the sets are read once.
    """
    costs = sketch_cost(set_sizes(cells), k).agg(
        F.count(F.lit(1)).alias("n_sets"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("signature_bytes").alias("signature_bytes"),
    )
    literal = F.array(*[F.array(*[F.lit(int(n)) for n in shape]) for shape in shapes])
    return parameter_sizes(costs.withColumn("shape", F.explode(literal)), k, rank)
