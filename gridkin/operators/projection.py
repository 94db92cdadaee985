"""Dense random projection of sets and vectors, the uncompressed baseline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.grid import total_cells
from gridkin.functions.hashing import gaussian
from gridkin.operators.cells import exploded
from gridkin.operators.families import BROADCAST_LIMIT

# Size above which the full matrix counts as infeasible, in megabytes of float32.
MATRIX_LIMIT_MB = 500


def matrix_size(n_cells: int, k: int) -> tuple[float, bool]:
    """Megabytes of the full float32 matrix, and whether that is within the limit."""
    megabytes = n_cells * k * 4 / 1_000_000
    return megabytes, megabytes <= MATRIX_LIMIT_MB


def projection_rows(positions: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``(cell, w)`` with k seeded Gaussian weights for every cell of a one-column table."""
    weights = [gaussian(F.lit(seed), F.col("cell"), F.lit(j)) for j in range(k)]
    return positions.select("cell", F.array(*weights).alias("w"))


def column_norms(spark, n_cells: int, k: int, seed: int = 42) -> list:
    """Column lengths over the whole grid: k numbers from one distributed aggregate."""
    cells = spark.range(n_cells).select(F.col("id").alias("cell"))
    squares = [
        F.sqrt(F.sum(F.pow(gaussian(F.lit(seed), F.col("cell"), F.lit(j)), 2))).alias(f"n{j}")
        for j in range(k)
    ]
    return list(cells.agg(*squares).first())


def project_sets(sets: DataFrame, shape: Sequence[int], k: int = 16, seed: int = 42) -> DataFrame:
    """``(set_id, plane, value)``: each set's projection on k normalised Gaussian directions.

    The matrix exists only as rows of the cells in use, made where they are needed.  A grid whose
    full matrix exceeds the limit is refused, as column lengths cover the whole grid.
    """
    n_cells = total_cells(shape)
    megabytes, feasible = matrix_size(n_cells, k)
    if not feasible:
        raise ValueError(f"the full matrix takes {megabytes:.0f} MB, above {MATRIX_LIMIT_MB}")
    cells = exploded(sets)
    norms = column_norms(cells.sparkSession, n_cells, k, seed)
    rows = projection_rows(cells.select("cell").distinct(), k, seed)
    joined = cells.join(rows, "cell")
    sums = [(F.sum(F.get("w", F.lit(j))) / F.lit(norms[j])).alias(f"v{j}") for j in range(k)]
    wide = joined.groupBy("set_id").agg(*sums)
    values = F.array(*[F.col(f"v{j}") for j in range(k)])
    return wide.select("set_id", F.posexplode(values).alias("plane", "value"))


def project_vectors(
    df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 16, seed: int = 42
) -> DataFrame:
    """``(id, plane, value)`` for dense vectors of one length.

    A matrix of broadcast size multiplies each Arrow batch where it lies; a larger one is joined by
    position.  A null vector gives no rows; a null component or another length is an error.  Repeated ids
    are vectors of their own.
    """
    spark = df.sparkSession
    vec = F.col(vector_col)
    fits = (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    wrong = F.raise_error(F.lit(f"{vector_col} must have {dim} components, none of them null"))
    df = df.where(vec.isNotNull()).select(F.col(id_col), F.when(fits, vec).otherwise(wrong).alias(vector_col))
    norms = column_norms(spark, dim, k, seed)
    rows = projection_rows(spark.range(dim).select(F.col("id").alias("cell")), k, seed)
    if dim * k * 8 > BROADCAST_LIMIT:
        numbered = df.withColumn("_vector", F.monotonically_increasing_id())
        entries = numbered.select(F.col(id_col), "_vector", F.posexplode(vector_col).alias("cell", "x"))
        joined = entries.join(rows, "cell")
        sums = [
            (F.sum(F.col("x") * F.get("w", F.lit(j))) / F.lit(norms[j])).alias(f"v{j}")
            for j in range(k)
        ]
        wide = joined.groupBy("_vector", id_col).agg(*sums)
        values = F.array(*[F.col(f"v{j}") for j in range(k)])
        return wide.select(id_col, F.posexplode(values).alias("plane", "value"))

    matrix = np.empty((dim, k))
    for row in rows.toLocalIterator():
        matrix[row["cell"]] = row["w"]
    shared = spark.sparkContext.broadcast(matrix / np.array(norms))

    def multiply(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            values = flat.reshape(-1, dim) @ shared.value
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * k)
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "values"])

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, vector_col).mapInArrow(multiply, f"{id_col} {id_type}, values array<double>")
    return out.select(id_col, F.posexplode("values").alias("plane", "value"))


def projection_feasibility(shapes: DataFrame, k: int) -> DataFrame:
    """Matrix size and feasibility of candidate shapes ``(shape ARRAY<INT>)``."""
    one = F.lit(1).cast("long")
    flat = F.aggregate("shape", one, lambda acc, n: acc * n.cast("long"))
    size = flat * F.lit(k) * F.lit(4) / F.lit(1_000_000)
    return shapes.select(
        "*",
        flat.alias("flat_dim"),
        size.alias("theoretical_mb"),
        (size <= F.lit(MATRIX_LIMIT_MB)).alias("feasible"),
    )
