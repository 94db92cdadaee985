"""Global positions, ranks and running sums without a single-task window.

Rows are sorted once by range partitioning and stored together with their place (partition, row).
Offsets of whole partitions come from one small aggregate: its size is the number of partitions, not
of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.operators.storage import write_and_read

_ROW_BITS = 33


def _cols(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def _placed(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Globally sorted and stored, with ``_part`` and the row number inside it, ``_row``."""
    place = F.monotonically_increasing_id()
    marked = df.orderBy(*_cols(order_by)).withColumn("_place", place)
    stored = write_and_read(marked, "sorted")
    return stored.select(
        *df.columns,
        F.shiftright("_place", _ROW_BITS).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def _offsets(per_part: DataFrame) -> DataFrame:
    """Running total over partitions: ``(_part, _before)`` from ``(_part, _total)``.

    One row per partition of the sort, so the ordered window here is over a few thousand rows at most.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )


def row_index(df: DataFrame, order_by: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Position of every row, from 0, in a stated total order."""
    placed = _placed(df, order_by)
    totals = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_total"))
    return placed.join(F.broadcast(_offsets(totals)), F.col("_part") == F.col("_p")).select(
        *df.columns, (F.col("_before") + F.col("_row")).alias(name)
    )


def running_total(
    df: DataFrame, order_by: Sequence[Column | str], weight: str, name: str = "before"
) -> DataFrame:
    """Sum of ``weight`` over all earlier rows of a stated total order."""
    placed = _placed(df, order_by)
    totals = placed.groupBy("_part").agg(F.sum(weight).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(F.broadcast(_offsets(totals)), F.col("_part") == F.col("_p")).select(
        *df.columns, (F.col("_before") + F.col("_local")).alias(name)
    )


def average_ranks(
    df: DataFrame, group: Sequence[str], value: str, name: str = "rank", weight: str | None = None
) -> DataFrame:
    """``(group..., value, n, rank)``: ties share the mean of their positions, from 1.

    Works on counted distinct values, so a value or group holding most rows is one pre-aggregated row.
    ``weight`` names the count of rows that are counted already.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(*group, value).agg(n.alias("n"))
    running = running_total(counted, [*group, value], "n", "_seen")
    starts = running.groupBy(*group).agg(F.min("_seen").alias("_start"))
    return running.join(starts, list(group)).select(
        *group, value, "n", (F.col("_seen") - F.col("_start") + (F.col("n") + 1) / 2).alias(name)
    )


def newest_per_group(
    df: DataFrame, group: Sequence[str], order_by: Sequence[Column], keep: int
) -> DataFrame:
    """The first ``keep`` rows of each group; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order_by)
    return (
        df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= keep).drop("_rn")
    )
