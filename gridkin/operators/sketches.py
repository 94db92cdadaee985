"""Mergeable sketches: the winning cell of every plane together with its rank.

A signature forgets the ranks, so two signatures cannot be merged.  A sketch keeps them: the sketch of a union is
the element-wise minimum, whatever the order, however often, and wherever the parts were made.  Sketches can be
stored, merged with what arrives later, and shipped instead of the cells they stand for.

A task makes one sketch of each set it sees; merging groups by (set, plane) with map-side combination, so of one
set, however large, a reduce task sees one row for each plane it is given and each task that ran before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators import kernels
from gridkin.operators.cells import exploded
from gridkin.operators.families import Family
from gridkin.operators.shipping import ship
from gridkin.operators.signatures import thinned_rows

_BEST = "ranks array<double>, cells array<bigint>"


def pane_sketches(rows: DataFrame, family: Family) -> DataFrame:
    """``(set_id, pane, at, ranks, cells)`` from ``(set_id, pane LONG, at LONG, cell)``, batch or stream.

    One row for each set and pane that a buffer of a task holds; ``at`` is the latest of its rows.  No shuffle.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(family.kernel())
    kind = rows.schema["set_id"].dataType.simpleString()
    return rows.select("set_id", "pane", "at", "cell").mapInArrow(
        lambda batches: kernels.sketch_rows(shared.value, batches), f"set_id {kind}, pane bigint, at bigint, {_BEST}"
    )


def sketches(sets: DataFrame, family: Family) -> DataFrame:
    """``(set_id, params_id, ranks, cells)`` of long or row sets, one row a set, to be ``merged`` with others.

    Repeated cells do not matter.  An empty set has no row.  A set of which a task holds few cells moves as these
    cells: a sketch for each would be larger than what it stands for.
    """
    ship(sets.sparkSession)
    shared = sets.sparkSession.sparkContext.broadcast(family.kernel())
    kind = sets.schema["set_id"].dataType.simpleString()
    whole = thinned_rows(exploded(sets), shared).mapInArrow(
        lambda batches: kernels.finish_sketches(shared.value, batches), f"set_id {kind}, {_BEST}"
    )
    return whole.select("set_id", F.lit(family.params_id).alias("params_id"), "ranks", "cells")


def merged(parts: DataFrame) -> DataFrame:
    """One sketch per set and parameters; of equal ranks the lower cell wins."""
    planes = parts.select("set_id", "params_id", F.posexplode(F.arrays_zip("ranks", "cells")).alias("plane", "b"))
    best = planes.groupBy("set_id", "params_id", "plane").agg(
        F.min(F.struct(F.col("b.ranks").alias("rank"), F.col("b.cells").alias("cell"))).alias("b")
    )
    # One row per plane.
    whole = best.groupBy("set_id", "params_id").agg(F.array_sort(F.collect_list(F.struct("plane", "b"))).alias("s"))
    return whole.select("set_id", "params_id", F.col("s.b.rank").alias("ranks"), F.col("s.b.cell").alias("cells"))


def sketch_signatures(whole: DataFrame) -> DataFrame:
    """The signatures of merged sketches."""
    return whole.select("set_id", "params_id", F.col("cells").alias("sig"))
