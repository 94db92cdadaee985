"""Signature building: sets in, one k-long array of winning cells per set out."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators import kernels
from gridkin.operators.families import (
    BROADCAST_LIMIT,
    ClassicFamily,
    Family,
    KronFamily,
    TTFamily,
    axis_coordinates,
    contracted,
    kron_axis_table,
    tt_axis_table,
)
from gridkin.operators.shipping import ship


def _id_type(df: DataFrame) -> str:
    return df.schema["set_id"].dataType.simpleString()


def signatures(sets: DataFrame, family: Family, keep: Sequence[str] = ()) -> DataFrame:
    """``(set_id, params_id, sig)`` for long sets ``(set_id, cell)`` or row sets ``(set_id, cells)``.

    Row sets never move.  Long sets move once, after each task has reduced its large sets to one row of
    winners; duplicates do not matter, so no distinct is needed before.  Parameters beyond the
    broadcast limit are applied a slice of planes at a time.  ``keep`` names further columns of row
    sets that pass through.
    """
    slices = -(-family.nbytes() // BROADCAST_LIMIT)
    width = -(-family.k // min(slices, family.k))
    planes = [slice(lo, lo + width) for lo in range(0, family.k, width)]
    if "cells" in sets.columns:
        out = _row_signatures(sets, family, planes, list(keep))
    else:
        # Long sets come out with one row per set_id, so the slices join one to one.
        out, *parts = [_plane_slice(sets, family, part, keep) for part in planes]
        for part in parts:
            more = part.withColumnRenamed("sig", "more")
            out = out.join(more, "set_id").select("set_id", F.concat("sig", "more").alias("sig"))
    return out.select("set_id", F.lit(family.params_id).alias("params_id"), "sig", *keep)


def _row_signatures(
    sets: DataFrame, family: Family, planes: Sequence[slice], keep: list[str]
) -> DataFrame:
    """Row sets pass slice after slice where they lie, so repeated ids stay rows of their own."""
    out, done = sets, []
    for i, part in enumerate(planes):
        last = i == len(planes) - 1
        carried = [*keep, *done] + ([] if last else ["_cells"])
        out = out if last else out.withColumn("_cells", F.col("cells"))
        out = _plane_slice(out, family, part, carried).withColumnRenamed("sig", f"_sig{i}")
        out = out.withColumnRenamed("_cells", "cells")
        done.append(f"_sig{i}")
    return out.select("set_id", F.concat(*done).alias("sig"), *keep)


def _plane_slice(
    sets: DataFrame, family: Family, planes: slice, keep: Sequence[str]
) -> DataFrame:
    ship(sets.sparkSession)
    shared = sets.sparkSession.sparkContext.broadcast(family.kernel(planes))
    schema = f"set_id {_id_type(sets)}, sig array<bigint>"
    if "cells" in sets.columns:
        kept = [f"{c} {sets.schema[c].dataType.simpleString()}" for c in keep]
        return sets.select("set_id", "cells", *keep).mapInArrow(
            lambda batches: kernels.finish_rows(shared.value, batches), ", ".join([schema, *kept])
        )
    if keep:
        raise ValueError("only row sets can carry further columns")
    return thinned_rows(sets, shared).mapInArrow(lambda batches: kernels.finish_sorted(shared.value, batches), schema)


def thinned_rows(sets: DataFrame, shared) -> DataFrame:
    """Rows ``(set_id, cell, best)`` of long sets, moved once, each set's side by side; ``shared`` is the kernel."""
    thinned = sets.select("set_id", "cell").mapInArrow(
        lambda batches: kernels.prune(shared.value, batches),
        f"set_id {_id_type(sets)}, cell bigint, best binary",
    )
    return thinned.repartition("set_id").sortWithinPartitions("set_id", "cell")


def _gather_planes(best: DataFrame, family: Family) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("plane", "cell")))
    return (
        best.groupBy("set_id")
        .agg(F.transform(packed, lambda s: s["cell"]).alias("sig"))
        .select("set_id", F.lit(family.params_id).alias("params_id"), "sig")
    )


def signatures_by_join(cells: DataFrame, family: Family) -> DataFrame:
    """The same signatures from built-in expressions and joins only.

    Needs no broadcast and no Python, at the price of one row per cell and plane before the
    map-side aggregate.  Covers the classic family and the md5-derived factored ones.
    """
    return _gather_planes(plane_minima(cells, family), family)


def plane_minima(cells: DataFrame, family: Family) -> DataFrame:
    """``(set_id, plane, rank, cell)``: the winning cell of every plane, built-ins only."""
    if isinstance(family, ClassicFamily):
        return _integral_minima(cells, family)
    best = F.min(F.struct("rank", "cell")).alias("best")
    return (
        plane_ranks(cells, family)
        .groupBy("set_id", "plane")
        .agg(best)
        .select("set_id", "plane", "best.rank", "best.cell")
    )


def _integral_minima(cells: DataFrame, family: ClassicFamily) -> DataFrame:
    """Winners of whole-number ranks: rank and cell side by side in one decimal, whose minimum is kept in place.

    A minimum of structs would sort a row per cell and plane; here all planes of a set are one row of each task.
    A set that holds a null cell has null winners, as null comes before all others.
    """
    step, half = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 63))
    a, b = family.coefficients
    cell = F.col("cell").cast("long")

    def packed(j: int):
        rank = family.rank(cell, F.lit(int(a[j])).cast("long"), F.lit(int(b[j])).cast("long"))
        return rank.cast("decimal(10,0)") * step + cell.cast("decimal(19,0)")

    best = cells.groupBy("set_id").agg(
        F.bool_or(F.col("cell").isNull()).alias("_null"), *[F.min(packed(j)).alias(f"_{j}") for j in range(family.k)]
    )
    planes = F.array(*[F.when(~F.col("_null"), F.col(f"_{j}")) for j in range(family.k)])
    best = best.select("set_id", F.posexplode(planes).alias("plane", "best"))
    won = F.pmod(F.col("best") + half, step) - half
    return best.select(
        "set_id",
        "plane",
        F.call_function("div", F.col("best") - won, step).alias("rank"),
        won.cast(cells.schema["cell"].dataType).alias("cell"),
    )


def plane_ranks(cells: DataFrame, family: Family) -> DataFrame:
    """``(set_id, cell, plane, rank)`` of every cell under every plane."""
    if isinstance(family, ClassicFamily):
        planes = cells.select("set_id", "cell", F.explode(family.plane_literals()).alias("p"))
        rank = family.rank(F.col("cell"), F.col("p.a"), F.col("p.b"))
        return planes.select("set_id", "cell", "p.plane", rank.alias("rank"))
    if isinstance(family, KronFamily) and family.source == "md5":
        rows = axis_coordinates(cells.select("set_id", "cell"), family.shape)
        total = None
        for mode in range(len(family.shape)):
            table = kron_axis_table(cells.sparkSession, family, mode).select(
                F.col("idx").cast("long").alias(f"i{mode}"), F.col("e").alias(f"e{mode}")
            )
            rows = rows.join(table, f"i{mode}")
            term = F.col(f"e{mode}")
            total = term if total is None else F.zip_with(total, term, lambda x, y: x + y)
        return rows.select("set_id", "cell", F.posexplode(total).alias("plane", "rank"))
    if isinstance(family, TTFamily) and family.source == "md5":
        # One join and one vector times matrix per axis; the vector of a cell has the bond's length.
        rows = axis_coordinates(cells.select("set_id", "cell"), family.shape)
        for mode, (lo, hi) in enumerate(family.bonds()):
            table = tt_axis_table(cells.sparkSession, family, mode).select(
                F.col("idx").cast("long").alias(f"i{mode}"), "core"
            )
            rows = rows.join(table, f"i{mode}")
            step = contracted(F.col("v"), F.col("core"), lo, hi) if mode else F.col("core")
            rows = rows.withColumn("v", step).drop("core", f"i{mode}")
        return rows.select("set_id", "cell", F.posexplode(F.transform("v", lambda x: F.get(x, F.lit(0)))).alias("plane", "rank"))
    raise ValueError(f"{family.params_id} has no table form; use signatures()")


def with_empty_sets(sigs: DataFrame, all_sets: DataFrame, family: Family) -> DataFrame:
    """Give the sets of a list that have no cell the all-zero signature."""
    zeros = F.array_repeat(F.lit(0).cast("long"), family.k)
    return (
        all_sets.select("set_id")
        .distinct()
        .join(sigs, "set_id", "left")
        .select(
            "set_id",
            F.lit(family.params_id).alias("params_id"),
            F.coalesce("sig", zeros).alias("sig"),
        )
    )
