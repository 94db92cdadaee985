"""Set construction, set algebra and profiles over cell tables ``(set_id, cell)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.functions.grid import bucket, flatten, total_cells


def grid_cells(
    df: DataFrame, set_id: Column | str, coords: Sequence[Column | str], shape: Sequence[int]
) -> DataFrame:
    """Rows to cells: every coordinate folded onto its axis, then flattened.  Not deduplicated."""
    set_id = F.col(set_id) if isinstance(set_id, str) else set_id
    folded = [bucket(c, n) for c, n in zip(coords, shape, strict=True)]
    return df.select(set_id.alias("set_id"), flatten(folded, shape).alias("cell"))


def unique_cells(cells: DataFrame) -> DataFrame:
    """Presence: one row per set and cell (partial aggregation runs before the shuffle)."""
    return cells.select("set_id", "cell").distinct()


def active_cells(cells: DataFrame, value: Column | str = "value") -> DataFrame:
    """Members of weighted cells: weight above zero."""
    value = F.col(value) if isinstance(value, str) else value
    return cells.where(value > 0).select("set_id", "cell")


def exploded(sets: DataFrame) -> DataFrame:
    """Long form of row sets; long sets pass unchanged."""
    if "cells" not in sets.columns:
        return sets.select("set_id", "cell")
    return sets.select("set_id", F.explode("cells").alias("cell"))


def set_sizes(cells: DataFrame) -> DataFrame:
    """Cells per set of a deduplicated table."""
    return cells.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_cells"))


def set_profile(cells: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Active cells, grid size and density of every set."""
    total = total_cells(shape)
    return set_sizes(cells).select(
        "set_id",
        "n_cells",
        F.lit(total).cast("long").alias("total_cells"),
        (F.col("n_cells") / F.lit(total)).alias("density"),
    )


def perturb(cells: DataFrame, add: DataFrame, drop: DataFrame) -> DataFrame:
    """Every set with cells added, then others dropped; repeated rows do not matter, and null drops nothing.

    One aggregate over all three tables, combined in each task; nothing is sorted.
    """
    marked = lambda df, out: df.select("set_id", "cell", F.lit(out).alias("_out"))
    dropped = drop.where(F.col("set_id").isNotNull() & F.col("cell").isNotNull())
    rows = marked(cells, False).unionByName(marked(add, False)).unionByName(marked(dropped, True))
    kept = rows.groupBy("set_id", "cell").agg(F.max("_out").alias("_out"))
    return kept.where(~F.col("_out")).select("set_id", "cell")


CONTENT_KEY = ("n_cells", "h1", "h2")


def with_content_keys(sets: DataFrame) -> DataFrame:
    """Row sets plus their content fingerprint, computed in place."""
    zero = F.lit(0).cast("long")

    def folded(salt: int) -> Column:
        return F.aggregate(
            "cells", zero, lambda acc, c: acc.bitwiseXOR(F.xxhash64(c, F.lit(salt)))
        )

    size = F.size("cells").cast("long")
    return sets.withColumns({"n_cells": size, "h1": folded(1), "h2": folded(2)})


def content_keys(sets: DataFrame) -> DataFrame:
    """``(set_id, n_cells, h1, h2)``: a 128-bit fingerprint of the whole content of each set.

    Exclusive-or of two independent 64-bit hashes over distinct cells, so it aggregates map-side and
    in any order.
    """
    if "cells" in sets.columns:
        return with_content_keys(sets).select("set_id", *CONTENT_KEY)
    h1, h2 = F.xxhash64(F.col("cell"), F.lit(1)), F.xxhash64(F.col("cell"), F.lit(2))
    return (
        unique_cells(sets)
        .groupBy("set_id")
        .agg(
            F.count(F.lit(1)).alias("n_cells"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2")
        )
    )


def copy_groups(keys: DataFrame) -> DataFrame:
    """``(set_id, rep, n_copies)``: sets of equal content under their lowest id.

    One output row per set, however large a group of copies is; the join back only meets one row per
    group on its other side, so a hot group can be split by adaptive execution.
    """
    reps = keys.groupBy(*CONTENT_KEY).agg(
        F.min("set_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")
    )
    return keys.join(reps, list(CONTENT_KEY)).select("set_id", "rep", "n_copies")
