"""Exact Jaccard similarity by joining on cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.compare import estimate, exact_ratio
from gridkin.operators.cells import exploded, set_sizes
from gridkin.operators.shipping import ship
from gridkin.operators.storage import BROADCAST_ROWS, write_and_read

# Sets of one block, and of one unit of small clusters.
UNIT_SETS = 512
# Cells of a long set with equal bits above these travel as one row.
STRETCH_BITS = 16
_NO_CELLS = np.empty(0, np.int64)


def pair_ids(pairs: DataFrame) -> DataFrame:
    """Distinct ids named by a pair table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
    return ids.distinct()


def only_ids(df: DataFrame, ids: DataFrame, id_col: str = "set_id") -> DataFrame:
    """Rows of a stored list of ids ``(set_id)``.

    A list of at most ``BROADCAST_ROWS`` ids goes to every task and the table stays where it is; a
    longer one is joined by shuffle.
    """
    side = ids.select(F.col("set_id").alias(id_col))
    if ids.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, id_col, "left_semi")


def exact_jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Attach ``n_a, n_b, inter, exact`` to ``(a, b, ...)``.

    ``sets`` holds deduplicated members, as row sets or long; narrow it with ``only_ids`` first when few
    sets occur in pairs.  Row sets are sent once to every unit of pairs they occur in, not once per pair.  Long sets, which may exceed any
    row, meet on (set, stretch of 65,536 possible cells), so one with very many cells or in many pairs spreads over
    its stretches.  A set without cells counts as empty.
    """
    sized = _meet_rows(pairs, sets) if "cells" in sets.columns else _meet_cells(pairs, sets)
    exact = exact_ratio("inter", "n_a", "n_b").alias("exact")
    return sized.select(*pairs.columns, "n_a", "n_b", "inter", exact)


def _exchange_units(pairs: DataFrame) -> DataFrame:
    """Pairs with ``_unit, _x, _y``: a group that sends each of its sets once, and the blocks of its two ends.

    A pair belongs to the least set that its first end is paired with, so the pairs of a cluster of alike sets
    come together.  Small clusters share units; in a large one the sets are dealt to blocks, and a unit is a
    pair of blocks.
    """
    lows = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("_low"))
    placed = write_and_read(
        pairs.join(lows, "a", "left").withColumn("_of", F.coalesce("_low", "a")).drop("_low"), "pair-clusters"
    )
    members = placed.select("_of", F.explode(F.array("a", "b")).alias("set_id")).distinct()
    sizes = write_and_read(members.groupBy("_of").agg(F.count(F.lit(1)).alias("_n")), "cluster-sizes")
    n_sets = sizes.agg(F.sum("_n")).first()[0] or 0
    units = max(-(-n_sets // UNIT_SETS), 1)
    blocks = F.ceil(F.col("_n") / UNIT_SETS).cast("int")
    small = F.col("_n") <= UNIT_SETS
    block = lambda end: F.when(small, 0).otherwise(F.pmod(F.xxhash64(end), blocks).cast("int"))
    unit = F.xxhash64("_of")
    return placed.join(sizes, "_of").select(
        *pairs.columns,
        F.when(small, F.pmod(unit, F.lit(units))).otherwise(unit).alias("_unit"),
        block("a").alias("_x"),
        block("b").alias("_y"),
    )


def _counted(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Sizes and shared cells of the pairs of one unit."""
    row = {key: i for i, key in enumerate(sets["set_id"].to_pylist())}
    lists = sets["cells"].combine_chunks()
    cells = [np.sort(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else _NO_CELLS for x in lists]
    ends = [[row.get(key) for key in pairs[c].to_pylist()] for c in ("a", "b")]
    counts = np.zeros((3, len(pairs)), np.int64)
    for i, (a, b) in enumerate(zip(*ends, strict=True)):
        x, y = (_NO_CELLS if r is None else cells[r] for r in (a, b))
        counts[:2, i] = len(x), len(y)
        if len(x) and len(y):
            few, many = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(many, few)
            counts[2, i] = np.count_nonzero(many[np.minimum(at, len(many) - 1)] == few)
    out = pairs.drop_columns(["_unit", "_x", "_y"])
    for name, values in zip(("n_a", "n_b", "inter"), counts, strict=True):
        out = out.append_column(name, pa.array(values))
    return out


def _meet_rows(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    ship(pairs.sparkSession)
    key = ["_unit", "_x", "_y"]
    units = write_and_read(_exchange_units(pairs), "pair-units")
    to = [f"_to{c}" for c in key]
    ends = F.explode(F.array("a", "b")).alias("set_id")
    wanted = units.select(*[F.col(c).alias(t) for c, t in zip(key, to, strict=True)], ends).distinct()
    sent = wanted.join(sets.select("set_id", "cells"), "set_id")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields]
    schema = ", ".join([*fields, *[f"{c} bigint" for c in ("n_a", "n_b", "inter")]])
    return units.groupBy(*key).cogroup(sent.groupBy(*to)).applyInArrow(_counted, schema)


def _meet_cells(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    stretch = F.shiftright(F.col("cell"), STRETCH_BITS).alias("_at")
    lists = cells.groupBy("set_id", stretch).agg(F.collect_list("cell").alias("_cells"))
    # Read from both ends of the pairs.
    lists = write_and_read(lists, "stretches")
    end = lambda c: lists.select(F.col("set_id").alias(c), "_at", F.col("_cells").alias(f"_cells_{c}"))
    shared = (
        pairs.select("a", "b").join(end("a"), "a").join(end("b"), ["b", "_at"])
        .groupBy("a", "b")
        .agg(F.sum(F.size(F.array_intersect("_cells_a", "_cells_b"))).cast("long").alias("inter"))
    )
    sizes = set_sizes(cells)
    zero = F.lit(0).cast("long")
    return (
        pairs.join(sizes.select(F.col("set_id").alias("a"), F.col("n_cells").alias("n_a")), "a", "left")
        .join(sizes.select(F.col("set_id").alias("b"), F.col("n_cells").alias("n_b")), "b", "left")
        .join(shared, ["a", "b"], "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("n_a", "n_b", "inter")})
    )


def shared_cells(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Intersection and union sizes of pairs."""
    sized = exact_jaccard(pairs, sets)
    return sized.select(
        "a", "b", "inter", (F.col("n_a") + F.col("n_b") - F.col("inter")).alias("union_size")
    )


def anchor_overlap(sets: DataFrame, anchor) -> DataFrame:
    """Exact similarity of one set to all others: ``(set_id, n_cells, inter, exact)``.

    One equi-join on the anchor's cells and one partial aggregate; no pair table is built.  A counted list of at
    most ``BROADCAST_ROWS`` cells goes to every task, so that the others' cells stay where they are.
    """
    cells = exploded(sets)
    own = cells.where(F.col("set_id") == F.lit(anchor)).select("cell", F.lit(1).alias("hit"))
    n_anchor = own.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    own = F.broadcast(own) if n_anchor <= BROADCAST_ROWS else own
    counted = (
        cells.where(F.col("set_id") != F.lit(anchor))
        .join(own, "cell", "left")
        .groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("n_cells"), F.count("hit").alias("inter"))
    )
    return counted.withColumn("exact", exact_ratio("inter", "n_cells", F.lit(n_anchor)))


def anchor_estimate(sigs: DataFrame, anchor) -> DataFrame:
    """Estimated similarity of one set to all others: ``(set_id, est)``.

    The anchor's signature is k numbers; it travels inside the plan as a literal.
    """
    own = sigs.where(F.col("set_id") == F.lit(anchor)).select("sig").first()
    if own is None:
        raise ValueError(f"no signature for {anchor!r}")
    literal = F.array(*[F.lit(int(v)).cast("long") for v in own["sig"]])
    others = sigs.where(F.col("set_id") != F.lit(anchor))
    return others.select("set_id", estimate(literal, "sig").alias("est"))
