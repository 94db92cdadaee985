"""Nucleotide sequences compared with an anchor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.compare import abs_error, pair_label, similarity_class
from gridkin.operators.families import ClassicFamily, Family, KronFamily, TTFamily
from gridkin.operators.overlap import anchor_estimate, anchor_overlap
from gridkin.operators.sequences import piece_cells, sequence_sets
from gridkin.operators.signatures import signatures, with_empty_sets
from gridkin.operators.storage import write_and_read


def default_families(shape: Sequence[int], k: int = 256, seed: int = 42) -> list[Family]:
    shape = tuple(shape)
    return [KronFamily(k, seed, shape), TTFamily(k, seed, shape), ClassicFamily(k, seed)]


def sequence_similarity(
    sequences: DataFrame,
    anchor,
    *,
    kmer: int = 12,
    shape: Sequence[int] = (64, 64, 64),
    families: Sequence[Family] | None = None,
) -> DataFrame:
    """``(set_id, pair, method, exact, est, error, similarity)`` of every sequence to the anchor.

    ``sequences`` has ``(seq_id, seq)``; one row per sequence and method.
    """
    sets = write_and_read(sequence_sets(sequences, kmer, shape), "sequence-sets")
    return _to_anchor(sets, None, anchor, families or default_families(shape))


def long_sequence_similarity(
    pieces: DataFrame,
    anchor,
    *,
    kmer: int = 12,
    shape: Sequence[int] = (64, 64, 64),
    families: Sequence[Family] | None = None,
) -> DataFrame:
    """The same for sequences of any length, given as pieces ``(seq_id, block, part, seq)``.

    Letters stay where they are: cells are found piece by piece, and what moves are distinct cells.
    """
    key = ["seq_id"]
    sets = piece_cells(pieces, kmer, shape, key).withColumnRenamed("seq_id", "set_id")
    everyone = pieces.select(F.col("seq_id").alias("set_id")).distinct()
    return _to_anchor(
        write_and_read(sets, "sequence-sets"),
        write_and_read(everyone, "sequences"),
        anchor,
        families or default_families(shape),
    )


def _to_anchor(
    sets: DataFrame, everyone: DataFrame | None, anchor, families: Sequence[Family]
) -> DataFrame:
    """``everyone`` names all sets where ``sets`` is long and so leaves out those without a cell."""
    exact = anchor_overlap(sets, anchor).select("set_id", "exact")
    rows = []
    for family in families:
        sigs = signatures(sets, family)
        sigs = write_and_read(sigs if everyone is None else with_empty_sets(sigs, everyone, family), "signatures")
        rows.append(
            anchor_estimate(sigs, anchor).select(
                "set_id", F.lit(family.method).alias("method"), "est"
            )
        )
    estimates = reduce(DataFrame.unionByName, rows)
    # A sequence without any k-mer has an (all-zero) signature but no cell: its overlap is 0.
    joined = estimates.join(exact, "set_id", "left").withColumn(
        "exact", F.coalesce("exact", F.lit(0.0))
    )
    return joined.select(
        "set_id",
        pair_label(F.lit(anchor), "set_id", " ↔ ").alias("pair"),
        "method",
        "exact",
        "est",
        abs_error("est", "exact").alias("error"),
        similarity_class("exact").alias("similarity"),
    )
