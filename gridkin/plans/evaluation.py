"""Accuracy of estimates on given or sampled pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators.accuracy import accuracy_metrics, sample_pairs, with_combined_scope
from gridkin.operators.banding import estimated_pairs
from gridkin.operators.families import Family
from gridkin.operators.overlap import exact_jaccard, only_ids, pair_ids
from gridkin.operators.signatures import signatures, with_empty_sets
from gridkin.operators.storage import write_and_read


def scored_pairs(
    pairs: DataFrame, sets: DataFrame, families: Sequence[Family], *, narrow: bool = True
) -> DataFrame:
    """``(a, b, ..., method, exact, est)``: one row per pair and hash family.

    The sets are stored once for all families; with ``narrow`` only those a pair names.
    """
    if narrow:
        sets = only_ids(sets, write_and_read(pair_ids(pairs), "pair-ids"))
    sets = write_and_read(sets, "scored-sets")
    exact = write_and_read(
        exact_jaccard(pairs, sets).drop("n_a", "n_b", "inter"), "exact-pairs"
    )
    rows = []
    for family in families:
        sigs = signatures(sets, family)
        if "cells" not in sets.columns:
            sigs = with_empty_sets(sigs, pair_ids(exact), family)
        # Both ends of the pairs read it.
        sigs = write_and_read(sigs, "signatures")
        rows.append(
            estimated_pairs(exact, sigs).withColumn("method", F.lit(family.method))
        )
    return reduce(DataFrame.unionByName, rows)


def evaluate(
    sets: DataFrame,
    families: Sequence[Family],
    *,
    pairs: DataFrame | None = None,
    n_pairs: int = 200,
    seed: int = 0,
) -> DataFrame:
    """Accuracy per scope and method.

    Without ``pairs``, so many are drawn from the sets.  Pairs with a ``scope`` column are reported
    per scope and combined.
    """
    if pairs is None:
        pairs = write_and_read(sample_pairs(sets, n_pairs, seed), "sampled-pairs")
    scoped = "scope" in pairs.columns
    scored = scored_pairs(pairs, sets, families)
    scored = (
        with_combined_scope(scored) if scoped else scored.withColumn("scope", F.lit("combined"))
    )
    return accuracy_metrics(scored)
