"""Reports over batches of stored pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.compare import abs_error, pair_label
from gridkin.operators.accuracy import error_summary
from gridkin.operators.families import Family
from gridkin.plans.evaluation import scored_pairs
from gridkin.sources.pairs import label_pairs


def _side(pair_no, side):
    return F.concat_ws("|", pair_no.cast("string"), side)


def scored_batch(cells: DataFrame, families: Sequence[Family]) -> DataFrame:
    """``(pair_no, a, b, method, exact, est)`` of every stored pair and hash family, one job for all.

    ``cells`` has ``(pair_no, side, cell)``, sides 'a' and 'b'.
    """
    sets = cells.select(_side(F.col("pair_no"), F.col("side")).alias("set_id"), "cell").distinct()
    pairs = cells.select("pair_no").distinct().select(
        "pair_no",
        _side(F.col("pair_no"), F.lit("a")).alias("a"),
        _side(F.col("pair_no"), F.lit("b")).alias("b"),
    )
    return scored_pairs(pairs, sets, families, narrow=False)


def batch_report(scored: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(pair_no, pair, method, exact, est, error)``, rounded to four digits, halves to even."""
    if labels is None:
        scored = scored.withColumns({"label_a": F.lit("?"), "label_b": F.lit("?")})
    else:
        scored = label_pairs(scored, labels)
    return scored.select(
        "pair_no",
        pair_label("label_a", "label_b").alias("pair"),
        "method",
        F.bround("exact", 4).alias("exact"),
        F.bround("est", 4).alias("est"),
        F.bround(abs_error("est", "exact"), 4).alias("error"),
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """Mean and largest error per method."""
    return error_summary(scored).select(
        "method",
        "n_pairs",
        F.bround("mae", 4).alias("mae"),
        F.bround("max_error", 4).alias("max_error"),
    )
