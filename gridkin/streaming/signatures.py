"""Signatures of event-time windows over an unbounded flow of cells.

The minimum per plane is associative and idempotent, so it runs as an ordinary streaming aggregate: state is one
(rank, cell) per open window, set and plane, and the watermark bounds it.  Each task first makes one sketch of
every set and pane it holds, so a set with very many rows reaches the state as a few rows per plane.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators.families import Family
from gridkin.operators.sketches import pane_sketches


def _microseconds(df: DataFrame, duration: str) -> int:
    """Length of a duration of fixed length, such as ``10 minutes``."""
    epoch = df.sparkSession.range(1).select(
        F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {duration}")).alias("n")
    )
    return epoch.first()["n"]


def windowed_minima(
    cells: DataFrame,
    family: Family,
    *,
    window: str = "1 hour",
    slide: str | None = None,
    lateness: str = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """``(window_start, set_id, plane, cell)`` from ``(ts, set_id, cell)``, batch or stream, any family.

    Windows of a slide share panes, the longest spans that no window cuts; a sketch stays inside one pane and
    carries its latest time, so it falls into the same windows as its rows.  Rows later than the watermark are
    dropped by the stream, as usual; within a pane of one batch the latest row decides.
    """
    pane = _microseconds(cells, window)
    if slide:
        pane = gcd(pane, _microseconds(cells, slide))
    at = F.unix_micros(ts)
    rows = cells.select("set_id", F.floor(at / F.lit(pane)).alias("pane"), at.alias("at"), "cell")
    made = pane_sketches(rows, family).withColumn(ts, F.timestamp_micros("at")).withWatermark(ts, lateness)
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    planes = made.select(ts, "set_id", F.posexplode(F.arrays_zip("ranks", "cells")).alias("plane", "b"))
    return (
        planes.groupBy(span.alias("span"), "set_id", "plane")
        .agg(F.min(F.struct(F.col("b.ranks").alias("rank"), F.col("b.cells").alias("cell"))).alias("best"))
        .select(F.col("span.start").alias("window_start"), "set_id", "plane", "best.cell")
    )
