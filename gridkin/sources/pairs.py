"""Stored set pairs: cell rows by pair and side, with a one-row manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "load_level INT, shape ARRAY<INT>, n_pairs INT, seed INT, "
    "pair_labels ARRAY<STRUCT<a: STRING, b: STRING>>"
)


def write_pairs(cells: DataFrame, path: str) -> None:
    """Store ``(pair_no, side, cell)``, replacing what was there; one directory per side."""
    cells.select("pair_no", "side", "cell").write.mode("overwrite").partitionBy("side").parquet(
        f"{path}/cells"
    )


def write_manifest(
    spark: SparkSession,
    path: str,
    *,
    shape: Sequence[int],
    n_pairs: int,
    labels: Sequence[tuple[str, str]] = (),
    load_level: int = 0,
    seed: int = 42,
) -> None:
    """Store the run's settings as one JSON row."""
    row = (load_level, list(shape), n_pairs, seed, [tuple(pair) for pair in labels])
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(
        f"{path}/manifest"
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(pair_no, cell, side)``; a missing path raises."""
    return spark.read.parquet(f"{path}/cells")


def read_manifest(spark: SparkSession, path: str, *, required: bool = True) -> DataFrame:
    """The manifest row; with ``required=False`` an absent one is an empty table."""
    reader = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True)
    try:
        return reader.json(f"{path}/manifest")
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def pair_labels(manifest: DataFrame) -> DataFrame:
    """``(pair_no, label_a, label_b)`` from the manifest's list."""
    rows = manifest.select(F.posexplode("pair_labels").alias("pair_no", "label"))
    return rows.select(
        F.col("pair_no").cast("long").alias("pair_no"),
        F.col("label.a").alias("label_a"),
        F.col("label.b").alias("label_b"),
    )


def label_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach labels by position; a pair without one is labelled "?"."""
    unknown = F.lit("?")
    return pairs.join(labels, "pair_no", "left").withColumns(
        {c: F.coalesce(c, unknown) for c in ("label_a", "label_b")}
    )
