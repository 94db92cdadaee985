"""Live view of a folder of run metrics: files are picked up as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.sources.runs import METRICS_SCHEMA


def stream_run_metrics(
    spark: SparkSession, path: str, glob: str = "*_metrics.json", files_per_trigger: int = 100
) -> DataFrame:
    """Unbounded form of ``read_run_metrics``; unreadable files are skipped."""
    return (
        spark.readStream.schema(METRICS_SCHEMA)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def live_standings(runs: DataFrame) -> DataFrame:
    """Best and mean time per method and load level so far (update or complete output mode)."""
    return runs.groupBy("algo", "load_level").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("elapsed_s").alias("best_s"),
        F.avg("mae").alias("mean_mae"),
    )
