"""Frequency filters, counts and deduplication over raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.operators.storage import write_and_read

# Rows of one task that sorts them where they lie.
TASK_ROWS = 500_000


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def keep_frequent(df: DataFrame, col: str, more_than: int) -> DataFrame:
    """Rows whose value of ``col`` occurs in more than so many rows."""
    frequent = value_counts(df, col).where(F.col("n_rows") > more_than).select(col)
    return df.join(frequent, col, "left_semi")


def frequent_values(
    df: DataFrame, *, port: str = "port", dst: str = "dst_ip", min_port: int = 10, min_dst: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Common ports, and destinations common among the rows of these, from one pass over the rows.

    Rows are counted once per (port, destination), stored; both levels are sums of these counts.
    """
    lattice = write_and_read(df.groupBy(port, dst).agg(F.count(F.lit(1)).alias("_n")), "port-dst-counts")

    def common(counts: DataFrame, col: str, more_than: int) -> DataFrame:
        return counts.groupBy(col).agg(F.sum("_n").alias("_n")).where(F.col("_n") > more_than).select(col)

    ports = write_and_read(common(lattice, port, min_port), "common-ports")
    return ports, write_and_read(common(lattice.join(ports, port, "left_semi"), dst, min_dst), "common-dsts")


def frequency_filter(
    df: DataFrame,
    *,
    port: str = "port",
    dst: str = "dst_ip",
    min_port: int = 10,
    min_dst: int = 100,
) -> DataFrame:
    """Common ports first, then destinations common among the rows that are left.

    The rows are read twice, once to count and once to filter.
    """
    ports, dsts = frequent_values(df, port=port, dst=dst, min_port=min_port, min_dst=min_dst)
    return df.join(ports, port, "left_semi").join(dsts, dst, "left_semi")


def frequency_report(
    df: DataFrame,
    cols: Sequence[str] = ("src_ip", "dst_ip", "port"),
    *,
    port: str = "port",
    dst: str = "dst_ip",
    min_port: int = 10,
    min_dst: int = 100,
) -> DataFrame:
    """``filter_report`` of the frequency filter, with the rows read twice for both stages together."""
    ports, dsts = frequent_values(df, port=port, dst=dst, min_port=min_port, min_dst=min_dst)
    wanted = list(dict.fromkeys([*cols, port, dst]))
    marked = (
        df.select(*wanted)
        .join(ports.withColumn("_p", F.lit(True)), port, "left")
        .join(dsts.withColumn("_d", F.lit(True)), dst, "left")
        .withColumn("_kept", F.coalesce(F.col("_p") & F.col("_d"), F.lit(False)))
    )
    both = marked.agg(
        F.count(F.lit(1)).alias("raw_n_rows"),
        F.count_if("_kept").alias("kept_n_rows"),
        *[F.count_distinct(F.col(c)).alias(f"raw_n_{c}") for c in cols],
        *[F.count_distinct(F.when(F.col("_kept"), F.col(c))).alias(f"kept_n_{c}") for c in cols],
    )
    names = ["n_rows", *[f"n_{c}" for c in cols]]
    stage = lambda s: F.struct(F.lit(s).alias("stage"), *[F.col(f"{s}_{n}").alias(n) for n in names])
    return both.select(F.inline(F.array(stage("raw"), stage("kept"))))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: number of rows and of distinct values per column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in cols],
    )


def filter_report(
    raw: DataFrame, kept: DataFrame, cols: Sequence[str] = ("src_ip", "dst_ip", "port")
) -> DataFrame:
    """Distinct counts before and after a filter, one row per stage."""
    stages = [
        distinct_counts(df, cols).select(F.lit(stage).alias("stage"), "*")
        for stage, df in (("raw", raw), ("kept", kept))
    ]
    return stages[0].unionByName(stages[1])


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """Drop duplicate keys, keeping the first row of a stated order (aggregates map-side)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    rest = [c for c in df.columns if c not in keys]
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    first = F.min(F.struct(*named, *rest)).alias("_first")
    return (
        df.groupBy(*keys)
        .agg(first)
        .select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])
    )


def in_small_tasks(df: DataFrame) -> DataFrame:
    """The same rows, dealt so that a task that sorts its own holds about ``TASK_ROWS`` of them; few stay in place.

    A split is cut by the size of its file, which says little of the rows in it.
    """
    tasks = -(-df.count() // TASK_ROWS)
    if tasks <= 1:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(tasks, "_row").drop("_row")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan of few, large splits; a scan already wide enough is left alone."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)
