"""Count-based windows and halves over an ordered table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.operators.ranking import row_index


def _in_blocks(indexed: DataFrame, size: int, keep: int | None) -> DataFrame:
    number = F.call_function("div", F.col("rn"), F.lit(size).cast("long"))
    out = indexed.withColumn("window_no", number)
    return out if keep is None else out.where(F.col("window_no") < keep)


def count_windows(
    df: DataFrame, order_by: Sequence[Column | str], window_size: int, keep: int | None = None
) -> DataFrame:
    """Add ``window_no``: consecutive blocks of rows, the last one possibly short.

    ``keep`` retains only the first so many windows.
    """
    if window_size < 1:
        raise ValueError("window_size must be positive")
    return _in_blocks(row_index(df, order_by), window_size, keep)


def split_windows(df: DataFrame, order_by: Sequence[Column | str], n_windows: int) -> DataFrame:
    """Exactly ``n_windows`` equal blocks; rows beyond the last full block are left out.

    The block length is the row count divided by the number of windows, rounded down.  The count is
    taken from the stored, sorted rows, so the input runs once.
    """
    indexed = row_index(df, order_by)
    return _in_blocks(indexed, max(indexed.count() // n_windows, 1), n_windows)


def halves(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Add ``half``: 'a' for the first n div 2 rows, 'b' for the rest."""
    indexed = row_index(df, order_by)
    cut = indexed.count() // 2
    return indexed.withColumn("half", F.when(F.col("rn") < cut, F.lit("a")).otherwise(F.lit("b")))
