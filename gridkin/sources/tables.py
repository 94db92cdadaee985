"""Sets out of relational and text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.functions.text import shingle_cells
from gridkin.operators.filters import spread
from gridkin.operators.overlap import only_ids
from gridkin.operators.ranking import row_index


def document_sets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    n_cells: int | None = None,
    method: str = "xxhash64",
    only: DataFrame | None = None,
) -> DataFrame:
    """Row sets ``(set_id, cells)`` of word shingles over whole texts; no row moves.

    ``only`` names the wanted ids in a stored table ``(set_id)``: other texts are dropped before any
    shingle is made.
    """
    docs = docs.select(id_col, text_col)
    docs = spread(docs if only is None else only_ids(docs, only, id_col))
    cells = shingle_cells(text_col, width, n_cells=n_cells, method=method)
    return docs.select(F.col(id_col).alias("set_id"), cells.alias("cells"))


def basket_rows(df: DataFrame, set_id: Column | str, member: Column | str) -> DataFrame:
    """Rows ``(set_id, cell)`` from two columns of a fact table, repeats included.

    Enough for signatures, where repeats do not matter.
    """
    set_id = F.col(set_id) if isinstance(set_id, str) else set_id
    member = F.col(member) if isinstance(member, str) else member
    return df.select(set_id.alias("set_id"), member.cast("long").alias("cell"))


def basket_sets(df: DataFrame, set_id: Column | str, member: Column | str) -> DataFrame:
    """Long sets ``(set_id, cell)``, deduplicated."""
    return basket_rows(df, set_id, member).distinct()


def with_default_ids(sets: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Number unnamed sets "0", "1", ... in a stated order and call that ``set_id``."""
    return row_index(sets, order_by, "set_id").withColumn("set_id", F.col("set_id").cast("string"))
