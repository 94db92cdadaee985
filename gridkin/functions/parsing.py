"""Lenient parsing of log fields: what cannot be read becomes 0, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark's own string-to-double cast also takes "1d", "inf" or "nan"; only these forms count here.
_WHOLE = r"^\s*[+-]?[0-9]+([eE][+-]?[0-9]+)?\s*$"
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# How workers print their progress and their result.
PROGRESS = r"PROGRESS:\s*(\d+)/(\d+)"
DONE = r"DONE:.*elapsed=([\d.]+)s.*mae=([\d.]+)"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _guarded(col: Column, pattern: str) -> Column:
    number = F.when(col.rlike(pattern), F.trim(col).try_cast("double"))
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("long"))


def to_int(col: Column | str) -> Column:
    """Number in a string, truncated; anything else is 0."""
    return _guarded(_col(col).cast("string"), _DECIMAL)


def ip_to_int(col: Column | str) -> Column:
    """Dotted address to integer: four parts, a missing or non-numeric part counts 0."""
    parts = F.split(_col(col).cast("string"), r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value + _guarded(F.get(parts, F.lit(i)), _WHOLE) * F.lit(256 ** (3 - i))
    return value


def clean_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Strip blanks around column names, then rename those present."""
    return df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(renames or {})


def _number(line: Column, pattern: str, group: int) -> Column:
    text = F.regexp_extract(line, pattern, group)
    return F.when(text != "", text.try_cast("double"))


def progress_fields(line: Column | str) -> dict[str, Column]:
    """Fields of a worker log line: fraction done, elapsed seconds, error, out-of-memory flag."""
    line = F.coalesce(_col(line), F.lit("-"))
    done = line.rlike(DONE)
    share = _number(line, PROGRESS, 1) / F.greatest(_number(line, PROGRESS, 2), F.lit(1.0))
    return {
        "fraction": F.when(done, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))),
        "elapsed_s": _number(line, DONE, 1),
        "mae": _number(line, DONE, 2),
        "oom": line.contains("OOM:"),
    }
