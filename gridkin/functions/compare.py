"""Similarity, error and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def estimate(sig_a: Column | str, sig_b: Column | str) -> Column:
    """Share of equal positions of two signatures of the same length."""
    a, b = _col(sig_a), _col(sig_b)
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v
    )
    return same / F.size(a)


def exact_ratio(inter: Column | str, size_a: Column | str, size_b: Column | str) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter, size_a, size_b = _col(inter), _col(size_a), _col(size_b)
    union = size_a + size_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def abs_error(est: Column | str, exact: Column | str) -> Column:
    return F.abs(_col(est) - _col(exact))


def similarity_class(value: Column | str) -> Column:
    value = _col(value)
    return F.when(value > 0.5, "HIGH").when(value > 0.2, "MED").otherwise("LOW")


def pair_label(a: Column | str, b: Column | str, arrow: str = "<->") -> Column:
    return F.concat(_col(a).cast("string"), F.lit(arrow), _col(b).cast("string"))


def shape_label(shape: Column | str) -> Column:
    """``10×10×10``."""
    return F.array_join(F.transform(_col(shape), lambda n: n.cast("string")), "×")


def epoch_label(ts: Column | str) -> Column:
    """Epoch seconds as local date and time."""
    return F.from_unixtime(_col(ts), "yyyy-MM-dd HH:mm:ss")
