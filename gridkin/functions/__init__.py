"""Column expressions.  Everything here stays inside Spark SQL built-ins."""

from gridkin.functions.compare import (
    abs_error,
    estimate,
    exact_ratio,
    pair_label,
    shape_label,
    similarity_class,
)
from gridkin.functions.grid import bucket, flatten, total_cells, unflatten
from gridkin.functions.hashing import hashed_cell, poly_hash, premix, uniform
from gridkin.functions.parsing import clean_names, ip_to_int, progress_fields, to_int
from gridkin.functions.text import is_dna, kmers, shingle_cells

__all__ = [
    "abs_error",
    "bucket",
    "clean_names",
    "estimate",
    "exact_ratio",
    "flatten",
    "hashed_cell",
    "ip_to_int",
    "is_dna",
    "kmers",
    "pair_label",
    "poly_hash",
    "premix",
    "progress_fields",
    "shape_label",
    "shingle_cells",
    "similarity_class",
    "to_int",
    "total_cells",
    "unflatten",
    "uniform",
]
