"""Strings to set elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridkin.functions.hashing import hashed_cell

DNA = "^[ACGT]+$"


def is_dna(col: Column | str) -> Column:
    """Only the four nucleotide letters."""
    return (F.col(col) if isinstance(col, str) else col).rlike(DNA)


def kmers(seq: Column | str, k: int) -> Column:
    """Distinct overlapping k-letter substrings over ACGT, as an array (short sequences).

    ``substring`` walks from the start of a string, so this costs length squared; long sequences go
    through ``operators.sequences.sequence_kmers``.
    """
    seq = F.col(seq) if isinstance(seq, str) else seq
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - F.lit(k - 1)))
    cut = F.transform(starts, lambda p: F.substring(seq, p, F.lit(k)))
    return F.array_distinct(F.filter(F.coalesce(cut, F.array().cast("array<string>")), is_dna))


def shingle_cells(
    text: Column | str, width: int = 3, *, n_cells: int | None = None, method: str = "md5"
) -> Column:
    """Distinct cell ids of the word ``width``-grams of a whole text, as an array.

    Words are separated by one blank.  A text shorter than ``width`` words has no shingle.
    """
    text = F.col(text) if isinstance(text, str) else text

    def grams(words: Column) -> Column:
        starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - F.lit(width)))
        return F.transform(
            starts,
            lambda i: hashed_cell(
                F.concat_ws(" ", *[F.get(words, i + F.lit(j)) for j in range(width)]),
                n_cells,
                method=method,
            ),
        )

    # The word array is bound as a lambda variable: named directly inside the inner lambda, the
    # split would run again for every shingle.
    bound = F.get(F.transform(F.array(F.split(text, " ")), grams), F.lit(0))
    return F.array_distinct(F.coalesce(bound, F.array().cast("array<bigint>")))
