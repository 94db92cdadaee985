"""Hash expressions that another SQL engine can reproduce digit by digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Mersenne prime of the universal hash family and of the k-mer hash,
# and the three k-mer bases (one per grid axis).
PRIME = 2147483647
KMER_BASES = (31, 37, 41)

# Offset and multiplier of the premix step.
MIX_ADD = 1013904223
MIX_MUL = 1664525


def md5_number(text: Column, hex_digits: int = 15) -> Column:
    """First hex digits of md5 as a non-negative LONG."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def hashed_cell(text: Column | str, n_cells: int | None = None, *, method: str = "md5") -> Column:
    """Cell id of a string: ``md5`` (portable) or ``xxhash64`` (fast), optionally folded to a grid."""
    text = F.col(text) if isinstance(text, str) else text
    if method == "md5":
        value = md5_number(text)
    elif method == "xxhash64":
        value = F.xxhash64(text).bitwiseAND(F.lit((1 << 60) - 1))
    else:
        raise ValueError(f"unknown hash method {method!r}")
    return value if n_cells is None else F.pmod(value, F.lit(n_cells).cast("long"))


def uniform(*parts: Column) -> Column:
    """A double in (0, 1] derived from the md5 of the ``:``-joined parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return (md5_number(text, 13) + F.lit(1)) / F.lit(float(1 << 52))


def gaussian(*parts: Column) -> Column:
    """A standard normal double derived from the parts."""
    u1 = uniform(*parts, F.lit("r"))
    u2 = uniform(*parts, F.lit("a"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def premix(cell: Column | str) -> Column:
    """Scatter a cell id over ``0..PRIME-1`` before the linear family is applied.

    Runs of consecutive ids bias a plain ``a*x+b`` family.  Raising to the fifth power permutes the
    residues of this prime (5 does not divide PRIME-1), breaks linear structure, and needs only
    64-bit arithmetic.  Cells beyond the prime are folded with their quotient first.
    """
    cell = F.col(cell) if isinstance(cell, str) else cell
    p = F.lit(PRIME).cast("long")
    high = F.call_function("div", cell, p) % p
    x = (cell % p + (high * F.lit(MIX_MUL)) % p + F.lit(MIX_ADD)) % p
    x2 = (x * x) % p
    return (((x2 * x2) % p) * x) % p


def poly_hash(text: Column | str, base: int, length: int | None = None) -> Column:
    """Horner polynomial hash of an ASCII string modulo the prime.

    With a known ``length`` the recurrence is unrolled into plain arithmetic (code-generated);
    otherwise a higher-order aggregate walks the characters.
    """
    text = F.col(text) if isinstance(text, str) else text
    p = F.lit(PRIME).cast("long")
    if length is not None:
        h = F.lit(0).cast("long")
        for i in range(1, length + 1):
            h = (h * F.lit(base) + F.ascii(F.substring(text, i, 1))) % p
        return h
    chars = F.filter(F.split(text, ""), lambda c: c != F.lit(""))
    return F.aggregate(
        chars, F.lit(0).cast("long"), lambda h, c: (h * F.lit(base) + F.ascii(c)) % p
    )
