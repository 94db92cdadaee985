"""The three hash families and their parameters.

A family gives every grid cell one rank per plane; a set's signature holds, per plane, its cell of
least rank.  Parameters are model-sized (planes times the sum of axis lengths at most), never data-sized.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.functions.grid import total_cells, unflatten
from gridkin.functions.hashing import MIX_ADD, MIX_MUL, PRIME, md5_number, premix, uniform

# Parameters beyond this size are broadcast and applied a slice of planes at a time.
BROADCAST_LIMIT = 256 << 20
# Ranks computed at a time (planes x cells), so that working arrays stay near the processor.
CHUNK_RANKS = 1 << 17
# Planes of the classic family whose products are formed together.
BLOCK_PLANES = 16
# Largest table of contracted axis prefixes a worker keeps, in entries.
PREFIX_LIMIT = 1 << 23


def _md5_int(text: str, digits: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def _md5_uniform(*path: int | str) -> float:
    """A multiple of 2**-52 in (0, 1]."""
    return (_md5_int(":".join(map(str, path)), 13) + 1) / (1 << 52)


@dataclass(frozen=True)
class Family:
    """Settings shared by all hash families."""

    k: int = 128
    seed: int = 42

    method = "family"

    @property
    def params_id(self) -> str:
        """Signatures are comparable only under the same id."""
        return f"{self.method}:k={self.k}:seed={self.seed}"

    def nbytes(self) -> int:
        raise NotImplementedError

    def kernel(self, planes: slice = slice(None)):
        """A small picklable object with ``ranks(cells) -> (planes, n)``."""
        raise NotImplementedError


# ---------------------------------------------------------------------------------------------
# classic: (a*x + b) mod p
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClassicFamily(Family):
    """Universal hashing of the flat cell id.

    ``mixed`` scatters the id first and is the default: the plain linear form is biased on runs of
    consecutive cells.  The plain form also needs every cell id below the prime.
    ``source`` picks the coefficients: ``md5`` (portable to SQL) or ``numpy`` (seeded generator).
    """

    mixed: bool = True
    source: str = "md5"
    shape: tuple[int, ...] | None = None

    method = "classic"

    def __post_init__(self):
        if not self.mixed and self.shape is not None and total_cells(self.shape) > PRIME:
            raise ValueError("the linear family needs fewer cells than its prime; use mixed=True")

    @property
    def params_id(self) -> str:
        form = "mixed" if self.mixed else "linear"
        return f"{super().params_id}:{form}:{self.source}"

    def nbytes(self) -> int:
        return 16 * self.k

    @cached_property
    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        if self.source == "numpy":
            rng = np.random.default_rng(self.seed)
            a = rng.integers(1, PRIME, size=self.k, dtype=np.int64)
            return a, rng.integers(0, PRIME, size=self.k, dtype=np.int64)
        a = [_md5_int(f"{self.seed}:a:{j}", 15) % (PRIME - 1) + 1 for j in range(self.k)]
        b = [_md5_int(f"{self.seed}:b:{j}", 15) % PRIME for j in range(self.k)]
        return np.array(a, np.int64), np.array(b, np.int64)

    def kernel(self, planes: slice = slice(None)):
        a, b = self.coefficients
        return _ClassicKernel(a[planes], b[planes], self.mixed)

    def plane_literals(self) -> Column:
        """All planes as one array-of-struct literal ``(plane, a, b)``."""
        a, b = self.coefficients
        return F.array(
            *[
                F.struct(
                    F.lit(j).alias("plane"),
                    F.lit(int(a[j])).cast("long").alias("a"),
                    F.lit(int(b[j])).cast("long").alias("b"),
                )
                for j in range(self.k)
            ]
        )

    def rank(self, cell: Column, a: Column, b: Column) -> Column:
        x = premix(cell) if self.mixed else cell
        return (a * x + b) % F.lit(PRIME).cast("long")


class _Kernel:
    """Shared sizing; ``prepare`` allocates work arrays in the worker, once per task."""

    def __init__(self, k: int):
        self.k = k
        self.chunk = max(256, CHUNK_RANKS // k)

    def _work(self, kind=np.float64) -> np.ndarray:
        return np.empty((self.k, self.chunk), kind)


class _ClassicKernel(_Kernel):
    rank_type = np.int64

    def __init__(self, a: np.ndarray, b: np.ndarray, mixed: bool):
        super().__init__(len(a))
        self.a, self.b, self.mixed = a, b, mixed

    def prepare(self) -> None:
        self._rank = self._work(np.uint32)
        block = (min(BLOCK_PLANES, self.k), self.chunk)
        self._value, self._carry, self._less = (np.empty(block, x) for x in (np.int64, np.int64, np.uint32))

    def _mix(self, cells: np.ndarray) -> np.ndarray:
        high = (cells // PRIME) % PRIME
        x = (cells % PRIME + high * MIX_MUL % PRIME + MIX_ADD) % PRIME
        x2 = x * x % PRIME
        return x2 * x2 % PRIME * x % PRIME

    def ranks(self, cells: np.ndarray) -> np.ndarray:
        if self.mixed:
            cells = self._mix(cells)
        elif len(cells) and int(cells.max()) >= PRIME:
            raise ValueError("cell id beyond the prime of the linear family; use mixed=True")
        elif len(cells) and int(cells.min()) < 0:
            cells = cells % PRIME
        out = self._rank[:, : len(cells)]
        # A few planes at a time, so that the products of a block stay in the processor's cache.
        for lo in range(0, self.k, BLOCK_PLANES):
            rank = out[lo : lo + BLOCK_PLANES]
            value, carry, less = (x[: len(rank), : len(cells)] for x in (self._value, self._carry, self._less))
            np.multiply(self.a[lo : lo + BLOCK_PLANES, None], cells[None, :], out=value)
            value += self.b[lo : lo + BLOCK_PLANES, None]
            # Modulo 2^31-1: the high bits folded once leave less than 2p, from which p is taken where it fits.
            np.right_shift(value, 31, out=carry)
            value &= PRIME
            value += carry
            np.copyto(rank, value, casting="unsafe")
            np.subtract(rank, np.uint32(PRIME), out=less)
            np.minimum(rank, less, out=rank)
        return out


# ---------------------------------------------------------------------------------------------
# additive factored: sum over axes of -ln(U)
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KronFamily(Family):
    """Rank = sum over the axes of one exponential variate per (axis, plane, index)."""

    shape: tuple[int, ...] = (64, 64, 64)
    source: str = "numpy"

    method = "kron"

    @property
    def params_id(self) -> str:
        return f"{super().params_id}:{'x'.join(map(str, self.shape))}:{self.source}"

    def nbytes(self) -> int:
        return 8 * self.k * sum(self.shape)

    @cached_property
    def factors(self) -> list[np.ndarray]:
        """Per axis a (k, length) table."""
        if self.source == "numpy":
            rng = np.random.default_rng([self.seed, len(self.shape)])
            return [rng.standard_exponential((self.k, n)) for n in self.shape]
        return [
            -np.log([[_md5_uniform(self.seed, mode, j, i) for i in range(n)] for j in range(self.k)])
            for mode, n in enumerate(self.shape)
        ]

    def kernel(self, planes: slice = slice(None)):
        return _KronKernel([f[planes] for f in self.factors], self.shape)


class _KronKernel(_Kernel):
    rank_type = np.float64

    def __init__(self, factors: Sequence[np.ndarray], shape: Sequence[int]):
        super().__init__(factors[0].shape[0])
        self.factors, self.shape = list(factors), tuple(shape)

    def prepare(self) -> None:
        self._sum, self._term = self._work(), self._work()

    def ranks(self, cells: np.ndarray) -> np.ndarray:
        total, term = self._sum[:, : len(cells)], self._term[:, : len(cells)]
        axes = np.unravel_index(cells, self.shape)
        for mode, index in enumerate(axes):
            target = total if mode == 0 else term
            np.take(self.factors[mode], index, axis=1, out=target, mode="clip")
            if mode:
                total += term
        return total


def kron_factors(spark: SparkSession, shape: Sequence[int], k: int, seed: int) -> DataFrame:
    """The md5-derived factor table ``(mode, plane, idx, e)``, computed by Spark."""
    modes = F.explode(
        F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("n")) for m, n in enumerate(shape)])
    )
    rows = (
        spark.range(k)
        .select(F.col("id").cast("int").alias("plane"), modes.alias("axis"))
        .select(
            "axis.mode",
            "plane",
            F.explode(F.sequence(F.lit(0), F.col("axis.n") - 1)).alias("idx"),
        )
    )
    u = uniform(F.lit(seed), F.col("mode"), F.col("plane"), F.col("idx"))
    return rows.withColumn("e", -F.ln(u))


def kron_axis_table(spark: SparkSession, family: KronFamily, mode: int) -> DataFrame:
    """``(idx, e ARRAY<DOUBLE>)`` of one axis, planes in order (bounded group of k values)."""
    table = kron_factors(spark, family.shape, family.k, family.seed).where(F.col("mode") == mode)
    packed = F.array_sort(F.collect_list(F.struct("plane", "e")))
    return table.groupBy("idx").agg(F.transform(packed, lambda s: s["e"]).alias("e"))


def classic_planes(spark: SparkSession, k: int, seed: int) -> DataFrame:
    """The md5-derived coefficient table ``(plane, a, b)``, computed by Spark."""
    j = F.col("id").cast("string")
    p = F.lit(PRIME).cast("long")
    a = md5_number(F.concat_ws(":", F.lit(str(seed)), F.lit("a"), j))
    b = md5_number(F.concat_ws(":", F.lit(str(seed)), F.lit("b"), j))
    return spark.range(k).select(
        F.col("id").cast("int").alias("plane"), (a % (p - 1) + 1).alias("a"), (b % p).alias("b")
    )


# ---------------------------------------------------------------------------------------------
# tensor train: product of small matrices along the axes
# ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TTFamily(Family):
    """Rank = chained product of one rank x rank Gaussian matrix per (axis, plane, index).

    ``source`` picks the entries: ``numpy`` (seeded generator) or ``md5`` (portable to SQL).
    """

    shape: tuple[int, ...] = (64, 64, 64)
    rank: int = 4
    source: str = "numpy"

    method = "tt"

    @property
    def params_id(self) -> str:
        return f"{super().params_id}:{'x'.join(map(str, self.shape))}:r={self.rank}:{self.source}"

    def bonds(self) -> list[tuple[int, int]]:
        """Left and right bond size of every core; the outer bonds are 1."""
        d = len(self.shape)
        sizes = [1] + [self.rank] * (d - 1) + [1]
        return list(zip(sizes[:-1], sizes[1:], strict=True))

    def nbytes(self) -> int:
        entries = sum(lo * n * hi for (lo, hi), n in zip(self.bonds(), self.shape, strict=True))
        return 4 * self.k * entries

    @cached_property
    def cores(self) -> list[np.ndarray]:
        """Per axis a (k, left, length, right) float32 stack of standard normal entries.

        A core is divided by the root of its left bond, so that a product of any number of them keeps the
        variance of one entry.
        """
        return [
            (self._normal(mode, (self.k, lo, n, hi)) / np.sqrt(lo)).astype(np.float32)
            for mode, ((lo, hi), n) in enumerate(zip(self.bonds(), self.shape, strict=True))
        ]

    def _normal(self, mode: int, size: tuple[int, ...]) -> np.ndarray:
        if self.source == "numpy":
            return np.random.default_rng([self.seed, self.rank, mode]).standard_normal(size)
        # Box and Muller, from two uniform numbers an entry.
        draws = [
            [_md5_uniform(self.seed, "tt", mode, entry, half) for half in (0, 1)] for entry in range(int(np.prod(size)))
        ]
        u, v = np.array(draws).T
        return (np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)).reshape(size)

    def kernel(self, planes: slice = slice(None)):
        return _TTKernel([c[planes] for c in self.cores], self.shape)


class _TTKernel(_Kernel):
    """Contracts all axes but the last into a prefix vector, then takes a dot product.

    Sums are element-wise and in a fixed order: a cell's rank must not depend on its neighbours in the
    batch, or partial and final winners could disagree.
    """

    rank_type = np.float64

    def __init__(self, cores: Sequence[np.ndarray], shape: Sequence[int]):
        super().__init__(cores[0].shape[0])
        # (left, right, k, length): a gather along the last axis reads contiguous rows.
        self.cores = [np.ascontiguousarray(c.transpose(1, 3, 0, 2), np.float64) for c in cores]
        self.shape = tuple(shape)
        self._prefixes = None

    def prepare(self) -> None:
        self._out, self._left, self._right = self._work(), self._work(), self._work()
        lead = int(np.prod(self.shape[:-1]))
        if len(self.shape) > 1 and self.k * lead * len(self.cores[-1]) <= PREFIX_LIMIT:
            self._prefixes = self._contract(np.arange(lead))

    def _contract(self, prefix: np.ndarray) -> list[np.ndarray]:
        axes = np.unravel_index(prefix, self.shape[:-1])
        left = [np.take(part, axes[0], axis=1) for part in self.cores[0][0]]
        for core, index in zip(self.cores[1:-1], axes[1:], strict=True):
            left = [
                sum(
                    (left[r] * np.take(core[r, s], index, axis=1) for r in range(1, len(left))),
                    left[0] * np.take(core[0, s], index, axis=1),
                )
                for s in range(core.shape[1])
            ]
        return left

    def ranks(self, cells: np.ndarray) -> np.ndarray:
        n = len(cells)
        # Checked here, so that no way of looking cells up can clip or wrap one that lies outside.
        if n and (cells.min() < 0 or cells.max() >= int(np.prod(self.shape))):
            raise ValueError(f"a cell lies outside the grid {'x'.join(map(str, self.shape))}")
        out, left, right = self._out[:, :n], self._left[:, :n], self._right[:, :n]
        last = cells % self.shape[-1]
        if len(self.shape) == 1:
            return np.take(self.cores[0][0, 0], last, axis=1, out=out, mode="clip")
        where = cells // self.shape[-1]
        prefixes = self._prefixes
        if prefixes is None:
            where, position = np.unique(where, return_inverse=True)
            prefixes, where = self._contract(where), position
        for r, tail in enumerate(self.cores[-1][:, 0]):
            term = out if r == 0 else left
            np.take(prefixes[r], where, axis=1, out=term, mode="clip")
            np.take(tail, last, axis=1, out=right, mode="clip")
            term *= right
            if r:
                out += term
        return out


def axis_coordinates(cells: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Add ``i0..i{d-1}`` to a cell table."""
    return cells.withColumns({f"i{m}": c for m, c in enumerate(unflatten("cell", shape))})


def tt_cores(spark: SparkSession, family: TTFamily, mode: int) -> DataFrame:
    """The md5-derived core of one axis, ``(plane, idx, entry, value)``, computed by Spark.

    ``entry`` counts the matrix of an index row by row, left bond first.
    """
    if family.source != "md5":
        raise ValueError("only md5-derived cores have a table form")
    (lo, hi), n = family.bonds()[mode], family.shape[mode]
    number = F.col("id")
    plane, left = F.floor(number / (lo * n * hi)), F.floor(number / (n * hi)) % lo
    index, right = F.floor(number / hi) % n, number % hi
    u, v = (uniform(F.lit(family.seed), F.lit("tt"), F.lit(mode), number, F.lit(half)) for half in (0, 1))
    normal = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v) / F.sqrt(F.lit(float(lo)))
    return spark.range(family.k * lo * n * hi).select(
        plane.cast("int").alias("plane"),
        index.cast("int").alias("idx"),
        (left * hi + right).cast("int").alias("entry"),
        normal.cast("float").cast("double").alias("value"),
    )


def tt_axis_table(spark: SparkSession, family: TTFamily, mode: int) -> DataFrame:
    """``(idx, core ARRAY<ARRAY<DOUBLE>>)`` of one axis: per plane the entries of the index's matrix."""
    matrix = F.transform(F.array_sort(F.collect_list(F.struct("entry", "value"))), lambda s: s["value"])
    planes = tt_cores(spark, family, mode).groupBy("idx", "plane").agg(matrix.alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("plane", "m")))
    return planes.groupBy("idx").agg(F.transform(packed, lambda s: s["m"]).alias("core"))


def contracted(left: Column, core: Column, lo: int, hi: int) -> Column:
    """Row vectors of all planes times the matrices of one axis, summed in the order of the left bond."""

    def times(vector: Column, matrix: Column) -> Column:
        columns = []
        for s in range(hi):
            terms = [F.get(vector, F.lit(r)) * F.get(matrix, F.lit(r * hi + s)) for r in range(lo)]
            total = terms[0]
            for term in terms[1:]:
                total = total + term
            columns.append(total)
        return F.array(*columns)

    return F.zip_with(left, core, times)
