"""The hash functions of Spark ML's MinHash as the library baseline.

The library draws its coefficients from its seed with a public generator; here they make a hash family like the
others, so sets of any size, long ones too, go through the same kernels, and pairs through the same buckets
instead of a join that lists every two rows of a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.feature import MinHashLSH
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.functions.hashing import premix
from gridkin.operators.banding import even_bands, similar_pairs
from gridkin.operators.families import BLOCK_PLANES, ClassicFamily, _ClassicKernel
from gridkin.operators.overlap import exact_jaccard
from gridkin.operators.signatures import signatures
from gridkin.operators.storage import write_and_read
from gridkin.operators.threshold_join import may_reach

# The library's prime, and the steps of the generator that it draws from.
LIBRARY_PRIME = 2038074743
_STEP, _ADD, _STATE = 0x5DEECE66D, 0xB, (1 << 48) - 1


def _drawn(seed: int, bound: int, n: int) -> list[int]:
    """Numbers below ``bound`` as the library's generator gives them; 31 bits each, too high ones drawn again."""
    state, out = (seed ^ _STEP) & _STATE, []
    while len(out) < n:
        state = (state * _STEP + _ADD) & _STATE
        bits = state >> 17
        if bits - bits % bound + bound <= 1 << 31:
            out.append(bits % bound)
    return out


@dataclass(frozen=True)
class LibraryFamily(ClassicFamily):
    """The library's ``((1 + x) a + b) mod prime`` on scattered cell ids, which lie within its index range."""

    method = "library"

    @cached_property
    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        drawn = np.array(_drawn(self.seed, LIBRARY_PRIME - 1, 2 * self.k), np.int64)
        return drawn[0::2] + 1, drawn[1::2]

    def kernel(self, planes: slice = slice(None)):
        a, b = self.coefficients
        return _LibraryKernel(a[planes], b[planes], self.mixed)

    def rank(self, cell: Column, a: Column, b: Column) -> Column:
        x = premix(cell) if self.mixed else cell
        return ((x + 1) * a + b) % F.lit(LIBRARY_PRIME).cast("long")


class _LibraryKernel(_ClassicKernel):
    def ranks(self, cells: np.ndarray) -> np.ndarray:
        if self.mixed:
            cells = self._mix(cells)
        elif len(cells) and int(cells.max()) >= LIBRARY_PRIME:
            raise ValueError("cell id beyond the prime of the library; use mixed=True")
        cells = cells + 1
        out = self._rank[:, : len(cells)]
        for lo in range(0, self.k, BLOCK_PLANES):
            rank = out[lo : lo + BLOCK_PLANES]
            value = self._value[: len(rank), : len(cells)]
            np.multiply(self.a[lo : lo + BLOCK_PLANES, None], cells[None, :], out=value)
            value += self.b[lo : lo + BLOCK_PLANES, None]
            np.remainder(value, LIBRARY_PRIME, out=value)
            np.copyto(rank, value, casting="unsafe")
        return out


def library_hashes(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``(set_id, hashes)`` of the library itself, from 0/1 vectors ``(set_id, features)``, none of them empty."""
    lsh = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=k, seed=seed)
    out = lsh.fit(vectors).transform(vectors)
    return out.select("set_id", F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)).cast("long")).alias("hashes"))


def _alike_in_size(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow the threshold: no similarity is above the ratio of the two sizes.

    One shared hash is far from the threshold, so such pairs go before any set is sent to be compared.
    """
    n = F.size("cells")
    sizes = write_and_read(sets.groupBy("set_id").agg(F.min(n).alias("lo"), F.max(n).alias("hi")), "set-sizes")
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("set_id").alias(end), F.struct("lo", "hi").alias(f"_{end}")), end)
    fits = F.least("_a.hi", "_b.hi") / F.greatest("_a.lo", "_b.lo") >= threshold
    return pairs.where(fits).drop("_a", "_b")


def library_pairs(sets: DataFrame, threshold: float, tables: int = 8, seed: int = 42) -> DataFrame:
    """``(a, b, exact)``, a < b, of the pairs that share one of the library's hashes and reach the threshold.

    Hand it row sets of distinct content without the empty ones.  Pairs that share a hash grow with the square of a
    bucket, so those that can reach the threshold are found first, and of them those that share one.
    """
    family = LibraryFamily(tables, seed)
    sigs = write_and_read(signatures(sets, family), "signatures")
    # An estimate of 1 / tables is one shared hash.
    among = write_and_read(may_reach(sets, threshold, images=False), "near-pairs") if threshold > 0 else None
    found = similar_pairs(sigs, even_bands(tables, tables), tables, 1 / tables, among=among)
    found = write_and_read(_alike_in_size(found, sets, threshold), "library-pairs")
    return exact_jaccard(found.select("a", "b"), sets).where(F.col("exact") >= threshold).select("a", "b", "exact")
