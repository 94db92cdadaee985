"""Banding, candidate pairs and estimates.

Buckets come in two sizes.  An ordinary bucket lists its few members and yields their pairs.  A hot
bucket (more than ``HOT_BUCKET`` members) is never gathered: its members are spread over blocks, every
pair of blocks is compared in its own task-sized group, and only pairs at or above the wanted estimate
leave it.  Both ways are exact, so nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.functions.compare import estimate
from gridkin.operators.shipping import ship
from gridkin.operators.storage import BROADCAST_ROWS, write_and_read

BUCKET = ("band", "key")
HOT_BUCKET = 128
BLOCK = 512
# A division of hot buckets should compare so many planes at once, and may give a set so many keys.
WIDTH, LEAST_WIDTH = 5, 3
MOST_KEYS = 512
# A bucket is worth dividing from so many members per key on: below, comparing all of them costs less.
WORTH = 16
# Planes in a number of a signature's outline, and bits of each.
OUTLINED, OUTLINE_BITS = 16, 4


def even_bands(k: int, bands: int) -> list[tuple[int, int]]:
    """``bands`` runs of k/bands planes as (start, length); the division must be exact."""
    if bands < 1 or k % bands:
        raise ValueError(f"{k} planes do not split into {bands} equal bands")
    rows = k // bands
    return [(b * rows, rows) for b in range(bands)]


def choose_bands(k: int, threshold: float, min_recall: float = 0.0) -> int:
    """Band count whose S-curve midpoint (1/B)^(1/r) lies at or below the threshold.

    Among the exact divisions of k, the fewest bands that do and that find a pair exactly at the threshold
    with a chance of ``min_recall`` or more; k bands if none reaches it.
    """
    for bands in range(1, k + 1):
        if k % bands or (1 / bands) ** (bands / k) > threshold:
            continue
        if expected_recall(k, bands, threshold) >= min_recall:
            return bands
    return k


def expected_recall(k: int, bands: int, similarity: float) -> float:
    """Chance that a pair of this similarity shares at least one band."""
    return 1 - (1 - similarity ** (k // bands)) ** bands


def complete_bands(k: int, threshold: float) -> list[tuple[int, int]]:
    """Bands no qualifying pair can miss.

    A pair at or above the threshold differs in at most ``e`` planes, so among ``e + 1`` disjoint
    bands one is equal throughout.
    """
    misses = k - ceil(threshold * k - 1e-9)
    bands = min(misses + 1, k)
    edges = [k * b // bands for b in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def divisions(k: int, threshold: float) -> list[list[tuple[int, ...]]]:
    """Key sets for dividing a bucket, coarse to fine: each key is the planes that two sets must agree in.

    A qualifying pair differs in at most ``e`` planes, so of ``m`` parts one holds at most ``e // m`` of these:
    with the keys "this part, but for any ``e // m`` planes of it" a pair shares a key in any case.  Fewer parts
    leave out more planes but compare longer ones.  The first division that compares ``WIDTH`` planes is given,
    or the widest within ``MOST_KEYS`` keys, and the next finer one.
    """
    misses = k - ceil(threshold * k - 1e-9)
    found: list[list[tuple[int, ...]]] = []
    for left_out in range(misses + 1):
        parts = min(misses // (left_out + 1) + 1, k)
        edges = [k * p // parts for p in range(parts + 1)]
        sizes = [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)]
        if min(sizes) <= left_out or sum(comb(n, left_out) for n in sizes) > MOST_KEYS:
            break
        keys = [
            kept
            for lo, hi in zip(edges, edges[1:], strict=False)
            for kept in combinations(range(lo, hi), hi - lo - left_out)
        ]
        if found and min(map(len, found[0])) >= WIDTH:
            return [found[0], keys]
        found = [keys]
    # Keys of one or two planes would list too many pairs that do not qualify.
    return [keys for keys in found if min(map(len, keys)) >= LEAST_WIDTH]


def band_slices(sigs: DataFrame, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """``(set_id, band, slice)``: each band's run of signature values."""
    runs = F.array(*[F.slice("sig", lo + 1, n) for lo, n in bands])
    return sigs.select("set_id", F.posexplode(runs).alias("band", "slice"))


def band_keys(
    sigs: DataFrame, bands: Sequence[tuple[int, int]], only: DataFrame | None = None, outlined: int = 0
) -> DataFrame:
    """``(set_id, band, key)`` with the slice folded to a LONG; ``only`` restricts the ids.

    A collision of keys could only add a candidate, which the estimate then rejects.  The outline of the first
    ``outlined`` planes goes along in columns of its own.
    """
    # The hash of a slice is that of its values in turn; no slice is made for it.
    keys = F.array(*[F.xxhash64(*[F.get("sig", F.lit(j)) for j in range(lo, lo + n)]) for lo, n in bands])
    outline = [c.alias(f"o{i}") for i, c in enumerate(_outline(F.col("sig"), outlined))]
    packed = sigs.select("set_id", keys.alias("keys"), *outline)
    if only is not None:
        packed = packed.join(only.select("set_id"), "set_id", "left_semi")
    return packed.select("set_id", *packed.columns[2:], F.posexplode("keys").alias("band", "key"))


def bucket_sizes(keys: DataFrame, bucket: Sequence[str] = BUCKET) -> DataFrame:
    """``(band, key, members)``; shared buckets only."""
    return (
        keys.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > 1)
    )


def bucket_histogram(keys: DataFrame) -> DataFrame:
    """Number of buckets per size: the skew report."""
    return bucket_sizes(keys).groupBy("members").agg(F.count(F.lit(1)).alias("n_buckets"))


def _outline(sig: Column, k: int) -> list[Column]:
    """Numbers that hold four hashed bits of every plane: an eighth of the signature, and equal where it is."""
    step = F.lit((1 << OUTLINE_BITS) - 1).cast("long")

    def packed(lo: int) -> Column:
        planes = range(lo, min(lo + OUTLINED, k))
        bits = [
            F.shiftleft(F.xxhash64(F.get(sig, F.lit(j))).bitwiseAND(step), OUTLINE_BITS * (j - lo)) for j in planes
        ]
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    return [packed(lo) for lo in range(0, k, OUTLINED)]


def _differing(a: Column, b: Column, k: int) -> Column:
    """Planes in which two outlines differ: never more than the signatures do."""
    ones = F.lit(int("1" * OUTLINED, 16)).cast("long")

    def planes(name: str) -> Column:
        odd = a[name].bitwiseXOR(b[name])
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 2))
        return F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(ones))

    return reduce(lambda x, y: x + y, [planes(f"o{i}") for i in range(-(-k // OUTLINED))])


def _listed_pairs(keys: DataFrame, bucket: Sequence[str], screen: tuple[int, int] | None = None) -> DataFrame:
    """Pairs of ordinary buckets; every list holds at most HOT_BUCKET ids.

    With ``screen``, the planes and how many may differ, only pairs whose outlines do not rule that out.
    """
    parts = [F.col("set_id"), *[F.col(c) for c in keys.columns if screen and c.startswith("o")]]
    members = (
        keys.groupBy(*bucket)
        .agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("ids"))
        .where(F.size("ids") > 1)
    )

    def after(a: Column, i: Column) -> Column:
        others = F.slice("ids", i + 2, F.size("ids"))
        if screen:
            others = F.filter(others, lambda b: _differing(a, b, screen[0]) <= screen[1])
        return F.transform(others, lambda b: F.struct(a["set_id"].alias("a"), b["set_id"].alias("b")))

    return members.select(F.inline(F.flatten(F.transform("ids", after))))


def _compare_block(keys: tuple, table: pa.Table, at_least: int) -> pa.Table:
    lo, hi = keys[2].as_py(), keys[3].as_py()
    table = table.combine_chunks()
    ids = table["set_id"].combine_chunks()
    block = table["block"].to_numpy()
    flat = table["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sig = np.ascontiguousarray(flat.reshape(len(block), -1).T)
    left = np.flatnonzero(block == lo)
    right = left if lo == hi else np.flatnonzero(block == hi)
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        same = np.zeros((len(rows), len(right)), np.int32)
        for plane in sig:
            same += plane[rows][:, None] == plane[right][None, :]
        i, j = np.nonzero(same >= at_least)
        i, j = rows[i], right[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        out_a.append(i)
        out_b.append(j)
    first = ids.take(pa.array(np.concatenate(out_a)))
    second = ids.take(pa.array(np.concatenate(out_b)))
    return pa.table({"x": first, "y": second})


def _carried(sigs: DataFrame, *columns: Column | str) -> DataFrame:
    """Signatures as one side of a join, never sent through the driver.

    Stored they take a small part of what they take in memory, so a broadcast chosen by the size of the files may
    exceed the driver.
    """
    return sigs.select(*columns).hint("merge")


def _blocked_pairs(members: DataFrame, sigs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Qualifying pairs of hot buckets ``(band, key, set_id, members)``."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    placed = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks").cast("long")).cast("int"))
        .join(_carried(sigs, "set_id", "sig"), "set_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band",
            "key",
            F.least("block", "other").alias("lo"),
            F.greatest("block", "other").alias("hi"),
            "block",
            "set_id",
            "sig",
        )
    )
    ship(sigs.sparkSession)
    id_type = sigs.schema["set_id"].dataType.simpleString()
    at_least = max(ceil(threshold * k - 1e-9), 0)
    found = placed.groupBy("band", "key", "lo", "hi").applyInArrow(
        lambda keys, table: _compare_block(keys, table, at_least), f"x {id_type}, y {id_type}"
    )
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidate_pairs(
    sigs: DataFrame,
    bands: Sequence[tuple[int, int]],
    k: int,
    only: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``(a, b)``, a < b: every pair that shares a band, whatever the size of its bucket.

    The answer is quadratic in a bucket, so use ``similar_pairs`` where only pairs above a threshold are
    wanted.  ``sigs`` should be stored: it is read more than once.  ``only`` restricts the ids.
    """
    return _sharing_pairs(sigs, bands, k, 0.0, only)


def similar_pairs(
    sigs: DataFrame,
    bands: Sequence[tuple[int, int]],
    k: int,
    threshold: float,
    only: DataFrame | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """``(a, b, est)``, a < b, of the pairs that share a band and whose estimate reaches the threshold.

    The same as ``estimated_pairs`` of ``candidate_pairs``, but pairs of hot buckets that stay below the
    threshold are never written down.  Where the only pairs that count are known, ``among`` has them, distinct: then
    no bucket is listed, and what a pair shares is seen from its two signatures.
    """
    if among is not None:
        named = among.select("a", "b")
        if only is not None:
            for end in ("a", "b"):
                named = named.join(only.select(F.col("set_id").alias(end)), end, "left_semi")
        return estimated_pairs(named.select("a", "b"), sigs, threshold, bands)
    return estimated_pairs(_sharing_pairs(sigs, bands, k, threshold, only), sigs, threshold)


def _sharing_pairs(
    sigs: DataFrame,
    bands: Sequence[tuple[int, int]],
    k: int,
    threshold: float,
    only: DataFrame | None,
    screened: bool = False,
) -> DataFrame:
    """Pairs that share a band; those below the threshold may be missing.

    ``screened`` leaves out the pairs of ordinary buckets whose outlines rule out the threshold.  It is for bands that
    no qualifying pair can miss: with others, rows of a repeated id could be told apart by their band.
    """
    at_most = k - max(ceil(threshold * k - 1e-9), 0)
    keys = band_keys(sigs, bands, only, k if screened else 0)
    found, hot, largest = _split_hot(keys, BUCKET, (k, at_most) if screened else None)
    steps = divisions(k, threshold) if threshold > 0 else []
    while largest:
        bound = WORTH * len(steps[0]) if steps else largest
        found = found.unionByName(_blocked_pairs(hot.where(F.col("members") <= bound), sigs, k, threshold))
        if largest <= bound:
            break
        finer = _finer_keys(hot.where(F.col("members") > bound), sigs, steps.pop(0))
        more, still, crowd = _split_hot(finer, (*BUCKET, "part"))
        found = found.unionByName(more)
        if not crowd:
            break
        # Only sets that still stand in a crowd go on, under the key they came with.
        rest = write_and_read(still.select("set_id", *BUCKET).distinct(), "hot-members")
        sizes = write_and_read(rest.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("members")), "hot-buckets")
        hot, largest = rest.join(sizes, list(BUCKET)), sizes.agg(F.max("members")).first()[0]
    return found.distinct()


def _split_hot(
    keys: DataFrame, bucket: Sequence[str], screen: tuple[int, int] | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """Pairs of the ordinary buckets, the members of the hot ones, and the size of the largest of these or 0."""
    hot = write_and_read(bucket_sizes(keys, bucket).where(F.col("members") > HOT_BUCKET), "hot-buckets")
    seen = hot.agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("largest")).first()
    if seen["n"] == 0:
        return _listed_pairs(keys, bucket, screen), hot, 0
    # Small lists of hot keys go to every task; a long list is joined by shuffle, where adaptive
    # execution may split the hot keys.
    side = F.broadcast(hot) if seen["n"] <= BROADCAST_ROWS else hot
    rest = keys.join(side, list(bucket), "left_anti")
    return _listed_pairs(rest, bucket, screen), keys.join(side, list(bucket)), seen["largest"]


def _finer_keys(hot: DataFrame, sigs: DataFrame, division: Sequence[tuple[int, ...]]) -> DataFrame:
    """``(set_id, band, key, part)``: members of hot buckets under every key of a division.

    Members that only have one frequent slice in common part here, before any comparison.  Keys that collide
    only add pairs, which the estimate then rejects.
    """
    inside = hot.select(*BUCKET, "set_id").join(_carried(sigs, "set_id", "sig"), "set_id")
    parts = F.array(
        *[F.xxhash64(F.lit(i), *[F.get("sig", F.lit(plane)) for plane in kept]) for i, kept in enumerate(division)]
    )
    return inside.select("set_id", *BUCKET, F.explode(parts).alias("part"))


def estimated_pairs(
    pairs: DataFrame,
    sigs: DataFrame,
    threshold: float | None = None,
    bands: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Attach the estimate to ``(a, b, ...)``; with ``bands`` only pairs that share one stay.

    Pairs with an unknown id fall out of the joins; only signatures of equal parameters are compared.
    """
    left = _carried(
        sigs, F.col("set_id").alias("a"), F.col("params_id").alias("_params"), F.col("sig").alias("_sig_a")
    )
    right = _carried(
        sigs, F.col("set_id").alias("b"), F.col("params_id").alias("_other"), F.col("sig").alias("_sig_b")
    )
    both = pairs.join(left, "a").join(right, "b").where(F.col("_params") == F.col("_other"))
    if bands is not None:
        same = [F.slice("_sig_a", lo + 1, n) == F.slice("_sig_b", lo + 1, n) for lo, n in bands]
        both = both.where(reduce(lambda x, y: x | y, same))
    out = both.select(*pairs.columns, estimate("_sig_a", "_sig_b").alias("est"))
    return out if threshold is None else out.where(F.col("est") >= threshold)


def exhaustive_pairs(
    sigs: DataFrame, k: int, threshold: float, only: DataFrame | None = None
) -> DataFrame:
    """Every pair with estimate at or above the threshold, as ``(a, b, est)``.

    Above zero this is a join on bands that no qualifying pair can miss.  At zero every pair
    qualifies by definition: the sets then form one bucket that is compared block by block.
    ``only`` restricts the ids: hand it one id of each group of copies, without the empty sets, which all
    have the same signature.
    """
    if threshold > 0:
        found = _sharing_pairs(sigs, complete_bands(k, threshold), k, threshold, only, screened=True)
        return estimated_pairs(found, sigs, threshold)
    ids = sigs.select("set_id")
    ids = ids if only is None else ids.join(only.select("set_id"), "set_id", "left_semi")
    everything = ids.select(F.lit(0).alias("band"), F.lit(0).cast("long").alias("key"), "set_id")
    everything = everything.withColumn("members", F.lit(ids.count()).cast("long"))
    return estimated_pairs(_blocked_pairs(everything, sigs, k, threshold), sigs, threshold)


def ranked_pairs(pairs: DataFrame, by: str = "est") -> DataFrame:
    """Most similar first, ties in id order."""
    return pairs.orderBy(F.desc(by), "a", "b")


def top_pairs(pairs: DataFrame, n: int = 10, by: str = "est") -> DataFrame:
    """The n most similar pairs (top-k per task, then merged)."""
    return ranked_pairs(pairs, by).limit(n)

