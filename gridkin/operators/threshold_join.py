"""Every pair of row sets that can reach a similarity: an exact join by the first cells of each set.

All cells have one order, common ones last, otherwise by a hash.  Of two sets that reach the threshold, the first
common cell lies in the first ``n - ceil(t n) + 1`` cells of both, so only these are filed, each under itself.
Under a cell two sets meet if their sizes and the place of the cell in both allow the threshold; and only if the cells
before it differ, as sets that share these too have met there.  All three hold at the first common cell of a
qualifying pair, so none is missed.  Those that met then exchange images, a quarter of their cells shortened to 16
bits, which can rule a pair out but not in.

What is common is told by a sketch of counts, which may take a rare cell for a common one: that changes the order, the
same way for all sets, and no result.  Cells are dealt by ranges of their hash.  One that many sets hold is a group of
its own, whose sets are spread over blocks and compared block against block, which is quadratic in the sets that begin
with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.operators.kernels import _slices
from gridkin.operators.overlap import exact_jaccard, only_ids, pair_ids
from gridkin.operators.shipping import ship
from gridkin.operators.storage import write_and_read

# Slots of the sketch as bits, and of how many pieces of it each is a row.
SLOT_BITS, CHUNKS = 20, 64
# A slot is one of common cells if it has so many more than the mean, besides so many deviations of a fair share.
COMMON, DEVIATIONS = 16, 5
# Filed cells in a range of the hash, and the least number of ranges.
RANGE, LEAST_RANGES = 1 << 20, 96
# Sets of a block of a common cell, and pairs looked at together.
BLOCK, PAIRS = 512, 1 << 20
# Bits of a number in the image of a set.
IMAGE_BITS = 16
# Counts the rounding of a product with the threshold cannot reach.
_EPS = 1e-6
_U = np.uint64
_FILED = "part bigint, blocks int, block int, keys binary, prevs binary, ns binary, places binary"


def _spread_bits(cells: np.ndarray) -> np.ndarray:
    """64-bit numbers, a different one for every cell, without the order of the cells."""
    x = cells.astype(np.int64).view(_U)
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _slot(keys: np.ndarray) -> np.ndarray:
    # The last bits, as the first ones place a cell in the order.
    return (keys & _U((1 << SLOT_BITS) - 1)).astype(np.int64)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of a batch and their cells, set after set."""
    lists = batch.column(1)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, lists.flatten().to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.int32)
    for batch in _slices(batches):
        counts += np.bincount(_slot(_spread_bits(_cells(batch)[1])), minlength=len(counts)).astype(np.int32)
    if counts.any():
        chunks = pa.array([x.tobytes() for x in counts.reshape(CHUNKS, -1)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), chunks], names=["chunk", "counts"])


def _summed(key: tuple, table: pa.Table, above: int) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table["counts"].to_pylist())
    at = np.flatnonzero(total > above)
    return pa.table({"slot": at + key[0].as_py() * len(total), "n": total[at]})


def _common_slots(sets: DataFrame, n_cells: int) -> np.ndarray:
    """For every slot the number of its cells where it is one of common cells, else 0; model-sized."""
    mean = n_cells / (1 << SLOT_BITS)
    above = int(mean + DEVIATIONS * mean**0.5) + COMMON
    counted = sets.mapInArrow(_count, "chunk int, counts binary")
    found = counted.groupBy("chunk").applyInArrow(lambda k, t: _summed(k, t, above), "slot bigint, n bigint").toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _file(
    batches: Iterator[pa.RecordBatch], threshold: float, common: np.ndarray, ranges: int
) -> Iterator[pa.RecordBatch]:
    """First cells of sets ``(set_id, cells, hash)``, those of one group and block in a row."""
    for batch in _slices(batches):
        lengths, cells = _cells(batch)
        of = np.repeat(np.arange(len(lengths)), lengths)
        keys = _spread_bits(cells)
        n_common = common[_slot(keys)]
        order = np.lexsort((keys, n_common, of))
        keys, n_common = keys[order], n_common[order]
        place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first = lengths - np.maximum(np.ceil(threshold * lengths - _EPS).astype(np.int64), 1) + 1
        at = np.flatnonzero(place < first[of])
        prev = keys[np.maximum(at - 1, 0)]
        of, place, keys, n_common = of[at], place[at], keys[at], n_common[at]
        blocks = np.maximum(-(-n_common // BLOCK), 1)
        block = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[of] % blocks
        ranged = ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
        # Groups of several blocks have negative numbers; cells that fall together are told apart by their keys.
        part = np.where(blocks > 1, -1 - (keys >> _U(1)).astype(np.int64), ranged)
        order = np.lexsort((of, block, part))
        of, part, block, blocks = of[order], part[order], block[order], blocks[order]
        columns = [keys[order], prev[order], lengths[of].astype(np.int32), place[order].astype(np.int32)]
        edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])]) if len(of) else of
        ends = np.append(edges[1:], len(of))
        raw = [pa.array([x[s:e].tobytes() for s, e in zip(edges, ends, strict=False)], pa.binary()) for x in columns]
        ids = pa.ListArray.from_arrays(np.append(edges, len(of)).astype(np.int32), batch.column(0).take(pa.array(of)))
        named = [pa.array(part[edges]), pa.array(blocks[edges], pa.int32()), pa.array(block[edges], pa.int32())]
        if len(edges):
            yield pa.RecordBatch.from_arrays(
                [*named, *raw, ids], names=["part", "blocks", "block", "keys", "prevs", "ns", "places", "ids"]
            )


def _meet(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """Pairs ``(x, y)`` of one group that may reach the threshold, each once."""
    lo, hi = key[1].as_py(), key[2].as_py()
    joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    keys, prevs = joined("keys", _U), joined("prevs", _U)
    ns, places = joined("ns", np.int32).astype(np.int64), joined("places", np.int32).astype(np.int64)
    ids = pa.chunked_array([x.flatten() for x in table["ids"].chunks], table.schema.field("ids").type.value_type)
    ids = ids.combine_chunks()
    block = np.repeat(table["block"].to_numpy(), table["ids"].combine_chunks().value_lengths().to_numpy())
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    length = np.diff(np.append(starts, len(order)))
    # How many follow each entry under its cell.
    after = np.repeat(starts + length, length) - np.arange(len(order)) - 1
    entry = np.flatnonzero(after)
    edges = np.r_[0, np.cumsum(after[entry])]
    found, at = [], 0
    while at < len(entry):
        end = max(int(np.searchsorted(edges, edges[at] + PAIRS, "right")) - 1, at + 1)
        count = after[entry[at:end]]
        x = np.repeat(entry[at:end], count)
        y = x + 1 + np.arange(len(x)) - np.repeat(edges[at:end] - edges[at], count)
        x, y = order[x], order[y]
        if lo != hi:
            across = block[x] != block[y]
            x, y = x[across], y[across]
        fits = np.minimum(ns[x], ns[y]) >= threshold * np.maximum(ns[x], ns[y]) - _EPS
        # Shared from this place on, it being the first.
        most = np.minimum(ns[x] - places[x], ns[y] - places[y])
        fits &= most * (1 + threshold) >= threshold * (ns[x] + ns[y]) - _EPS
        fits &= (places[x] == 0) | (places[y] == 0) | (prevs[x] != prevs[y])
        found.append(np.stack([x[fits], y[fits]]))
        at = end
    x, y = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    out = pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y)), "total": ns[x] + ns[y]})
    return out.group_by(["x", "y", "total"]).aggregate([])


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets ``(set_id, cells)`` of small numbers: a quarter of all cells, the same for all sets, as 16 bits each."""
    for batch in _slices(batches):
        lengths, cells = _cells(batch)
        keys = _spread_bits(cells)
        sampled = keys >> _U(62 - IMAGE_BITS) & _U(3) == 0
        of = np.repeat(np.arange(len(lengths)), lengths)[sampled]
        short = (keys[sampled] >> _U(20)).astype(np.int64) & ((1 << IMAGE_BITS) - 1)
        found = np.unique(of << IMAGE_BITS | short)
        edges = np.searchsorted(found >> IMAGE_BITS, np.arange(len(lengths) + 1)).astype(np.int32)
        short = (found & ((1 << IMAGE_BITS) - 1)) - (1 << IMAGE_BITS - 1)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(short.astype(np.int16)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["set_id", "cells"])


def _unlike_left_out(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, total)`` whose images do not differ in more than sets of these sizes may.

    Images never differ in more than the sets do, and have a sixteenth of their bytes.
    """
    named = only_ids(sets.select("set_id", "cells"), write_and_read(pair_ids(pairs), "pair-ids"))
    id_type = sets.schema["set_id"].dataType.simpleString()
    images = named.mapInArrow(_images, f"set_id {id_type}, cells array<smallint>")
    differ = F.col("n_a") + F.col("n_b") - 2 * F.col("inter")
    return exact_jaccard(pairs, images).where(differ * (1 + threshold) <= (1 - threshold) * F.col("total") + _EPS)


def may_reach(sets: DataFrame, threshold: float, images: bool = True) -> DataFrame:
    """Distinct ``(a, b)``, a <= b: all pairs of row sets of at least this similarity, and few others.

    ``sets`` holds deduplicated members and is read four times, so it should be stored.  Sets of equal content meet
    like others: hand it one of each.  Empty sets and those without an id have no pair; rows of one id should be of
    equal content.  ``exact_jaccard`` tells which pairs do reach the threshold.  ``images=False`` saves their exchange
    where something else leaves out most pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a join by cells needs a threshold above 0")
    ship(sets.sparkSession)
    sets = sets.where(F.col("set_id").isNotNull() & (F.size("cells") > 0))
    n_cells = sets.agg(F.sum(F.size("cells").cast("long"))).first()[0] or 0
    rows = sets.select("set_id", "cells", F.xxhash64("set_id").alias("hash"))
    common = sets.sparkSession.sparkContext.broadcast(_common_slots(rows, n_cells))
    ranges = max(-(-n_cells // RANGE), LEAST_RANGES)
    id_type = sets.schema["set_id"].dataType.simpleString()
    filed = rows.mapInArrow(
        lambda batches: _file(batches, threshold, common.value, ranges), f"{_FILED}, ids array<{id_type}>"
    )
    placed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
        "keys", "prevs", "ns", "places", "ids",
    )
    met = placed.groupBy("part", "lo", "hi").applyInArrow(
        lambda key, table: _meet(key, table, threshold), f"x {id_type}, y {id_type}, total bigint"
    )
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "total").distinct()
    if not images:
        return met.select("a", "b").distinct()
    return _unlike_left_out(write_and_read(met, "met-pairs"), sets, threshold).select("a", "b").distinct()
