"""Arrow-batch argmin over planes: the inner loop of signature building.

What a task has seen of a large set is one row, its least ranks and their cells (`prune`); rows of small sets
pass as they are.  `finish_sorted` merges both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BUFFER_ROWS = 1 << 17
# Cells of row sets that are ranked together.
SLICE_CELLS = 1 << 19
MAX_STATE = 4096
MAX_COUNTS = 1 << 18


def segment_argmin(kernel, starts: np.ndarray, cells: np.ndarray):
    """Least rank and its cell per plane for each run of ``cells``.

    ``starts`` holds the first position of every (non-empty) run; cells ascend within a run, so the
    first minimum is the lowest cell.  Returns two (runs, k) arrays.
    """
    n, runs = len(cells), len(starts)
    worst = np.iinfo(np.int64).max if kernel.rank_type is np.int64 else np.inf
    best = np.full((runs, kernel.k), worst, kernel.rank_type)
    cell = np.zeros((runs, kernel.k), np.int64)
    for lo in range(0, n, kernel.chunk):
        part = cells[lo : lo + kernel.chunk]
        ranks = kernel.ranks(part)
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, lo + len(part), "left"))
        local = np.maximum(starts[first:last] - lo, 0)
        if len(part) >= 32 * len(local):
            ends = np.append(local[1:], len(part))
            at = np.stack(
                [s + ranks[:, s:e].argmin(axis=1) for s, e in zip(local, ends, strict=True)]
            )
            low = ranks[np.arange(kernel.k)[None, :], at]
        else:
            low_t = np.minimum.reduceat(ranks, local, axis=1)
            lengths = np.diff(np.append(local, len(part)))
            hit = ranks == np.repeat(low_t, lengths, axis=1)
            index = np.where(hit, np.arange(len(part))[None, :], len(part))
            at = np.minimum.reduceat(index, local, axis=1).T
            low = low_t.T
        better = low < best[first:last]
        best[first:last][better] = low[better]
        cell[first:last][better] = part[at][better]
    return best, cell


def _codes(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    encoded = ids.dictionary_encode(null_encoding="encode")
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)


def _column(batches: list[pa.RecordBatch], i: int) -> pa.Array:
    return pa.concat_arrays([b.column(i) for b in batches])


def _run_starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


PRUNED = ["set_id", "cell", "best"]


def packed_best(best: np.ndarray, cell: np.ndarray) -> bytes:
    return best.tobytes() + cell.astype(np.int64).tobytes()


def unpacked_best(raw: bytes, rank_type) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.frombuffer(raw[:half], rank_type), np.frombuffer(raw[half:], np.int64)


def keep_lower(best, cell, other_best, other_cell) -> None:
    """Element-wise minimum of (rank, cell), into the first pair."""
    better = (other_best < best) | ((other_best == best) & (other_cell < cell))
    best[better], cell[better] = other_best[better], other_cell[better]


def prune(kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(set_id, cell, best)``: of every large set seen by this task one row with its winners, and no cell.

    A set passes unchanged, cell by cell, until the task has seen 2k cells of it, so output never exceeds input
    and a set with very many rows leaves at most 2k cells and a few rows of winners per task, however thinly it
    is spread over it.
    State for large sets lives until the task ends.  Both the state and the counts are of a bounded number
    of sets; forgetting a count only thins a set later.
    """
    kernel.prepare()
    state: dict = {}
    seen: dict = {}

    def combine(buffer):
        schema = buffer[0].schema
        ids, cells = _column(buffer, 0), _column(buffer, 1).to_numpy(zero_copy_only=False)
        names, codes = _codes(ids)
        keys = names.to_pylist()
        total = np.bincount(codes, minlength=len(keys))
        total += np.fromiter((seen.get(key, 0) for key in keys), np.int64, len(keys))
        if len(seen) > MAX_COUNTS:
            seen.clear()
        seen.update(zip(keys, total.tolist(), strict=True))
        large = total > 2 * kernel.k
        small = ~large[codes]
        if small.any():
            mask = pa.array(small)
            kept = ids.filter(mask)
            yield pa.RecordBatch.from_arrays([kept, pa.array(cells[small]), pa.nulls(len(kept), pa.binary())], names=PRUNED)
        if not large.any():
            return
        codes, cells = codes[~small], cells[~small]
        order = np.lexsort((cells, codes))
        codes, cells = codes[order], cells[order]
        starts = _run_starts(codes)
        best, cell = segment_argmin(kernel, starts, cells)
        for row, code in enumerate(codes[starts]):
            key = keys[int(code)]
            old = state.get(key)
            if old is not None:
                keep_lower(best[row], cell[row], *old)
            state[key] = (best[row].copy(), cell[row].copy())

    def flush(schema):
        if not state:
            return
        best = pa.array([packed_best(*pair) for pair in state.values()], pa.binary())
        ids = pa.array(list(state), schema.field(0).type)
        state.clear()
        yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.int64()), best], names=PRUNED)

    buffer, rows, schema = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        buffer.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            yield from combine(buffer)
            buffer, rows = [], 0
            if len(state) > MAX_STATE:
                yield from flush(schema)
    if buffer:
        yield from combine(buffer)
    if schema is not None:
        yield from flush(schema)


def sketch_rows(kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least ranks and their cells for each (set, pane) of some hundred thousand rows (set_id, pane, at, cell)."""
    kernel.prepare()
    buffer, rows = [], 0
    for batch in batches:
        buffer.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            yield _sketched(kernel, buffer)
            buffer, rows = [], 0
    if rows:
        yield _sketched(kernel, buffer)


def _sketched(kernel, buffer: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids = _column(buffer, 0)
    pane, at, cells = (_column(buffer, i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    _, codes = _codes(ids)
    order = np.lexsort((cells, pane, codes))
    codes, pane, at, cells = codes[order], pane[order], at[order], cells[order]
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (pane[1:] != pane[:-1])])
    best, cell = segment_argmin(kernel, starts, cells)
    edges = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * kernel.k)
    lists = [pa.ListArray.from_arrays(edges, pa.array(x.ravel())) for x in (best.astype(np.float64), cell)]
    heads = ids.take(pa.array(order[starts]))
    latest = pa.array(np.maximum.reduceat(at, starts))
    return pa.RecordBatch.from_arrays(
        [heads, pa.array(pane[starts]), latest, *lists], names=["set_id", "pane", "at", "ranks", "cells"]
    )


def _emit(ids: pa.Array, sig: np.ndarray, schema: pa.Schema, kept=()) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * sig.shape[1])
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(sig).ravel()))
    return pa.RecordBatch.from_arrays([ids, lists, *kept], schema=schema)


def _output_schema(id_type: pa.DataType, kept=()) -> pa.Schema:
    return pa.schema([("set_id", id_type), ("sig", pa.list_(pa.int64())), *kept])


def finish_sorted(kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures from rows ``(set_id, cell, best)`` sorted by the first two."""
    for ids, _, cell in _merged_runs(kernel, batches):
        yield _emit(ids, cell, _output_schema(ids.type))


def finish_sketches(kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches ``(set_id, ranks, cells)`` from the same rows."""
    for ids, best, cell in _merged_runs(kernel, batches):
        edges = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * kernel.k)
        lists = [pa.ListArray.from_arrays(edges, pa.array(x.ravel())) for x in (best.astype(np.float64), cell)]
        yield pa.RecordBatch.from_arrays([ids, *lists], names=["set_id", "ranks", "cells"])


def _merged_runs(kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``(ids, ranks, cells)`` of whole sets from rows ``(set_id, cell, best)`` sorted by the first two.

    Only the open set is held back.  A row has either a cell or winners.
    """
    kernel.prepare()
    open_id = open_best = open_cell = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        _, codes = _codes(ids)
        starts = _run_starts(codes)
        best, cell = _run_winners(kernel, batch, starts)
        heads = ids.take(pa.array(starts))
        if open_id is not None:
            if heads[0].equals(open_id):
                keep_lower(best[0], cell[0], open_best, open_cell)
            else:
                yield pa.array([open_id.as_py()], open_id.type), open_best[None, :], open_cell[None, :]
        if len(starts) > 1:
            yield heads.slice(0, len(starts) - 1), best[:-1], np.ascontiguousarray(cell[:-1])
        open_id, open_best, open_cell = heads[len(starts) - 1], best[-1], cell[-1]
    if open_id is not None:
        yield pa.array([open_id.as_py()], open_id.type), open_best[None, :], open_cell[None, :]


def _run_winners(kernel, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least rank and its cell per plane of each run of rows."""
    single = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    if single.all():
        return segment_argmin(kernel, starts, batch.column(1).to_numpy(zero_copy_only=False))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    worst = np.iinfo(np.int64).max if kernel.rank_type is np.int64 else np.inf
    best = np.full((len(starts), kernel.k), worst, kernel.rank_type)
    cell = np.zeros((len(starts), kernel.k), np.int64)
    if single.any():
        own = run[single]
        firsts = _run_starts(own)
        cells = batch.column(1).drop_null().to_numpy(zero_copy_only=False)
        best[own[firsts]], cell[own[firsts]] = segment_argmin(kernel, firsts, cells)
    for i in np.flatnonzero(~single):
        keep_lower(best[run[i]], cell[run[i]], *unpacked_best(batch.column(2)[int(i)].as_py(), kernel.rank_type))
    return best, cell


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``SLICE_CELLS`` cells at a time or one larger set."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        before = np.cumsum(lengths, dtype=np.int64) - lengths
        edges = np.flatnonzero(np.diff(before // SLICE_CELLS)) + 1
        edges = [0, *edges.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)


def finish_rows(kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures from rows ``(set_id, cells ARRAY, ...)``; an empty set gets all zeros.

    Further columns pass through unchanged.
    """
    kernel.prepare()
    for batch in _slices(batches):
        ids, lists = batch.column(0), batch.column(1)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = lists.flatten().to_numpy(zero_copy_only=False)
        sig = np.zeros((batch.num_rows, kernel.k), np.int64)
        filled = np.flatnonzero(lengths)
        if len(filled):
            starts = np.r_[0, np.cumsum(lengths[filled])[:-1]]
            cells = cells.copy()
            for start, end in zip(starts.tolist(), np.append(starts[1:], len(cells)).tolist(), strict=True):
                cells[start:end].sort()
            sig[filled] = segment_argmin(kernel, starts, cells)[1]
        kept = [batch.schema.field(i) for i in range(2, batch.num_columns)]
        yield _emit(ids, sig, _output_schema(ids.type, kept), batch.columns[2:])
