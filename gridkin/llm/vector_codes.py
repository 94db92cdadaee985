"""Vector code compression: each part of a vector becomes the number of the nearest entry of a codebook.

Vectors are cut into equal parts; every part position has its own codebook, refined by rounds of nearest entry
and mean, all in integers.

Rows are kept in chunks of bounded size.  Inside a chunk the parts of each position are sorted along a Hilbert
curve and cut into flat blocks, which hold the box of their values and their sum.  In a round the distances from
a box to the entries leave a shortlist: an entry whose least distance to the box is above the greatest distance
of another one is nearest to nothing inside.  A block with one entry left is settled by its sum, without a look
at its rows; the others are compared with their shortlist by an exact integer kernel.

Chunks are built where the rows lie and stored, so nothing is shuffled but sums: at most one per entry and
component from each task.  The driver holds the codebooks, whose size is ``ENTRIES`` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import map_arrow
from gridkin.operators.storage import BROADCAST_ROWS, write_and_read

SCALE = 256.0
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 64
# Components of a chunk, and bits that a Hilbert key has at most.
CHUNK_VALUES = 1 << 19
KEY_BITS = 60
# Integers beyond this are refused: squared distances stay within 64 bits.
LARGEST = 1 << 25
_CHUNK = "rest binary, n int, width int, places binary, flat binary, low binary, high binary, sums binary"


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, vec)`` of the rows that take part; repeated rows each.

    A null vector, and one with a null, NaN or infinite component, takes no part.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    return rows.where(F.col("vec").isNotNull()).where(~bad & (F.size("vec") > 0))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along a Hilbert curve of points with ``bits`` bits in each of their coordinates.

    From the highest bit on: a coordinate with that bit set mirrors the lower bits of the first one, one without
    it swaps them with the first one; Gray decoding and interleaving then give the key.
    """
    x = [points[:, j].astype(np.int64) for j in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for j in range(len(x)):
            up = (x[j] >> level & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[j]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if j:
                x[j] = x[j] ^ swap
    for j in range(1, len(x)):
        x[j] = x[j] ^ x[j - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for xj in x:
            key = key << 1 | (xj ^ turn) >> level & 1
    return key


def _curve_order(part: np.ndarray) -> np.ndarray:
    """Rows of one part in Hilbert order.  Coordinates beyond the key's bits are left out of the key only."""
    part = part[:, :KEY_BITS]
    low, high = part.min(0), part.max(0)
    bits = max(1, min(KEY_BITS // part.shape[1], int(high.max() - low.min() + 1).bit_length()))
    cell = ((part - low) << bits) // (high - low + 1)
    return np.argsort(hilbert_keys(cell, bits), kind="stable")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for some thousand vectors: ids and labels as an Arrow stream, and the blocks of every part."""
    for batch in batches:
        vec = batch["vec"]
        offsets = vec.offsets.to_numpy()
        if len(np.unique(np.diff(offsets))) > 1:
            raise ValueError("vectors of different lengths")
        width = int(offsets[1] - offsets[0]) if len(vec) else 0
        step = max(BLOCK, CHUNK_VALUES // max(width, 1))
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            values = piece["vec"].flatten().to_numpy(zero_copy_only=False)
            values = np.floor(SCALE * values).reshape(piece.num_rows, width)
            if np.abs(values).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            yield _packed(piece.select(["vec_id", "label"]), values.astype(np.int64))


def _packed(rest: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
    n, width = values.shape
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    size = width // PARTS
    starts = np.arange(0, n, BLOCK)
    places, flat, low, high, sums = [], [], [], [], []
    for p in range(PARTS):
        part = values[:, p * size : (p + 1) * size]
        order = _curve_order(part)
        part = part[order]
        places.append(order.astype(np.int32))
        flat.append(part.astype(np.int32))
        low.append(np.minimum.reduceat(part, starts))
        high.append(np.maximum.reduceat(part, starts))
        sums.append(np.add.reduceat(part, starts))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest.schema) as writer:
        writer.write_batch(rest)
    as_bytes = lambda arrays: np.ascontiguousarray(np.stack(arrays)).tobytes()
    arrays = [pa.array([sink.getvalue().to_pybytes()], pa.binary()), *(pa.array([x], pa.int32()) for x in (n, width))]
    arrays += [pa.array([as_bytes(a)], pa.binary()) for a in (places, flat, low, high, sums)]
    return pa.record_batch(arrays, names=["rest", "n", "width", "places", "flat", "low", "high", "sums"])


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Boxes x entries: whether an entry may be nearest to a value inside the box; ties stay."""
    under, over = low[:, None, :] - entries, entries - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
    most = (np.maximum(-under, -over) ** 2).sum(2).min(1, keepdims=True)
    return least <= most


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index of the nearest entry, and the squared distance."""
    apart = np.zeros((len(values), len(entries)), np.int64)
    for j in range(values.shape[1]):
        apart += (values[:, j, None].astype(np.int64) - entries[:, j]) ** 2
    best = apart.argmin(1)
    return best, apart[np.arange(len(values)), best]


def _parts(row: dict, codebooks: np.ndarray) -> Iterator[tuple]:
    """Of each part of a chunk: its number, rows in curve order, their places, sums, shortlists."""
    n, size = row["n"], row["width"] // PARTS
    blocks = -(-n // BLOCK)
    shaped = lambda name, kind, *dims: np.frombuffer(row[name], kind).reshape(PARTS, *dims)
    flat, places = shaped("flat", np.int32, n, size), shaped("places", np.int32, n)
    low, high, sums = (shaped(c, np.int64, blocks, size) for c in ("low", "high", "sums"))
    for p in range(PARTS):
        yield p, flat[p], places[p], sums[p], shortlists(low[p], high[p], codebooks[p])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sums(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sum of the values next to each entry, and their number, over all chunks of a task."""
    total = np.zeros(codebooks.shape, np.int64)
    count = np.zeros(codebooks.shape[:2], np.int64)
    for row in _rows(batches):
        for p, flat, _, sums, may in _parts(row, codebooks):
            alone = may.sum(1) == 1
            only = may.argmax(1)
            sizes = np.minimum(BLOCK, len(flat) - BLOCK * np.arange(len(may)))
            np.add.at(total[p], only[alone], sums[alone])
            np.add.at(count[p], only[alone], sizes[alone])
            for b in np.flatnonzero(~alone):
                values, short = flat[b * BLOCK : (b + 1) * BLOCK], np.flatnonzero(may[b])
                best = short[nearest(values, codebooks[p][short])[0]]
                np.add.at(total[p], best, values)
                np.add.at(count[p], best, 1)
    p, e = np.nonzero(count)
    size = codebooks.shape[2]
    yield pa.record_batch(
        {
            "slot": pa.array(np.repeat(p * codebooks.shape[1] + e, size), pa.int64()),
            "place": pa.array(np.tile(np.arange(size), len(p)), pa.int64()),
            "n": pa.array(np.repeat(count[p, e], size), pa.int64()),
            "total": pa.array(total[p, e].ravel(), pa.int64()),
        }
    )


def _codes(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    for row in _rows(batches):
        n = row["n"]
        code, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
        for p, flat, places, _, may in _parts(row, codebooks):
            for b in range(len(may)):
                inside, short = slice(b * BLOCK, (b + 1) * BLOCK), np.flatnonzero(may[b])
                best, apart = nearest(flat[inside], codebooks[p][short])
                code[places[inside], p] = short[best]
                error[places[inside]] += apart
        text = digits[np.stack([code >> 4, code & 15], 2)].reshape(n, 2 * PARTS)
        ends = pa.py_buffer(np.arange(0, 2 * PARTS * (n + 1), 2 * PARTS, dtype=np.int32).tobytes())
        codes = pa.StringArray.from_buffers(n, ends, pa.py_buffer(text.tobytes()))
        rest = pa.ipc.open_stream(row["rest"]).read_all().to_batches()[0]
        yield pa.record_batch([*rest.columns, codes, pa.array(error)], names=["vec_id", "label", "code", "error"])


def first_codebooks(rows: DataFrame) -> np.ndarray:
    """Parts of the vectors with the least ids, as ``PARTS`` x entries x size.

    Equal ids are taken in the order of their vectors, rows without an id last.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64)
    widths = {len(r["vec"]) for r in first}
    if len(widths) > 1:
        raise ValueError("vectors of different lengths")
    if (width := widths.pop()) % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    values = np.floor(SCALE * np.array([r["vec"] for r in first], np.float64))
    if np.abs(values).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    values = values.astype(np.int64)
    return np.ascontiguousarray(values.reshape(len(first), PARTS, -1).transpose(1, 0, 2))


def stored_chunks(rows: DataFrame) -> DataFrame:
    return write_and_read(map_arrow(rows, _chunks, _CHUNK), "vector-blocks")


def refined(chunks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: every used entry becomes the floor of the mean of what is next to it."""
    partial = map_arrow(chunks, lambda b: _sums(b, codebooks), "slot long, place long, n long, total long")
    # One row per component of an entry.
    found = partial.groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = codebooks.copy()
    for r in found:
        p, e = divmod(r["slot"], codebooks.shape[1])
        out[p, e, r["place"]] = r["total"] // r["n"]
    return out


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, one row per vector that takes part.

    Components are ``floor(256 * x)``.  All vectors need one length that ``PARTS`` divides, and components
    within ``LARGEST``; anything else is refused with an error, as no code would mean anything.  An empty table
    gives no rows.  Repeated rows are vectors each; a null id keeps its code; fewer vectors than entries give
    fewer entries.  Other columns are ignored, whatever their names.
    """
    rows = kept_vectors(vectors, id_col, vec_col, label_col)
    codebooks = first_codebooks(rows)
    chunks = stored_chunks(rows)
    for _ in range(ROUNDS if codebooks.shape[1] else 0):
        codebooks = refined(chunks, codebooks)
    coded = map_arrow(chunks, lambda b: _codes(b, codebooks), "vec_id long, label string, code string, error long")
    coded = write_and_read(coded, "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("said")).agg(F.sum("error").alias("label_error"))
    by_label = write_and_read(by_label, "label-errors")
    if by_label.count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("said"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )
