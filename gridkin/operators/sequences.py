"""k-mers of nucleotide sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.functions.grid import flatten
from gridkin.functions.hashing import KMER_BASES, PRIME, poly_hash
from gridkin.functions.text import kmers
from gridkin.operators.shipping import ship
from gridkin.operators.storage import BROADCAST_ROWS, write_and_read

# Cells of sequences that are handed on together.
SLICE_CELLS = 1 << 19


def kmer_table(sequences: DataFrame, k: int = 12) -> DataFrame:
    """``(seq_id, kmer)`` distinct per sequence, built-ins only (short sequences)."""
    return sequences.select("seq_id", F.explode(kmers("seq", k)).alias("kmer"))


def kmer_cell(kmer: Column | str, k: int, shape: Sequence[int]) -> Column:
    """Grid cell of a k-mer: one polynomial hash per axis."""
    axes = [poly_hash(kmer, base, k) % F.lit(n) for base, n in zip(KMER_BASES, shape, strict=True)]
    return flatten(axes, shape)


def _grid(shape: Sequence[int]) -> tuple[int, ...]:
    if len(shape) != len(KMER_BASES):
        raise ValueError(f"k-mer grids have {len(KMER_BASES)} axes")
    return tuple(int(n) for n in shape)


def _windows(text: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the length-k runs over ACGT."""
    good = np.isin(text, np.frombuffer(b"ACGT", np.uint8))
    seen = np.concatenate([[0], np.cumsum(good)])
    return np.flatnonzero(seen[k:] - seen[:-k] == k) if len(text) >= k else np.empty(0, np.int64)


def _folded(value: np.ndarray) -> np.ndarray:
    """Remainders modulo 2^31-1 of numbers below 2^62 + 2^31, in place, by folding the high bits twice."""
    for _ in range(2):
        high = value >> 31
        value &= PRIME
        value += high
    value[value == PRIME] = 0
    return value


def _window_hashes(letters: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of every k letters in a row: runs of 1, 2, 4, ... letters are put together."""
    run, size, out, done = letters, 1, None, 0
    while True:
        if k & size:
            # What is done lies before the run.
            if out is None:
                out = run
            else:
                n = len(letters) - done - size + 1
                out = _folded(out[:n] * pow(base, size, PRIME) + run[done : done + n])
            done += size
        if done == k:
            return out
        n = len(letters) - 2 * size + 1
        run = _folded(run[:n] * pow(base, size, PRIME) + run[size : size + n])
        size *= 2


def _cells_of(text: np.ndarray, k: int, shape: Sequence[int]) -> np.ndarray:
    starts = _windows(text, k)
    if not len(starts):
        return np.empty(0, np.int64)
    letters = text.astype(np.int64)
    cell = np.zeros(len(starts), np.int64)
    for base, n in zip(KMER_BASES, shape, strict=True):
        cell = cell * n + _window_hashes(letters, k, base)[starts] % n
    return np.unique(cell)


def sequence_sets(
    sequences: DataFrame, k: int = 12, shape: Sequence[int] = (64, 64, 64)
) -> DataFrame:
    """Row sets ``(set_id, cells, n_letters)`` of whole sequences.

    All windows of a sequence are hashed together over its bytes, one pass per k-mer position, so the
    work is linear in its length.  Letters outside ACGT (also multi-byte ones) break windows.
    """
    ship(sequences.sparkSession)
    id_type = sequences.schema["seq_id"].dataType.simpleString()
    shape = _grid(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, found, held = batch.column(1).cast(pa.large_binary()), 0, [], 0
            for end, text in enumerate(texts, 1):
                found.append(_cells_of(np.frombuffer(text.as_py() or b"", np.uint8), k, shape))
                held += len(found[-1])
                # A batch may hold very many letters; what is found in it goes on in slices.
                if held < SLICE_CELLS and end < len(texts):
                    continue
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, part.column(2)], names=["set_id", "cells", "n_letters"]
                )
                start, found, held = end, [], 0

    rows = sequences.select("seq_id", "seq", F.length("seq").alias("n_letters"))
    return rows.mapInArrow(run, f"set_id {id_type}, cells array<bigint>, n_letters int")


def sequence_kmers(sequences: DataFrame, k: int = 12) -> DataFrame:
    """``(seq_id, kmer)`` distinct per sequence, linear in length (long sequences)."""
    ship(sequences.sparkSession)
    id_type = sequences.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                text = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                starts = _windows(text, k)
                if not len(starts):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(text, k)[starts]
                found = np.unique(np.ascontiguousarray(view).view(f"S{k}").ravel())
                # Written in slices: a chromosome has more k-mers than one batch should hold.
                for lo in range(0, len(found), 100_000):
                    part = found[lo : lo + 100_000]
                    ids = pa.array([name.as_py()] * len(part), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(part.astype("U"))], names=["seq_id", "kmer"]
                    )

    return sequences.select("seq_id", "seq").mapInArrow(run, f"seq_id {id_type}, kmer string")


def piece_seams(pieces: DataFrame, k: int, key: Sequence[str] = ("file", "record")) -> DataFrame:
    """``(*key, seq)``: the letters around every place where two pieces of a sequence meet.

    The last k-1 letters before it and the first k-1 after it, taken from as many pieces as hold them, so that
    every k-mer lies inside a piece or inside a seam.  Only these few letters of a piece move.
    """
    # Anything but the four letters stands for a letter that no k-mer holds.
    edge = lambda part: F.regexp_replace(part.cast("string"), "[^ACGT]", "N")
    n = F.length("seq")
    size = F.least(n, F.lit(k - 1))
    edges = pieces.where(n > 0).select(
        *key, "block", "part",
        edge(F.substring("seq", F.lit(1), size)).alias("head"),
        edge(F.substring("seq", n - size + 1, size)).alias("tail"),
    )
    order = Window.partitionBy(*key).orderBy("block", "part")
    joined = lambda c, frame: F.array_join(F.collect_list(c).over(frame), "")
    around = edges.select(
        *key,
        joined("tail", order.rowsBetween(-(k - 2), 0)).alias("left"),
        joined("head", order.rowsBetween(1, k - 1)).alias("right"),
    )
    seam = F.concat(F.right("left", F.lit(k - 1)), F.left("right", F.lit(k - 1)))
    return around.where("right <> ''").select(*key, seam.cast("binary").alias("seq"))


def _from_pieces(pieces: DataFrame, k: int, key: Sequence[str], values, columns, schema: str) -> DataFrame:
    """Distinct ``(*key, ...)`` of what ``values`` finds in the letters of pieces and seams.

    ``columns`` turns what was found in several pieces, which leaves a worker together, into the columns of ``schema``.
    What ``values`` finds in one piece is distinct, so a sequence that lies in one piece, and so has no seam, is not
    shuffled; only what sequences of several pieces hold is compared among these.  The key stands beside every value,
    so it should be short.
    """
    ship(pieces.sparkSession)
    fields = [pieces.schema[c] for c in key]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], schema])

    def handed_on(batch: pa.RecordBatch, rows: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        of = pa.array(np.repeat(rows, [len(x) for x in found]))
        ids = [batch.column(c).take(of) for c in range(len(key))]
        made = columns(np.concatenate(found))
        return pa.RecordBatch.from_arrays([*ids, *made.values()], names=[*key, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0
            for i, raw in enumerate(batch.column(len(key))):
                got = values(np.frombuffer(raw.as_buffer(), np.uint8)) if raw.is_valid else ()
                if len(got):
                    rows.append(i)
                    found.append(got)
                    held += len(got)
                if held >= HANDED_ON:
                    yield handed_on(batch, rows, found)
                    rows, found, held = [], [], 0
            if held:
                yield handed_on(batch, rows, found)

    def out(df: DataFrame) -> DataFrame:
        return df.mapInArrow(run, schema)

    whole = pieces.select(*key, "seq")
    if k == 1:
        return out(whole).distinct()
    seams = write_and_read(piece_seams(pieces, k, key), "piece-seams")
    several = write_and_read(seams.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct(), "in-pieces")
    side = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    joined = whole.join(side, same, "left_semi").unionByName(seams)
    return out(whole.join(side, same, "left_anti")).unionByName(out(joined).distinct())


# Letters of a k-mer that fit a number, and values of pieces that leave a worker together.
MOST_NUMBERED, HANDED_ON = 31, 1 << 16
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _numbers(text: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-mers as numbers to the base of four, which are in the order of the letters."""
    starts = _windows(text, k)
    if not len(starts):
        return np.empty(0, np.int64)
    run, size, out, done = _DIGIT[text].astype(np.int32 if k <= 15 else np.int64), 1, None, 0
    # Runs of 1, 2, 4, ... letters are put together.
    while True:
        if k & size:
            if out is None:
                out = run
            else:
                n = len(text) - done - size + 1
                out = out[:n] << 2 * size | run[done : done + n]
            done += size
        if done == k:
            break
        n = len(text) - 2 * size + 1
        run = run[:n] << 2 * size | run[size : size + n]
        size *= 2
    out = np.sort(out[starts])
    return out[np.r_[True, out[1:] != out[:-1]]].astype(np.int64)


def _spelled(numbers: np.ndarray, k: int) -> pa.Array:
    """The k-mers of numbers as strings."""
    # Some letters at a time, by a table of all runs of so many.
    letters = np.empty((len(numbers), k), np.uint8)
    for lo in range(0, k, 6):
        n = min(6, k - lo)
        runs = np.arange(4**n)[:, None] >> 2 * np.arange(n)[::-1] & 3
        runs = np.frombuffer(b"ACGT", np.uint8)[runs].view(f"V{n}").ravel()
        letters[:, lo : lo + n] = runs[numbers >> 2 * (k - lo - n) & 4**n - 1].view(np.uint8).reshape(-1, n)
    edges = np.arange(len(numbers) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(edges), pa.py_buffer(letters))


def piece_kmers(
    pieces: DataFrame, k: int = 12, key: Sequence[str] = ("file", "record"), numbered: bool = False
) -> DataFrame:
    """``(*key, kmer)``, distinct, of sequences in pieces ``(*key, block, part, seq)`` of any length.

    A sequence is worked on by as many tasks as its pieces lie in.  ``numbered`` adds ``place``, the k-mer as a number
    to the base of four, for at most 31 letters; these numbers are in the order of the letters.
    """
    if k <= MOST_NUMBERED:

        def columns(found: np.ndarray) -> dict[str, pa.Array]:
            return {"kmer": _spelled(found, k)} | ({"place": pa.array(found)} if numbered else {})

        schema = "kmer string, place bigint" if numbered else "kmer string"
        return _from_pieces(pieces, k, key, lambda text: _numbers(text, k), columns, schema)
    if numbered:
        raise ValueError(f"k-mers of more than {MOST_NUMBERED} letters have no number")

    def words(text: np.ndarray) -> np.ndarray:
        starts = _windows(text, k)
        if not len(starts):
            return starts
        view = np.lib.stride_tricks.sliding_window_view(text, k)[starts]
        return np.unique(np.ascontiguousarray(view).view(f"S{k}").ravel())

    spelled = lambda found: {"kmer": pa.array(found.astype("U"), pa.string())}
    return _from_pieces(pieces, k, key, words, spelled, "kmer string")


def piece_cells(
    pieces: DataFrame, k: int = 12, shape: Sequence[int] = (64, 64, 64), key: Sequence[str] = ("file", "record")
) -> DataFrame:
    """``(*key, cell)``, distinct: the grid cells of all k-mers of sequences in pieces."""
    shape = _grid(shape)
    cells = lambda found: {"cell": pa.array(found, pa.int64())}
    return _from_pieces(pieces, k, key, lambda text: _cells_of(text, k, shape), cells, "cell bigint")


def piece_records(pieces: DataFrame, key: Sequence[str] = ("file", "record")) -> DataFrame:
    """``(*key, header, n_letters)``, one row per sequence; a letter of several bytes counts once."""
    return pieces.groupBy(*key).agg(
        F.max("header").alias("header"), F.sum(F.length(F.col("seq").cast("string"))).cast("long").alias("n_letters")
    )


def sequence_profile(sequences: DataFrame, k: int = 12) -> DataFrame:
    """Length and number of distinct k-mers of every sequence."""
    counts = sequence_kmers(sequences, k).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_kmers"))
    return (
        sequences.select("seq_id", F.length("seq").alias("n_letters"))
        .join(counts, "seq_id", "left")
        .withColumn("n_kmers", F.coalesce("n_kmers", F.lit(0).cast("long")))
    )
