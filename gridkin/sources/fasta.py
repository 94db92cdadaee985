"""FASTA files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridkin.operators.shipping import ship
from gridkin.operators.storage import write_and_read


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, header, seq)``, one row per record; sequences upper-cased and joined over lines.

    Records are split at ``>`` at the start of a line, so files split between tasks like any text.  A record is
    one row and must fit a task; ``read_fasta_pieces`` has no such limit.
    """
    cut = F.instr("value", "\n")
    body = F.when(cut > 0, F.substring("value", cut + 1, F.length("value"))).otherwise("")
    lines = spark.read.text(path, lineSep="\n>")
    named = lines.select(
        F.col("_metadata.file_name").alias("file"),
        F.regexp_replace(F.ltrim("value"), r"^>", "").alias("value"),
    )
    return named.select(
        "file",
        F.trim(F.regexp_replace(F.split_part("value", F.lit("\n"), F.lit(1)), "\r", "")).alias("header"),
        F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"),
    ).where(F.trim("value") != "")


def write_fasta(sequences: DataFrame, path: str, width: int = 70) -> None:
    """Write ``(header, seq)`` rows as FASTA text with wrapped lines."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})", "$1\n")
    sequences.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped).alias("value")).write.text(path)


# Bytes of a piece; what is left of a run after the last whole piece is added to that.
PIECE = 1 << 16
_BLANKS = b" \t\r\n\x0b\x0c"
_PIECES = "file string, block long, part long, run long, header string, seq binary"


def _is_header(lines: pa.Array) -> np.ndarray:
    """Lines whose first character that is not blank is ``>``."""
    marked = pc.starts_with(lines, ">").to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(pc.match_substring_regex(lines, r"^\s+>").to_numpy(zero_copy_only=False)):
        marked[i] = True
    return marked


class _Split:
    """Pieces of one split of a file, in the order of its lines."""

    def __init__(self, file: str, block: int, piece: int):
        self.file, self.block, self.piece = file, block, piece
        self.run, self.part, self.header = 0, 0, None
        self.open = bytearray()

    def letters(self, raw: bytes) -> Iterator[dict]:
        self.open += raw.translate(None, _BLANKS).upper()
        while len(self.open) >= 2 * self.piece:
            yield self._piece(self.piece)

    def close(self) -> Iterator[dict]:
        """The rest of a run; a record has one piece at least, so that its header is not lost."""
        if self.open or self.header is not None:
            yield self._piece(len(self.open))

    def next_run(self, line: str) -> Iterator[dict]:
        yield from self.close()
        self.run, self.header = self.run + 1, line.strip()[1:].strip()

    def _piece(self, n: int) -> dict:
        # Not inside a letter of several bytes.
        while n < len(self.open) and self.open[n] & 0xC0 == 0x80:
            n += 1
        row = {"file": self.file, "block": self.block, "part": self.part, "run": self.run, "header": self.header}
        row["seq"] = bytes(self.open[:n])
        del self.open[:n]
        self.part += 1
        return row


def _pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("run", pa.int64())]
        + [("header", pa.string()), ("seq", pa.binary())]
    )
    split, rows, held = None, [], 0

    def done(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        nonlocal rows, held
        for row in found:
            rows.append(row)
            held += len(row["seq"]) + 64
            if held >= 16 * PIECE:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0

    for batch in batches:
        file, block = batch["file"].dictionary_encode(), batch["block"].to_numpy()
        codes = file.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])])
        for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            name = file.dictionary[int(codes[start])].as_py(), int(block[start])
            if split is None or (split.file, split.block) != name:
                if split is not None:
                    yield from done(split.close())
                split = _Split(*name, piece)
            lines = batch["value"].slice(start, end - start)
            edges = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
            data = memoryview(lines.buffers()[2] or b"")
            at = 0
            # The letters of the lines between two headers lie side by side.
            for i in [*np.flatnonzero(_is_header(lines)), len(lines)]:
                if i > at:
                    for lo in range(edges[at], edges[i], 16 * PIECE):
                        yield from done(split.letters(bytes(data[lo : min(lo + 16 * PIECE, edges[i])])))
                if i < len(lines):
                    yield from done(split.next_run(lines[int(i)].as_py()))
                at = i + 1
    if split is not None:
        yield from done(split.close())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_fasta_pieces(spark: SparkSession, path: str | list[str], piece: int = PIECE) -> DataFrame:
    """``(file, record, header, block, part, seq)``, stored: letters of records in pieces, as bytes.

    For records of any length in files of any length.  Lines are read in byte ranges, one task each; a range
    turns its lines into pieces, knowing only how many headers it has seen.  A prefix scan over the ranges of a
    file (one row each) then gives every piece its record, counted from 1, and its header.  Letters before the
    first header are record 0, whose header is null.  ``(block, part)`` orders the pieces of a record.

    Blanks inside and around lines do not count, ASCII letters are upper-cased.
    A record whose letters are all on one line is read by one task, but stored in pieces as well.
    """
    ship(spark)
    # One copy of every letter is written, so that ranges and their order are the same in all that follows.
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    pieces = write_and_read(lines.mapInArrow(lambda batches: _pieces(batches, piece), _PIECES), "fasta-pieces")
    ranges = pieces.groupBy("file", "block").agg(
        F.max("run").alias("headers"), F.max(F.when(F.col("run") > 0, F.struct("run", "header"))).alias("last")
    )
    # One row per range of a file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = ranges.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("_earlier"),
        F.last(F.col("last.header"), ignorenulls=True).over(before).alias("_open"),
    )
    found = pieces.join(
        F.broadcast(scanned), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    )
    return found.select(
        "file",
        (F.col("_earlier") + F.col("run")).alias("record"),
        F.when(F.col("run") == 0, F.col("_open")).otherwise(F.col("header")).alias("header"),
        "block",
        "part",
        "seq",
    )
