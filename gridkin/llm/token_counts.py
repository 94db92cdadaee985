"""Token counts of the documents in flat token files, by a scan for separators.

A flat file is nothing but token ids of fixed width, one document after the other, each ended by a separator
id; there is no index.  Files are read in blocks of whole tokens.  Each block is searched for the separator at
once and reports its inner documents and what hangs over its two edges; a prefix scan over the blocks of a
file (some bytes per block) numbers the documents and joins the overhangs, so a document may reach over any
number of blocks.
"""

from __future__ import annotations

import base64
import contextlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridkin.llm.common import map_arrow, text_or_empty
from gridkin.operators.storage import scratch_path, write_and_read

VOCABULARY = "byte_bpe_50k.tiktoken"
# The vocabulary leaves this id free; it ends a document.
SEPARATOR = 50_256
WIDTH = 2
BLOCK = 1 << 20
_SPLITS = "spark.sql.files.minPartitionNum"


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(path)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            texts = batch[0].slice(start, 256).to_pylist()
            raw = [np.array(encoding.encode_ordinary(t), f"<u{WIDTH}").tobytes() for t in texts]
            yield pa.record_batch({"tokens": pa.array(raw, pa.binary())})


def write_token_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Tokenize every whole text and write flat files, one per task, in row order.

    The text sink writes the bytes of each document as they are, and the separator after it.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    texts = docs.select(text_or_empty("text").alias("text"))
    ended = np.array([SEPARATOR], f"<u{WIDTH}").tobytes().decode("latin-1")
    map_arrow(texts, lambda b: _tokens(b, path), "tokens binary").select(F.col("tokens").cast("string")).write.option(
        "encoding", "ISO-8859-1"
    ).option("lineSep", ended).text(folder)


def _scan(batches: Iterator[pa.RecordBatch], width: int, separator: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, tails, inner, found = [], [], [], []
        for block in batch[2]:
            ids = np.frombuffer(block.as_buffer(), f"<u{width}")
            ends = np.flatnonzero(ids == separator)
            found.append(len(ends))
            heads.append(int(ends[0]) if len(ends) else len(ids))
            tails.append(len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids))
            inner.append(np.diff(ends) - 1)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in inner])]).astype(np.int32)
        flat = np.concatenate([*inner, np.zeros(0, np.int64)]).astype(np.int64)
        yield pa.record_batch(
            {
                "file": batch[0],
                "block": batch[1],
                "found": pa.array(found, pa.int64()),
                "head": pa.array(heads, pa.int64()),
                "tail": pa.array(tails, pa.int64()),
                "inner": pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)),
            }
        )


def token_counts(
    spark: SparkSession, folder: str, *, width: int = WIDTH, separator: int = SEPARATOR, block: int = BLOCK
) -> DataFrame:
    """``(file, document, n_tokens)``: tokens of every document, separators not counted; documents from 0.

    Files are streams of their own.  Tokens after the last separator of a file are one more document; a file
    without bytes has none, two separators in a row hold an empty one.  ``block`` is in bytes, a whole number
    of tokens; bytes after the last whole token of a file are an error.  A file is one row of Spark's binary
    source and so at most 2 GB: write more files for more data.
    """
    if block % width:
        raise ValueError("a block must hold whole tokens")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(
        F.raise_error(F.concat(F.col("path"), F.lit(" does not hold whole tokens")))
    )
    number = F.sequence(F.lit(0), F.floor((whole - 1) / block).cast("int"))
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(number).alias("block"))
    cut = blocks.select("file", "block", F.substring("content", F.col("block") * block + 1, F.lit(block)).alias("bytes"))
    scanned = map_arrow(
        cut,
        lambda b: _scan(b, width, separator),
        "file string, block int, found long, head long, tail long, inner array<long>",
    )
    # One row per block.  What is open before a block: its own file's tail since the last separator, carried
    # over blocks without any.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).over(upto)
    seen = scanned.withColumn("document", F.coalesce(F.sum("found").over(before), F.lit(0))).withColumn("run", run)
    # Blocks of one run: the first ends with a separator somewhere and leaves its tail, the others are all tail.
    in_run = Window.partitionBy("file", "run")
    carried = seen.withColumn("left", F.sum("tail").over(in_run)).withColumn(
        "first_left", F.first("left").over(Window.partitionBy("file").orderBy("run").rangeBetween(-1, -1))
    )
    opened = F.coalesce("first_left", F.lit(0))
    last = F.max("block").over(Window.partitionBy("file"))
    closed = carried.withColumn("last", last).select(
        "file",
        F.concat(
            F.when(
                F.col("found") > 0,
                F.concat(
                    F.array(F.struct(F.col("document").alias("document"), (opened + F.col("head")).alias("n_tokens"))),
                    F.transform(
                        "inner",
                        lambda n, i: F.struct((F.col("document") + 1 + i).alias("document"), n.alias("n_tokens")),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<document:bigint,n_tokens:bigint>>")),
            # The open end of a file, if it holds any token.
            F.when(
                (F.col("block") == F.col("last")) & (F.col("left") > 0),
                F.array(
                    F.struct((F.col("document") + F.col("found")).alias("document"), F.col("left").alias("n_tokens"))
                ),
            ).otherwise(F.array().cast("array<struct<document:bigint,n_tokens:bigint>>")),
        ).alias("rows"),
    )
    return closed.select("file", F.inline("rows"))


def document_token_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)`` of a table, by way of flat files in the shared folder.

    Row i of a task is document i of the task's file, which is how ids, that the files do not hold, come back.
    ``docs`` must be a plain scan of files.  How a scan is dealt out to tasks depends on the cores that there are
    at the time, unless their number is given; so it is, for both reads.  If ids and files differ in their
    documents all the same, that is an error.  A null text has no tokens; repeated rows and null ids stay as
    they are; an empty table gives no rows; very long texts reach over several blocks; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    with _same_splits(spark):
        write_token_files(docs, folder)
        place = F.monotonically_increasing_id()
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place")).select(
            "doc_id",
            F.shiftright("place", 33).alias("task"),
            F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("document"),
        )
        ids = write_and_read(ids, "token-ids")
    counted = token_counts(spark, folder).select(
        F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long").alias("task"), "document", "n_tokens"
    )
    counted = write_and_read(counted, "token-counts")
    total = lambda df, name: df.groupBy("task").agg(F.count(F.lit(1)).alias(name))
    # One row per task.
    both = total(ids, "rows").join(total(counted, "found"), "task", "full")
    if both.where(~F.col("rows").eqNullSafe(F.col("found"))).limit(1).count():
        raise RuntimeError("the documents were dealt out differently when their ids were read")
    return ids.join(counted, ["task", "document"]).select("doc_id", "n_tokens")


@contextlib.contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans planned meanwhile cut files for the same number of tasks, whatever executors come and go."""
    before = spark.conf.get(_SPLITS, None)
    spark.conf.set(_SPLITS, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_SPLITS) if before is None else spark.conf.set(_SPLITS, before)
