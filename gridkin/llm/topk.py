"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block against block.  A first pass counts the scores of
each query in bins over the whole possible range, the next ones split the bin that holds the k-th score,
until a bin is one score wide.  The last pass keeps the candidates at or above that score; ties go to the
smaller id.  Only counts travel between passes: a block reports a query's bins from the top until it has
counted k scores of its own, since lower bins cannot hold the k-th of all.

Blocks have bounded size and meet by an equality join on (query block, candidate block), so no vector
passes through the driver and nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.llm.common import map_arrow, map_groups
from gridkin.operators.ranking import newest_per_group
from gridkin.operators.storage import write_and_read

SCALE = 256.0
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
BINS = 512
# Larger scores are refused (a score is a LONG).
LIMIT = (1 << 62) - 1
_FIELDS = ("rows", "ids", "lens", "flat")
_PACKED = "block int, rows binary, ids binary, lens binary, flat binary"


def finite_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(row, id, vec)`` of the rows that take part; ``row`` holds once the table is stored.

    A null id, a null vector, and one with a null, NaN or infinite component take no part.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kept = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(~bad)
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "vec")


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One row per block: ids, lengths and floor(256 x) of all components."""
    order = np.lexsort((rows["row"].to_numpy(), rows["id"].to_numpy()))
    rows = rows.take(pa.array(order))
    vec = rows["vec"].combine_chunks()
    flat = np.floor(SCALE * vec.flatten().to_numpy(zero_copy_only=False))
    lens = np.diff(vec.offsets.to_numpy()).astype(np.int64)
    packed = [*(rows[c].to_numpy().astype(np.int64) for c in ("row", "id")), lens, flat.astype(np.float64)]
    return pa.table(
        {"block": pa.array([key[0].as_py()], pa.int32())}
        | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(_FIELDS, packed, strict=True)}
    )


def packed_blocks(vectors: DataFrame, n_blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    return map_groups(vectors.select(block.alias("block"), "row", "id", "vec"), ["block"], _pack, _PACKED)


def _matrices(rows: bytes, ids: bytes, lens: bytes, flat: bytes) -> dict[int, tuple[np.ndarray, ...]]:
    """By vector length: places in the block, ids, rows and matrix."""
    source, ids, lens = (np.frombuffer(x, np.int64) for x in (rows, ids, lens))
    flat = np.frombuffer(flat, np.float64)
    starts = np.cumsum(lens) - lens
    out = {}
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        out[int(n)] = rows, ids[rows], source[rows], flat[starts[rows][:, None] + np.arange(n)]
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact while all partial sums stay below 2**53."""
    largest = [float(np.abs(x).max(initial=0.0)) for x in (left, right)]
    if left.shape[1] * largest[0] * largest[1] < 2.0**53:
        return (left @ right.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (left, right)]
    found = whole[0] @ whole[1].T
    if found.size and max(abs(found.min()), abs(found.max())) > LIMIT:
        raise ValueError("a score does not fit 62 bits")
    return found.astype(np.int64)


def _scored(cell: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, candidate ids, scores, which count) for a few hundred queries at a time."""
    queries = _matrices(*[cell[f"q_{c}"] for c in _FIELDS])
    candidates = _matrices(*[cell[c] for c in _FIELDS])
    for n, (rows, _, own, matrix) in queries.items():
        if n not in candidates:
            continue
        _, other, others, right = candidates[n]
        for start in range(0, len(rows), 256):
            part = slice(start, start + 256)
            yield rows[part], other, _products(matrix[part], right), own[part][:, None] != others[None, :]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1).to_pylist()[0]


def _histograms(batches: Iterator[pa.RecordBatch], k: int, span: int) -> Iterator[pa.RecordBatch]:
    width = -(-span // BINS)
    for cell in _cells(batches):
        lo = np.array(cell["lo"], np.int64)
        for rows, _, scores, counts in _scored(cell):
            low = lo[rows][:, None]
            # Scores above the window are counted already, in ``above``; the last column takes all that is outside.
            inside = counts & (scores >= low) & (scores - low < span)
            bins = np.where(inside, (scores - low) // width, BINS)
            flat = (bins + np.arange(len(rows))[:, None] * (BINS + 1)).ravel()
            hist = np.bincount(flat, minlength=len(rows) * (BINS + 1)).reshape(len(rows), BINS + 1)[:, :BINS]
            higher = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
            i, b = np.nonzero((hist > 0) & (higher < k))
            yield pa.record_batch(
                {
                    "q": pa.array(np.full(len(i), cell["q"]), pa.int32()),
                    "idx": pa.array(rows[i], pa.int32()),
                    "bin": pa.array(b, pa.int64()),
                    "n": pa.array(hist[i, b], pa.int64()),
                }
            )


def _at_least(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for cell in _cells(batches):
        lo = np.array(cell["lo"], np.int64)
        q_ids, q_rows = (np.frombuffer(cell[c], np.int64) for c in ("q_ids", "q_rows"))
        for rows, ids, scores, counts in _scored(cell):
            i, j = np.nonzero(counts & (scores >= lo[rows][:, None]))
            order = np.lexsort((ids[j], -scores[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            yield pa.record_batch(
                {
                    "query": pa.array(q_rows[rows[i]], pa.int64()),
                    "query_id": pa.array(q_ids[rows[i]], pa.int64()),
                    "vec_id": pa.array(ids[j], pa.int64()),
                    "score": pa.array(scores[i, j], pa.int64()),
                }
            )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of every query row, rank from 1.

    Queries are the rows where ``is_query`` (an expression over ``id``) holds; candidates are all other rows
    of the same vector length, also those that repeat its id; rows that share an id are queries each.  The score is the integer inner product of floor(256 x); one beyond ``LIMIT`` is an
    error.  A query with fewer than k candidates gets all of them, one without any gets no row.  An empty
    table gives no row.  Other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    stored = write_and_read(finite_vectors(vectors, id_col, vec_col), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), 2.0))
    sizes = stored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("n_q"), F.max(norm).alias("norm")
    ).first()
    n_c, n_q = -(-sizes["n"] // CANDIDATE_BLOCK) or 1, -(-sizes["n_q"] // QUERY_BLOCK) or 1
    # No inner product exceeds the largest squared length (the last term covers rounding).
    bound = min(math.floor(min(sizes["norm"] or 0.0, float(LIMIT)) * (1 + 1e-9)) + 1, LIMIT)

    candidates = write_and_read(packed_blocks(stored, n_c), "candidate-blocks")
    queries = write_and_read(packed_blocks(stored.where(is_query), n_q), "query-blocks").select(
        F.col("block").alias("q"), *[F.col(c).alias(f"q_{c}") for c in _FIELDS]
    )
    tasks = max(min(n_c * n_q, 20_000), 1)
    right = (
        candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
        .withColumnRenamed("block", "c")
        .repartition(tasks, "q", "c")
    )

    def cells(state: DataFrame) -> DataFrame:
        lows = state.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("idx", "lo"))).alias("s"))
        left = queries.join(lows.select("q", F.col("s.lo").alias("lo")), "q").withColumn(
            "c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))
        )
        return left.repartition(tasks, "q", "c").join(right, ["q", "c"])

    n_ids = (F.length("q_ids") / 8).cast("int")
    state = queries.select("q", F.explode(F.sequence(F.lit(0), n_ids - 1)).alias("idx")).select(
        "q", "idx", F.lit(-bound).cast("long").alias("lo"), F.lit(0).cast("long").alias("above")
    )
    span = 2 * bound + 1
    while span > 1:
        width = -(-span // BINS)
        found = map_arrow(
            cells(state),
            lambda batches, span=span: _histograms(batches, k, span),
            "q int, idx int, bin long, n long",
        )
        counted = found.groupBy("q", "idx", "bin").agg(F.sum("n").alias("n")).join(state, ["q", "idx"])
        down = Window.partitionBy("q", "idx").orderBy(F.desc("bin"))
        running = counted.withColumn("higher", F.col("above") + F.sum("n").over(down) - F.col("n"))
        kth = running.where((F.col("higher") < k) & (F.col("higher") + F.col("n") >= k)).select(
            "q", "idx", "bin", "higher"
        )
        # Where all candidates together are fewer than k, the low end stays and all of them qualify.
        state = state.join(kth, ["q", "idx"], "left").select(
            "q",
            "idx",
            (F.col("lo") + F.coalesce("bin", F.lit(0)) * width).alias("lo"),
            F.coalesce("higher", "above").alias("above"),
        )
        state = write_and_read(state, "kth-scores")
        span = width
    best = map_arrow(
        cells(state), lambda batches: _at_least(batches, k), "query long, query_id long, vec_id long, score long"
    )
    order = [F.desc("score"), F.col("vec_id")]
    ranked = newest_per_group(best, ["query"], order, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return ranked.select("query_id", rank.alias("rank"), "vec_id", "score")
