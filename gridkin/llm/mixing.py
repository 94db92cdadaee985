"""Mixing sources to target weights by systematic sampling.

Every document is expected ``target / size`` times of its source.  The expected copies are summed up along an
order of the source's documents, one random offset is added for each source, and a document is taken once for
every whole number that the sum passes on its way over it.  Sizes rise along the order, so the taken words of
a source differ from its target by about one document of its largest size at most.

The order is one range sort over (source, size, hash), whatever the size of a source; the place inside a
source is the place in the whole order less the place where the source begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import WORD, free_name
from gridkin.operators.ranking import row_index
from gridkin.operators.storage import write_and_read

WEIGHTS = (5, 2, 1)
MOST = 3.0
# Offsets that are tried for a source.
OFFSETS = 16
RESULTS = ("size", "source_size", "target", "copies")


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, stored.

    Sources by code point, null last, have the weights in turn and share the whole size by them.  A target
    stops at ``most`` times its source's size; the excess is shared again by weight among the others, until
    none is above.  Each round is one aggregate over the table of sources.
    """
    ranked = row_index(sizes, [F.col("source").isNull(), F.col("source")], "_place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.select(
        "source",
        "source_size",
        F.get(cycle, (F.col("_place") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(most)).alias("most"),
    )
    stored = write_and_read(weighted, "source-weights")
    total = stored.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    share, full = 0.0, -1
    while True:
        # Sources at their limit at the present share per weight; the rest divide what these leave.
        at_limit = F.col("most") <= F.col("weight") * share
        found = stored.agg(
            F.count_if(at_limit).alias("full"),
            F.coalesce(F.sum(F.when(at_limit, F.col("most"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if found["full"] == full or not found["weight"]:
            break
        full, share = found["full"], (total - found["used"]) / found["weight"]
    return stored.select("source", "source_size", F.least("most", F.col("weight") * share).alias("target"))


def mix(
    docs: DataFrame,
    *,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST,
    seed: int = 7,
) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``docs`` has ``doc_id``, ``source`` and, unless ``size`` is given, ``text``; the size is the number of
    words, 0 for a null text.  Columns that are called like a result are replaced.  Repeated rows are
    documents of their own.  A source without words has target 0 and is not taken; documents without words
    count as size 0.  The offsets come from the seed and the source's name, so reruns agree.
    """
    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    sized = docs.select(*[F.col(f"`{c}`") for c in rest], (n_words("text") if size is None else size).alias("size"))
    order, place = free_name(sized.columns, "order"), free_name(sized.columns, "place")
    simple = [c for c, kind in sized.dtypes if not kind.startswith("map")]
    sized = sized.withColumn(order, F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in simple]))
    placed = write_and_read(
        row_index(sized, [F.col("source").isNull(), F.col("source"), F.col("size"), F.col(order)], place), "places"
    )
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(place).alias("first"))
    targets = source_targets(sources.select("source", "source_size"), weights, most)
    starts = sources.select(F.col("source").alias("_mix_s"), F.col("first").alias("_mix_first"))
    rates = write_and_read(
        targets.join(starts, F.col("source").eqNullSafe(F.col("_mix_s"))).select(
            F.col("source").alias("_mix_s"),
            "source_size",
            "target",
            "_mix_first",
            F.coalesce(
                F.least(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(most)), F.lit(0.0)
            ).alias("_mix_rate"),
        ),
        "source-rates",
    )
    step = F.col(place) - F.col("_mix_first")

    def copies(offset: Column) -> Column:
        upto = lambda n: F.floor(offset + F.col("_mix_rate") * n)
        return F.least(upto(step + 1) - upto(step), F.ceil(F.lit(most)))

    def offset(j: int) -> Column:
        """A multiple of 2**-20 in [0, 1)."""
        drawn = F.xxhash64(F.lit(seed), F.lit(j), F.coalesce("_mix_s", F.lit("")), F.col("_mix_s").isNull())
        return F.pmod(drawn, F.lit(1 << 20)) / float(1 << 20)

    # Of some offsets drawn for a source the one whose documents come nearest to its target.
    tried = placed.select("source", "size", place).join(rates, F.col("source").eqNullSafe(F.col("_mix_s")))
    taken = tried.groupBy("_mix_s").agg(
        F.first("target").alias("wanted"), *[F.sum(copies(offset(j)) * F.col("size")).alias(f"t{j}") for j in range(OFFSETS)]
    )
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{j}") - F.col("wanted")), F.lit(j).alias("j")) for j in range(OFFSETS)]))
    chosen = taken.select(F.col("_mix_s").alias("_mix_of"), F.get(F.array(*[offset(j) for j in range(OFFSETS)]), nearest["j"]).alias("_mix_offset"))
    table = write_and_read(rates.join(chosen, F.col("_mix_s").eqNullSafe(F.col("_mix_of"))).drop("_mix_of"), "source-offsets")
    joined = placed.join(table, F.col("source").eqNullSafe(F.col("_mix_s"))).withColumn("_mix_copies", copies(F.col("_mix_offset")))
    copies_column = F.col("_mix_copies")
    return joined.select(
        *[F.col(f"`{c}`") for c in rest], "size", "source_size", "target", copies_column.cast("long").alias("copies")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs`` only."""
    own = {c: free_name(docs.columns, f"own_{c}") for c in docs.columns if c.lower() in RESULTS}
    taken = mix(docs.withColumnsRenamed(own), **how).where(F.col("copies") > 0)
    repeated = taken.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
