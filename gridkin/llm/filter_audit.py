"""Filter interaction audit: what each filter removes in every order of five filters.

Four filters look at one text.  The fifth, E, asks whether an equal text with a smaller id exists anywhere: an
existential self-join.  Hashes find the texts that may have an equal; only their rows are read again with their
text, reduced to the least id of each text on one side and joined to it on hash, exact text and smaller id
(left semi).  A hash that many rows share is salted, so that a group of copies of any size is spread.

The ids so marked are united with the ids that fail the other filters and reduced to one combination of bits
each.  Everything else follows from how many documents of a part have which combination.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridkin.llm.common import SPACES, text_or_empty
from gridkin.operators.storage import BROADCAST_ROWS, write_and_read

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
# Rows of one hash that meet in one group of the self-join.
ROWS_PER_SALT = 512
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))
    kinds = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = lambda w: (
        w["n"] < 200,
        100 * w["k"].cast("long") < 50 * w["n"].cast("long"),
        100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        F.rlike(text, F.lit(r"[#$%&*|]")),
    )
    bits = lambda w: sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails(w))), F.lit(0))
    return F.transform(F.array(kinds), bits)[0]


def _plain(docs: DataFrame) -> DataFrame:
    text = text_or_empty("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
    )


def later_copies(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(doc_id, part, hash)`` of the documents whose text equals that of a smaller doc_id, each once.

    ``hashes`` holds ``(hash, doc_id)`` of all documents.  A null text counts as empty; a row without an id is
    neither larger nor smaller than another one.  Only rows that share their hash with another id are read with
    their text; of these the side of the smaller ids holds each text once.
    """
    shared = write_and_read(
        hashes.where(F.col("doc_id").isNotNull())
        .groupBy("hash")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("least") < F.col("last"))
        .select(F.col("hash").alias("h"), F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")),
        "shared-hashes",
    )
    # Two numbers a row; counted, so that a longer list is joined by shuffle.
    small = shared.count() <= BROADCAST_ROWS
    rows = _plain(docs).where(F.col("doc_id").isNotNull())
    rows = rows.join(F.broadcast(shared) if small else shared, F.col("hash") == F.col("h")).drop("h")
    firsts = rows.groupBy(F.col("hash").alias("h"), F.col("text").alias("t"), F.col("salts").alias("n")).agg(
        F.min("doc_id").alias("first")
    )
    firsts = firsts.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    return (
        salted.join(
            firsts,
            (F.col("hash") == F.col("h"))
            & (F.col("salt") == F.col("s"))
            & (F.col("text") == F.col("t"))
            & (F.col("first") < F.col("doc_id")),
            "left_semi",
        )
        .select("doc_id", "part", "hash")
        .distinct()
    )


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, good, toxic, n)``: documents of a part by what they fail and how they are labelled.

    Rows with the same id, part and text are counted each and fail the same filters.  A document is good (toxic)
    if any label row of its id says so; null labels and ids say nothing.
    """
    facts = write_and_read(
        _plain(docs).select("doc_id", "part", "hash", text_failures(F.col("text")).alias("bits")), "text-failures"
    )
    marked = later_copies(docs, facts.select("hash", "doc_id"))
    failures = facts.withColumn("n", F.lit(1)).unionByName(
        marked.select("doc_id", "part", "hash", F.lit(DUPLICATE).alias("bits"), F.lit(0).alias("n"))
    )
    by_id = failures.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    said = labels.select(
        F.col("doc_id").cast("long").alias("id"),
        (F.col("quality") == 1).alias("good"),
        (F.col("toxic") == 1).alias("toxic"),
    )
    said = said.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(
        F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")
    )
    labelled = by_id.join(said, F.col("doc_id") == F.col("id"), "left").na.fill(False, ["good", "toxic"])
    return labelled.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps(spark: SparkSession) -> DataFrame:
    """``(filter_order, step, at, before)``: the filter of each step of each order, and the bits before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, at in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, at, before))
            before |= 1 << at
    return spark.createDataFrame(rows, "filter_order string, step int, at int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, with ``COUNTS`` and ``shapley``, all long.

    A null source is the part ``''``, a null text the empty text.  No documents give no parts.  Other columns
    are ignored, whatever their names.
    """
    counted = combinations(docs, labels)
    places = range(len(FILTERS))
    # What a step removes depends on the filters before it, not on their order: 80 cases, not 600.
    cases = [(i, s) for i in places for s in range(1 << len(FILTERS)) if not s >> i & 1]
    case = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("before")) for i, s in cases]))
    rows = counted.withColumn("case", case).select("*", "case.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("at"))
    fails = F.col("bits").bitwiseAND(bit) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda holds: F.sum(F.when(holds, F.col("n")).otherwise(F.lit(0))).cast("long")
    by_case = rows.groupBy("part", "at", "before").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("bits") == bit).alias("unique_fails"),
        total(~gone & fails & F.col("good")).alias("good_lost"),
        total(~gone & fails & F.col("toxic")).alias("toxic_lost"),
    )
    n = len(FILTERS)
    # Orders in which just these filters come before this one.
    orders = F.get(
        F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count(F.col("before"))
    )
    # 16 rows a window.
    share = F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "at"))
    by_case = by_case.withColumn("shapley", share.cast("long"))
    steps = F.broadcast(_steps(docs.sparkSession))  # 600 rows
    return by_case.join(steps, ["at", "before"]).select("part", "filter_order", "step", *COUNTS, "shapley")
