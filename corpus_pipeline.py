"""A corpus pipeline of five stages, each one operation of ``gridkin.llm`` over all that came before.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` stores and reads again as the
documents of the next one.  All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.llm import bpe, jaccard_join, mixing, quality_rules, secret_scan
from gridkin.llm.common import free_name, table
from gridkin.operators.storage import write_and_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep, each repeated row by itself; null texts go."""
    return quality_rules.kept_documents(docs, quality_rules.learned_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, of repeated rows of that id one.

    Documents without words, which link with nothing, and rows without an id stay.
    """
    return jaccard_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts replaced by a mark; ``n_chars``, where there is one, follows the text.

    No document goes; a null text stays null.
    """
    redacted = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.length("text").cast(kind)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; a null source is a source, a null text has size 0."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns of the documents with ``ids``, and their number ``n_tokens``; a null text has none."""
    lexicon = bpe.ship_lexicon(bpe.word_counts(docs))
    ids = free_name([c for c in docs.columns if c != "text"], "ids")
    encoded = bpe.encode(docs, ids_col=ids, lexicon=lexicon)
    return encoded.withColumn(free_name(encoded.columns, "n_tokens"), F.size(ids).cast("long"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

# Learned rules, whole-set similarity, test batteries and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; an empty table passes through all of them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_and_read(docs, f"pipeline-{name}")
    return docs
