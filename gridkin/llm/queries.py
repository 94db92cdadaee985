"""The registered queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.llm import (
    bpe,
    filter_audit,
    jaccard_join,
    language_id,
    mixing,
    personal_data,
    quality_classifier,
    quality_rules,
    quotation,
    secret_scan,
    token_counts,
    topk,
    twins,
    vector_codes,
)
from gridkin.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, bpe.ship_lexicon(bpe.word_counts(docs)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op5_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply order of all conversations, written as mails that quote what they answer."""
    mails = quotation.with_quotes(table(spark, sf_dir, "conversations"))
    return quotation.conversations(mails).select("conv_id", "root", "depth", "turn", "parent", "role", F.md5("text").alias("text_md5"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words("text").alias("n"))
    mixed = mixing.mix(docs, size=F.col("n"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality(docs, quality_rules.learned_rules(docs, labels))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents."""
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.score(docs, quality_classifier.learn(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_quotation": op5_quotation,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_personal_data": op13_personal_data,
}
SQL = {
    "op1_topk": OP1_SQL,
    "op5_quotation": twins.QUOTATION,
    "op9_jaccard_join": twins.JACCARD_JOIN,
    "op11_filter_audit": twins.FILTER_AUDIT,
    "op12_vector_codes": twins.VECTOR_CODES,
    "op13_personal_data": twins.PERSONAL_DATA,
}
