"""Sets derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.operators.filters import spread
from gridkin.sources.tables import basket_rows, document_sets

# Grids the queries work on.
EVENT_SHAPE = (64, 5, 24)
TEXT_SHAPE = (32, 32, 32)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sets(
    spark: SparkSession, sf_dir: str, n_cells: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Row sets of word 3-grams of whole documents, md5-numbered."""
    documents = table(spark, sf_dir, "documents")
    return document_sets(documents, n_cells=n_cells, method="md5", only=only)


def text_sets_sql(n_cells: int | None = None) -> str:
    """``text_cells(set_id, cell)``, distinct."""
    number = "('0x' || substr(md5(g), 1, 15))::BIGINT"
    cell = number if n_cells is None else f"{number} % {n_cells}"
    return f"""
      words AS (SELECT doc_id AS set_id, string_split(text, ' ') AS w FROM documents),
      grams AS (
        SELECT set_id, unnest(list_transform(generate_series(1, len(w) - 2),
               lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
        FROM words WHERE len(w) >= 3),
      text_cells AS (SELECT DISTINCT set_id, {cell} AS cell FROM grams)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flow rows: who (user), what (event type), when (hour of day)."""
    events = spread(table(spark, sf_dir, "events"))
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("src_ip"),
        kind.alias("dst_ip"),
        F.hour("ts").cast("long").alias("port"),
    )


EVENT_ROWS_SQL = """
      event_rows AS (
        SELECT event_id, ts, user_id AS src_ip,
               coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 0)
                 ::BIGINT AS dst_ip,
               hour(ts)::BIGINT AS port
        FROM events)"""


def event_cell_sql(row: str = "") -> str:
    a, b, c = EVENT_SHAPE
    return (
        f"(({row}src_ip % {a}) * {b} + ({row}dst_ip % {b})) * {c} + ({row}port % {c})"
    )


def customer_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sets: the parts each customer ordered."""
    return customer_rows(spark, sf_dir).distinct()


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeats."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return basket_rows(joined, "o_custkey", "l_partkey")


BASKETS_SQL = """
      baskets AS (
        SELECT DISTINCT o_custkey AS set_id, l_partkey AS cell
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def supplier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sets: the parts each supplier shipped."""
    return supplier_rows(spark, sf_dir).distinct()


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeats, for consumers that do not mind them."""
    return basket_rows(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


SUPPLIERS_SQL = """
      supplier_sets AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS cell FROM lineitem)"""


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flow rows: order -> supplier over part."""
    return spread(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("src_ip"),
            F.col("l_suppkey").alias("dst_ip"),
            F.col("l_partkey").alias("port"),
            "l_linenumber",
        )
    )


FLOW_ROWS_SQL = """
      flow_rows AS (
        SELECT l_orderkey AS src_ip, l_suppkey AS dst_ip, l_partkey AS port, l_linenumber
        FROM lineitem)"""
