"""Network-flow CSV files."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.functions.parsing import clean_names, ip_to_int, to_int

# Header names of the flow files and what they are called here.
FLOW_NAMES = {
    "Source IP": "src_ip_raw",
    "Destination IP": "dst_ip_raw",
    "Destination Port": "port",
    "Label": "label",
}


# Every header stands in the first line of a file, so at its first place in the first block.
_FIRST = "_metadata.file_block_start = 0"


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(header, files)``: the first line of every file below a path, with the files that share it.

    One row per kind of header.  Only first blocks are looked at.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).where(_FIRST).select("value", F.col("_metadata.file_path").alias("file"), row.alias("row"))
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    return first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def read_flows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan flow files: every column as text, then normalised; columns are found by name in every file.

    Files whose headers are alike are one scan.  A column that some files lack is null there, a label that is
    lacking ``unknown``.  A missing path raises Spark's ``PATH_NOT_FOUND``.
    """
    kinds = file_headers(spark, path).collect()
    if len(kinds) <= 1:
        return normalise_flows(spark.read.option("header", True).csv(path))
    scans = [
        normalise_flows(spark.read.option("header", True).csv([unquote(f) for f in kind["files"]]))
        for kind in sorted(kinds, key=lambda k: k["header"])
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def normalise_flows(raw: DataFrame) -> DataFrame:
    """Clean headers, default label, integer addresses and port; other columns are kept."""
    df = clean_names(raw, FLOW_NAMES)
    if "label" not in df.columns:
        df = df.withColumn("label", F.lit("unknown"))
    return df.withColumns(
        {
            "src_ip": ip_to_int("src_ip_raw"),
            "dst_ip": ip_to_int("dst_ip_raw"),
            "port": to_int("port"),
        }
    )
