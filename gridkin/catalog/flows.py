"""Log parsing, frequency filters, row positions and count windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridkin.catalog import inputs as src
from gridkin.functions.compare import exact_ratio
from gridkin.functions.parsing import ip_to_int, to_int
from gridkin.operators import filters as ops
from gridkin.operators.cells import grid_cells
from gridkin.operators.ranking import row_index
from gridkin.operators.storage import scratch_path
from gridkin.operators.windows import count_windows, split_windows
from gridkin.plans.flows import flow_sets
from gridkin.sources.flows import read_flows

ORDER = ["src_ip", "l_linenumber", "port", "dst_ip"]
MIN_PORT, MIN_DST = 30, 300


def _raw_ip(part, supp, order, line):
    """Addresses out of keys, some of them malformed on purpose."""
    good = F.concat_ws(".", part % 256, supp % 256, order % 256, line.cast("long"))
    return (
        F.when(line == 3, F.concat_ws(".", part % 256, supp % 256))
        .when(line == 4, F.concat(good, F.lit(".9")))
        .when(line == 5, F.concat(F.lit("x"), good))
        .when(line == 6, F.concat(F.lit(" "), good))
        .otherwise(good)
    )


RAW_IP_SQL = """
      CASE l_linenumber
        WHEN 3 THEN concat_ws('.', l_partkey % 256, l_suppkey % 256)
        WHEN 4 THEN concat_ws('.', l_partkey % 256, l_suppkey % 256, l_orderkey % 256, l_linenumber, 9)
        WHEN 5 THEN 'x' || concat_ws('.', l_partkey % 256, l_suppkey % 256, l_orderkey % 256, l_linenumber)
        WHEN 6 THEN ' ' || concat_ws('.', l_partkey % 256, l_suppkey % 256, l_orderkey % 256, l_linenumber)
        ELSE concat_ws('.', l_partkey % 256, l_suppkey % 256, l_orderkey % 256, l_linenumber) END"""

IP_SQL = " + ".join(
    f"coalesce(try_cast(trim(string_split(ip, '.')[{i + 1}]) AS BIGINT), 0) * {256 ** (3 - i)}"
    for i in range(4)
)


def _with_ip(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    ip = _raw_ip(*[F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")])
    return lines.withColumn("ip", ip)


def ip_numbers(spark, sf):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return _with_ip(spark, sf).select(*keys, "ip", ip_to_int("ip").alias("ip_int"))


def port_numbers(spark, sf):
    """Numbers out of text; flags and statuses are not numbers and become 0."""
    text = F.when(F.col("l_linenumber") == 2, F.col("l_returnflag")).otherwise(
        F.col("l_quantity").cast("string")
    )
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return src.table(spark, sf, "lineitem").select(*keys, to_int(text).alias("port"))


def flow_csv_scan(spark, sf):
    """Line items written as a flow log with blank-padded headers, then scanned and normalised."""
    path = scratch_path(spark, "flow-csv")
    raw = _with_ip(spark, sf).select(
        F.col("l_orderkey").alias("Flow ID"),
        F.col("ip").alias(" Source IP"),
        F.concat_ws(".", F.col("l_suppkey") % 256, F.lit("0.0"), F.col("l_linenumber")).alias(
            " Destination IP"
        ),
        F.when(F.col("l_returnflag") == "N", F.lit("n/a"))
        .otherwise(F.col("l_quantity").cast("string"))
        .alias(" Destination Port"),
    )
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    # A second kind of file: other names first, without blanks, and with labels.
    more = raw.select(
        F.when(F.col("Flow ID") % 2 == 0, "even").otherwise("odd").alias("Label"),
        *[F.col(c).alias(c.strip()) for c in reversed(raw.columns)],
    )
    more.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    flows = read_flows(spark, path)
    return flows.groupBy("label", "src_ip", "dst_ip", "port").agg(F.count(F.lit(1)).alias("n_rows"))


def freq_filter(spark, sf):
    return ops.frequency_filter(src.flow_rows(spark, sf), min_port=MIN_PORT, min_dst=MIN_DST)


def value_counts(spark, sf):
    return ops.value_counts(src.flow_rows(spark, sf), "port")


def distinct_counts(spark, sf):
    return ops.distinct_counts(src.flow_rows(spark, sf), ["src_ip", "dst_ip", "port"])


def filter_report(spark, sf):
    return ops.frequency_report(src.flow_rows(spark, sf), min_port=MIN_PORT, min_dst=MIN_DST)


def flow_windows(spark, sf):
    """Cells of blocks of 2,000 filtered flow rows and of five equal blocks, by the verb."""
    rows = src.flow_rows(spark, sf)
    kwargs = {"min_port": MIN_PORT, "min_dst": MIN_DST}
    by_size = flow_sets(rows, (50, 50, 50), ORDER, window_size=2000, **kwargs)
    by_number = flow_sets(rows, (50, 50, 50), ORDER, n_windows=5, **kwargs)
    named = lambda df, how: df.select(F.lit(how).alias("how"), "set_id", "cell")
    return named(by_size, "size").unionByName(named(by_number, "number"))


def row_positions(spark, sf):
    return row_index(src.event_rows(spark, sf).select("event_id", "ts"), ["ts", "event_id"]).select(
        "event_id", "rn"
    )


def window_cells(spark, sf):
    """Cells of consecutive blocks of 1,000 events in time order."""
    placed = count_windows(src.event_rows(spark, sf), ["ts", "event_id"], 1000)
    coords = ["src_ip", "dst_ip", "port"]
    return grid_cells(placed, "window_no", coords, src.EVENT_SHAPE).distinct()


def first_windows(spark, sf):
    """Exactly seven equal windows; the rows of the short eighth are left out."""
    placed = split_windows(src.event_rows(spark, sf), ["ts", "event_id"], 7)
    return placed.groupBy("window_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("min_id")
    )


def halves_jaccard(spark, sf):
    """Exact similarity of the first and second half of the filtered flow log."""
    sets = flow_sets(
        src.flow_rows(spark, sf), (50, 50, 50), ORDER, min_port=MIN_PORT, min_dst=MIN_DST
    )
    per_cell = sets.groupBy("cell").agg(
        F.max((F.col("set_id") == "a").cast("int")).alias("in_a"),
        F.max((F.col("set_id") == "b").cast("int")).alias("in_b"),
    )
    sums = per_cell.agg(
        F.sum("in_a").alias("n_a"),
        F.sum("in_b").alias("n_b"),
        F.sum(F.col("in_a") * F.col("in_b")).alias("inter"),
    )
    return sums.withColumn("exact", F.round(exact_ratio("inter", "n_a", "n_b"), 9))


def dedup_rows(spark, sf):
    """First line per (order, supplier) in line and part order."""
    rows = src.flow_rows(spark, sf)
    return ops.first_per_key(rows, ["src_ip", "dst_ip"], ["l_linenumber", "port"])


KEPT_SQL = f"""{src.FLOW_ROWS_SQL},
      by_port AS (SELECT * FROM flow_rows WHERE port IN
        (SELECT port FROM flow_rows GROUP BY 1 HAVING count(*) > {MIN_PORT})),
      kept AS (SELECT * FROM by_port WHERE dst_ip IN
        (SELECT dst_ip FROM by_port GROUP BY 1 HAVING count(*) > {MIN_DST}))"""

_COUNTS = """count(*) AS n_rows, count(DISTINCT src_ip) AS n_src_ip, count(DISTINCT dst_ip) AS n_dst_ip,
             count(DISTINCT port) AS n_port"""

QUERIES = {
    "ip_to_int": ip_numbers,
    "port_to_int": port_numbers,
    "flow_csv_scan": flow_csv_scan,
    "freq_filter": freq_filter,
    "value_counts": value_counts,
    "distinct_counts": distinct_counts,
    "filter_report": filter_report,
    "row_index": row_positions,
    "count_windows": window_cells,
    "first_windows": first_windows,
    "flow_windows": flow_windows,
    "halves_jaccard": halves_jaccard,
    "dedup_rows": dedup_rows,
}

SQL = {
    "ip_to_int": f"""WITH raw AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {RAW_IP_SQL} AS ip FROM lineitem)
      SELECT *, {IP_SQL} AS ip_int FROM raw""",
    "port_to_int": """
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CASE WHEN l_linenumber = 2 THEN 0 ELSE trunc(l_quantity)::BIGINT END AS port
      FROM lineitem""",
    "flow_csv_scan": f"""WITH raw AS (SELECT *, {RAW_IP_SQL} AS ip FROM lineitem),
      parsed AS (SELECT l_orderkey, {IP_SQL} AS src_ip, (l_suppkey % 256) * 16777216 + l_linenumber AS dst_ip,
                 CASE WHEN l_returnflag = 'N' THEN 0 ELSE trunc(l_quantity) END::BIGINT AS port FROM raw)
      SELECT label, src_ip, dst_ip, port, count(*) AS n_rows
      FROM parsed, (VALUES (true), (false)) t(named),
           LATERAL (SELECT CASE WHEN NOT named THEN 'unknown' WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label)
      GROUP BY ALL""",
    "freq_filter": f"WITH {KEPT_SQL} SELECT src_ip, dst_ip, port, l_linenumber FROM kept",
    "value_counts": f"WITH {src.FLOW_ROWS_SQL} SELECT port, count(*) AS n_rows FROM flow_rows GROUP BY 1",
    "distinct_counts": f"WITH {src.FLOW_ROWS_SQL} SELECT {_COUNTS} FROM flow_rows",
    "filter_report": f"""WITH {KEPT_SQL} SELECT 'raw' AS stage, {_COUNTS} FROM flow_rows
      UNION ALL SELECT 'kept', {_COUNTS} FROM kept""",
    "row_index": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events",
    "count_windows": f"""WITH {src.EVENT_ROWS_SQL},
      placed AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS set_id
                 FROM event_rows)
      SELECT DISTINCT set_id, {src.event_cell_sql()} AS cell FROM placed""",
    "first_windows": """WITH placed AS (
        SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)
               // ((SELECT count(*) FROM events) // 7) AS window_no FROM events)
      SELECT window_no, count(*) AS n_rows, min(event_id) AS min_id FROM placed
      WHERE window_no < 7 GROUP BY 1""",
    "halves_jaccard": f"""WITH {KEPT_SQL},
      placed AS (SELECT *, row_number() OVER (ORDER BY src_ip, l_linenumber, port, dst_ip) - 1 AS rn
                 FROM kept),
      cells AS (SELECT DISTINCT rn < (SELECT count(*) FROM kept) // 2 AS first_half,
                  ((src_ip % 50) * 50 + dst_ip % 50) * 50 + port % 50 AS cell FROM placed),
      per_cell AS (SELECT cell, max(first_half::INT) AS in_a, max((NOT first_half)::INT) AS in_b
                   FROM cells GROUP BY 1),
      s AS (SELECT sum(in_a)::BIGINT AS n_a, sum(in_b)::BIGINT AS n_b, sum(in_a * in_b)::BIGINT AS inter
            FROM per_cell)
      SELECT *, round(inter::DOUBLE / (n_a + n_b - inter), 9) AS exact FROM s""",
    "flow_windows": f"""WITH {KEPT_SQL},
      placed AS (SELECT *, row_number() OVER (ORDER BY src_ip, l_linenumber, port, dst_ip) - 1 AS rn,
                   ((src_ip % 50) * 50 + dst_ip % 50) * 50 + port % 50 AS cell FROM kept),
      numbered AS (SELECT 'size' AS how, rn // 2000 AS w, cell FROM placed
                   UNION SELECT 'number', rn // ((SELECT count(*) FROM kept) // 5), cell FROM placed
                         WHERE rn < 5 * ((SELECT count(*) FROM kept) // 5))
      SELECT how, 'w' || CASE WHEN w < 1000 THEN lpad(w::VARCHAR, 3, '0') ELSE w::VARCHAR END AS set_id, cell FROM numbered""",
    "dedup_rows": f"""WITH {src.FLOW_ROWS_SQL}
      SELECT src_ip, dst_ip, port, l_linenumber FROM flow_rows
      QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY l_linenumber, port) = 1""",
}
