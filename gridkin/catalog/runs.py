"""Run tables: leaderboards, series, telemetry, logs and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridkin.catalog import inputs as src
from gridkin.functions.compare import epoch_label, shape_label
from gridkin.operators import runs as ops
from gridkin.operators.accuracy import throughput
from gridkin.operators.storage import scratch_path
from gridkin.plans.runs import run_report
from gridkin.sources import pairs as pair_files
from gridkin.sources import runs as files

EPOCH_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
# Noon of 15 January 2024.
MOMENT = 1705320000


def _events(spark, sf):
    events = src.table(spark, sf, "events")
    return events.select(
        "event_id", "user_id", "event_type", "value", F.expr(EPOCH_SECONDS).alias("timestamp")
    )


def leaderboard(spark, sf):
    """Orders of a customer raced by price; pending orders have no time."""
    orders = src.table(spark, sf, "orders")
    elapsed = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 1000, 3))
    runs = orders.select("o_custkey", "o_orderkey", elapsed.alias("elapsed_s"))
    return ops.leaderboard(runs, ["o_custkey"], "o_orderkey")


def recent_points(spark, sf):
    """The newest 300 lines of every supplier."""
    lines = src.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"
    )
    order = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_partkey"), F.desc("l_linenumber")]
    return ops.recent_points(lines, ["l_suppkey"], order).drop("l_shipdate")


def proximity_join(spark, sf):
    """Errors and purchases of the same user less than an hour apart."""
    events = _events(spark, sf)
    left = events.where(F.col("event_type") == "error").select(
        "user_id", F.col("event_id").alias("error_id"), F.col("timestamp").alias("error_ts")
    )
    right = events.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("timestamp").alias("purchase_ts")
    )
    return ops.nearby_join(left, right, "error_ts", "purchase_ts", 3600, ["user_id"])


def recent_runs(spark, sf):
    return ops.recent_runs(_events(spark, sf), F.lit(MOMENT), 86400)


def series_pivot(spark, sf):
    """Number of events per hour of the month, one column per type."""
    hour = F.call_function("div", F.col("timestamp"), F.lit(3600).cast("long"))
    points = _events(spark, sf).groupBy(hour.alias("t"), F.col("event_type").alias("algo")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return ops.series_table(points, "n", algos=src.EVENT_TYPES)


def _log_lines(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    seconds = F.format_string("%.2f", F.col("l_quantity"))
    text = (
        F.when(F.col("l_linenumber") == 1, F.lit("worker started"))
        .when(
            F.col("l_linenumber") == 7,
            F.concat(F.lit("DONE: algo=kron load_level=7 elapsed="), seconds, F.lit("s mae=0.0"),
                     F.col("l_suppkey").cast("string")),
        )
        .when(
            (F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"),
            F.lit("OOM: algo=minhash score_matrix=1KB"),
        )
        .otherwise(
            F.concat(F.lit("  PROGRESS: "), F.col("l_linenumber").cast("string"), F.lit("/8 pairs  elapsed="),
                     seconds, F.lit("s"))
        )
    )
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    return lines.select(
        F.col("l_suppkey").alias("source"), number.alias("line_no"), text.alias("line")
    )


def log_parse(spark, sf):
    """Latest state of every supplier's worker log."""
    return ops.last_progress(_log_lines(spark, sf))


def race_summary(spark, sf):
    return ops.race_summary(_events(spark, sf), ["user_id"], "timestamp")


def run_throughput(spark, sf):
    """Lines per second if an order's total were its seconds."""
    lines = src.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_sets"), F.sum(F.col("l_linenumber")).cast("double").alias("elapsed_s")
    )
    return throughput(lines).withColumns(
        {c: F.round(c, 6) for c in ("sets_per_sec", "per_set_ms")}
    )


def _metrics(spark, sf):
    """Events as runs: method by user, level by day part."""
    events = _events(spark, sf)
    seconds = F.round("value", 2)
    return events.select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("algo"),
        (F.col("event_id") % 10 + 1).cast("int").alias("load_level"),
        F.array(F.lit(30), F.lit(30), F.lit(30)).alias("shape"),
        (F.col("user_id") % 50).cast("int").alias("n_pairs"),
        F.lit(256).alias("num_hashes"),
        seconds.alias("elapsed_s"),
        F.lit(0.02).alias("mae"),
        F.lit(0.05).alias("max_error"),
        F.col("event_id").alias("memory_kb"),
        "timestamp",
        F.array(
            F.struct(
                F.col("event_id").cast("string").alias("pair"), F.lit(0.5).alias("exact"),
                seconds.alias("minhash"),
            )
        ).alias("pairs"),
    )


def run_metrics_scan(spark, sf):
    """Runs written as JSON by method and read back with the declared schema."""
    path = scratch_path(spark, "runs")
    files.write_run_metrics(_metrics(spark, sf), path)
    back = files.read_run_table(spark, path)
    return back.select(
        "algo", "load_level", shape_label("shape").alias("shape"), "n_pairs", "elapsed_s", "memory_kb",
        "timestamp", F.get("pairs", F.lit(0))["pair"].alias("first_pair"),
        F.get("pairs", F.lit(0))["kron"].alias("first_kron"),
    )


def _telemetry(spark, sf):
    """Per user all events of each type as time series, in the form of telemetry files."""
    points = _events(spark, sf).select(
        F.col("user_id").cast("string").alias("race_id"),
        F.col("event_type").alias("algo"),
        F.col("timestamp").cast("double").alias("t"),
        F.round("value", 2).alias("cpu"),
        F.col("event_id").cast("double").alias("ram"),
    )
    series = points.groupBy("race_id", "algo").agg(
        F.array_sort(F.collect_list(F.struct("t", "cpu", "ram"))).alias("points"),
        F.max("t").alias("last"),
    )
    entry = F.struct("algo", "points")
    final = F.struct("algo", F.struct(F.col("last").alias("elapsed_s"), F.lit(0.1).alias("mae")))
    return series.groupBy("race_id").agg(
        F.max("last").cast("long").alias("timestamp"),
        F.array_sort(F.collect_list("algo")).alias("algos"),
        F.map_from_entries(F.collect_list(entry)).alias("telemetry"),
        F.map_from_entries(F.collect_list(final)).alias("final"),
    )


def _stored_telemetry(spark, sf):
    path = scratch_path(spark, "telemetry")
    files.write_telemetry(_telemetry(spark, sf), path)
    return files.read_telemetry_table(spark, path)


def telemetry_points(spark, sf):
    """Telemetry written as JSON, read back and flattened."""
    return ops.telemetry_points(_stored_telemetry(spark, sf))


def telemetry_files(spark, sf):
    """Telemetry as one JSON file per record, all found below a folder and flattened."""
    path = scratch_path(spark, "telemetry-files")
    _telemetry(spark, sf).write.option("maxRecordsPerFile", 1).json(path)
    return ops.telemetry_points(files.read_telemetry(spark, path, "*.json"))


def run_files(spark, sf):
    """Nations as runs over their suppliers' accounts, one JSON file each, beside files that cannot be read."""
    path = scratch_path(spark, "run-files")
    supplier = src.table(spark, sf, "supplier")
    nations = supplier.groupBy("s_nationkey").agg(
        F.count(F.lit(1)).cast("int").alias("n_pairs"),
        F.round(F.max("s_acctbal"), 2).cast("double").alias("elapsed_s"),
        F.min("s_suppkey").alias("timestamp"),
    )
    runs = nations.select(F.concat(F.lit("n"), "s_nationkey").alias("algo"), "n_pairs", "elapsed_s", "timestamp")
    runs.write.option("maxRecordsPerFile", 1).json(path)
    supplier.select(F.lit("{").alias("value")).distinct().write.mode("append").text(f"{path}/broken.json")
    return files.read_run_metrics(spark, path, "*").where(F.col("algo").isNotNull()).select(
        "algo", "n_pairs", "elapsed_s", "timestamp"
    )


def final_results(spark, sf):
    return ops.final_results(_stored_telemetry(spark, sf))


def run_history(spark, sf):
    """Telemetry records with the runs stamped near them, ranked."""
    path = scratch_path(spark, "runs")
    files.write_run_metrics(_metrics(spark, sf), path)
    metrics = files.read_run_table(spark, path).withColumn("_file", F.col("memory_kb"))
    out = run_report(metrics, _stored_telemetry(spark, sf))
    return out.select(
        "race_id", "race_ts", "run_time", "duration", "algo", "shape", "n_pairs", "elapsed_s", "run_ts",
        "run_file", "medal",
    )


def manifest_labels(spark, sf):
    """Pair labels through a manifest: nations by region, in order."""
    nations = src.table(spark, sf, "nation").join(
        src.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    label = F.struct(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", label.alias("label"))))
    manifest = nations.groupBy().agg(F.transform(ordered, lambda s: s["label"]).alias("pair_labels"))
    path = scratch_path(spark, "manifest")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    labels = pair_files.pair_labels(pair_files.read_manifest(spark, path))
    suppliers = src.table(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 30).alias("pair_no")
    )
    return pair_files.label_pairs(suppliers, labels)


def display_times(spark, sf):
    """Local time of each user's first event."""
    return ops.race_summary(_events(spark, sf), ["user_id"], "timestamp").select(
        "user_id", epoch_label("started").alias("started")
    )


_EVENTS_SQL = """
      ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS timestamp FROM events)"""

_POINTS_SQL = f"""{_EVENTS_SQL},
      points AS (SELECT user_id::VARCHAR AS race_id, event_type AS algo, timestamp::DOUBLE AS t,
                        round(value, 2) AS cpu, event_id::DOUBLE AS ram FROM ev)"""

_LOG_SQL = """
      logs AS (
        SELECT l_suppkey AS source, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS line_no,
          CASE WHEN l_linenumber = 1 THEN 'worker started'
               WHEN l_linenumber = 7 THEN 'DONE: algo=kron load_level=7 elapsed='
                 || printf('%.2f', l_quantity) || 's mae=0.0' || l_suppkey
               WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'OOM: algo=minhash score_matrix=1KB'
               ELSE '  PROGRESS: ' || l_linenumber || '/8 pairs  elapsed=' || printf('%.2f', l_quantity)
                 || 's' END AS line
        FROM lineitem),
      newest AS (SELECT source, trim(line) AS line FROM logs
                 WHERE regexp_matches(line, 'PROGRESS:|DONE:|OOM:')
                 QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no DESC) = 1)"""

QUERIES = {
    "leaderboard": leaderboard,
    "recent_points": recent_points,
    "proximity_join": proximity_join,
    "recent_runs": recent_runs,
    "series_pivot": series_pivot,
    "log_parse": log_parse,
    "race_summary": race_summary,
    "throughput": run_throughput,
    "run_metrics_scan": run_metrics_scan,
    "telemetry_points": telemetry_points,
    "telemetry_files": telemetry_files,
    "run_files": run_files,
    "final_results": final_results,
    "run_report": run_history,
    "manifest_labels": manifest_labels,
    "display_times": display_times,
}

SQL = {
    "leaderboard": """WITH runs AS (
        SELECT o_custkey, o_orderkey,
               CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 1000, 3) END AS elapsed_s
        FROM orders),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
                   ORDER BY coalesce(elapsed_s, 999), o_orderkey) AS rn FROM runs)
      SELECT o_custkey, o_orderkey, elapsed_s, ['🥇', '🥈', '🥉', '4th'][least(rn, 4)] AS medal
      FROM ranked""",
    "recent_points": """
      SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC,
        l_partkey DESC, l_linenumber DESC) <= 300""",
    "proximity_join": f"""WITH {_EVENTS_SQL}
      SELECT e.user_id, e.event_id AS error_id, e.timestamp AS error_ts, p.event_id AS purchase_id,
             p.timestamp AS purchase_ts
      FROM ev e JOIN ev p ON e.event_type = 'error' AND p.event_type = 'purchase'
        AND e.user_id = p.user_id AND abs(e.timestamp - p.timestamp) < 3600""",
    "recent_runs": f"""WITH {_EVENTS_SQL}
      SELECT * FROM ev WHERE abs(timestamp - {MOMENT}) < 86400""",
    "series_pivot": f"""WITH {_EVENTS_SQL}
      SELECT timestamp // 3600 AS t, {', '.join(
          f"nullif(count(*) FILTER (event_type = '{t}'), 0) AS {t}" for t in src.EVENT_TYPES)}
      FROM ev GROUP BY 1""",
    "log_parse": rf"""WITH {_LOG_SQL}
      SELECT source, line,
        CASE WHEN line LIKE 'DONE:%' THEN 1.0
             WHEN line LIKE 'PROGRESS:%' THEN regexp_extract(line, 'PROGRESS:\s*(\d+)/', 1)::DOUBLE / 8
             ELSE 0.0 END AS fraction,
        CASE WHEN line LIKE 'DONE:%' THEN regexp_extract(line, 'elapsed=([\d.]+)s', 1)::DOUBLE END
          AS elapsed_s,
        CASE WHEN line LIKE 'DONE:%' THEN regexp_extract(line, 'mae=([\d.]+)', 1)::DOUBLE END AS mae,
        line LIKE '%OOM:%' AS oom
      FROM newest""",
    "race_summary": f"""WITH {_EVENTS_SQL}
      SELECT user_id, min(timestamp) AS started, max(timestamp) AS duration FROM ev GROUP BY 1""",
    "throughput": """
      SELECT l_orderkey, count(*) AS n_sets, sum(l_linenumber)::DOUBLE AS elapsed_s,
             round(count(*) / sum(l_linenumber)::DOUBLE, 6) AS sets_per_sec,
             round(sum(l_linenumber)::DOUBLE / count(*) * 1000, 6) AS per_set_ms
      FROM lineitem GROUP BY 1""",
    "run_metrics_scan": f"""WITH {_EVENTS_SQL}
      SELECT 'm' || (user_id % 3) AS algo, (event_id % 10 + 1)::INTEGER AS load_level,
             '30×30×30' AS shape, (user_id % 50)::INTEGER AS n_pairs, round(value, 2) AS elapsed_s,
             event_id AS memory_kb, timestamp, event_id::VARCHAR AS first_pair,
             NULL::DOUBLE AS first_kron
      FROM ev""",
    "telemetry_points": f"WITH {_POINTS_SQL} SELECT * FROM points",
    "telemetry_files": f"WITH {_POINTS_SQL} SELECT * FROM points",
    "run_files": """SELECT 'n' || s_nationkey AS algo, count(*)::INTEGER AS n_pairs,
             round(max(s_acctbal), 2)::DOUBLE AS elapsed_s, min(s_suppkey) AS timestamp
      FROM supplier GROUP BY s_nationkey""",
    "final_results": f"""WITH {_POINTS_SQL}
      SELECT race_id, algo, max(t) AS elapsed_s, 0.1::DOUBLE AS mae FROM points GROUP BY 1, 2""",
    "run_report": f"""WITH {_POINTS_SQL},
      races AS (SELECT race_id, max(t)::BIGINT AS race_ts, max(t) AS duration FROM points GROUP BY 1),
      runs AS (SELECT 'm' || (user_id % 3) AS algo, '30×30×30' AS shape, (user_id % 50)::INTEGER AS n_pairs,
                      round(value, 2) AS elapsed_s, timestamp AS run_ts, event_id AS run_file
               FROM ev),
      near AS (SELECT * FROM races JOIN runs ON abs(race_ts - run_ts) < 180),
      ranked AS (SELECT *, ['🥇', '🥈', '🥉', '4th'][least(4, row_number() OVER (
                   PARTITION BY race_id, race_ts ORDER BY coalesce(elapsed_s, 999), run_file))] AS medal
                 FROM near)
      SELECT race_id, race_ts, strftime(make_timestamp(race_ts * 1000000), '%Y-%m-%d %H:%M:%S') AS run_time,
             r.duration, algo, shape, n_pairs, elapsed_s, run_ts, run_file, medal
      FROM races r LEFT JOIN ranked USING (race_id, race_ts)""",
    "manifest_labels": """WITH labels AS (
        SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pair_no, n_name, r_name
        FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT s_suppkey, s_suppkey % 30 AS pair_no, coalesce(n_name, '?') AS label_a,
             coalesce(r_name, '?') AS label_b
      FROM supplier LEFT JOIN labels ON pair_no = s_suppkey % 30""",
    "display_times": f"""WITH {_EVENTS_SQL}
      SELECT user_id, strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') AS started
      FROM ev GROUP BY 1""",
}
