"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the local cores.
Signature throughput is reported in sets per second with 128 planes over whole documents, including the
scan and the shingling, beside the plain seconds of every query, and the accuracy of the estimates.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridkin import catalog  # noqa: E402
from gridkin.catalog import inputs  # noqa: E402
from gridkin.operators.families import ClassicFamily, KronFamily, TTFamily  # noqa: E402
from gridkin.operators.signatures import signatures  # noqa: E402
from gridkin.sources.tables import document_sets  # noqa: E402

HEADLINE = (
    "near_duplicates",
    "lsh_candidates",
    "exact_jaccard",
    "all_pairs_threshold",
    "classic_signature_long",
    "freq_filter",
    "row_index",
    "count_windows",
    "halves_jaccard",
    "poly_hash_cells",
    "accuracy_by_scope",
    "pair_report",
    "recent_points",
    "leaderboard",
    "run_report",
)
SHAPE = (64, 64, 64)
SHORT_S = 6


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    documents = inputs.table(spark, sf_dir, "documents")
    n_docs = documents.count()

    families = {
        "signatures_classic": ClassicFamily(128),
        "signatures_kron": KronFamily(128, 42, SHAPE),
        "signatures_tt": TTFamily(128, 42, SHAPE),
    }
    grid_sets = document_sets(documents, n_cells=64**3)
    jobs = {
        name: (lambda family=family: signatures(grid_sets, family)) for name, family in families.items()
    }
    registered = catalog.all_queries()
    jobs |= {name: (lambda q=registered[name]: q(spark, sf_dir)) for name in HEADLINE}

    # Start the Python workers and load classes before the clock runs.
    signatures(grid_sets.limit(100), ClassicFamily(8)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, job in jobs.items():
        runs = []
        # Short ones vary most: the median of three.
        while not runs or (len(runs) < 3 and runs[0] < SHORT_S):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    accuracy = [
        {"scope": r.scope, "method": r.method, "mae": r.mae, "spearman": r.spearman_r}
        for r in registered["accuracy_by_scope"](spark, sf_dir).orderBy("scope", "method").collect()
    ]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "accuracy": accuracy,
                "sets_per_sec": {name: round(n_docs / seconds[name], 1) for name in families},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
