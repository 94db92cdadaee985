from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.operators.accuracy import accuracy_metrics, error_summary, sample_pairs
from gridkin.operators.families import ClassicFamily, KronFamily, TTFamily
from gridkin.plans.evaluation import evaluate
from gridkin.streaming.runs import live_standings, stream_run_metrics
from gridkin.streaming.signatures import windowed_minima


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    exact = np.round(rng.random(400), 2)
    est = np.round(np.clip(exact + rng.normal(0, 0.1, 400), 0, 1) * 32) / 32
    df = spark.createDataFrame([("s", "m", float(e), float(t)) for e, t in zip(est, exact, strict=True)],
                               "scope string, method string, est double, exact double")
    row = accuracy_metrics(df).first()

    def ranks(x):
        order = np.argsort(x, kind="stable")
        out = np.empty(len(x))
        out[order] = np.arange(1, len(x) + 1)
        return np.array([out[x == v].mean() for v in x])

    assert row.mae == pytest.approx(np.abs(est - exact).mean())
    assert row.rmse == pytest.approx(np.sqrt(((est - exact) ** 2).mean()))
    assert row.pearson_r == pytest.approx(np.corrcoef(est, exact)[0, 1])
    assert row.spearman_r == pytest.approx(np.corrcoef(ranks(est), ranks(exact))[0, 1])
    assert (row.n_pairs, row.min_exact, row.max_exact) == (400, exact.min(), exact.max())
    summary = error_summary(df).first()
    assert summary.max_error == pytest.approx(np.abs(est - exact).max())


def test_flat_estimates_have_no_correlation(spark):
    df = spark.createDataFrame([("s", "m", 0.5, x / 10) for x in range(5)],
                               "scope string, method string, est double, exact double")
    row = accuracy_metrics(df).first()
    assert (row.pearson_r, row.spearman_r) == (0.0, 0.0)


@pytest.mark.parametrize(("n", "wanted", "expect"), [(6, 100, 15), (20, 100, 100), (100, 50, 50), (1, 5, 0), (6, 14, 14)])
def test_sample_pairs(spark, n, wanted, expect):
    ids = spark.createDataFrame([(10 * i,) for i in range(n)], "set_id long")
    got = [tuple(r) for r in sample_pairs(ids, wanted, 7).collect()]
    assert len(got) == len(set(got)) == expect
    assert all(a < b and a % 10 == 0 and b <= 10 * (n - 1) for a, b in got)
    assert sorted(got) == sorted(tuple(r) for r in sample_pairs(ids, wanted, 7).collect())


def test_three_scopes_reach_the_rank_target(spark):
    """High, medium and low overlap; combined rank correlation above 0.85 for every family."""
    rng = np.random.default_rng(0)
    shape, total, size = (25, 25, 25), 25**3, 1200
    keep = {"high": (0.85, 0.98), "medium": (0.4, 0.8), "low": (0.0, 0.3)}
    sets, pairs = [], []
    for scope, (lo, hi) in keep.items():
        for _ in range(15):
            pool = rng.choice(total, 2 * size, replace=False)
            shared = int(size * rng.uniform(lo, hi))
            a, b = f"{scope}{len(pairs)}a", f"{scope}{len(pairs)}b"
            sets += [(a, sorted(map(int, pool[:size]))), (b, sorted(map(int, np.r_[pool[:shared], pool[size : 2 * size - shared]])))]
            pairs.append((a, b, scope))
    table = spark.createDataFrame(sets, "set_id string, cells array<bigint>")
    scoped = spark.createDataFrame(pairs, "a string, b string, scope string")
    families = [ClassicFamily(128), KronFamily(128, 0, shape), TTFamily(128, 0, shape)]
    got = {(r.scope, r.method): r for r in evaluate(table, families, pairs=scoped).collect()}
    assert len(got) == 12
    for method in ("classic", "kron", "tt"):
        assert got["combined", method].spearman_r > 0.85
        assert got["combined", method].mae < 0.08
    assert got["high", "kron"].min_exact > 0.60 and got["low", "kron"].max_exact < 0.40
    sampled = evaluate(table, families[:1], n_pairs=40).first()
    assert sampled.n_pairs == 40 and sampled.scope == "combined"


def test_stream_equals_batch(spark, tmp_path):
    family = ClassicFamily(4)
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", h % 2, (h * 60 + m) * 7 % 101) for h in range(4) for m in range(0, 60, 3)]
    batch = spark.createDataFrame(rows, "ts string, set_id long, cell long").selectExpr(
        "cast(ts as timestamp) ts", "set_id", "cell")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        windowed_minima(stream, family).writeStream.format("memory").queryName("minima")
        .outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("minima").collect()))
    assert got == sorted(map(tuple, windowed_minima(batch, family).collect())) and len(got) == 16


@pytest.mark.parametrize(("window", "slide"), [("1 hour", None), ("1 hour", "20 minutes"), ("50 minutes", "30 minutes")])
def test_windows_over_panes_equal_windows_over_cells(spark, window, slide):
    family = KronFamily(3, 1, (11, 11))
    rows = [(f"2024-01-01 0{h}:{m:02d}:17", h % 2, (h * 60 + m) * 7 % 101) for h in range(4) for m in range(0, 60, 7)]
    cells = spark.createDataFrame(rows, "ts string, set_id long, cell long").selectExpr("cast(ts as timestamp) ts", "set_id", "cell")
    got = windowed_minima(cells, family, window=window, slide=slide).collect()
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    want = {}
    kernel = family.kernel()
    kernel.prepare()
    for r in cells.select(span.alias("w"), "set_id", "cell").collect():
        ranks = kernel.ranks(np.array([r.cell]))[:, 0]
        for plane in range(3):
            key = (r.w.start, r.set_id, plane)
            want[key] = min(want.get(key, (np.inf, 0)), (ranks[plane], r.cell))
    assert {(r.window_start, r.set_id, r.plane): r.cell for r in got} == {k: c for k, (_, c) in want.items()}


def test_live_standings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, algo in enumerate(["kron", "kron", "tt"]):
        (tmp_path / "in" / f"{algo}_{i}_metrics.json").write_text(
            f'{{"algo": "{algo}", "load_level": 1, "elapsed_s": {i + 1}.0, "mae": 0.1}}')
    (tmp_path / "in" / "bad_9_metrics.json").write_text("{")
    runs = stream_run_metrics(spark, str(tmp_path / "in"))
    query = (
        live_standings(runs).writeStream.format("memory").queryName("standings").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r.algo: (r.n_runs, r.best_s) for r in spark.table("standings").where("algo is not null").collect()}
    assert got == {"kron": (2, 1.0), "tt": (1, 3.0)}


def test_a_larger_sample_holds_the_smaller_one(spark):
    ids = spark.range(8).withColumnRenamed("id", "set_id")
    small, large = ({tuple(r) for r in sample_pairs(ids, n, 3).collect()} for n in (9, 27))
    assert len(small) == 9 and len(large) == 27 and small <= large
