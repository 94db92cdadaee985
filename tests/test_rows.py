"""Filters, positions, windows, ranks, run tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridkin.operators import cells as cell_ops
from gridkin.operators import filters, runs, windows
from gridkin.operators.ranking import average_ranks, newest_per_group, row_index, running_total
from gridkin.operators.projection import project_sets, projection_feasibility
from gridkin.operators.sizing import parameter_sizes
from gridkin.operators.storage import shared_folder
from gridkin.plans.flows import filtered_shape, flow_sets


def shuffled(spark, n=1000, seed=1):
    order = np.random.default_rng(seed).permutation(n)
    return spark.createDataFrame([(int(i), int(i) // 10) for i in order], "id long, grp long")


def test_row_index_is_dense_and_ordered(spark):
    got = row_index(shuffled(spark), ["id"]).collect()
    assert len(got) == 1000 and all(r.rn == r.id for r in got)


def test_row_index_descending_and_empty(spark):
    got = row_index(shuffled(spark, 50), [F.desc("id")]).collect()
    assert all(r.rn == 49 - r.id for r in got)
    assert row_index(shuffled(spark).where("id < 0"), ["id"]).count() == 0


def test_positions_never_sort_in_one_task(spark):
    plan = row_index(shuffled(spark), ["id"])._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Window")[0]
    assert "SinglePartition" not in above


def test_running_total_and_average_ranks(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 5.0), ("h", 2.0)], "k string, v double")
    got = {(r.k, r.v): r["rank"] for r in average_ranks(df, ["k"], "v").collect()}
    assert got == {("g", 1.0): 1.0, ("g", 2.0): 2.5, ("g", 5.0): 4.0, ("h", 2.0): 1.0}
    total = running_total(shuffled(spark, 100), ["id"], "id").collect()
    assert all(r.before == r.id * (r.id - 1) // 2 for r in total)


@pytest.mark.parametrize(("n", "size"), [(1500, 300), (1000, 300), (5, 10)])
def test_count_windows(spark, n, size):
    got = windows.count_windows(shuffled(spark, n), ["id"], size).groupBy("window_no").count().collect()
    assert len(got) == -(-n // size)
    assert {r["window_no"]: r["count"] for r in got}[len(got) - 1] == n - (len(got) - 1) * size


def test_split_windows_drop_the_short_tail(spark):
    got = windows.split_windows(shuffled(spark, 103), ["id"], 10).groupBy("window_no").count().collect()
    assert sorted((r["window_no"], r["count"]) for r in got) == [(i, 10) for i in range(10)]


def test_halves(spark):
    got = windows.halves(shuffled(spark, 7), ["id"]).collect()
    assert {r.id for r in got if r.half == "a"} == {0, 1, 2}


def test_frequency_filter_is_strict_and_sequential(spark):
    # Port 1 has 11 rows, port 2 has 10; destination 7 reaches its count only with port 2.
    data = [(i, 7, 1) for i in range(6)] + [(i, 8, 1) for i in range(5)] + [(i, 7, 2) for i in range(10)]
    df = spark.createDataFrame(data, "src_ip long, dst_ip long, port long")
    kept = filters.frequency_filter(df, min_port=10, min_dst=5)
    assert kept.count() == 6 and kept.where("dst_ip <> 7 or port <> 1").count() == 0
    assert filters.frequency_filter(df, min_port=11, min_dst=0).count() == 0
    report = {r.stage: r.n_rows for r in filters.filter_report(df, kept).collect()}
    assert report == {"raw": 21, "kept": 6}


def test_first_per_key(spark, rows):
    df = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 9, None)], "k int, o int, v string")
    assert rows(filters.first_per_key(df, ["k"], ["o"])) == [(1, 2, "y"), (2, 9, None)]


def test_flow_sets(spark):
    rng = np.random.default_rng(9)
    data = [(i, *map(int, rng.integers(0, 15, 3))) for i in range(1500)]
    flows = spark.createDataFrame(data, "ts long, src_ip long, dst_ip long, port long")
    shape = (15, 15, 15)
    sets = flow_sets(flows, shape, ["ts"], window_size=300, min_port=None)
    want = {}
    for ts, s, d, p in data:
        want.setdefault(f"w{ts // 300:03d}", set()).add((s * 15 + d) * 15 + p)
    got = {}
    for r in sets.collect():
        assert r.cell not in got.setdefault(r.set_id, set())
        got[r.set_id].add(r.cell)
    assert got == want
    assert flow_sets(flows, shape, ["ts"], min_port=None).select("set_id").distinct().count() == 2
    assert flow_sets(flows, shape, ["ts"], n_windows=7, min_port=None).select("set_id").distinct().count() == 7
    assert filtered_shape(flows) == shape


def test_set_algebra(spark, rows):
    base = spark.createDataFrame([(1, 1), (1, 2)], "set_id long, cell long")
    add = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "set_id long, cell long")
    drop = spark.createDataFrame([(1, 1)], "set_id long, cell long")
    assert rows(cell_ops.perturb(base, add, drop)) == [(1, 2), (1, 3), (2, 9)]
    weighted = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5), (1, 3, -1.0)], "set_id long, cell long, value double")
    assert rows(cell_ops.active_cells(weighted)) == [(1, 2)]
    assert rows(cell_ops.set_profile(base, (2, 5))) == [(1, 2, 10, 0.2)]


def test_parameter_sizes(spark):
    df = spark.createDataFrame([([10, 10, 10],), ([100, 100, 100],), ([5, 6, 7],), ([9],)], "shape array<int>")
    got = {tuple(r.shape): r for r in parameter_sizes(df, 128, 4).collect()}
    assert got[100, 100, 100].compression_ratio == 3333
    assert got[100, 100, 100].kron_params == 38_400
    assert got[100, 100, 100].tt_params == 307_200
    assert got[100, 100, 100].full_bytes == 512_000_000
    assert got[10, 10, 10].compression_ratio == 33
    assert got[5, 6, 7].total_cells == 210
    assert got[9,].tt_params == 9 * 128
    feasible = projection_feasibility(df.union(spark.createDataFrame([([200, 200, 200],)], "shape array<int>")), 128)
    assert {tuple(r.shape): r.feasible for r in feasible.collect()}[200, 200, 200] is False


def test_projection_refuses_large_grids(spark):
    cells = spark.createDataFrame([(1, 1)], "set_id long, cell long")
    with pytest.raises(ValueError, match="MB"):
        project_sets(cells, (200, 200, 200), 128)


def test_leaderboard_and_recent(spark):
    data = [("r", i, float(10 - i)) for i in range(5)] + [("r", 9, None), ("q", 1, 2.0)]
    board = runs.leaderboard(spark.createDataFrame(data, "race string, run long, elapsed_s double"), ["race"], "run")
    medals = {(r.race, r.run): r.medal for r in board.collect()}
    assert medals["r", 4] == "🥇" and medals["r", 2] == "🥉" and medals["r", 0] == medals["r", 9] == "4th"
    assert medals["q", 1] == "🥇" and len(medals) == 7
    stamped = spark.createDataFrame([(100,), (399,), (400,), (701,)], "timestamp long")
    assert [r.timestamp for r in runs.recent_runs(stamped, F.lit(400), 300).collect()] == [399, 400]
    points = shuffled(spark, 700)
    kept = newest_per_group(points.withColumn("g", F.lit(1)), ["g"], [F.desc("id")], 300)
    assert kept.count() == 300 and kept.agg(F.min("id")).first()[0] == 400


def test_nearby_join_matches_plain_condition(spark, rows):
    rng = np.random.default_rng(0)
    left = spark.createDataFrame([(i, int(t)) for i, t in enumerate(rng.integers(-500, 5000, 80))], "l long, lt long")
    right = spark.createDataFrame([(i, int(t)) for i, t in enumerate(rng.integers(-500, 5000, 80))], "r long, rt long")
    got = rows(runs.nearby_join(left, right, "lt", "rt", 180).select("l", "r"))
    want = rows(left.crossJoin(right).where("abs(lt - rt) < 180").select("l", "r"))
    assert got == want and len(got) == len(set(got))


def test_series_table(spark, rows):
    points = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7), (2, "b", 0.9)], "t int, algo string, cpu double")
    assert rows(runs.series_table(points, "cpu", algos=["a", "b"]).orderBy("t").fillna(-1)) == [
        (1, 0.5, 0.7), (2, -1.0, 0.9)]


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stored_intermediates_can_be_removed(spark, tmp_path, monkeypatch):
    from gridkin.operators import storage

    assert storage.stored_folder(spark).endswith(spark.sparkContext.applicationId)
    monkeypatch.setattr(storage, "stored_folder", lambda s: str(tmp_path / "own"))
    storage.write_and_read(spark.range(3), "numbers")
    assert list((tmp_path / "own").glob("numbers-*"))
    storage.remove_stored(spark)
    assert not (tmp_path / "own").exists()


def test_missing_table_raises(spark):
    with pytest.raises(AnalysisException):
        spark.read.parquet("/nonexistent/pairs")


def test_leaderboard_with_repeated_ids_and_null_race(spark):
    from gridkin.operators.runs import leaderboard

    rows = [("r", "x", 1.0), ("r", "x", 2.0), ("r", "y", None), (None, "z", 5.0), ("r", "w", 3.0)]
    df = spark.createDataFrame(rows, "race string, run string, elapsed_s double")
    got = leaderboard(df, ["race"], "run").collect()
    assert len(got) == len(rows)
    by_time = {(r.race, r.elapsed_s): r.medal for r in got}
    assert len({by_time["r", t] for t in (1.0, 2.0, 3.0, None)}) == 4
    assert by_time[None, 5.0] == by_time["r", 1.0]


def test_leaderboard_ranks_three_rows_a_race_and_task(spark):
    runs_table = spark.range(1000).selectExpr("id % 2 AS race", "id AS run", "cast(id % 7 AS double) AS elapsed_s")
    board = runs.leaderboard(runs_table, ["race"], "run")
    assert "WindowGroupLimit" in board._jdf.queryExecution().executedPlan().toString()
    best = board.where("medal <> '4th'").collect()
    assert sorted((r.race, r.run) for r in best) == [(0, 0), (0, 14), (0, 28), (1, 7), (1, 21), (1, 35)]
    assert board.count() == 1000 and board.columns == ["race", "run", "elapsed_s", "medal"]


def test_a_burst_is_spread(spark, rows, monkeypatch):
    monkeypatch.setattr(runs, "HOT_SLOT", 10)
    left = spark.range(200).selectExpr("id AS l", "1000 + id % 5 AS lt", "id % 2 AS k")
    right = spark.range(60).selectExpr("id AS r", "700 + 10 * id AS rt", "id % 2 AS k")
    joined = runs.nearby_join(left, right, "lt", "rt", 180, ["k"])
    assert joined.columns == runs.nearby_join(left.limit(3), right, "lt", "rt", 180, ["k"]).columns
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    want = left.join(right, "k").where("abs(lt - rt) < 180")
    assert rows(joined.select("l", "r", "k")) == rows(want.select("l", "r", "k"))


def test_filters_read_the_rows_twice(spark, tmp_path, rows):
    data = [(i, i % 7 if i % 3 else None, i % 5, i) for i in range(500)]
    spark.createDataFrame(data, "src_ip long, port long, dst_ip long, n long").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    kept = filters.frequency_filter(table, min_port=47, min_dst=38)
    by_steps = filters.keep_frequent(filters.keep_frequent(table, "port", 47), "dst_ip", 38)
    assert rows(kept.select(*table.columns)) == rows(by_steps.select(*table.columns)) and 0 < kept.count() < 500
    report = filters.frequency_report(table, min_port=47, min_dst=38)
    assert rows(report) == rows(filters.filter_report(table, by_steps))
    for made in (kept, report):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert plan.count(str(tmp_path / "t")) == 1  # and once before, to count
