from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridkin.operators import filters
from gridkin.operators import runs as ops
from gridkin.operators.families import ClassicFamily, KronFamily
from gridkin.operators.runs import final_results, last_progress, telemetry_points
from gridkin.operators.sequences import kmer_cell, kmer_table, sequence_kmers, sequence_profile, sequence_sets
from gridkin.plans.batches import batch_report, batch_summary, scored_batch
from gridkin.plans.runs import run_report
from gridkin.plans.sequences import sequence_similarity
from gridkin.sources import pairs as pair_files
from gridkin.sources import runs as run_files
from gridkin.sources.fasta import read_fasta
from gridkin.sources.flows import read_flows

HEADERS = ["Source IP,Destination IP,Destination Port", " Source IP, Destination IP, Destination Port"]


@pytest.mark.parametrize("header", HEADERS)
def test_flow_csv(spark, tmp_path, header):
    (tmp_path / "f.csv").write_text(header + "\n192.168.1.1,10.0.0.1,80\nbad,192.168.1.2,x\n")
    got = read_flows(spark, str(tmp_path / "f.csv")).select("src_ip", "dst_ip", "port", "label").collect()
    assert sorted(map(tuple, got)) == [(0, 3232235778, 0, "unknown"), (3232235777, 167772161, 80, "unknown")]


def test_flow_csv_keeps_labels_and_other_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" Source IP, Destination IP, Destination Port, Label, Flow Bytes\n1.0.0.1,1.0.0.2,80.7,,5\n")
    row = read_flows(spark, str(tmp_path / "f.csv")).first()
    assert (row["label"], row["Flow Bytes"], row.port, row.src_ip_raw) == (None, "5", 80, "1.0.0.1")


def test_missing_flow_file(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_flows(spark, "/nonexistent/data.csv")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n>one first > record\nacgt\n\nNACg\n tac \n>two\n>three\r\nAC\r\nGT\r\n")
    got = {r.header: r.seq for r in read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"one first > record": "ACGTNACGTAC", "two": "", "three": "ACGT"}
    with pytest.raises(AnalysisException):
        read_fasta(spark, str(tmp_path / "none.fasta"))


def sequences(spark):
    data = [(0, "ACGTNACGTAC"), (1, "ACG"), (2, "éACGTé"), (3, ""), (4, "ACGT" * 500)]
    return spark.createDataFrame(data, "seq_id long, seq string")


def test_kmer_forms_agree(spark, rows):
    seqs = sequences(spark)
    assert rows(kmer_table(seqs, 4)) == rows(sequence_kmers(seqs, 4))
    assert [r.kmer for r in kmer_table(seqs, 4).where("seq_id = 0").orderBy("kmer").collect()] == ["ACGT", "CGTA", "GTAC"]
    cells = kmer_table(seqs, 4).select("seq_id", kmer_cell("kmer", 4, (7, 5, 3)).alias("cell")).distinct()
    fused = sequence_sets(seqs, 4, (7, 5, 3)).select("set_id", F.explode("cells"))
    assert rows(cells) == rows(fused)
    assert rows(sequence_profile(seqs, 4))[4] == (4, 2000, 4)


def test_sequence_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("ACGT"), 3000))
    near = base[:1500] + "".join(rng.choice(list("ACGT"), 1500))
    seqs = spark.createDataFrame([("h", base), ("c", near), ("z", "")], "seq_id string, seq string")
    got = {(r.set_id, r.method): r for r in sequence_similarity(seqs, "h").collect()}
    assert len(got) == 6
    for method in ("kron", "tt", "classic"):
        row = got["c", method]
        assert 0.25 < row.exact < 0.42 and row.error < 0.12 and row.pair == "h ↔ c"
        assert got["z", method].exact == 0.0
        assert row.similarity == "MED"


def test_pair_files_and_report(spark, tmp_path):
    path = str(tmp_path / "in")
    cells = [(0, "a", c) for c in range(20)] + [(0, "b", c) for c in range(20)]
    cells += [(1, "a", c) for c in range(10)] + [(1, "b", c) for c in range(5, 15)] + [(2, "a", 1)]
    table = spark.createDataFrame(cells, "pair_no long, side string, cell long")
    for _ in range(2):
        pair_files.write_pairs(table, path)
    pair_files.write_manifest(spark, path, shape=(4, 4, 4), n_pairs=3, labels=[("Human", "Chimp")])
    manifest = pair_files.read_manifest(spark, path)
    assert manifest.first().shape == [4, 4, 4]
    back = pair_files.read_pairs(spark, path)
    assert back.count() == len(cells)
    scored = scored_batch(back, [ClassicFamily(32), KronFamily(32, 1, (4, 4, 4))])
    report = {(r.pair_no, r.method): r for r in batch_report(scored, pair_files.pair_labels(manifest)).collect()}
    assert len(report) == 6
    assert report[0, "classic"].pair == "Human<->Chimp" and report[0, "kron"].est == 1.0
    assert report[1, "kron"].pair == "?<->?" and report[1, "classic"].exact == 0.3333
    assert report[2, "classic"].exact == 0.0
    assert {r.method: r.n_pairs for r in batch_summary(scored).collect()} == {"classic": 3, "kron": 3}


def test_missing_manifest(spark, tmp_path):
    with pytest.raises(AnalysisException):
        pair_files.read_manifest(spark, str(tmp_path))
    assert pair_files.read_manifest(spark, str(tmp_path), required=False).count() == 0


def metrics(algo, elapsed, ts, **more):
    row = dict(algo=algo, load_level=1, shape=[15, 15, 15], n_pairs=30, num_hashes=256, elapsed_s=elapsed,
               mae=0.02, max_error=0.1, memory_kb=90, timestamp=ts,
               pairs=[dict(pair="x<->y", exact=0.5, error=0.1, **{algo: 0.4})])
    return row | more


def test_run_files(spark, tmp_path):
    (tmp_path / "kron_100_level1_metrics.json").write_text(json.dumps(metrics("kron", 2.0, 1000), indent=2))
    (tmp_path / "tt_200_level1_metrics.json").write_text(json.dumps(metrics("tt", 1.0, 1010), indent=2))
    (tmp_path / "zz_300_level1_metrics.json").write_text('{"algo": "broken", ')
    (tmp_path / "other.json").write_text("{}")
    telemetry = dict(race_id="2024", timestamp=1100, algos=["kron", "tt"],
                     telemetry={"kron": [dict(t=0.5, cpu=1.0, ram=2.0), dict(t=7.5, cpu=3.0, ram=4.0)], "tt": []},
                     final={"kron": dict(elapsed_s=2.0, mae=0.02)})
    (tmp_path / "telemetry_400.json").write_text(json.dumps(telemetry, indent=2))
    runs = run_files.read_run_metrics(spark, str(tmp_path))
    assert [(r.algo, r._file.rsplit("/")[-1]) for r in runs.collect()] == [
        ("tt", "tt_200_level1_metrics.json"), ("kron", "kron_100_level1_metrics.json")]
    assert runs.where("algo = 'kron'").first().pairs[0].kron == 0.4
    tel = run_files.read_telemetry(spark, str(tmp_path))
    assert telemetry_points(tel).count() == 2
    assert [tuple(r) for r in final_results(tel).collect()] == [("2024", "kron", 2.0, 0.02)]
    report = {r.algo: r for r in run_report(runs, tel).collect()}
    assert report["tt"].medal == "🥇" and report["kron"].medal == "🥈"
    assert report["kron"].duration == 7.5 and report["kron"].shape == "15×15×15"


def test_log_lines(spark, tmp_path):
    (tmp_path / "kron.log").write_text("start\nPROGRESS: 1/4 pairs\nPROGRESS: 3/4 pairs\nbye\n")
    (tmp_path / "tt.log").write_text("PROGRESS: 1/4 pairs\n  DONE: algo=tt elapsed=3.41s mae=0.0210\n")
    got = last_progress(run_files.read_logs(spark, str(tmp_path))).collect()
    got = {r.source.rsplit("/")[-1]: r for r in got}
    assert got["kron.log"].fraction == 0.75
    assert (got["tt.log"].fraction, got["tt.log"].elapsed_s, got["tt.log"].mae) == (1.0, 3.41, 0.021)


def test_lines_of_equal_names_and_many_blocks(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        lines = [f"PROGRESS: {i}/{5000 if folder == 'x' else 10000} pairs" for i in range(5001)]
        (tmp_path / folder / "worker.log").write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        logs = run_files.read_logs(spark, str(tmp_path / "*"))
        assert sorted(r.fraction for r in last_progress(logs).collect()) == [0.5, 1.0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_metrics_of_equal_names_stay_apart(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "kron_1_metrics.json").write_text(json.dumps(metrics("kron", 2.0, 1000)))
    runs = run_files.read_run_metrics(spark, str(tmp_path)).collect()
    assert len({r._file for r in runs}) == 2


def test_flow_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "a b.csv").write_text(" Source IP, Destination IP, Destination Port\n1.1.1.1,2.2.2.2,80\n")
    (tmp_path / "c.csv").write_text("Destination Port,Label,Source IP,Destination IP,Extra\n443,bad,3.3.3.3,4.4.4.4,x\n")
    (tmp_path / "d.csv").write_text(" Source IP, Destination IP, Destination Port\n5.5.5.5,6.6.6.6,22\n")
    flows = read_flows(spark, str(tmp_path))
    got = sorted((r.src_ip_raw, r.dst_ip_raw, r.port, r.label, r.Extra) for r in flows.collect())
    assert got == [("1.1.1.1", "2.2.2.2", 80, "unknown", None), ("3.3.3.3", "4.4.4.4", 443, "bad", "x"),
                   ("5.5.5.5", "6.6.6.6", 22, "unknown", None)]


def test_runs_are_sorted_for_their_directories_in_small_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filters, "TASK_ROWS", 100)
    runs = spark.range(1000).coalesce(1).select(F.lit("m").alias("algo"), F.col("id").alias("timestamp"))
    run_files.write_run_metrics(runs, str(tmp_path / "runs"))
    assert len(list((tmp_path / "runs").rglob("*.json"))) == 10
    assert run_files.read_run_table(spark, str(tmp_path / "runs")).select("timestamp").distinct().count() == 1000


def test_large_leaderboard_is_ranked_in_small_tasks_and_joined_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(filters, "TASK_ROWS", 100)
    monkeypatch.setattr(ops, "HASHED_FROM", 100)
    runs = spark.range(1000).select((F.col("id") % 20).alias("race"), F.col("id").alias("run"), F.lit(1.0).alias("s"))
    out = ops.leaderboard(runs, ["race"], "run", "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "REPARTITION_BY_NUM, [plan_id" in plan
    medals = {r.run: r.medal for r in out.collect()}
    assert medals == {i: [*ops.MEDALS, ops.OTHER_RANK][min(i // 20, 3)] for i in range(1000)}


def test_very_large_leaderboard_stays_where_it_is(spark, monkeypatch):
    """r04 F3: the rows are not shuffled to meet their medals; repeated ids and a null race as in the other forms."""
    rows = [((None, "x", "y")[i % 3], i // 2, [None, 2.0, 1.0][i % 7 % 3]) for i in range(200)]
    runs = spark.createDataFrame(rows, "race string, run long, s double")
    want = sorted(map(str, ops.leaderboard(runs, ["race"], "run", "s").select("race", "run", "s", "medal").collect()))
    monkeypatch.setattr(ops, "SENT_FROM", 100)
    out = ops.leaderboard(runs, ["race"], "run", "s")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.collect())) == want


def test_report_keeps_records_without_runs_and_repeated_ones(spark, monkeypatch):
    """r04 F3: ranked rows are not shuffled to meet the records; both forms agree."""
    from gridkin.plans import runs as plan

    telemetry = spark.createDataFrame(
        [("a", 1000), ("a", 1000), ("b", 1100), ("c", 9000), (None, 1000), ("d", None)], "race_id string, timestamp long"
    ).selectExpr("*", "map('kron', array(named_struct('t', 0.5D, 'cpu', 1D, 'ram', 1D))) AS telemetry")
    metrics = spark.createDataFrame(
        [("kron", 3, 2.0, 1000, "f1"), ("tt", 3, 1.0, 1100, "f2"), ("tt", 3, None, 950, "f3")],
        "algo string, n_pairs int, elapsed_s double, timestamp long, _file string",
    ).selectExpr("*", "0.1D AS mae", "0.2D AS max_error", "1L AS memory_kb", "array(1, 2) AS shape")
    sent = run_report(metrics, telemetry)
    monkeypatch.setattr(plan, "BROADCAST_ROWS", 0)
    shuffled = run_report(metrics, telemetry)
    assert sent.schema == shuffled.schema
    got = sorted(map(str, sent.collect()))
    assert got == sorted(map(str, shuffled.collect())) and len(got) == 4 * 3 + 3 + 3
