"""Steps whose work must not outgrow the input, told from plans and from small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridkin.operators.overlap import anchor_overlap
from gridkin.operators.sequences import piece_cells, piece_kmers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """Joins as they are on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _pieces(spark):
    rows = [("one", 0, 0, b"ACGTACGT"), ("two", 0, 0, b"ACGTA"), ("two", 0, 1, b"CGTAC"), (None, 0, 0, b"AACC"), (None, 1, 0, b"GGAACC")]
    return spark.createDataFrame(rows, "seq_id string, block long, part long, seq binary")


def test_only_sequences_in_several_pieces_are_shuffled(spark, rows):
    """F2, F5."""
    found = piece_kmers(_pieces(spark), 3, ["seq_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    whole = {"one": "ACGTACGT", "two": "ACGTACGTAC", None: "AACCGGAACC"}
    wanted = {(name, text[i : i + 3]) for name, text in whole.items() for i in range(len(text) - 2)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    cells = piece_cells(_pieces(spark), 3, (64, 64, 64), ["seq_id"])
    assert cells.count() == cells.distinct().count() == len(wanted)


def test_cells_stay_where_they_are_beside_a_short_anchor(spark, rows, no_small_tables):
    """F2, F12, F15."""
    sets = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3), (2, 9)], "set_id long, cell long")
    out = anchor_overlap(sets, 0)
    assert "SortMergeJoin" not in plan(out)
    assert rows(out.select("set_id", "n_cells", "inter")) == [(1, 2, 1), (2, 1, 0)]


def test_kmers_are_summed_up_without_a_sort(spark):
    """F5, F7."""
    from gridkin.catalog.sequences import _kmer_summary

    kmers = spark.createDataFrame([(1, "CAAAAAAAAAAT"), (1, "AAAAAAAAAAAC"), (1, "TTTTTTTTTTTT"), (2, "AAAAAAAAAAAA")], "seq_id long, kmer string")
    out = kmers.groupBy("seq_id").agg(*_kmer_summary())
    assert "SortAggregate" not in plan(out)
    got = {r["seq_id"]: (r["n_kmers"], r["first"], r["last"]) for r in out.collect()}
    assert got == {1: (3, "AAAAAAAAAAAC", "T" * 12), 2: (1, "A" * 12, "A" * 12)}


def test_winners_are_kept_in_place(spark, rows):
    """F4, F11."""
    from gridkin.operators.families import ClassicFamily
    from gridkin.operators.library import LibraryFamily
    from gridkin.operators.signatures import plane_minima, plane_ranks

    cells = [(s, c) for s in (1, 2, 3) for c in (5 * s, 7, (1 << 60) + s, -(1 << 40) - s)] + [(None, 4), (4, None), (4, 8)]
    table = spark.createDataFrame(cells, "set_id long, cell long")
    # The second one ranks cells that differ by its prime alike.
    for family, part in ((ClassicFamily(8), table), (LibraryFamily(3, mixed=False), table.where("cell is null or cell between 0 and 99"))):
        out = plane_minima(part, family)
        assert "SortAggregate" not in plan(out)
        ranked = plane_ranks(part, family).groupBy("set_id", "plane").agg(F.min(F.struct("rank", "cell")).alias("b"))
        key = lambda t: str(t)
        assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, ranked.select("set_id", "plane", "b.rank", "b.cell").collect()), key=key)


def test_sketches_of_few_cells_do_not_move(spark, rows, monkeypatch):
    """F8."""
    from gridkin.operators import kernels
    from gridkin.operators.families import ClassicFamily
    from gridkin.operators.sketches import sketches

    family = ClassicFamily(16)
    sets = spark.range(0, 3000, 1, 4).select((F.col("id") % 500).alias("set_id"), F.col("id").alias("cell"))
    out = sketches(sets, family)
    # One row a set, of the cells that each task passed on as they were.
    assert out.count() == out.select("set_id").distinct().count() == 500
    kernel = family.kernel()
    kernel.prepare()
    import numpy as np

    got = {r["set_id"]: (r["ranks"], r["cells"]) for r in out.collect()}
    for name in (0, 77):
        own = np.arange(name, 3000, 500)
        best, cell = kernels.segment_argmin(kernel, np.array([0]), own)
        assert got[name] == (best[0].astype(float).tolist(), cell[0].tolist())


def test_row_sets_are_ranked_in_slices(monkeypatch):
    """F12."""
    import numpy as np
    import pyarrow as pa
    from gridkin.operators import kernels
    from gridkin.operators.families import ClassicFamily

    lists = [[1, 2, 3], [], None, [4] * 1, list(range(50)), [9, 8], [7]]
    batch = pa.record_batch({"set_id": pa.array(range(7), pa.int64()), "cells": pa.array(lists, pa.list_(pa.int64()))})
    whole = pa.Table.from_batches(kernels.finish_rows(ClassicFamily(4).kernel(), iter([batch])))
    monkeypatch.setattr(kernels, "SLICE_CELLS", 4)
    parts = list(kernels.finish_rows(ClassicFamily(4).kernel(), iter([batch])))
    assert len(parts) > 1 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_copies_are_told_from_keys_made_once(spark, monkeypatch, tmp_path):
    """F9."""
    from gridkin.catalog import sets

    spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sets.copy_groups(spark, str(tmp_path))
    assert "md5" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2), (2, 1, 2)]


def test_long_sets_meet_in_stretches(spark, rows, no_small_tables):
    """F10, F14, F22."""
    from gridkin.operators.overlap import exact_jaccard

    sets = spark.createDataFrame(
        [("a", c) for c in (1, 2, 70_000, -5)] + [("b", c) for c in (2, 3, 70_000, -5)] + [("c", None), ("c", 2)], "set_id string, cell long"
    )
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("c", "c")], "a string, b string")
    out = exact_jaccard(pairs, sets)
    assert "array_intersect" in plan(out)
    assert rows(out.select("a", "b", "n_a", "n_b", "inter")) == [("a", "b", 4, 4, 3), ("a", "c", 4, 2, 1), ("a", "d", 4, 0, 0), ("c", "c", 2, 2, 1)]


def test_scopes_come_from_one_aggregate(spark, tmp_path):
    """F10, F14."""
    from gridkin.catalog import pairs

    lines = [(1, 5, 7), (1, 5, 1), (1, 6, 6), (2, 5, None), (None, 1, 3), (1, 4096 + 5, 2)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = pairs._scoped_sets(spark, str(tmp_path))
    assert "Union" not in plan(out)
    names = ["whole:1", "high:1", "medium:1", "low:1"]
    wanted = {(n, 5) for n in names} | {("whole:1", 6), ("high:1", 6), ("whole:2", 5), (None, 1)}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == wanted


def test_files_are_opened_once(spark, tmp_path):
    """F16."""
    from gridkin.sources.runs import read_telemetry

    spark.range(3).select(F.col("id").cast("string").alias("race_id")).write.option("maxRecordsPerFile", 1).json(f"{tmp_path}/t")
    out = read_telemetry(spark, f"{tmp_path}/t", "*.json")
    assert "json" not in plan(out).lower().replace("json-files", "") and out.count() == 3


def test_sets_are_perturbed_by_one_aggregate(spark, rows, no_small_tables):
    """F18."""
    from gridkin.operators.cells import perturb

    table = lambda data: spark.createDataFrame(data, "set_id long, cell long")
    out = perturb(table([(1, 1), (1, 1), (1, 2), (2, None)]), table([(1, 3), (3, 1)]), table([(1, 2), (1, 3), (1, 9), (2, None)]))
    assert "Join" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 1), (2, None), (3, 1)]


def test_pairs_of_unlike_sizes_are_not_compared(spark, rows):
    """F3."""
    from gridkin.operators.library import _alike_in_size

    sets = spark.createDataFrame([(1, [1] * 7), (2, [1] * 10), (3, [1] * 11)], "set_id long, cells array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert rows(_alike_in_size(pairs, sets, 0.7).select("a", "b")) == [(1, 2), (2, 3)]


def test_texts_go_to_the_encoder_in_slices(spark, monkeypatch):
    """Pipeline, encode."""
    import pyarrow as pa
    from gridkin.llm import bpe

    seen = []

    class Counting:
        def encode(self, texts):
            seen.append(len(texts))
            return [], [0] * (len(texts) + 1)

    monkeypatch.setattr(bpe, "_encoder", lambda path, lexicon: Counting())
    batch = pa.record_batch({"doc_id": pa.array(range(3000)), "text": pa.array(["a b"] * 3000)})
    out = list(bpe._encoded(iter([batch]), "", None))
    assert max(seen) <= 1024 and sum(b.num_rows for b in out) == 3000
