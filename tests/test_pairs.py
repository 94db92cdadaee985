from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.operators import banding
from gridkin.operators.cells import exploded
from gridkin.operators.families import ClassicFamily
from gridkin.operators.library import library_pairs
from gridkin.operators.overlap import anchor_estimate, anchor_overlap, exact_jaccard, shared_cells
from gridkin.operators.signatures import signatures
from gridkin.plans import duplicates
from gridkin.plans.duplicates import (
    all_similar_pairs,
    copies,
    expand_copies,
    near_duplicate_pairs,
    representatives,
)


def as_rows(spark, sets):
    data = [(i, sorted({int(c) for c in cells})) for i, cells in sets.items()]
    return spark.createDataFrame(data, "set_id long, cells array<bigint>")


def jaccard(a, b):
    a, b = set(map(int, a)), set(map(int, b))
    return len(a & b) / len(a | b) if a | b else 0.0


def families_of_sets(n_groups=6, per_group=4, seed=0):
    """Groups of near copies with some exact ones, and loners."""
    rng = np.random.default_rng(seed)
    sets = {}
    for _ in range(n_groups):
        base = rng.choice(100_000, 200, replace=False)
        sets[len(sets)] = base
        sets[len(sets)] = base
        for _ in range(per_group - 2):
            changed = base.copy()
            changed[: rng.integers(1, 30)] += 200_000
            sets[len(sets)] = changed
    for _ in range(10):
        sets[len(sets)] = rng.choice(100_000, 200, replace=False)
    sets[len(sets)] = []
    sets[len(sets)] = []
    return sets


def test_exact_jaccard_cases(spark, rows):
    sets = {0: range(125), 1: range(125), 2: [0], 3: [15], 4: [0, 1], 5: [0, 2], 6: [], 7: []}
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (6, 7), (0, 6)], "a long, b long")
    for table in (as_rows(spark, sets), exploded(as_rows(spark, sets))):
        got = {(r.a, r.b): r.exact for r in exact_jaccard(pairs, table).collect()}
        assert got == {(0, 1): 1.0, (2, 3): 0.0, (4, 5): pytest.approx(1 / 3), (6, 7): 0.0, (0, 6): 0.0}
    assert (4, 5, 1, 3) in rows(shared_cells(pairs, as_rows(spark, sets)))


@pytest.mark.parametrize("form", ["rows", "long"])
def test_near_duplicates_match_brute_force(spark, form):
    sets = families_of_sets()
    table = as_rows(spark, sets)
    table = exploded(table) if form == "long" else table
    found = near_duplicate_pairs(table, 0.6, family=ClassicFamily(128), bands=32)
    full = expand_copies(found, copies(table))
    got = {(r.a, r.b): round(r.exact, 9) for r in full.collect()}
    want = {
        (a, b): round(jaccard(sets[a], sets[b]), 9)
        for a, b in combinations(sets, 2)
        if jaccard(sets[a], sets[b]) >= 0.6
    }
    assert got == want
    assert full.count() == len(want)


def test_copies_cost_one_row_each(spark):
    sets = {i: range(50) for i in range(60)} | {99: range(40)}
    found = near_duplicate_pairs(as_rows(spark, sets), 0.5).collect()
    assert len(found) == 60
    assert {(r.a, r.b) for r in found if r.exact == 1.0} == {(0, i) for i in range(1, 60)}
    assert [(-r.exact, r.a, r.b) for r in found] == sorted((-r.exact, r.a, r.b) for r in found)
    assert [(r.a, r.b, r.exact) for r in found if r.exact < 1.0] == [(0, 99, 0.8)]


def test_estimate_only_uses_threshold_on_estimate(spark):
    found = near_duplicate_pairs(as_rows(spark, families_of_sets()), 0.6, verify=False)
    assert found.columns == ["a", "b", "est"]
    assert found.where("est < 0.6 or a >= b").count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """Half the sets share most of their cells, so some buckets are far above the ordinary size."""
    rng = np.random.default_rng(4)
    core = np.arange(80)
    sets = {i: np.r_[core, 1000 + rng.choice(9000, 20, replace=False)] for i in range(300)}
    sets |= {i: rng.choice(9000, 100, replace=False) for i in range(300, 330)}
    k = 32
    sigs = signatures(as_rows(spark, sets), ClassicFamily(k)).cache()
    table = {r.set_id: np.array(r.sig) for r in sigs.collect()}
    return sigs, table, k


def _brute(table, k, threshold, bands=None):
    out = {}
    for a, b in combinations(sorted(table), 2):
        same = table[a] == table[b]
        shares = bands is None or any(same[lo : lo + n].all() for lo, n in bands)
        if shares and same.mean() >= threshold:
            out[a, b] = same.mean()
    return out


@pytest.mark.parametrize("block", [512, 64])
def test_hot_buckets_lose_and_add_nothing(spark, hot, block, monkeypatch):
    sigs, table, k = hot
    monkeypatch.setattr(banding, "BLOCK", block)
    bands = banding.even_bands(k, 16)
    sizes = [r.members for r in banding.bucket_sizes(banding.band_keys(sigs, bands)).collect()]
    assert max(sizes) > banding.HOT_BUCKET
    got = {(r.a, r.b): r.est for r in banding.similar_pairs(sigs, bands, k, 0.7).collect()}
    assert got == _brute(table, k, 0.7, bands)


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_hot_buckets_divided_further(spark, hot, monkeypatch, threshold):
    sigs, table, k = hot
    monkeypatch.setattr(banding, "HOT_BUCKET", 8)
    monkeypatch.setattr(banding, "BLOCK", 16)
    monkeypatch.setattr(banding, "WORTH", 0)
    bands = banding.even_bands(k, 16)
    assert banding.divisions(k, threshold)
    got = {(r.a, r.b): r.est for r in banding.similar_pairs(sigs, bands, k, threshold).collect()}
    assert got == _brute(table, k, threshold, bands)


@pytest.mark.parametrize(("k", "threshold"), [(128, 0.58), (128, 0.9), (32, 0.7), (16, 0.5), (128, 0.25), (64, 1.0)])
def test_divisions_miss_no_qualifying_pair(k, threshold):
    rng = np.random.default_rng(k)
    steps = banding.divisions(k, threshold)
    misses = k - int(np.ceil(threshold * k - 1e-9))
    for keys in steps:
        assert len(keys) <= banding.MOST_KEYS and min(map(len, keys)) >= banding.LEAST_WIDTH
        sets = np.zeros((len(keys), k), bool)
        for i, key in enumerate(keys):
            sets[i, list(key)] = True
        for _ in range(300):
            differ = np.zeros(k, bool)
            # Spread out, bunched together, and at random.
            start, step = int(rng.integers(k)), int(rng.integers(1, 4))
            at = rng.permutation(k)[:misses] if step == 3 else (start + step * np.arange(misses)) % k
            differ[at] = True
            assert not (sets & differ).any(1).all()
    assert steps or k * threshold < 16 or threshold < 0.5


def test_a_crowd_of_unlike_sets_makes_no_blocks(spark, monkeypatch):
    """At the defaults of the verb: many sets that share one band and nothing else, and a few alike ones."""
    k, n = 128, 8_000
    rng = np.random.default_rng(0)
    table = rng.integers(0, 1 << 40, (n, k))
    table[:, :4] = 7
    for i in range(0, 40, 2):
        table[i + 1] = np.where(rng.random(k) < 0.25, table[i + 1], table[i])
    rows = [(i, "p", row.tolist()) for i, row in enumerate(table)]
    sigs = spark.createDataFrame(rows, "set_id long, params_id string, sig array<long>")
    seen = []
    blocked = banding._blocked_pairs

    def counted(members, *args):
        seen.append(members.count())
        return blocked(members, *args)

    monkeypatch.setattr(banding, "_blocked_pairs", counted)
    found = banding.similar_pairs(sigs, banding.even_bands(k, 32), k, 0.58).collect()
    assert sorted((r.a, r.b) for r in found) == [(i, i + 1) for i in range(0, 40, 2)]
    assert sum(seen) == 0


@pytest.mark.parametrize("limit", [8, 128, 10_000])
def test_candidates_do_not_depend_on_the_size_of_buckets(spark, hot, limit, monkeypatch):
    sigs, table, k = hot
    monkeypatch.setattr(banding, "HOT_BUCKET", limit)
    bands = banding.even_bands(k, 16)
    found = [(r.a, r.b) for r in banding.candidate_pairs(sigs, bands, k).collect()]
    assert sorted(found) == sorted(_brute(table, k, 0.0, bands))


@pytest.mark.parametrize("threshold", [0.0, 0.5])
def test_exhaustive_pairs_of_some_ids(spark, threshold):
    sets = as_rows(spark, {0: [], 1: [], 2: [5, 6], 3: [5, 6], 4: [5, 6, 7]})
    only = representatives(copies(sets))
    sigs = signatures(sets, ClassicFamily(8))
    found = banding.exhaustive_pairs(sigs, 8, threshold, only).collect()
    assert {(r.a, r.b) for r in found} <= {(2, 4)} and (found or threshold)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.75, 1.0])
def test_exhaustive_pairs_are_complete(spark, hot, threshold, monkeypatch):
    sigs, table, k = hot
    some = sigs.where("set_id % 3 = 0").cache()
    monkeypatch.setattr(banding, "BLOCK", 32)
    table = {i: s for i, s in table.items() if i % 3 == 0}
    got = {(r.a, r.b): r.est for r in banding.exhaustive_pairs(some, k, threshold).collect()}
    assert got == _brute(table, k, threshold)


def test_no_cartesian_plan(spark, hot):
    sigs, _, k = hot
    for threshold in (0.0, 0.5):
        plan = banding.exhaustive_pairs(sigs, k, threshold)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_six_sets_at_zero_threshold_sorted(spark):
    rng = np.random.default_rng(3)
    sets = {i: np.flatnonzero(rng.random(1000) < 0.1) for i in range(6)}
    sigs = signatures(as_rows(spark, sets), ClassicFamily(16))
    found = [r.est for r in all_similar_pairs(sigs, 16, 0.0).collect()]
    assert len(found) == 15 and found == sorted(found, reverse=True)
    twins = signatures(as_rows(spark, {0: sets[0], 1: sets[0]}), ClassicFamily(16))
    assert [tuple(r) for r in all_similar_pairs(twins, 16, 1.0).collect()] == [(0, 1, 1.0)]


def test_band_choices():
    assert banding.even_bands(16, 4) == [(0, 4), (4, 4), (8, 4), (12, 4)]
    with pytest.raises(ValueError):
        banding.even_bands(16, 5)
    for k, t in ((128, 0.5), (128, 0.8), (64, 0.3)):
        bands = banding.choose_bands(k, t)
        assert (1 / bands) ** (bands / k) <= t
        assert banding.expected_recall(k, bands, t) > 0.5
    for t in (0.5, 0.7, 0.71, 0.75, 0.8, 0.9):
        assert banding.expected_recall(128, banding.choose_bands(128, t, 0.99), t) >= 0.99
    cover = banding.complete_bands(128, 0.9)
    assert len(cover) == 13 and sum(n for _, n in cover) == 128
    assert banding.complete_bands(10, 1.0) == [(0, 10)]


def test_three_identical_sets_pair_once(spark, rows):
    sigs = signatures(as_rows(spark, {i: range(9) for i in range(3)}), ClassicFamily(8))
    pairs = banding.candidate_pairs(sigs, banding.even_bands(8, 4), 8)
    assert rows(pairs) == [(0, 1), (0, 2), (1, 2)]


def test_unknown_ids_drop_out(spark):
    sigs = signatures(as_rows(spark, {0: [1], 1: [1]}), ClassicFamily(8))
    pairs = spark.createDataFrame([(0, 1), (0, 7)], "a long, b long")
    assert [tuple(r) for r in banding.estimated_pairs(pairs, sigs).collect()] == [(0, 1, 1.0)]


def test_anchor(spark, rows):
    sets = as_rows(spark, {0: [1, 2], 1: [2, 3], 2: [9]})
    assert rows(anchor_overlap(sets, 0).select("set_id", "inter", F.round("exact", 4))) == [
        (1, 1, 0.3333), (2, 0, 0.0)]
    sigs = signatures(sets, ClassicFamily(8))
    assert [r.set_id for r in anchor_estimate(sigs, 0).orderBy("set_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        anchor_estimate(sigs, 55)


def test_top_pairs_order(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (0, 9, 0.5), (3, 4, 0.9)], "a long, b long, est double")
    assert [(r.a, r.b) for r in banding.top_pairs(pairs, 2).collect()] == [(3, 4), (0, 9)]


def test_library_join_is_exact(spark):
    sets = {0: range(100), 1: range(5, 100), 2: range(500, 600)}
    found = library_pairs(as_rows(spark, sets), 0.5).collect()
    assert [(r.a, r.b, round(r.exact, 4)) for r in found] == [(0, 1, 0.95)]


def _crowd(spark):
    """100 signatures of 64 planes that agree in plane 0 alone, and a copy of the first."""
    rows = [(i, "p", [7] + [1000 * i + j for j in range(1, 64)]) for i in range(100)]
    return spark.createDataFrame([*rows, (100, "p", rows[0][2])], "set_id long, params_id string, sig array<long>")


def test_signatures_are_never_broadcast_to_join_them(spark):
    pairs = spark.createDataFrame([(0, 100)], "a long, b long")
    out = banding.estimated_pairs(pairs, _crowd(spark), 0.25)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(0, 100, 1.0)]


def test_exhaustive_buckets_leave_only_pairs_that_may_qualify(spark):
    sigs = _crowd(spark)
    bands = banding.complete_bands(64, 0.25)
    found = banding._sharing_pairs(sigs, bands, 64, 0.25, None, screened=True)
    assert [tuple(r) for r in found.collect()] == [(0, 100)]
    assert [tuple(r) for r in banding.exhaustive_pairs(sigs, 64, 0.25).collect()] == [(0, 100, 1.0)]


def test_hashed_sets_are_not_made_again(spark, rows, monkeypatch):
    sets = as_rows(spark, families_of_sets())
    hashed = duplicates.hashed_sets(sets, ClassicFamily(64))
    want = rows(near_duplicate_pairs(sets, 0.5, family=ClassicFamily(64), bands=16))
    monkeypatch.setattr(duplicates, "hashed_sets", None)
    assert rows(near_duplicate_pairs(sets, 0.5, family=ClassicFamily(64), bands=16, hashed=hashed)) == want


def test_top_pairs_leaves_none_to_chance(spark, tmp_path):
    """r04 F5: six pairs of texts at 83/117, none of which shares one of 16 bands and reaches the estimate."""
    from gridkin import catalog

    texts = []
    for s in (28, 71, 152, 245, 353, 357):
        words = [f"w{s}x{i}" for i in range(102)]
        texts += [(2 * s, " ".join(words)), (2 * s + 1, " ".join(words[:85] + [f"v{s}x{i}" for i in range(17)]))]
    table = [*texts, (9001, texts[0][1]), (9002, None), (9003, "too short")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.all_queries()["top_pairs"](spark, str(tmp_path)).collect()
    pairs = [(a, b, round(83 / 117, 9)) for (a, _), (b, _) in zip(texts[::2], texts[1::2], strict=True)]
    assert [(r.a, r.b, r.exact) for r in found] == [(56, 9001, 1.0), *pairs]


def test_complete_pairs_match_brute_force(spark):
    sets = families_of_sets()
    table = as_rows(spark, sets)
    for threshold in (0.3, 0.8):
        found = near_duplicate_pairs(table, threshold, family=ClassicFamily(16), complete=True)
        got = {(r.a, r.b): r.exact for r in expand_copies(found, copies(table)).collect()}
        assert got == {
            (a, b): pytest.approx(jaccard(sets[a], sets[b]))
            for a, b in combinations(sets, 2)
            if jaccard(sets[a], sets[b]) >= threshold
        }
    with pytest.raises(ValueError):
        near_duplicate_pairs(exploded(table), 0.8, complete=True)
