from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.operators import banding
from gridkin.operators.library import LibraryFamily, library_pairs
from gridkin.operators.overlap import exact_jaccard
from gridkin.operators.signatures import signatures
from gridkin.operators.threshold_join import may_reach
from test_pairs import as_rows, jaccard


def alike_sets(seed=5, n=60):
    """Sets of all sizes, many of them a part of an earlier one with a few cells more."""
    rng = np.random.default_rng(seed)
    sets = {}
    for i in range(n):
        if i % 3 == 0:
            cells = rng.choice(400, rng.integers(1, 40), replace=False)
        else:
            old = np.array(sorted(sets[int(rng.integers(0, i))]))
            cells = np.r_[rng.choice(old, max(1, int(len(old) * rng.uniform(0.6, 1))), replace=False), rng.integers(0, 400, 2)]
        sets[i] = {int(c) for c in cells}
    return sets


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7, 0.75, 1.0])
def test_no_pair_that_reaches_the_threshold_is_missed(spark, threshold):
    sets = alike_sets() | {100: {1 << 61, -5, 0}, 101: {1 << 61, -5}, 102: set()}
    found = may_reach(as_rows(spark, sets), threshold).collect()
    pairs = {(r.a, r.b) for r in found}
    assert len(found) == len(pairs)
    assert pairs >= {(a, b) for a, b in combinations(sets, 2) if jaccard(sets[a], sets[b]) >= threshold}
    assert pairs <= {(a, b) for a, b in combinations(sets, 2) if sets[a] & sets[b]}


def test_common_cells_are_compared_in_blocks(spark):
    """600 sets begin with two cells that all of them hold, more than a block has."""
    sets = spark.range(600).select(
        F.concat(F.lit("s"), "id").alias("set_id"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("id") + 10).alias("cells")
    )
    found = may_reach(sets.localCheckpoint(), 0.5)
    assert found.count() == 600 * 599 // 2 and found.where("a >= b").count() == 0


def test_rows_without_an_id_and_of_one_id(spark, rows):
    data = [(None, [1, 2, 3]), (1, [1, 2, 3]), (1, [1, 2, 3]), (2, [1, 2, 3, 4]), (3, None)]
    sets = spark.createDataFrame(data, "set_id long, cells array<long>")
    assert rows(may_reach(sets, 0.7)) == [(1, 1), (1, 2)]
    with pytest.raises(ValueError):
        may_reach(sets, 0.0)


def test_library_join_lists_no_bucket(spark, rows, monkeypatch):
    """r04 F2: pairs that share a hash grow with the square of a bucket; only near ones may be written."""
    table = as_rows(spark, alike_sets())
    sigs = signatures(table, LibraryFamily(8))
    listed = banding.similar_pairs(sigs, banding.even_bands(8, 8), 8, 1 / 8)
    want = exact_jaccard(listed.select("a", "b"), table).where("exact >= 0.5").select("a", "b", "exact")
    want = rows(want)
    monkeypatch.setattr(banding, "_sharing_pairs", None)
    assert rows(library_pairs(table, 0.5)) == want and want


def test_known_pairs_are_looked_up_not_listed(spark, rows):
    sigs = signatures(as_rows(spark, alike_sets()), LibraryFamily(8))
    bands = banding.even_bands(8, 4)
    everything = spark.createDataFrame(list(combinations(range(60), 2)), "a long, b long")
    only = spark.range(40).select(F.col("id").alias("set_id"))
    want = rows(banding.similar_pairs(sigs, bands, 8, 0.25, only))
    assert want and rows(banding.similar_pairs(sigs, bands, 8, 0.25, only, everything)) == want
