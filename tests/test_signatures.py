from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridkin.operators import kernels
from gridkin.operators.cells import exploded
from gridkin.operators.families import PRIME, ClassicFamily, KronFamily, TTFamily
from gridkin.operators.library import LibraryFamily, library_hashes
from gridkin.operators.sketches import merged, sketch_signatures, sketches
from gridkin.operators.signatures import signatures, signatures_by_join, with_empty_sets

SHAPE = (20, 20, 20)
FAMILIES = [
    ClassicFamily(32),
    ClassicFamily(32, mixed=False, source="numpy", shape=SHAPE),
    KronFamily(32, 0, SHAPE),
    KronFamily(32, 0, SHAPE, "md5"),
    TTFamily(32, 0, SHAPE),
]
NAMES = [f.params_id for f in FAMILIES]


def random_sets(n=12, density=0.1, shape=SHAPE, seed=3):
    rng = np.random.default_rng(seed)
    total = int(np.prod(shape))
    return {i: np.flatnonzero(rng.random(total) < density) for i in range(n)}


def as_rows(spark, sets):
    data = [(i, [int(c) for c in cells]) for i, cells in sets.items()]
    return spark.createDataFrame(data, "set_id long, cells array<bigint>")


def sig_of(df):
    return {r.set_id: list(r.sig) for r in df.collect()}


def dense_signature(family, cells):
    """Straight from the definition: first minimum over ascending cells, plane by plane."""
    cells = np.sort(np.asarray(cells))
    if isinstance(family, ClassicFamily):
        a, b = family.coefficients
        x = family.kernel()._mix(cells) if family.mixed else cells
        return [int(cells[np.argmin((int(a[j]) * x + int(b[j])) % PRIME)]) for j in range(family.k)]
    index = np.unravel_index(cells, family.shape)
    out = []
    for j in range(family.k):
        if isinstance(family, KronFamily):
            rank = sum(f[j, i] for f, i in zip(family.factors, index, strict=True))
        else:
            rank = [_chain(family, j, at) for at in zip(*index, strict=True)]
        out.append(int(cells[np.argmin(rank)]))
    return out


def _chain(family, j, at):
    value = np.ones((1, 1))
    for core, i in zip(family.cores, at, strict=True):
        value = value @ core[j][:, i, :].astype(np.float64)
    return value[0, 0]


@pytest.mark.parametrize("family", FAMILIES, ids=NAMES)
def test_row_and_long_forms_match_definition(spark, family):
    sets = random_sets()
    rows = as_rows(spark, sets)
    expected = {i: dense_signature(family, cells) for i, cells in sets.items()}
    assert sig_of(signatures(rows, family)) == expected
    long = exploded(rows)
    assert sig_of(signatures(long.union(long).repartition(3), family)) == expected


@pytest.mark.parametrize("family", [FAMILIES[0], FAMILIES[3], TTFamily(8, 0, SHAPE, 3, "md5"), LibraryFamily(16)])
def test_join_form_matches_kernel(spark, family):
    rows = as_rows(spark, random_sets(4, 0.02))
    assert sig_of(signatures_by_join(exploded(rows), family)) == sig_of(signatures(rows, family))


@pytest.mark.parametrize("family", FAMILIES, ids=NAMES)
def test_parameter_slices_match_whole(spark, family, monkeypatch):
    rows = as_rows(spark, random_sets(4))
    whole = sig_of(signatures(rows, family))
    monkeypatch.setattr("gridkin.operators.signatures.BROADCAST_LIMIT", family.nbytes() // 3)
    assert sig_of(signatures(rows, family)) == whole
    assert sig_of(signatures(exploded(rows), family)) == whole


def test_self_symmetric_repeatable(spark):
    rows = as_rows(spark, random_sets(2))
    for family in FAMILIES:
        one, two = sig_of(signatures(rows, family)), sig_of(signatures(rows, family))
        assert one == two and all(len(s) == family.k for s in one.values())


def test_empty_set_is_zero(spark):
    rows = as_rows(spark, {0: [], 1: [5]})
    for family in FAMILIES:
        got = sig_of(signatures(rows, family))
        assert got[0] == [0] * family.k and got[1] == [5] * family.k
    long = exploded(rows)
    filled = with_empty_sets(signatures(long, FAMILIES[0]), rows, FAMILIES[0])
    assert sig_of(filled)[0] == [0] * 32


def test_ids_of_any_type_and_ties(spark):
    rows = spark.createDataFrame([("b", [1, 2]), ("a", [3])], "set_id string, cells array<bigint>")
    assert set(sig_of(signatures(exploded(rows), FAMILIES[0]))) == {"a", "b"}

    class Flat:
        rank_type, k, chunk = np.float64, 3, 256

        def ranks(self, cells):
            return np.zeros((3, len(cells)))

    _, cell = kernels.segment_argmin(Flat(), np.array([0, 600]), np.r_[np.arange(600), [7, 9]])
    assert cell.tolist() == [[0, 0, 0], [7, 7, 7]]


def test_cells_beyond_32_bits(spark):
    cells = [2**31 + 5, 2**32 - 1, 17]
    shape = (2048, 2048, 1024)
    rows = as_rows(spark, {0: cells})
    assert set(sig_of(signatures(rows, ClassicFamily(64)))[0]) <= set(cells)
    assert set(sig_of(signatures(rows, KronFamily(8, 0, shape)))[0]) <= set(cells)
    with pytest.raises(ValueError):
        ClassicFamily(8, mixed=False, shape=shape)


def _batches(ids, cells, size, best=None):
    columns = {"set_id": pa.array(ids, pa.int64()), "cell": pa.array(cells, pa.int64())}
    table = pa.table(columns | {"best": pa.array(best or [None] * len(ids), pa.binary())})
    return iter(table.to_batches(max_chunksize=size))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 7999)), min_size=1, max_size=300), st.integers(1, 50))
def test_partial_winners_merge_to_the_whole(rows, size):
    """Pruning any part of a set first never changes its signature."""
    family = ClassicFamily(4)
    ids, cells = zip(*rows, strict=True)

    def finish(rows):
        rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1]))
        out = kernels.finish_sorted(family.kernel(), _batches(*zip(*[r[:2] for r in rows], strict=True), size, [r[2] for r in rows]))
        return {i: s for b in out for i, s in zip(b["set_id"].to_pylist(), b["sig"].to_pylist(), strict=True)}

    kept = []
    for batch in kernels.prune(family.kernel(), _batches(ids, cells, size)):
        kept += zip(*[batch[c].to_pylist() for c in kernels.PRUNED], strict=True)
    assert len(kept) <= len(rows) and all((r[1] is None) != (r[2] is None) for r in kept)
    assert finish(kept) == finish([(*r, None) for r in rows])


def test_hot_set_leaves_one_row_per_task():
    family = ClassicFamily(16)
    n = 300_000
    out = list(kernels.prune(family.kernel(), _batches([1] * n, range(n), 10_000)))
    assert sum(b.num_rows for b in out) == 1


@pytest.mark.parametrize("family", FAMILIES)
def test_sketches_merge_in_any_order(spark, family):
    sets = random_sets(6)
    rows = exploded(as_rows(spark, sets))
    whole = signatures(as_rows(spark, sets), family).collect()
    want = {r.set_id: r.sig for r in whole}
    odd, even = (sketches(rows.where(f"cell % 2 = {i}"), family) for i in (1, 0))
    once = merged(odd.unionByName(even).unionByName(odd))
    again = merged(merged(even).unionByName(merged(odd)))
    for found in (once, again):
        assert {r.set_id: r.sig for r in sketch_signatures(found).collect()} == want
    assert sketches(rows, family).columns == ["set_id", "params_id", "ranks", "cells"]


def test_plan_moves_long_sets_once(spark):
    long = exploded(as_rows(spark, random_sets(3)))
    plan = signatures(long, FAMILIES[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows_plan = signatures(as_rows(spark, random_sets(3)), FAMILIES[0])._jdf.queryExecution().toString()
    assert "Exchange" not in rows_plan


def _agreement(sigs, a, b):
    return float(np.mean(np.array(sigs[a]) == np.array(sigs[b])))


@pytest.mark.parametrize(
    ("family", "shape", "density", "low"),
    [
        (KronFamily(128, 42, (30, 30, 30)), (30, 30, 30), 0.06, 0.85),
        (TTFamily(64, 42, (20, 20, 20)), (20, 20, 20), 0.05, 0.80),
        (ClassicFamily(128), (30, 30, 30), 0.06, 0.85),
    ],
    ids=["kron", "tt", "classic"],
)
def test_graded_overlap_correlates(spark, family, shape, density, low):
    rng = np.random.default_rng(1)
    total, size = int(np.prod(shape)), int(np.prod(shape) * density)
    sets, truth = {}, []
    for level in range(6):
        for _ in range(6):
            pool = rng.choice(total, 2 * size, replace=False)
            shared = size * level // 6
            a, b = pool[:size], np.r_[pool[:shared], pool[size : 2 * size - shared]]
            sets |= {2 * len(truth): a, 2 * len(truth) + 1: b}
            truth.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    sigs = sig_of(signatures(as_rows(spark, sets), family))
    est = [_agreement(sigs, 2 * i, 2 * i + 1) for i in range(len(truth))]
    assert np.corrcoef(est, truth)[0, 1] > low
    assert np.mean(np.abs(np.array(est) - truth)) < 0.08


def test_disjoint_sets_rarely_agree(spark):
    rng = np.random.default_rng(5)
    total = 15**3
    sets = {0: rng.choice(total // 2, 50, replace=False), 1: total // 2 + rng.choice(total // 2, 50, replace=False)}
    sigs = sig_of(signatures(as_rows(spark, sets), TTFamily(32, 42, (15, 15, 15), 3)))
    assert _agreement(sigs, 0, 1) < 0.2


def test_structured_sets_favour_premixed_family(spark):
    """A shared port-scan column: factored families stray far, the premixed one does not."""
    rng = np.random.default_rng(2)
    shared = np.arange(64)
    private = rng.choice(np.arange(64, 64**3), 128, replace=False)
    sets = {0: np.r_[shared, private[:64]], 1: np.r_[shared, private[64:]]}
    k, exact = 1024, 1 / 3
    rows = as_rows(spark, sets)
    est = {
        f.method: _agreement(sig_of(signatures(rows, f)), 0, 1)
        for f in (ClassicFamily(k), KronFamily(k, 1, (64, 64, 64)))
    }
    assert abs(est["classic"] - exact) < 4 * (exact * (1 - exact) / k) ** 0.5
    assert abs(est["kron"] - exact) > 0.1


def test_library_baseline(spark):
    rows = as_rows(spark, {0: range(100), 1: range(100), 2: range(50, 150), 3: []})
    sigs = sig_of(signatures(rows, LibraryFamily(64)))
    assert sigs[0] == sigs[1] and set(sigs[3]) == {0}
    assert abs(_agreement(sigs, 0, 2) - 1 / 3) < 0.25
    assert sig_of(signatures(exploded(rows), LibraryFamily(64))) == {i: s for i, s in sigs.items() if i < 3}


def test_library_ranks_of_many_planes():
    """More planes than are ranked together, their number not a multiple of these."""
    family, cells = LibraryFamily(40, mixed=False), np.array([0, 1, 7, 2038074742, 1 << 30], np.int64)
    kernel = family.kernel()
    kernel.prepare()
    a, b = family.coefficients
    expected = [[((1 + int(x)) * int(m) + int(n)) % 2038074743 for x in cells] for m, n in zip(a, b, strict=True)]
    assert kernel.ranks(cells).tolist() == expected


@pytest.mark.parametrize("seed", [42, 0, -7, 123456789012])
def test_library_family_equals_the_library(spark, seed):
    from pyspark.ml.linalg import Vectors

    sets = {i: sorted(np.random.default_rng(i).choice(1 << 30, 50, replace=False).tolist()) for i in range(4)}
    rows = [(i, Vectors.sparse(1 << 30, cells, [1.0] * len(cells))) for i, cells in sets.items()]
    vectors = spark.createDataFrame(rows, ["set_id", "features"])
    family = LibraryFamily(16, seed, mixed=False)
    kernel = family.kernel()
    kernel.prepare()
    for r in library_hashes(vectors, 16, seed).collect():
        assert list(r.hashes) == kernel.ranks(np.array(sets[r.set_id])).min(1).tolist()


def test_tensor_train_rejects_cells_outside_the_grid(monkeypatch):
    import numpy as np
    import pytest

    from gridkin.operators import families

    for limit in (families.PREFIX_LIMIT, 0):
        monkeypatch.setattr(families, "PREFIX_LIMIT", limit)
        kernel = families.TTFamily(4, 42, (8, 8, 8)).kernel()
        kernel.prepare()
        kernel.ranks(np.array([0, 511]))
        for cell in (-1, 512, 5000):
            with pytest.raises(ValueError, match="outside"):
                kernel.ranks(np.array([3, cell]))


def test_hot_set_spread_thinly_is_thinned(monkeypatch):
    monkeypatch.setattr(kernels, "BUFFER_ROWS", 1_000)
    family = ClassicFamily(8)
    ids = [0 if i % 100 == 0 else i for i in range(50_000)]
    out = list(kernels.prune(family.kernel(), _batches(ids, range(50_000), 500)))
    kept = [i for b in out for i in b["set_id"].to_pylist()]
    assert kept.count(0) <= 2 * family.k + 1 and len(kept) - kept.count(0) == 50_000 - 500


def test_repeated_row_sets_stay_rows_under_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1, 2], "x"), (1, [3], "y"), (2, [], "z")], "set_id long, cells array<long>, note string")
    family = ClassicFamily(12)
    whole = sorted(tuple(r) for r in signatures(rows, family, ["note"]).collect())
    monkeypatch.setattr("gridkin.operators.signatures.BROADCAST_LIMIT", family.nbytes() // 3)
    assert sorted(tuple(r) for r in signatures(rows, family, ["note"]).collect()) == whole and len(whole) == 3


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_vector_projection_at_both_sizes(spark, limit, monkeypatch):
    from gridkin.operators import projection

    monkeypatch.setattr(projection, "BROADCAST_LIMIT", limit)
    data = [(1, [1.0, 2.0, 3.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(data, "id long, v array<double>")
    found = projection.project_vectors(vectors, "id", "v", 3, k=2).collect()
    assert sorted((r.id, r.plane) for r in found) == [(1, 0), (1, 0), (1, 1), (1, 1), (3, 0), (3, 1)]
    assert {round(r.value, 9) for r in found if r.id == 3} <= {round(r.value, 9) for r in found if r.id == 1}
    for bad in ([1.0], [1.0, None, 2.0]):
        wrong = spark.createDataFrame([(1, bad)], "id long, v array<double>")
        with pytest.raises(Exception, match="must have 3 components"):
            projection.project_vectors(wrong, "id", "v", 3, k=2).collect()


def test_classic_ranks_are_the_residues_in_half_the_width():
    kernel = ClassicFamily(20).kernel()
    kernel.prepare()
    cells = np.array([0, 1, 2**31 - 2, 2**31 - 1, 2**31, 2**60 - 1, 2**62, -1, -(2**40)])
    ranks = kernel.ranks(cells)
    assert ranks.dtype == np.uint32
    p = 2**31 - 1
    mixed = [((c % p + (c // p) % p * 1664525 + 1013904223) % p) ** 5 % p for c in cells.tolist()]
    want = [[(a * x + b) % p for x in mixed] for a, b in zip(kernel.a.tolist(), kernel.b.tolist(), strict=True)]
    assert ranks.tolist() == want
