"""The packed lists and the block comparison of the Jaccard join."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from gridkin.llm import jaccard_join
from gridkin.llm.jaccard_join import _listed, _pack, _scan_block, _shortened, from_packed_sorted, from_planes, packed_sorted, planes


def _table(sets, blocks, roots):
    rows = {
        "row": pa.array(range(10, 10 + len(sets)), pa.int64()),
        "cluster": pa.array([0] * len(sets), pa.int64()),
        "blocks": pa.array([2] * len(sets), pa.int32()),
        "block": pa.array(blocks, pa.int32()),
        "root": pa.array(roots, pa.int64()),
        "n": pa.array([len(s) for s in sets], pa.int64()),
        "elements": pa.array([np.array(sorted(x << 33 for x in s), np.uint64).tobytes() for s in sets], pa.binary()),
    }
    return pa.Table.from_batches(list(_shortened([pa.record_batch(rows)])))


def _key(lo, hi):
    return pa.scalar(0), pa.scalar(lo), pa.scalar(hi)


def test_links_are_roots_and_given_once():
    near = [set(range(100)) ^ {1000 + i} for i in range(4)]
    far = set(range(50, 150))
    table = _table([*near, far], [0, 0, 1, 1, 1], [7, 7, 3, 3, 9])
    assert [(r["a"], r["b"]) for r in _scan_block(_key(0, 1), table).to_pylist()] == [(3, 7)]
    every = _scan_block(_key(0, 1), table, True).to_pylist()
    assert [tuple(r.values()) for r in every] == [(3, 7, x, y) for x in (10, 11) for y in (12, 13)]


def test_a_block_with_itself_and_one_component():
    near = [set(range(100)) ^ {1000 + i} for i in range(3)]
    found = _scan_block(_key(0, 0), _table(near, [0, 0, 0], [5, 2, 5])).to_pylist()
    assert [(r["a"], r["b"]) for r in found] == [(2, 5)]
    assert _scan_block(_key(0, 0), _table(near, [0, 0, 0], [5, 5, 5])).num_rows == 0


def test_a_block_that_is_empty():
    assert _scan_block(_key(0, 1), _table([{1, 2}], [0], [1])).num_rows == 0


def test_packing_gives_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 100):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        assert (from_planes(planes(x)) == x).all()
        x.sort()
        assert (from_packed_sorted(packed_sorted(x)) == x).all()


@pytest.mark.parametrize("parts", [1, 7, 70_000])
@pytest.mark.parametrize("packs", [1, 3])
def test_listed_rows_hold_every_shared_list_together(parts, packs):
    rng = np.random.default_rng(parts)
    sets = [(r, int(rng.integers(9, 30)), rng.integers(0, 40, 12)) for r in range(60)]
    keys = [np.unique(np.append(k, 1)).astype(np.uint64) * np.uint64(7_000_000_000_000) for _, _, k in sets]
    batches = []
    for i in range(packs):
        mine = range(i, len(sets), packs)
        batches.append(_pack([keys[j] for j in mine], [sets[j][1] for j in mine], [sets[j][0] for j in mine], parts))
    table = pa.Table.from_batches(batches)
    roots: dict = {}
    for part in set(table["part"].to_pylist()):
        inside = table.filter(pa.compute.equal(table["part"], part))
        for r in _listed((pa.scalar(part),), inside).to_pylist():
            assert r["before"] == -1 or sets[r["before"]][1] == r["n_before"]
            assert sets[r["row"]][1] == r["n"]
            roots.setdefault(r["key"], []).append((r["row"], r["before"]))
    for key in set(np.concatenate(keys).tolist()):
        members = {sets[j][0] for j in range(len(sets)) if key in keys[j]}
        if len(members) < 2:
            assert key not in roots
            continue
        reached = {next(r for r, b in roots[key] if b == -1)}
        while more := {r for r, b in roots[key] if b in reached} | {b for r, b in roots[key] if r in reached and b >= 0} - reached:
            if more <= reached:
                break
            reached |= more
        assert reached == members


def test_a_pair_that_only_shortened_elements_link(spark, monkeypatch):
    """A false pair of two roots makes every pair of sets be tried."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:59]), " ".join(f"v{i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = jaccard_join.shingle_sets(docs)
    rows = {r["doc_id"]: r["row"] for r in sets.collect()}
    named = sets.select("row", "n", "elements").selectExpr("row", "0L AS cluster", "1 AS blocks", "0 AS block", "row AS root", "n", "elements")
    short = jaccard_join.map_arrow(named, _shortened, "row long, cluster long, blocks int, block int, root long, n long, short binary")
    placed = short.selectExpr("cluster", "0 AS lo", "0 AS hi", "block", "row", "root", "n", "short")
    right = tuple(sorted((rows[0], rows[1])))
    assert [tuple(r) for r in jaccard_join._confirmed(placed, sets, False).collect()] == [right]
    def all_pairs(key, table, every=False):
        r, n = table["root"].to_pylist(), len(table)
        pairs = [(min(r[i], r[j]), max(r[i], r[j])) for i in range(n) for j in range(i)]
        return pa.table({c: pa.array([p[k % 2] for p in pairs], pa.int64()) for k, c in enumerate("abxy")})

    monkeypatch.setattr(jaccard_join, "_scan_block", all_pairs)
    assert jaccard_join._confirmed(placed, sets, False) is None
    assert [tuple(r) for r in jaccard_join._confirmed(placed, sets, True).collect()] == [right]
