"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Sets of equal content are one class; everything below works on one set per class, so a group of copies,
however large, counts once.

*Light* sets, up to a boundary, are filed under all their subsets of the size that a qualifying partner must
share, for every pair of sizes.  Two sets under one subset (of their pair of sizes) share enough.

*Heavy* sets scan inverted lists.  A list of one frequent shingle would hold much of the corpus, so a set is
cut by hash ranges into segments and a list is entered by the whole content of a segment.  Sizes come in
classes, and a class has two segments more than qualifying sets can differ in elements, so such sets agree in
at least two segments.  Segments of at most one shingle, which many sets could share, are filed together with
each other segment of the set: of two agreeing segments either one is long or the pair is on file.  No
qualifying pair can be missed, whatever the distribution of shingles.

The boundary is the size at which the weighted number of entries of both kinds together is least, from the
counted sizes of all sets.

Most entries are alone in their list.  Entries travel packed, some thousand to a row, by ranges of their key;
of a list that a task fills with more than ``LOCAL`` sets these are chained where they are and only that many go
on, so a list that a third of all sets share is never brought together.

Lists give pairs in two rounds, both checked on the whole sets.  First neighbours in a list, by size: one
pair per entry.  Then, for lists whose sets are still in different components, blocks of the sets that such
lists hold together scan each other's inverted lists of shingles, shortened to 32 bits, which can only add a
pair; what they find is checked on the whole sets.  No pair is written down unless it may link two components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.llm.common import free_name, in_slices, map_arrow, map_groups, ragged_gather, stored_in_small_batches, text_or_empty
from gridkin.llm.components import components
from gridkin.operators.shipping import ship
from gridkin.operators.storage import BROADCAST_ROWS, write_and_read

WIDTH = 3
PERCENT = 90
# Smallest size at which sets of different content can link.
SMALLEST = 9
LARGEST_BOUNDARY = 40
# What an entry of a heavy list counts against one of a light list: sets under one subset link, while a heavy
# list may hold sets that do not, and each of these costs a comparison of whole sets.
HEAVY_WEIGHT = 4
# Sets in a block of a cluster.
BLOCK = 256
WORDS_REMEMBERED = 150_000
# Bits of a list's key; lists that fall together only add pairs to be checked.
KEY_BITS = 48
# Entries that a task packs at a time, that a range of keys shall hold, and that a set has (a guess, for the
# number of ranges only).
PACKED, RANGE, ENTRIES = 1 << 18, 1 << 19, 128
# Sets of one list that go on from one pack.
LOCAL = 4
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift, twice)."""
    x = (x ^ (x >> _U(31))) * _ODD[3]
    x = (x ^ (x >> _U(29))) * _ODD[1]
    return x ^ (x >> _U(32))


def needed(n: int, m: int) -> int:
    """Shared elements at which sets of these sizes link: 100 i >= 90 (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Shingler:
    """Sets of hashed word shingles; remembers the hashes of a bounded number of words."""

    def __init__(self, width: int = WIDTH):
        self.width, self._known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes.  Only A-Z are lowered, only ASCII white space separates."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, _U)
        known = self._known
        if len(known) > WORDS_REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        width = min(self.width, len(h))
        total = np.full(len(h) - width + 1, width, _U)
        for k in range(width):
            total = _mix(total * _ODD[0] + h[k : len(h) - width + 1 + k])
        return np.unique(total)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(width)
    for batch in in_slices(batches, column=1):
        found = [shingle(t) for t in batch[1].to_pylist()]
        yield pa.record_batch(
            {
                "doc_id": batch[0],
                "n": pa.array([len(x) for x in found], pa.int64()),
                "content": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                "elements": pa.array([x.tobytes() for x in found], pa.binary()),
            }
        )


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(row, doc_id, n, content, elements)``, stored: one row per document, ``row`` unique."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    made = map_arrow(plain, lambda b: _sets(b, width), "doc_id long, n long, content binary, elements binary")
    return stored_in_small_batches(made.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def size_classes(largest: int) -> list[tuple[int, int]]:
    """(first size, segments) of each class of heavy sets, up to the class of ``largest``.

    A set links within its class or with the next one.
    """
    out, low = [], SMALLEST
    while low <= largest:
        following = 100 * low // PERCENT + 1
        high = following - 1
        differ = (high + 100 * high // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
        out.append((low, differ + 2))
        low = following
    return out


def _light_sizes(n: int, boundary: int) -> list[tuple[int, int, int]]:
    """(smaller, larger, elements left out) for every pair of sizes that a light set takes part in."""
    out = []
    for other in range(SMALLEST, boundary + 1):
        small, large = min(n, other), max(n, other)
        share = needed(small, large)
        if share <= small and not (small == large == share):
            out.append((small, large, n - share))
    return out


def light_entries(n: int, boundary: int) -> int:
    return sum(comb(n, left_out) for _, _, left_out in _light_sizes(n, boundary))


def choose_boundary(sizes: dict[int, int]) -> int:
    """The size with the fewest entries of light and heavy sets together; sizes up to it are light."""
    classes = size_classes(LARGEST_BOUNDARY * 2)

    def heavy(n: int) -> int:
        own = max((i for i, (low, _) in enumerate(classes) if low <= n), default=None)
        return 0 if own is None else HEAVY_WEIGHT * (classes[own][1] + (classes[own - 1][1] if own else 0))

    def cost(boundary: int) -> int:
        light = sum(k * light_entries(n, boundary) for n, k in sizes.items() if SMALLEST <= n <= boundary)
        return light + sum(k * heavy(n) for n, k in sizes.items() if 100 * n // PERCENT > boundary)

    return min(range(SMALLEST - 1, LARGEST_BOUNDARY + 1), key=cost)


def _light_keys(x: np.ndarray, boundary: int) -> list[int]:
    spread = [int(v) for v in _mix(x + _ODD[2])]
    whole, out = sum(spread), []
    for small, large, left_out in _light_sizes(len(x), boundary):
        tag = small << 8 | large
        out += [hash_of(whole - sum(gone), tag) for gone in combinations(spread, left_out)]
    return out


def hash_of(total: int, tag: int) -> int:
    """One 64-bit key of a sum of spread elements and its tag."""
    raw = (total % (1 << 64)).to_bytes(8, "little") + tag.to_bytes(8, "little")
    return xxhash.xxh3_64_intdigest(raw)


def _heavy_keys(x: np.ndarray, spread: np.ndarray, place: int, segments: int) -> np.ndarray:
    """Keys of a set's segments under the parameters of one size class."""
    at = ((x >> _U(32)) * _U(segments)) >> _U(32)  # rises with x
    starts = np.searchsorted(at, np.arange(segments + 1, dtype=_U))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(spread)])
    content = sums[starts[1:]] - sums[starts[:-1]]
    tag = _mix(np.arange(segments, dtype=_U) + _U(place << 32))
    keys = _mix(content * _ODD[0] + tag)
    few = np.diff(starts) <= 1
    if not few.any():
        return keys
    out = [keys[~few]]
    for i in np.flatnonzero(few):
        others = np.delete(keys, i)
        # The same for both orders of a pair of segments.
        out.append(_mix((keys[i] ^ others) * _ODD[2] + (keys[i] + others)))
    return np.concatenate(out)


def _keys_of(x: np.ndarray, boundary: int, classes: Sequence[tuple[int, int]], lows: np.ndarray) -> np.ndarray:
    """Distinct keys of the lists that a set enters."""
    n, parts = len(x), [np.zeros(0, _U)]
    if SMALLEST <= n <= boundary:
        parts.append(np.array(_light_keys(x, boundary), _U))
    if n >= SMALLEST and 100 * n // PERCENT > boundary:
        spread = _mix(x + _ODD[2])
        own = int(np.searchsorted(lows, n, "right")) - 1
        parts.append(_heavy_keys(x, spread, own, classes[own][1]))
        if own and n > boundary:
            parts.append(_heavy_keys(x, spread, own - 1, classes[own - 1][1]))
    return np.unique(np.concatenate(parts) >> _U(64 - KEY_BITS))


def planes(x: np.ndarray) -> bytes:
    """64-bit values, all first bytes before all second ones: what the values share compresses away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=_U(0)))


def from_packed_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw), dtype=_U)


def _entry_order(key: np.ndarray, n: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.lexsort((row, n, key))


def _chains(key: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in order: whether one follows another of its list, and the length of its list."""
    follows = np.concatenate([[False], key[1:] == key[:-1]])
    starts = np.flatnonzero(~follows)
    return follows, np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))


_FILED = "part int, keys binary, ns binary, rows binary, chained binary"
_LISTED = "key long, row long, n long, before long, n_before long"


def _filed(batches: Iterator[pa.RecordBatch], boundary: int, classes: Sequence[tuple[int, int]], parts: int) -> Iterator[pa.RecordBatch]:
    """Entries of some thousand sets at a time, packed by ranges of their key."""
    lows = np.array([low for low, _ in classes])
    keys, sizes, rows, held = [], [], [], 0
    for batch in in_slices(batches, column=2):
        for row, raw in zip(batch[0].to_pylist(), batch[2], strict=True):
            x = np.frombuffer(raw.as_buffer(), _U)
            keys.append(_keys_of(x, boundary, classes, lows))
            sizes.append(len(x))
            rows.append(row)
            held += len(keys[-1])
            if held >= PACKED:
                yield _pack(keys, sizes, rows, parts)
                keys, sizes, rows, held = [], [], [], 0
    if held:
        yield _pack(keys, sizes, rows, parts)


def _pack(keys: list[np.ndarray], sizes: list[int], rows: list[int], parts: int) -> pa.RecordBatch:
    counts = [len(k) for k in keys]
    key, n, row = np.concatenate(keys), np.repeat(np.array(sizes, _U), counts), np.repeat(np.array(rows, _U), counts)
    order = _entry_order(key, n, row)
    key, n, row = key[order], n[order], row[order]
    follows, length = _chains(key, n, row)
    starts = np.flatnonzero(~follows)
    place = np.arange(len(key)) - np.repeat(starts, length[starts])
    many = length > LOCAL
    # Evenly spaced by size, the first and the last among them.
    goes_on = ~many | (place * (LOCAL - 1) // np.maximum(length - 1, 1) > (place - 1) * (LOCAL - 1) // np.maximum(length - 1, 1))
    chained = np.flatnonzero(many & follows)
    part = (key * _U(parts) >> _U(KEY_BITS)).astype(np.int64) if parts < 1 << 16 else (key >> _U(16)).astype(np.int64) * parts >> KEY_BITS - 16
    edges, chain_edges = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(part[chained], np.arange(parts + 1))
    out = {name: [] for name in ("part", "keys", "ns", "rows", "chained")}
    for p in range(parts):
        inside = slice(edges[p], edges[p + 1])
        if inside.start == inside.stop:
            continue
        go = np.flatnonzero(goes_on[inside]) + inside.start
        at = chained[chain_edges[p] : chain_edges[p + 1]]
        out["part"].append(p)
        out["keys"].append(packed_sorted(key[go]))
        out["ns"].append(planes(n[go]))
        out["rows"].append(planes(row[go]))
        out["chained"].append(planes(np.concatenate([key[at], row[at], n[at], row[at - 1], n[at - 1]])))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _listed(key: tuple, table: pa.Table) -> pa.Table:
    """Entries of one range of keys that share their list with another set.

    Each with the one before it, -1 for the first.
    """
    lists = [np.concatenate([f(x) for x in table[c].to_pylist()]) for c, f in (("keys", from_packed_sorted), ("ns", from_planes), ("rows", from_planes))]
    order = _entry_order(*lists)
    key, n, row = (x[order] for x in lists)
    follows, length = _chains(key, n, row)
    at = np.flatnonzero(length > 1)
    own = np.stack([key[at], row[at], n[at], row[at - 1], n[at - 1]]).astype(np.int64)
    own[3, ~follows[at]] = -1
    chains = [from_planes(x).reshape(5, -1).astype(np.int64) for x in table["chained"].to_pylist()]
    out = np.concatenate([own, *chains], axis=1)
    return pa.table(dict(zip(("key", "row", "n", "before", "n_before"), map(pa.array, out), strict=True)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch[2], batch[3], strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            linked[i] = 100 * shared >= PERCENT * (len(both) - shared)
        yield batch.select([0, 1]).filter(pa.array(linked))


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links ``(a, b)`` among stored pairs of rows, by comparing whole sets; stored."""
    wanted = write_and_read(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "wanted-sets")
    # A counted list of at most a million longs is broadcast; a longer one is joined by shuffle.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = sets.select("row", "elements").join(side, "row", "left_semi")
    left = found.select(F.col("row").alias("a"), F.col("elements").alias("x"))
    right = found.select(F.col("row").alias("b"), F.col("elements").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored_in_small_batches(map_arrow(both, _shared, "a long, b long"), "links")


def _fits(n: str, m: str) -> F.Column:
    small, large = F.least(n, m), F.greatest(n, m)
    return 100 * small >= PERCENT * large


def _pairs(rows: DataFrame) -> DataFrame:
    return write_and_read(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def linked_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document.

    Sets of ``width``-word shingles link at a Jaccard similarity of 0.9; ``component_id`` is the smallest
    doc_id that links reach, the document itself included.  A text with fewer words than ``width`` is one
    shingle; a null text or one without words has none and links with nothing.  Repeated rows are documents
    of equal content and so linked; a null doc_id stays null and is never the smallest of a component that
    has others.  An empty table gives no rows, texts of any length are taken whole, and other columns are
    ignored, whatever their names.  Elements are 64-bit hashes of shingles.
    """
    sets = shingle_sets(docs, width)
    found = class_components(sets).select("content", "component_id")
    return sets.select("doc_id", "n", "content").join(found, "content", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without near duplicates, with all their columns.

    Of each component the document with the smallest id stays, of repeated rows of that id one; documents
    without words, which link with nothing, and rows without an id all stay.
    """
    sets = shingle_sets(docs.where(F.col("doc_id").isNotNull()), width)
    found = class_components(sets).select("content", "component_id")
    marked = sets.select("doc_id", "n", "content").join(found, "content", "left")
    stays = (F.col("n") == 0) | (F.col("component_id") == F.col("doc_id"))
    by_id = marked.groupBy("doc_id").agg(
        F.count_if(stays).alias("stay"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")
    )
    out = write_and_read(
        by_id.where((F.col("stay") == 0) | ((F.col("rows") > 1) & (F.col("n") > 0))), "not-simply-kept"
    )
    key = F.col("doc_id").cast("long")
    # A counted list of at most a million ids is broadcast; a longer one is joined by shuffle.
    side = out.select(F.col("doc_id").alias("_out"))
    side = F.broadcast(side) if out.count() <= BROADCAST_ROWS else side
    kept = docs.join(side, key == F.col("_out"), "left_anti")
    repeated = out.where("stay > 0").select(F.col("doc_id").alias("_out"))
    if repeated.limit(1).count() == 0:
        return kept
    # Ids on several rows: look at each row's own content again.
    names = [free_name(docs.columns, c) for c in ("n", "content", "component")]
    ship(docs.sparkSession)
    rows = docs.join(repeated, key == F.col("_out"), "left_semi").withColumns(
        dict(zip(names[:2], _content_of(F.coalesce("text", F.lit("")), width), strict=True))
    )
    named = found.select(F.col("content").alias(names[1]), F.col("component_id").alias(names[2]))
    again = rows.join(named, names[1], "left")
    empty = again.where(F.col(names[0]) == 0)
    first = again.where((F.col(names[0]) > 0) & (F.col(names[2]) == key)).dropDuplicates([names[2]])
    return kept.unionByName(first.unionByName(empty).select(*[F.col(f"`{c}`") for c in docs.columns]))


def _content_of(text: F.Column, width: int) -> tuple[F.Column, F.Column]:
    """Size and content digest of a text's set, as ``shingle_sets`` has them."""

    def described(texts: pd.Series) -> pd.DataFrame:
        shingle = Shingler(width)
        found = [shingle(t) for t in texts]
        return pd.DataFrame(
            {"n": [len(x) for x in found], "content": [xxhash.xxh3_128_digest(x.tobytes()) for x in found]}
        )

    both = F.pandas_udf(described, "n long, content binary")(text)
    return both["n"], both["content"]


def class_components(sets: DataFrame) -> DataFrame:
    """``(content, least, component_id)`` of every class of stored sets that has a shingle."""
    classes = write_and_read(
        sets.where(F.col("n") > 0)
        .groupBy("content")
        .agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.max("n").alias("n")),
        "classes",
    )
    sizes = classes.where(F.col("n") <= 2 * LARGEST_BOUNDARY).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()
    boundary = choose_boundary({r["n"]: r["k"] for r in sizes})
    cut = size_classes(classes.agg(F.max("n")).first()[0] or 0)

    # One set of each class; a counted list of at most a million longs is broadcast.
    n_classes = classes.count()
    own = classes.where(F.col("n") >= SMALLEST).select("row")
    own = sets.select("row", "n", "elements").join(F.broadcast(own) if n_classes <= BROADCAST_ROWS else own, "row", "left_semi")
    parts = max(-(-n_classes * ENTRIES // RANGE), 16)
    filed = map_arrow(own, lambda b: _filed(b, boundary, cut, parts), _FILED)
    lists = stored_in_small_batches(map_groups(filed, ["part"], _listed, _LISTED), "lists")
    neighbours = lists.where((F.col("before") >= 0) & _fits("n_before", "n"))
    first = _pairs(neighbours.select(F.col("before").alias("a"), F.col("row").alias("b")))
    roots = components(checked(first, sets))
    top = components(_links_between(lists, roots, sets))
    of_class = (
        classes.join(roots.withColumnRenamed("node", "row"), "row", "left")
        .select("content", "least", F.coalesce("root", "row").alias("node"))
        .join(top, "node", "left")
        .select("content", "least", F.coalesce("root", "node").alias("root"))
    )
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    return of_class.join(least, "root").select("content", "least", "component_id")


def _links_between(lists: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components of the first round, as pairs ``(a, b)`` of their roots, stored.

    Lists that lie in one component are done with.  Sets that the other lists hold together, directly or by
    way of others, form clusters, which hold all pairs of these lists; inside a cluster sets are compared
    block against block, each block pair in its own task-sized group, and only links leave it.
    """
    known = roots.select(F.col("node").alias("row"), "root")
    marked = lists.select("key", "row", "before").join(known, "row", "left")
    marked = marked.withColumn("root", F.coalesce("root", "row"))
    mixed = (
        marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    )
    held = marked.join(mixed, "key", "left_semi").where(F.col("before") >= 0)
    clusters = components(held.select(F.col("before").alias("a"), F.col("row").alias("b")))
    clusters = clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = write_and_read(
        clusters.join(sizes, "cluster")
        .join(known, "row", "left")
        .select(
            "row", "cluster", "blocks", F.coalesce("root", "row").alias("root"),
            F.pmod(F.xxhash64("row"), F.col("blocks").cast("long")).cast("int").alias("block"),
        ),
        "clusters",
    )
    side = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    named = sets.select("row", "n", "elements").join(side, "row")
    short = map_arrow(
        named.select("row", "cluster", "blocks", "block", "root", "n", "elements"),
        _shortened,
        "row long, cluster long, blocks int, block int, root long, n long, short binary",
    )
    placed = short.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "block", "row", "root", "n", "short",
    )
    links = _confirmed(placed, sets, every=False)
    return links if links is not None else _confirmed(placed, sets, every=True)


def _confirmed(placed: DataFrame, sets: DataFrame, every: bool) -> DataFrame | None:
    """Links between roots that hold on the whole sets, stored.

    Unless ``every`` pair of sets is asked for, one pair of each two roots is tried, and the result is None if
    one of them does not hold: then another pair of the same roots might.
    """
    found = map_groups(placed, ["cluster", "lo", "hi"], lambda k, t: _scan_block(k, t, every), "a long, b long, x long, y long")
    if every:
        tried = stored_in_small_batches(found, "found")
    else:
        tried = stored_in_small_batches(
            found.groupBy("a", "b").agg(F.min(F.struct("x", "y")).alias("p")).select("a", "b", "p.*"), "found"
        )
    pairs = tried.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    sound = checked(write_and_read(pairs, "pairs"), sets)
    if not every and sound.count() < pairs.count():
        return None
    sound = sound.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return write_and_read(tried.join(sound, ["x", "y"], "left_semi").select("a", "b").distinct(), "links")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements by their first 32 bits, as packed differences."""
    for batch in in_slices(batches, column=6):
        short = [packed_sorted(np.frombuffer(x.as_buffer(), _U) >> _U(32)) for x in batch[6]]
        names = [*batch.schema.names[:-1], "short"]
        yield pa.record_batch([*batch.columns[:-1], pa.array(short, pa.binary())], names=names)


def _scan_block(key: tuple, rows: pa.Table, every: bool = False) -> pa.Table:
    """Scan the inverted lists of one block with the sets of another.

    ``(a, b, x, y)``: roots and the pair of sets that may link them; one pair for each two roots, or ``every``.
    """
    lo, hi = key[1].as_py(), key[2].as_py()
    block, root, row, n = (rows[c].to_numpy() for c in ("block", "root", "row", "n"))
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    out: dict[tuple, tuple] = {}
    if len(left) and len(right) and (root[left].min() != root[right].max() or root[left].max() != root[right].min()):
        raw = rows["short"].to_pylist()
        of = np.repeat(np.arange(len(right)), n[right])
        elements = np.concatenate([from_packed_sorted(raw[i]) for i in right])
        order = np.argsort(elements, kind="stable")
        of, elements = of[order], elements[order]
        for i in left:
            own = from_packed_sorted(raw[i])
            start, end = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
            listed, _ = ragged_gather(of, start, end - start)
            shared = np.bincount(listed, minlength=len(right))
            linked = 100 * shared >= PERCENT * (n[i] + n[right] - shared)
            for j in right[linked & (root[right] != root[i])]:
                a, b = sorted((int(root[i]), int(root[j])))
                x, y = sorted((int(row[i]), int(row[j])))
                out.setdefault((a, b, x, y) if every else (a, b), (a, b, x, y))
    found = np.array(sorted(out.values()), np.int64).reshape(-1, 4)
    return pa.table({name: pa.array(found[:, i]) for i, name in enumerate("abxy")})
