"""Signatures of every family, their bands and estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridkin.catalog import inputs as src
from gridkin.functions.compare import estimate
from gridkin.functions.grid import unflatten
from gridkin.operators import banding
from gridkin.operators.cells import exploded
from gridkin.operators.families import (
    ClassicFamily,
    KronFamily,
    TTFamily,
    classic_planes,
    kron_factors,
    tt_cores,
)
from gridkin.operators.library import LIBRARY_PRIME, LibraryFamily
from gridkin.operators.signatures import plane_minima, plane_ranks, signatures
from gridkin.operators.sketches import merged, sketch_signatures, sketches
from gridkin.operators.storage import write_and_read

K = 32
BANDS = 8
KRON_K = 16
TT_K, TT_RANK = 8, 3
PRIME = 2147483647


def joined(sigs):
    return sigs.select("set_id", F.array_join("sig", ",").alias("sig"))


def classic_signature(spark, sf):
    """Premixed family over whole documents, one row per set."""
    return joined(signatures(src.text_sets(spark, sf), ClassicFamily(K)))


def classic_long(spark, sf):
    """Premixed family over suppliers' parts in long form."""
    return joined(signatures(src.supplier_rows(spark, sf), ClassicFamily(K)))


def classic_linear(spark, sf):
    """Plain linear family over customers' parts."""
    return joined(signatures(src.customer_rows(spark, sf), ClassicFamily(K, mixed=False)))


def classic_planes_native(spark, sf):
    """Built-in expressions only: winning rank and cell of each plane."""
    return plane_minima(src.supplier_rows(spark, sf), ClassicFamily(K))


def family_parameters(spark, sf):
    """Coefficients of the planes that actually decide some supplier's signature."""
    best = plane_minima(src.supplier_rows(spark, sf), ClassicFamily(8))
    wins = best.groupBy("plane").agg(F.count_distinct("cell").alias("n_winners"))
    return classic_planes(spark, 8, 42).join(wins, "plane")


def kron_parameters(spark, sf):
    """Factors of the positions on all axes that are in use by the documents."""
    factors = kron_factors(spark, src.TEXT_SHAPE, 4, 42)
    return factors.join(_positions_in_use(spark, sf), ["mode", "idx"]).select(
        "mode", "idx", "plane", F.round("e", 9).alias("e"), "n_cells"
    )


def _positions_in_use(spark, sf):
    """``(mode, idx, n_cells)``."""
    cells = exploded(src.text_sets(spark, sf, 32**3))
    axes = F.array(*[c.cast("int") for c in unflatten("cell", src.TEXT_SHAPE)])
    places = cells.select(F.posexplode(axes).alias("mode", "idx"))
    return places.groupBy("mode", "idx").agg(F.count(F.lit(1)).alias("n_cells"))


def tt_parameters(spark, sf):
    """Entries of the cores at the positions in use by the documents."""
    family = TTFamily(2, 42, src.TEXT_SHAPE, TT_RANK, "md5")
    cores = [tt_cores(spark, family, m).withColumn("mode", F.lit(m)) for m in range(len(src.TEXT_SHAPE))]
    table = reduce(lambda a, b: a.unionByName(b), cores)
    return table.join(_positions_in_use(spark, sf), ["mode", "idx"]).select(
        "mode", "idx", "plane", "entry", F.round("value", 6).alias("value"), "n_cells"
    )


def tt_axis_ranks(spark, sf):
    """Least rank per set and plane, contracted axis by axis through joins."""
    cells = src.supplier_sets(spark, sf).select("set_id", (F.col("cell") % 4096).alias("cell"))
    ranks = plane_ranks(cells, TTFamily(4, 42, (16, 16, 16), 2, "md5"))
    return ranks.groupBy("set_id", "plane").agg(F.round(F.min("rank"), 9).alias("rank"))


def kron_signature(spark, sf):
    sets = src.text_sets(spark, sf, 32**3)
    return joined(signatures(sets, KronFamily(KRON_K, 42, src.TEXT_SHAPE, "md5")))


def kron_axis_ranks(spark, sf):
    """Least rank per set and plane, gathered through per-axis joins."""
    cells = src.supplier_sets(spark, sf).select("set_id", (F.col("cell") % 4096).alias("cell"))
    ranks = plane_ranks(cells, KronFamily(4, 42, (16, 16, 16), "md5"))
    return ranks.groupBy("set_id", "plane").agg(F.round(F.min("rank"), 9).alias("rank"))


def tt_signature(spark, sf):
    sets = src.text_sets(spark, sf, 32**3)
    return joined(signatures(sets, TTFamily(TT_K, 42, src.TEXT_SHAPE, TT_RANK, "md5")))


def library_signature(spark, sf):
    return joined(signatures(src.text_sets(spark, sf), LibraryFamily(K)))


def merged_sketches(spark, sf):
    """Suppliers' parts sketched in three instalments, stored, and merged one after the other."""
    rows = src.supplier_rows(spark, sf)
    third = F.pmod(F.xxhash64("set_id", "cell"), F.lit(3))
    whole = None
    for i in range(3):
        part = sketches(rows.where(third == i), ClassicFamily(K))
        whole = write_and_read(merged(part if whole is None else whole.unionByName(part)), "sketches")
    total = F.aggregate("ranks", F.lit(0.0), lambda a, b: a + b)
    return joined_with(sketch_signatures(whole), whole.select("set_id", total.alias("total_rank")))


def joined_with(sigs, more):
    return joined(sigs).join(more, "set_id")


def signature_estimate(spark, sf):
    """Estimated similarity of each supplier's parts to the next supplier's."""
    sigs = signatures(src.supplier_rows(spark, sf), ClassicFamily(K))
    left = sigs.select(F.col("set_id").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select((F.col("set_id") - 1).alias("a"), F.col("sig").alias("sb"))
    return left.join(right, "a").select("a", estimate("sa", "sb").alias("est"))


def lsh_bands(spark, sf):
    sigs = signatures(src.text_sets(spark, sf), ClassicFamily(K))
    slices = banding.band_slices(sigs, banding.even_bands(K, BANDS))
    return slices.withColumn("slice", F.array_join("slice", ","))


def lsh_buckets(spark, sf):
    """How many shared buckets there are of each size."""
    sigs = signatures(src.text_sets(spark, sf), ClassicFamily(K))
    return banding.bucket_histogram(banding.band_keys(sigs, banding.even_bands(K, BANDS)))


def planes_sql(k: int) -> str:
    return f"""
      planes AS (
        SELECT j.j AS plane,
               ('0x' || substr(md5('42:a:' || j.j), 1, 15))::BIGINT % {PRIME - 1} + 1 AS a,
               ('0x' || substr(md5('42:b:' || j.j), 1, 15))::BIGINT % {PRIME} AS b
        FROM range({k}) j(j))"""


def minima_sql(cells: str, k: int, mixed: bool = True, library: bool = False) -> str:
    """CTEs ``planes``, ``placed`` and ``best(set_id, plane, rank, cell)`` over a cell table."""
    if mixed:
        x1 = f"((cell % {PRIME}) + (((cell // {PRIME}) % {PRIME}) * 1664525) % {PRIME} + 1013904223) % {PRIME}"
        placed = f"""
          shifted AS (SELECT set_id, cell, {x1} AS x1 FROM {cells}),
          squared AS (SELECT *, (x1 * x1) % {PRIME} AS x2 FROM shifted),
          placed AS (SELECT set_id, cell, (((x2 * x2) % {PRIME}) * x1) % {PRIME} AS x FROM squared)"""
    else:
        placed = f"placed AS (SELECT set_id, cell, cell AS x FROM {cells})"
    planes, rank = planes_sql(k), f"(a * x + b) % {PRIME}"
    if library:
        drawn = zip(*LibraryFamily(k).coefficients, strict=True)
        planes = f"planes(plane, a, b) AS (VALUES {', '.join(f'({j}, {a}::BIGINT, {b}::BIGINT)' for j, (a, b) in enumerate(drawn))})"
        rank = f"((x + 1) * a + b) % {LIBRARY_PRIME}"
    return f"""{planes},
      {placed},
      best AS (
        SELECT set_id, plane, min({{'r': {rank}, 'c': cell}}) AS m
        FROM placed CROSS JOIN planes GROUP BY 1, 2)"""


def signature_sql(cells: str, k: int, mixed: bool = True, library: bool = False) -> str:
    """Adds ``sigs(set_id, sig LIST)``."""
    return f"""{minima_sql(cells, k, mixed, library)},
      sigs AS (SELECT set_id, list(m.c ORDER BY plane) AS sig FROM best GROUP BY 1)"""


def factors_sql(k: int, shape) -> str:
    axes = ", ".join(f"({m}, {n})" for m, n in enumerate(shape))
    return f"""
      axes(m, n) AS (VALUES {axes}),
      cells_of_axes AS (SELECT m, unnest(range(n)) AS i FROM axes),
      factors AS (
        SELECT m AS mode, j.j AS plane, i AS idx,
               -ln((('0x' || substr(md5('42:' || m || ':' || j.j || ':' || i), 1, 13))::BIGINT + 1)
                   / 4503599627370496.0) AS e
        FROM cells_of_axes CROSS JOIN range({k}) j(j))"""


def kron_minima_sql(cells: str, k: int, shape) -> str:
    n1, n2 = shape[1], shape[2]
    return f"""{factors_sql(k, shape)},
      kron_best AS (
        SELECT set_id, f0.plane AS plane, min({{'r': f0.e + f1.e + f2.e, 'c': cell}}) AS m
        FROM {cells}
        JOIN factors f0 ON f0.mode = 0 AND f0.idx = cell // {n1 * n2}
        JOIN factors f1 ON f1.mode = 1 AND f1.idx = (cell // {n2}) % {n1} AND f1.plane = f0.plane
        JOIN factors f2 ON f2.mode = 2 AND f2.idx = cell % {n2} AND f2.plane = f0.plane
        GROUP BY 1, 2),
      kron_sigs AS (SELECT set_id, list(m.c ORDER BY plane) AS sig FROM kron_best GROUP BY 1)"""


def tt_minima_sql(cells: str, k: int, shape, rank: int) -> str:
    """CTE ``tt_sigs``: cores of three axes drawn as the family draws them, contracted from left to right."""
    bonds = [(1, rank), (rank, rank), (rank, 1)]
    cores = []
    for mode, ((lo, hi), n) in enumerate(zip(bonds, shape, strict=True)):
        uniform = [
            f"(('0x' || substr(md5('42:tt:{mode}:' || e.e || ':{half}'), 1, 13))::BIGINT + 1) / 4503599627370496.0"
            for half in (0, 1)
        ]
        # Entry e of (plane, left, index, right) in row-major order.
        cores.append(f"""
      core{mode} AS MATERIALIZED (
        SELECT e // {lo * n * hi} AS plane, (e // {hi}) % {n} AS idx,
               list(v::FLOAT::DOUBLE ORDER BY (e // {n * hi}) % {lo}, e % {hi}) AS c
        FROM (SELECT e.e, sqrt(-2 * ln({uniform[0]})) * cos(2 * pi() * {uniform[1]}) / sqrt({lo}) AS v
              FROM range({k * lo * n * hi}) e(e)) GROUP BY 1, 2)""")
    left = [" + ".join(f"a.c[{r + 1}] * b.c[{r * rank + s + 1}]" for r in range(rank)) for s in range(rank)]
    total = " + ".join(f"({left[s]}) * z.c[{s + 1}]" for s in range(rank))
    n1, n2 = shape[1], shape[2]
    return f"""{",".join(cores)},
      tt_ranks AS (
        SELECT cell, a.plane, {total} AS r
        FROM (SELECT DISTINCT cell FROM {cells})
        JOIN core0 a ON a.idx = cell // {n1 * n2}
        JOIN core1 b ON b.idx = (cell // {n2}) % {n1} AND b.plane = a.plane
        JOIN core2 z ON z.idx = cell % {n2} AND z.plane = a.plane),
      tt_best AS (SELECT set_id, plane, min({{'r': r, 'c': cell}}) AS m FROM {cells} JOIN tt_ranks USING (cell) GROUP BY 1, 2),
      tt_sigs AS (SELECT set_id, list(m.c ORDER BY plane) AS sig FROM tt_best GROUP BY 1)"""


def _all_documents(sigs: str, k: int) -> str:
    """Documents without a shingle get zeros."""
    zeros = ",".join(["0"] * k)
    return f"""SELECT doc_id AS set_id, coalesce(array_to_string(sig, ','), '{zeros}') AS sig
      FROM documents LEFT JOIN {sigs} ON set_id = doc_id"""


_USED_SQL = """used AS (
        SELECT mode, CASE mode WHEN 0 THEN cell // 1024 WHEN 1 THEN (cell // 32) % 32 ELSE cell % 32 END AS idx,
               count(*) AS n_cells FROM text_cells CROSS JOIN range(3) m(mode) GROUP BY 1, 2)"""
_TEXT_SIGS = f"{src.text_sets_sql()}, {signature_sql('text_cells', K)}"
_ALL_SIGS = f"""{_TEXT_SIGS},
      all_sigs AS (SELECT doc_id AS set_id, coalesce(sig, list_transform(range({K}), lambda i: 0)) AS sig
                   FROM documents LEFT JOIN sigs ON set_id = doc_id),
      slices AS (SELECT set_id, b.b::INTEGER AS band,
                        array_to_string(sig[b.b * {K // BANDS} + 1 : (b.b + 1) * {K // BANDS}], ',') AS slice
                 FROM all_sigs CROSS JOIN range({BANDS}) b(b))"""

QUERIES = {
    "classic_signature": classic_signature,
    "classic_signature_long": classic_long,
    "classic_signature_linear": classic_linear,
    "classic_planes_native": classic_planes_native,
    "family_parameters": family_parameters,
    "kron_params": kron_parameters,
    "kron_signature": kron_signature,
    "kron_axis_ranks": kron_axis_ranks,
    "tt_signature": tt_signature,
    "tt_params": tt_parameters,
    "tt_axis_ranks": tt_axis_ranks,
    "merged_sketches": merged_sketches,
    "mllib_minhash": library_signature,
    "signature_estimate": signature_estimate,
    "lsh_bands": lsh_bands,
    "lsh_buckets": lsh_buckets,
}

SQL = {
    "classic_signature": f"WITH {_TEXT_SIGS} {_all_documents('sigs', K)}",
    "classic_signature_long": f"""WITH {src.SUPPLIERS_SQL}, {signature_sql('supplier_sets', K)}
      SELECT set_id, array_to_string(sig, ',') AS sig FROM sigs""",
    "classic_signature_linear": f"""WITH {src.BASKETS_SQL}, {signature_sql('baskets', K, mixed=False)}
      SELECT set_id, array_to_string(sig, ',') AS sig FROM sigs""",
    "classic_planes_native": f"""WITH {src.SUPPLIERS_SQL}, {minima_sql('supplier_sets', K)}
      SELECT set_id, plane::INTEGER AS plane, m.r AS rank, m.c AS cell FROM best""",
    "family_parameters": f"""WITH {src.SUPPLIERS_SQL}, {minima_sql('supplier_sets', 8)}
      SELECT plane::INTEGER AS plane, any_value(a) AS a, any_value(b) AS b,
             count(DISTINCT m.c) AS n_winners
      FROM best JOIN planes USING (plane) GROUP BY 1""",
    "kron_params": f"""WITH {src.text_sets_sql(32**3)}, {factors_sql(4, src.TEXT_SHAPE)},
      {_USED_SQL}
      SELECT mode::INTEGER AS mode, idx::INTEGER AS idx, plane::INTEGER AS plane, round(e, 9) AS e, n_cells
      FROM factors JOIN used USING (mode, idx)""",
    "tt_params": f"""WITH {src.text_sets_sql(32**3)},
      {tt_minima_sql('text_cells', 2, src.TEXT_SHAPE, TT_RANK)}, {_USED_SQL},
      cores AS ({" UNION ALL ".join(f"SELECT {m} AS mode, * FROM core{m}" for m in range(3))})
      SELECT mode::INTEGER AS mode, idx::INTEGER AS idx, plane::INTEGER AS plane, entry::INTEGER AS entry,
             round(c[entry + 1], 6) AS value, n_cells
      FROM cores JOIN used USING (mode, idx), LATERAL (SELECT unnest(range(len(c))) AS entry)""",
    "tt_axis_ranks": f"""WITH {src.SUPPLIERS_SQL},
      folded AS (SELECT set_id, cell % 4096 AS cell FROM supplier_sets),
      {tt_minima_sql('folded', 4, (16, 16, 16), 2)}
      SELECT set_id, plane::INTEGER AS plane, round(m.r, 9) AS rank FROM tt_best""",
    "kron_signature": f"""WITH {src.text_sets_sql(32**3)},
      {kron_minima_sql('text_cells', KRON_K, src.TEXT_SHAPE)} {_all_documents('kron_sigs', KRON_K)}""",
    "tt_signature": f"""WITH {src.text_sets_sql(32**3)},
      {tt_minima_sql('text_cells', TT_K, src.TEXT_SHAPE, TT_RANK)} {_all_documents('tt_sigs', TT_K)}""",
    "mllib_minhash": f"""WITH {src.text_sets_sql()}, {signature_sql('text_cells', K, library=True)}
      {_all_documents('sigs', K)}""",
    "merged_sketches": f"""WITH {src.SUPPLIERS_SQL}, {minima_sql('supplier_sets', K)}
      SELECT set_id, array_to_string(list(m.c ORDER BY plane), ',') AS sig, sum(m.r)::DOUBLE AS total_rank
      FROM best GROUP BY 1""",
    "kron_axis_ranks": f"""WITH {src.SUPPLIERS_SQL},
      folded AS (SELECT set_id, cell % 4096 AS cell FROM supplier_sets),
      {kron_minima_sql('folded', 4, (16, 16, 16))}
      SELECT set_id, plane::INTEGER AS plane, round(m.r, 9) AS rank FROM kron_best""",
    "signature_estimate": f"""WITH {src.SUPPLIERS_SQL}, {minima_sql('supplier_sets', K)}
      SELECT x.set_id AS a, avg((x.m.c = y.m.c)::INT) AS est
      FROM best x JOIN best y ON y.set_id = x.set_id + 1 AND x.plane = y.plane GROUP BY 1""",
    "lsh_bands": f"WITH {_ALL_SIGS} SELECT set_id, band, slice FROM slices",
    "lsh_buckets": f"""WITH {_ALL_SIGS},
      buckets AS (SELECT band, slice, count(*) AS members FROM slices GROUP BY 1, 2)
      SELECT members, count(*) AS n_buckets FROM buckets WHERE members > 1 GROUP BY 1""",
}
