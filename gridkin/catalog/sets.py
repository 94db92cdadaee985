"""Set construction, profiles, algebra, cost and projection."""

from __future__ import annotations

from math import prod

from pyspark.sql import functions as F

from gridkin.catalog import inputs as src
from gridkin.functions.grid import flatten, unflatten
from gridkin.operators import cells as ops
from gridkin.operators.overlap import shared_cells
from gridkin.operators.projection import project_sets, project_vectors
from gridkin.plans.duplicates import copies
from gridkin.plans.sizing import sketch_sizing
from gridkin.sources.tables import with_default_ids

PROJECT_SHAPE = (12, 5, 24)
# Grids of the queries, the calendar's and one of four axes.
SIZING_SHAPES = (PROJECT_SHAPE, src.EVENT_SHAPE, src.TEXT_SHAPE, (31, 24, 60), (128, 64, 96), (7, 24, 64, 5))


def _event_cells(spark, sf):
    """One set per day of events."""
    rows = src.event_rows(spark, sf)
    return ops.unique_cells(
        ops.grid_cells(
            rows, F.date_format("ts", "yyyy-MM-dd"), ["src_ip", "dst_ip", "port"], src.EVENT_SHAPE
        )
    )


EVENT_CELLS_SQL = f"""{src.EVENT_ROWS_SQL},
      event_cells AS (
        SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS set_id, {src.event_cell_sql()} AS cell
        FROM event_rows)"""


def cells_presence(spark, sf):
    return _event_cells(spark, sf)


def set_profile(spark, sf):
    out = ops.set_profile(_event_cells(spark, sf), src.EVENT_SHAPE)
    return out.withColumn("density", F.round("density", 9))


def unflatten_cells(spark, sf):
    """Cells back to coordinates, and forth again."""
    i, j, k = unflatten("cell", src.EVENT_SHAPE)
    out = _event_cells(spark, sf).select("set_id", "cell", i.alias("i0"), j.alias("i1"), k.alias("i2"))
    return out.withColumn("again", flatten(["i0", "i1", "i2"], src.EVENT_SHAPE))


def active_cells(spark, sf):
    """Membership by positive net weight: returned quantity counts against the part."""
    lines = src.table(spark, sf, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    weights = lines.groupBy(
        F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("cell")
    ).agg(F.sum(signed).alias("value"))
    return ops.active_cells(weights)


def perturb_sets(spark, sf):
    """Customer baskets with urgent orders' suppliers added and returned parts dropped."""
    base = src.customer_rows(spark, sf)
    lines = src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"
    )
    orders = src.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    add = joined.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("set_id"), F.col("l_suppkey").alias("cell")
    )
    drop = joined.where(F.col("l_returnflag") == "R").select(
        F.col("o_custkey").alias("set_id"), F.col("l_partkey").alias("cell")
    )
    return ops.perturb(base, add, drop)


def set_overlap(spark, sf):
    """Intersection and union of each supplier's parts with the next supplier's."""
    suppliers = src.table(spark, sf, "supplier")
    pairs = suppliers.select(
        F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")
    )
    return shared_cells(pairs, src.supplier_sets(spark, sf))


def copy_groups(spark, sf):
    """Documents of equal shingle content under their lowest id."""
    return copies(src.text_sets(spark, sf))


def sizing_report(spark, sf):
    out = sketch_sizing(src.supplier_sets(spark, sf), SIZING_SHAPES)
    ratios = ("kron_vs_full", "tt_vs_full", "kron_vs_tt")
    return out.withColumn("shape", F.array_join("shape", "x")).withColumns(
        {c: F.round(c, 6) for c in ratios}
    )


def random_projection(spark, sf):
    """Daily event sets on eight Gaussian directions."""
    rows = src.event_rows(spark, sf)
    cells = ops.grid_cells(
        rows, F.date_format("ts", "yyyy-MM-dd"), ["src_ip", "dst_ip", "port"], PROJECT_SHAPE
    ).distinct()
    return project_sets(cells, PROJECT_SHAPE, k=8).withColumn("value", F.round("value", 6))


def vector_projection(spark, sf):
    """Embeddings on eight Gaussian directions."""
    out = project_vectors(src.table(spark, sf, "embeddings"), "vec_id", "embedding", 64, k=8)
    return out.withColumn("value", F.round("value", 6))


def default_set_ids(spark, sf):
    """Documents numbered "0", "1", ... by length and id."""
    docs = src.table(spark, sf, "documents").select("doc_id", "n_chars")
    return with_default_ids(docs, ["n_chars", "doc_id"])


_GAUSS = """sqrt(-2.0 * ln((('0x' || substr(md5('42:' || {c} || ':' || {j} || ':r'), 1, 13))::BIGINT + 1)
              / 4503599627370496.0)) *
            cos(6.283185307179586 * ((('0x' || substr(md5('42:' || {c} || ':' || {j} || ':a'), 1, 13))::BIGINT + 1)
              / 4503599627370496.0))"""


def _shapes_sql() -> str:
    rows = []
    for shape in SIZING_SHAPES:
        d, r = len(shape), 4
        tt = sum(
            (1 if m == 0 else r) * n * (1 if m == d - 1 else r) for m, n in enumerate(shape)
        )
        rows.append(
            f"('{'x'.join(map(str, shape))}', {prod(shape)}, {sum(shape)}, {tt}, {prod(shape[:-1])})"
        )
    return ", ".join(rows)


QUERIES = {
    "cells_presence": cells_presence,
    "set_profile": set_profile,
    "unflatten_cells": unflatten_cells,
    "active_cells": active_cells,
    "perturb_sets": perturb_sets,
    "set_overlap": set_overlap,
    "copy_groups": copy_groups,
    "sketch_sizing": sizing_report,
    "random_projection": random_projection,
    "vector_projection": vector_projection,
    "default_set_ids": default_set_ids,
}

SQL = {
    "cells_presence": f"WITH {EVENT_CELLS_SQL} SELECT * FROM event_cells",
    "set_profile": f"""WITH {EVENT_CELLS_SQL}
      SELECT set_id, count(*) AS n_cells, {prod(src.EVENT_SHAPE)}::BIGINT AS total_cells,
             round(count(*)::DOUBLE / {prod(src.EVENT_SHAPE)}, 9) AS density
      FROM event_cells GROUP BY set_id""",
    "unflatten_cells": f"""WITH {EVENT_CELLS_SQL}
      SELECT set_id, cell, cell // 120 AS i0, (cell // 24) % 5 AS i1, cell % 24 AS i2, cell AS again
      FROM event_cells""",
    "active_cells": """
      SELECT l_suppkey AS set_id, l_partkey AS cell FROM lineitem GROUP BY 1, 2
      HAVING sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) > 0""",
    "perturb_sets": """WITH joined AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      (SELECT o_custkey AS set_id, l_partkey AS cell FROM joined
       UNION
       SELECT o_custkey, l_suppkey FROM joined WHERE o_orderpriority = '1-URGENT')
      EXCEPT
      SELECT o_custkey, l_partkey FROM joined WHERE l_returnflag = 'R'""",
    "set_overlap": f"""WITH {src.SUPPLIERS_SQL},
      sizes AS (SELECT set_id, count(*) AS n FROM supplier_sets GROUP BY 1),
      pairs AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
      inter AS (SELECT p.a, p.b, count(*) AS n FROM pairs p
                JOIN supplier_sets x ON x.set_id = p.a
                JOIN supplier_sets y ON y.set_id = p.b AND x.cell = y.cell GROUP BY 1, 2)
      SELECT p.a, p.b, coalesce(i.n, 0)::BIGINT AS inter,
             (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(i.n, 0))::BIGINT AS union_size
      FROM pairs p LEFT JOIN sizes x ON x.set_id = p.a LEFT JOIN sizes y ON y.set_id = p.b
      LEFT JOIN inter i ON i.a = p.a AND i.b = p.b""",
    "copy_groups": f"""WITH {src.text_sets_sql()},
      content AS (SELECT set_id, list(cell ORDER BY cell) AS c FROM text_cells GROUP BY 1)
      SELECT set_id, min(set_id) OVER (PARTITION BY c) AS rep, count(*) OVER (PARTITION BY c) AS n_copies
      FROM content""",
    "sketch_sizing": f"""WITH {src.SUPPLIERS_SQL},
      cost AS (SELECT count(DISTINCT set_id) AS n_sets, count(*) * 8 AS raw_bytes,
                      count(DISTINCT set_id) * 1024 AS signature_bytes FROM supplier_sets),
      shapes(shape, cells, axes, cores, prefix) AS (VALUES {_shapes_sql()}),
      sized AS (
        SELECT shape, cells::BIGINT AS total_cells, (axes * 128)::BIGINT AS kron_params,
               (cores * 128)::BIGINT AS tt_params, (cells * 128)::BIGINT AS full_params,
               (prefix * 128 * 4)::BIGINT AS tt_prefix_params FROM shapes)
      SELECT n_sets, raw_bytes, signature_bytes, sized.*, kron_params * 8 AS kron_bytes,
             tt_params * 4 AS tt_bytes, full_params * 4 AS full_bytes,
             full_params // kron_params AS compression_ratio,
             full_params // tt_params AS tt_compression_ratio,
             round(full_params * 4.0 / (kron_params * 8), 6)::DOUBLE AS kron_vs_full,
             round(full_params * 4.0 / (tt_params * 4), 6)::DOUBLE AS tt_vs_full,
             round(tt_params * 4.0 / (kron_params * 8), 6)::DOUBLE AS kron_vs_tt
      FROM cost, sized""",
    "random_projection": f"""WITH {src.EVENT_ROWS_SQL},
      cells AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS set_id,
                  ((src_ip % 12) * 5 + dst_ip % 5) * 24 + port % 24 AS cell FROM event_rows),
      w AS (SELECT c.c AS cell, j.j AS plane, {_GAUSS.format(c='c.c', j='j.j')} AS w
            FROM range(1440) c(c), range(8) j(j)),
      norms AS (SELECT plane, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
      SELECT set_id, plane::INTEGER AS plane, round(sum(w / n), 6) AS value
      FROM cells JOIN w USING (cell) JOIN norms USING (plane) GROUP BY 1, 2""",
    "vector_projection": f"""WITH
      w AS (SELECT c.c AS cell, j.j AS plane, {_GAUSS.format(c='c.c', j='j.j')} AS w
            FROM range(64) c(c), range(8) j(j)),
      norms AS (SELECT plane, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
      entries AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
                         generate_subscripts(embedding, 1) - 1 AS cell FROM embeddings)
      SELECT vec_id, plane::INTEGER AS plane, round(sum(x * w / n), 6) AS value
      FROM entries JOIN w USING (cell) JOIN norms USING (plane) GROUP BY 1, 2""",
    "default_set_ids": """
      SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1)::VARCHAR AS set_id
      FROM documents""",
}
