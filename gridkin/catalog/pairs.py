"""Candidate pairs, near-duplicates, exact similarity and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridkin.catalog import inputs as src
from gridkin.catalog.signatures import kron_minima_sql, minima_sql, signature_sql
from gridkin.functions.compare import similarity_class
from gridkin.operators import banding
from gridkin.operators.accuracy import error_summary, sample_pairs
from gridkin.operators.families import ClassicFamily, KronFamily
from gridkin.operators.library import library_pairs
from gridkin.operators.overlap import anchor_estimate, anchor_overlap, exact_jaccard
from gridkin.operators.signatures import signatures
from gridkin.operators.storage import scratch_path, write_and_read
from gridkin.plans.batches import batch_report, batch_summary, scored_batch
from gridkin.plans.duplicates import (
    all_similar_sets,
    copies,
    expand_copies,
    hashed_sets,
    near_duplicate_pairs,
    representatives,
)
from gridkin.plans.evaluation import evaluate, scored_pairs
from gridkin.sources import pairs as pair_files

K = 64
BANDS = 16
THRESHOLD = 0.5
# Three standard errors of an estimate at the threshold.
FLOOR = THRESHOLD - 3 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5
KRON_SHAPE = (16, 16, 16)
EVAL_K = 32
EVAL_KRON_K = 16
SAMPLE = 500


def _duplicates(spark, sf, threshold=THRESHOLD, bands=BANDS, **settings):
    return near_duplicate_pairs(
        src.text_sets(spark, sf),
        threshold,
        family=ClassicFamily(K),
        bands=bands,
        fetch=lambda ids: src.text_sets(spark, sf, only=ids),
        **settings,
    )


def near_duplicates(spark, sf):
    """Flagship: similar documents, estimated and exact, copies linked to their lowest id."""
    return _duplicates(spark, sf).withColumn("exact", F.round("exact", 9))


def near_duplicates_expanded(spark, sf):
    """The same with every copy's pairs written out."""
    hashed = hashed_sets(src.text_sets(spark, sf), ClassicFamily(K))
    full = expand_copies(_duplicates(spark, sf, hashed=hashed, ranked=False), hashed[1])
    return full.withColumn("exact", F.round("exact", 9))


def near_duplicates_default(spark, sf):
    """The verb at its own defaults: bands from the threshold and the recall wanted at it."""
    out = near_duplicate_pairs(
        src.text_sets(spark, sf), fetch=lambda ids: src.text_sets(spark, sf, only=ids)
    )
    return out.select("a", "b", F.round("exact", 9).alias("exact"))


def all_pairs_verb(spark, sf):
    """Every pair of documents whose estimate reaches the threshold, by the verb; empty texts have no pair."""
    return all_similar_sets(src.text_sets(spark, sf), THRESHOLD, ClassicFamily(K))


def lsh_candidates(spark, sf):
    """Document pairs of distinct content sharing a band, at or above the floor."""
    sigs, groups = hashed_sets(src.text_sets(spark, sf), ClassicFamily(K))
    return banding.similar_pairs(sigs, banding.even_bands(K, BANDS), K, FLOOR, representatives(groups))


def top_pairs(spark, sf):
    """The most similar of all pairs of documents that reach 0.7, none of them left to chance."""
    return banding.top_pairs(_duplicates(spark, sf, 0.7, bands=None, complete=True), 10, "exact").withColumn(
        "exact", F.round("exact", 9)
    )


def _next_pairs(spark, sf):
    suppliers = src.table(spark, sf, "supplier")
    return suppliers.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))


def exact_pairs(spark, sf):
    out = exact_jaccard(_next_pairs(spark, sf), src.supplier_sets(spark, sf))
    return out.withColumn("exact", F.round("exact", 9))


def all_pairs_threshold(spark, sf):
    """Every supplier pair whose estimate reaches the threshold; no pair can be missed."""
    sigs = write_and_read(signatures(src.supplier_rows(spark, sf), ClassicFamily(K)), "signatures")
    return banding.exhaustive_pairs(sigs, K, 0.25)


def anchor_similarity(spark, sf):
    """Supplier 1 against all others, exact and estimated."""
    sets = src.supplier_sets(spark, sf)
    exact = anchor_overlap(sets, 1)
    sigs = write_and_read(signatures(sets, ClassicFamily(K)), "signatures")
    est = anchor_estimate(sigs, 1)
    return exact.join(est, "set_id").select(
        "set_id", "n_cells", "inter", F.round("exact", 9).alias("exact"), "est",
        similarity_class("exact").alias("similarity"),
    )


def pair_sample(spark, sf):
    suppliers = src.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("set_id"))
    return sample_pairs(suppliers, SAMPLE)


_EVAL = [ClassicFamily(EVAL_K), KronFamily(EVAL_KRON_K, 42, KRON_SHAPE, "md5")]
_METRICS = (
    "avg_estimated", "avg_exact", "mae", "rmse", "pearson_r", "spearman_r", "min_exact", "max_exact",
)


def _rounded(metrics):
    return metrics.withColumns({c: F.round(c, 6) for c in _METRICS})


def accuracy_metrics(spark, sf):
    """Accuracy on sampled supplier pairs."""
    sets = src.supplier_sets(spark, sf).select("set_id", (F.col("cell") % 4096).alias("cell")).distinct()
    return _rounded(evaluate(sets, _EVAL, n_pairs=SAMPLE))


_SCOPES = (("high", "l_linenumber < 7"), ("medium", "l_linenumber < 5"), ("low", "l_linenumber < 2"))


def _scoped_sets(spark, sf):
    """Each supplier's parts whole, and thinned to three degrees."""
    lines = src.table(spark, sf, "lineitem")
    # A part is in a scope if its least line is; so lines are aggregated once, by number, for all scopes.
    parts = lines.groupBy("l_suppkey", (F.col("l_partkey") % 4096).alias("cell")).agg(
        F.min("l_linenumber").alias("l_linenumber")
    )
    scopes = F.array(F.lit("whole"), *[F.when(F.expr(cond), F.lit(scope)) for scope, cond in _SCOPES])
    named = parts.select("l_suppkey", "cell", F.explode(F.array_compact(scopes)).alias("scope"))
    return named.select(F.concat("scope", F.lit(":"), F.col("l_suppkey").cast("string")).alias("set_id"), "cell")


def _scoped_pairs(spark, sf):
    key = F.col("s_suppkey").cast("string")
    suppliers = src.table(spark, sf, "supplier")
    scopes = F.explode(F.array(*[F.lit(scope) for scope, _ in _SCOPES])).alias("scope")
    return suppliers.select(key.alias("key"), scopes).select(
        F.concat(F.lit("whole:"), "key").alias("a"), F.concat("scope", F.lit(":"), "key").alias("b"), "scope"
    )


def accuracy_by_scope(spark, sf):
    return _rounded(evaluate(_scoped_sets(spark, sf), _EVAL, pairs=_scoped_pairs(spark, sf)))


def error_by_method(spark, sf):
    scored = scored_pairs(_scoped_pairs(spark, sf), _scoped_sets(spark, sf), _EVAL)
    return error_summary(scored, ["scope", "method"]).withColumns(
        {c: F.round(c, 6) for c in ("mae", "max_error")}
    )


def _stored_pairs(spark, sf):
    """Per supplier the parts of even and odd lines, through the pair files."""
    lines = src.table(spark, sf, "lineitem")
    cells = lines.select(
        F.col("l_suppkey").alias("pair_no"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("side"),
        (F.col("l_partkey") % 4096).alias("cell"),
    ).distinct()
    path = scratch_path(spark, "pairs")
    pair_files.write_pairs(cells, path)
    return pair_files.read_pairs(spark, path)


def _labels(spark, sf):
    """Labels of two suppliers in three; the others stay unknown."""
    suppliers = src.table(spark, sf, "supplier").where(F.col("s_suppkey") % 3 != 0)
    return suppliers.select(
        F.col("s_suppkey").alias("pair_no"),
        F.col("s_name").alias("label_a"),
        F.col("s_nationkey").cast("string").alias("label_b"),
    )


def pair_report(spark, sf):
    return batch_report(scored_batch(_stored_pairs(spark, sf), _EVAL), _labels(spark, sf))


def pair_summary(spark, sf):
    return batch_summary(scored_batch(_stored_pairs(spark, sf), _EVAL))


def library_join(spark, sf):
    """Similar documents by the library's join, over sets of distinct content."""
    sets = src.text_sets(spark, sf)
    reps = representatives(copies(sets))
    distinct = write_and_read(sets.join(reps, "set_id", "left_semi"), "distinct-sets")
    return library_pairs(distinct, 0.7).withColumn("exact", F.round("exact", 9))


def _duplicates_sql(threshold: float) -> str:
    """CTE ``result(a, b, est, exact)``."""
    floor = max(threshold - 3 * (threshold * (1 - threshold) / K) ** 0.5, 1 / K)
    rows = K // BANDS
    return f"""{src.text_sets_sql()},
      content AS (SELECT set_id, list(cell ORDER BY cell) AS c FROM text_cells GROUP BY 1),
      groups AS (SELECT set_id, len(c) AS n, min(set_id) OVER (PARTITION BY c) AS rep FROM content),
      rep_cells AS (SELECT t.* FROM text_cells t JOIN groups g USING (set_id) WHERE g.rep = g.set_id),
      {signature_sql('rep_cells', K)},
      keys AS (SELECT set_id, b.b AS band, sig[b.b * {rows} + 1 : (b.b + 1) * {rows}] AS slice
               FROM sigs CROSS JOIN range({BANDS}) b(b)),
      candidates AS (SELECT DISTINCT x.set_id AS a, y.set_id AS b FROM keys x JOIN keys y
                     ON x.band = y.band AND x.slice = y.slice AND x.set_id < y.set_id),
      scored AS (SELECT c.a, c.b, avg((x.m.c = y.m.c)::INT) AS est FROM candidates c
                 JOIN best x ON x.set_id = c.a JOIN best y ON y.set_id = c.b AND x.plane = y.plane
                 GROUP BY 1, 2 HAVING est >= {floor}),
      shared AS (SELECT s.a, s.b, count(*) AS inter FROM scored s
                 JOIN rep_cells x ON x.set_id = s.a
                 JOIN rep_cells y ON y.set_id = s.b AND x.cell = y.cell GROUP BY 1, 2),
      verified AS (SELECT s.a, s.b, s.est,
                     coalesce(h.inter, 0)::DOUBLE / (x.n + y.n - coalesce(h.inter, 0)) AS exact
                   FROM scored s LEFT JOIN shared h USING (a, b)
                   JOIN groups x ON x.set_id = s.a JOIN groups y ON y.set_id = s.b),
      result AS (SELECT a, b, est, round(exact, 9) AS exact FROM verified WHERE exact >= {threshold}
                 UNION ALL SELECT rep, set_id, 1.0, 1.0 FROM groups WHERE rep <> set_id)"""


def _complete_sql(threshold: float) -> str:
    """CTE ``result(a, b, est, exact)`` of every pair of different contents that reaches the threshold, and the copies."""
    return f"""{src.text_sets_sql()},
      content AS (SELECT set_id, list(cell ORDER BY cell) AS c FROM text_cells GROUP BY 1),
      groups AS (SELECT set_id, len(c) AS n, min(set_id) OVER (PARTITION BY c) AS rep FROM content),
      rep_cells AS (SELECT t.* FROM text_cells t JOIN groups g USING (set_id) WHERE g.rep = g.set_id),
      {minima_sql('rep_cells', K)},
      shared AS (SELECT x.set_id AS a, y.set_id AS b, count(*) AS inter
                 FROM rep_cells x JOIN rep_cells y ON x.cell = y.cell AND x.set_id < y.set_id GROUP BY 1, 2),
      verified AS (SELECT a, b, inter::DOUBLE / (x.n + y.n - inter) AS exact
                   FROM shared JOIN groups x ON x.set_id = a JOIN groups y ON y.set_id = b
                   WHERE inter::DOUBLE / (x.n + y.n - inter) >= {threshold}),
      result AS (SELECT a, b, avg((x.m.c = y.m.c)::INT) AS est, round(any_value(exact), 9) AS exact
                 FROM verified JOIN best x ON x.set_id = a JOIN best y ON y.set_id = b AND x.plane = y.plane
                 GROUP BY 1, 2
                 UNION ALL SELECT rep, set_id, 1.0, 1.0 FROM groups WHERE rep <> set_id)"""


_SAMPLE_SQL = f"""
      ids AS (SELECT s_suppkey AS set_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier),
      total AS (SELECT count(*) * (count(*) - 1) // 2 AS t FROM supplier),
      draws AS (SELECT r.r AS id, ('0x' || substr(md5('0:' || r.r), 1, 15))::BIGINT % greatest(t, 1) AS p
                FROM range({2 * SAMPLE + 64}) r(r), total WHERE t > {2 * SAMPLE}),
      firsts AS (SELECT p, min(id) AS id FROM draws GROUP BY 1 ORDER BY id LIMIT {SAMPLE}),
      drawn AS (SELECT p FROM firsts UNION ALL
                SELECT unnest(range(t)) FROM total WHERE t <= {SAMPLE}),
      sampled AS (SELECT x.set_id AS a, y.set_id AS b FROM ids x JOIN ids y ON x.pos < y.pos
                  JOIN drawn ON p = y.pos * (y.pos - 1) // 2 + x.pos)"""


def _scored_sql(cells: str, pairs: str) -> str:
    """CTE ``scored(<pairs>, method, est, exact)`` under both evaluation families."""
    n0 = KRON_SHAPE
    return f"""{minima_sql(cells, EVAL_K)}, {kron_minima_sql(cells, EVAL_KRON_K, n0)},
      sizes AS (SELECT set_id, count(*) AS n FROM {cells} GROUP BY 1),
      shared AS (SELECT p.a, p.b, count(*) AS inter FROM {pairs} p JOIN {cells} x ON x.set_id = p.a
                 JOIN {cells} y ON y.set_id = p.b AND x.cell = y.cell GROUP BY 1, 2),
      exacts AS (SELECT p.*, coalesce(inter, 0)::DOUBLE
                   / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(inter, 0)) AS exact
                 FROM {pairs} p LEFT JOIN shared USING (a, b)
                 LEFT JOIN sizes x ON x.set_id = p.a LEFT JOIN sizes y ON y.set_id = p.b),
      winners AS (SELECT 'classic' AS method, set_id, plane, m.c AS c FROM best
                  UNION ALL SELECT 'kron', set_id, plane, m.c FROM kron_best),
      ests AS (SELECT p.a, p.b, x.method, avg((x.c = y.c)::INT) AS est FROM {pairs} p
               JOIN winners x ON x.set_id = p.a
               JOIN winners y ON y.set_id = p.b AND x.method = y.method AND x.plane = y.plane
               GROUP BY 1, 2, 3),
      scored AS (SELECT * FROM exacts JOIN ests USING (a, b))"""


_METRICS_SQL = """
      ranked AS (SELECT *,
          rank() OVER (PARTITION BY scope, method ORDER BY est)
            + (count(*) OVER (PARTITION BY scope, method, est) - 1) / 2.0 AS re,
          rank() OVER (PARTITION BY scope, method ORDER BY exact)
            + (count(*) OVER (PARTITION BY scope, method, exact) - 1) / 2.0 AS rt
        FROM scoped)
      SELECT scope, method, count(*) AS n_pairs, round(avg(est), 6) AS avg_estimated,
             round(avg(exact), 6) AS avg_exact, round(avg(abs(est - exact)), 6) AS mae,
             round(sqrt(avg((est - exact) * (est - exact))), 6) AS rmse,
             round(corr(est, exact), 6) AS pearson_r, round(corr(re, rt), 6) AS spearman_r,
             round(min(exact), 6) AS min_exact, round(max(exact), 6) AS max_exact
      FROM ranked GROUP BY 1, 2"""

_SCOPED_SQL = """
      scoped_cells AS (
        SELECT DISTINCT set_id, cell FROM (
          SELECT 'whole:' || l_suppkey AS set_id, l_partkey % 4096 AS cell FROM lineitem
          UNION ALL SELECT 'high:' || l_suppkey, l_partkey % 4096 FROM lineitem WHERE l_linenumber < 7
          UNION ALL SELECT 'medium:' || l_suppkey, l_partkey % 4096 FROM lineitem WHERE l_linenumber < 5
          UNION ALL SELECT 'low:' || l_suppkey, l_partkey % 4096 FROM lineitem WHERE l_linenumber < 2)),
      scoped_pairs AS (SELECT 'whole:' || s_suppkey AS a, s.s || ':' || s_suppkey AS b, s.s AS scope
                       FROM supplier CROSS JOIN (VALUES ('high'), ('medium'), ('low')) s(s))"""

_REPORT_SQL = f"""
      side_cells AS (SELECT DISTINCT l_suppkey || '|' || (CASE WHEN l_linenumber % 2 = 0 THEN 'a'
                       ELSE 'b' END) AS set_id, l_partkey % 4096 AS cell FROM lineitem),
      side_pairs AS (SELECT DISTINCT l_suppkey AS pair_no, l_suppkey || '|a' AS a, l_suppkey || '|b' AS b
                     FROM lineitem),
      {_scored_sql('side_cells', 'side_pairs')},
      report AS (
        SELECT pair_no, coalesce(s_name, '?') || '<->' || coalesce(s_nationkey::VARCHAR, '?') AS pair,
               method, round_even(exact, 4) AS exact, round_even(est, 4) AS est,
               round_even(abs(est - exact), 4) AS error
        FROM scored LEFT JOIN supplier ON s_suppkey = pair_no AND s_suppkey % 3 <> 0)"""

QUERIES = {
    "near_duplicates": near_duplicates,
    "near_duplicates_expanded": near_duplicates_expanded,
    "near_duplicates_default": near_duplicates_default,
    "all_pairs_verb": all_pairs_verb,
    "lsh_candidates": lsh_candidates,
    "top_pairs": top_pairs,
    "exact_jaccard": exact_pairs,
    "all_pairs_threshold": all_pairs_threshold,
    "anchor_similarity": anchor_similarity,
    "pair_sample": pair_sample,
    "accuracy_metrics": accuracy_metrics,
    "accuracy_by_scope": accuracy_by_scope,
    "error_by_method": error_by_method,
    "pair_report": pair_report,
    "pair_summary": pair_summary,
    "mllib_similarity_join": library_join,
}

SQL = {
    "near_duplicates": f"WITH {_duplicates_sql(THRESHOLD)} SELECT * FROM result",
    "near_duplicates_expanded": f"""WITH {_duplicates_sql(THRESHOLD)},
      between_reps AS (SELECT r.* FROM result r JOIN groups g ON g.set_id = r.b AND g.rep = r.b)
      SELECT least(x.set_id, y.set_id) AS a, greatest(x.set_id, y.set_id) AS b, est, exact
      FROM between_reps r JOIN groups x ON x.rep = r.a JOIN groups y ON y.rep = r.b
      UNION ALL SELECT x.set_id, y.set_id, 1.0, 1.0 FROM groups x JOIN groups y
      ON x.rep = y.rep AND x.set_id < y.set_id""",
    # Brute force over every pair of different contents that has a cell in common.
    "near_duplicates_default": f"""WITH {src.text_sets_sql()},
      content AS (SELECT set_id, list(cell ORDER BY cell) AS c FROM text_cells GROUP BY 1),
      groups AS (SELECT set_id, len(c) AS n, min(set_id) OVER (PARTITION BY c) AS rep FROM content),
      rep_cells AS (SELECT t.* FROM text_cells t JOIN groups g USING (set_id) WHERE g.rep = g.set_id),
      shared AS (SELECT x.set_id AS a, y.set_id AS b, count(*) AS inter
                 FROM rep_cells x JOIN rep_cells y ON x.cell = y.cell AND x.set_id < y.set_id GROUP BY 1, 2)
      SELECT a, b, round(inter::DOUBLE / (x.n + y.n - inter), 9) AS exact
      FROM shared JOIN groups x ON x.set_id = a JOIN groups y ON y.set_id = b
      WHERE inter::DOUBLE / (x.n + y.n - inter) >= 0.7
      UNION ALL SELECT rep, set_id, 1.0 FROM groups WHERE rep <> set_id""",
    "mllib_similarity_join": f"""WITH {src.text_sets_sql()},
      content AS (SELECT set_id, list(cell ORDER BY cell) AS c FROM text_cells GROUP BY 1),
      groups AS (SELECT set_id, len(c) AS n, min(set_id) OVER (PARTITION BY c) AS rep FROM content),
      rep_cells AS (SELECT t.* FROM text_cells t JOIN groups g USING (set_id) WHERE g.rep = g.set_id),
      {minima_sql('rep_cells', 8, library=True)},
      found AS (SELECT DISTINCT x.set_id AS a, y.set_id AS b FROM best x JOIN best y
                ON x.plane = y.plane AND x.m.c = y.m.c AND x.set_id < y.set_id),
      shared AS (SELECT a, b, count(*) AS inter FROM found JOIN rep_cells x ON x.set_id = a
                 JOIN rep_cells y ON y.set_id = b AND x.cell = y.cell GROUP BY 1, 2)
      SELECT a, b, round(inter::DOUBLE / (x.n + y.n - inter), 9) AS exact
      FROM shared JOIN groups x ON x.set_id = a JOIN groups y ON y.set_id = b
      WHERE inter::DOUBLE / (x.n + y.n - inter) >= 0.7""",
    "all_pairs_verb": f"""WITH {src.text_sets_sql()},
      content AS (SELECT set_id, list(cell ORDER BY cell) AS c FROM text_cells GROUP BY 1),
      groups AS (SELECT set_id, min(set_id) OVER (PARTITION BY c) AS rep FROM content),
      rep_cells AS (SELECT t.* FROM text_cells t JOIN groups g USING (set_id) WHERE g.rep = g.set_id),
      {minima_sql('rep_cells', K)}
      SELECT x.set_id AS a, y.set_id AS b, avg((x.m.c = y.m.c)::INT) AS est
      FROM best x JOIN best y ON x.plane = y.plane AND x.set_id < y.set_id
      GROUP BY 1, 2 HAVING est >= {THRESHOLD}
      UNION ALL SELECT rep, set_id, 1.0 FROM groups WHERE rep <> set_id""",
    "lsh_candidates": f"WITH {_duplicates_sql(THRESHOLD)} SELECT a, b, est FROM scored",
    # Brute force as well.
    "top_pairs": f"WITH {_complete_sql(0.7)} SELECT * FROM result ORDER BY exact DESC, a, b LIMIT 10",
    "exact_jaccard": f"""WITH {src.SUPPLIERS_SQL},
      sizes AS (SELECT set_id, count(*) AS n FROM supplier_sets GROUP BY 1),
      pairs AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
      shared AS (SELECT p.a, p.b, count(*) AS n FROM pairs p
                JOIN supplier_sets x ON x.set_id = p.a
                JOIN supplier_sets y ON y.set_id = p.b AND x.cell = y.cell GROUP BY 1, 2),
      sized AS (SELECT p.a, p.b, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b,
                       coalesce(i.n, 0) AS inter
                FROM pairs p LEFT JOIN sizes x ON x.set_id = p.a LEFT JOIN sizes y ON y.set_id = p.b
                LEFT JOIN shared i ON i.a = p.a AND i.b = p.b)
      SELECT *, CASE WHEN n_a + n_b > inter THEN round(inter::DOUBLE / (n_a + n_b - inter), 9)
                ELSE 0.0 END AS exact FROM sized""",
    "all_pairs_threshold": f"""WITH {src.SUPPLIERS_SQL}, {minima_sql('supplier_sets', K)}
      SELECT x.set_id AS a, y.set_id AS b, avg((x.m.c = y.m.c)::INT) AS est
      FROM best x JOIN best y ON x.plane = y.plane AND x.set_id < y.set_id
      GROUP BY 1, 2 HAVING est >= 0.25""",
    "anchor_similarity": f"""WITH {src.SUPPLIERS_SQL}, {minima_sql('supplier_sets', K)},
      own AS (SELECT cell FROM supplier_sets WHERE set_id = 1),
      counted AS (SELECT set_id, count(*) AS n_cells, count(own.cell) AS inter
                  FROM supplier_sets s LEFT JOIN own USING (cell) WHERE set_id <> 1 GROUP BY 1),
      ests AS (SELECT y.set_id, avg((x.m.c = y.m.c)::INT) AS est
               FROM best x JOIN best y ON x.set_id = 1 AND y.set_id <> 1 AND x.plane = y.plane GROUP BY 1),
      valued AS (SELECT *, inter::DOUBLE / (n_cells + (SELECT count(*) FROM own) - inter) AS j
                 FROM counted JOIN ests USING (set_id))
      SELECT set_id, n_cells, inter, round(j, 9) AS exact, est,
             CASE WHEN j > 0.5 THEN 'HIGH' WHEN j > 0.2 THEN 'MED' ELSE 'LOW' END AS similarity
      FROM valued""",
    "pair_sample": f"WITH {_SAMPLE_SQL} SELECT a, b FROM sampled",
    "accuracy_metrics": f"""WITH {_SAMPLE_SQL},
      folded AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey % 4096 AS cell FROM lineitem),
      {_scored_sql('folded', 'sampled')},
      scoped AS (SELECT *, 'combined' AS scope FROM scored), {_METRICS_SQL}""",
    "accuracy_by_scope": f"""WITH {_SCOPED_SQL}, {_scored_sql('scoped_cells', 'scoped_pairs')},
      scoped AS (SELECT scope, method, est, exact FROM scored
                 UNION ALL SELECT 'combined', method, est, exact FROM scored), {_METRICS_SQL}""",
    "error_by_method": f"""WITH {_SCOPED_SQL}, {_scored_sql('scoped_cells', 'scoped_pairs')}
      SELECT scope, method, count(*) AS n_pairs, round(avg(abs(est - exact)), 6) AS mae,
             round(max(abs(est - exact)), 6) AS max_error FROM scored GROUP BY 1, 2""",
    "pair_report": f"WITH {_REPORT_SQL} SELECT * FROM report",
    "pair_summary": f"""WITH {_REPORT_SQL}
      SELECT method, count(*) AS n_pairs, round_even(avg(abs(est - exact)), 4) AS mae,
             round_even(max(abs(est - exact)), 4) AS max_error FROM scored GROUP BY 1""",
}
