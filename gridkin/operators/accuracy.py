"""How well estimates match exact similarities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.compare import abs_error
from gridkin.functions.hashing import md5_number
from gridkin.operators.ranking import average_ranks, row_index
from gridkin.operators.storage import write_and_read

# Spread below which a correlation is undefined and reported as 0.
FLAT = 1e-10


def with_combined_scope(scored: DataFrame, label: str = "combined") -> DataFrame:
    """Each row once under its own scope and once under the combined one."""
    return scored.withColumn("scope", F.explode(F.array(F.col("scope"), F.lit(label))))


def error_summary(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Mean and largest absolute error per group."""
    error = abs_error("est", "exact")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(error).alias("mae"), F.max(error).alias("max_error")
    )


def accuracy_metrics(scored: DataFrame, by: Sequence[str] = ("scope", "method")) -> DataFrame:
    """Error and correlation metrics of ``(by..., est, exact)`` per group.

    Rows are first counted per distinct (group, est, exact): estimates take at most k+1 values, so the
    ranking and every later join runs on far fewer rows, and no value or group can be hot.
    """
    by = list(by)
    points = write_and_read(
        scored.groupBy(*by, "est", "exact").agg(F.count(F.lit(1)).alias("w")), "points"
    )
    est_ranks = _weighted_ranks(points, by, "est", "rank_est")
    exact_ranks = _weighted_ranks(points, by, "exact", "rank_exact")
    ranked = points.join(est_ranks, [*by, "est"]).join(exact_ranks, [*by, "exact"])

    w, diff = F.col("w"), F.col("est") - F.col("exact")
    n = F.sum(w)

    def moment(x, y=None):
        return F.sum(w * x * (x if y is None else y))

    e, t = F.col("est"), F.col("exact")
    re, rt = F.col("rank_est"), F.col("rank_exact")
    sums = ranked.groupBy(*by).agg(
        n.alias("n_pairs"),
        (F.sum(w * e) / n).alias("avg_estimated"),
        (F.sum(w * t) / n).alias("avg_exact"),
        (F.sum(w * F.abs(diff)) / n).alias("mae"),
        F.sqrt(F.sum(w * diff * diff) / n).alias("rmse"),
        F.min(t).alias("min_exact"),
        F.max(t).alias("max_exact"),
        *[moment(x, y).alias(name) for name, x, y in (
            ("_ee", e, e), ("_tt", t, t), ("_et", e, t),
            ("_ree", re, re), ("_rtt", rt, rt), ("_ret", re, rt),
        )],
    )
    count = F.col("n_pairs")
    mean_e, mean_t, mean_r = F.col("avg_estimated"), F.col("avg_exact"), (count + 1) / 2
    zero = F.lit(0.0)
    sd_e = F.sqrt(F.greatest(F.col("_ee") / count - mean_e * mean_e, zero))
    sd_t = F.sqrt(F.greatest(F.col("_tt") / count - mean_t * mean_t, zero))
    sd_re = F.sqrt(F.greatest(F.col("_ree") / count - mean_r * mean_r, zero))
    sd_rt = F.sqrt(F.greatest(F.col("_rtt") / count - mean_r * mean_r, zero))
    flat = (sd_e < FLAT) | (sd_t < FLAT)
    pearson = (F.col("_et") / count - mean_e * mean_t) / (sd_e * sd_t)
    spearman = (F.col("_ret") / count - mean_r * mean_r) / (sd_re * sd_rt)
    return sums.select(
        *by,
        "n_pairs",
        "avg_estimated",
        "avg_exact",
        "mae",
        "rmse",
        F.when(flat, zero).otherwise(pearson).alias("pearson_r"),
        F.when(flat, zero).otherwise(spearman).alias("spearman_r"),
        "min_exact",
        "max_exact",
    )


def _weighted_ranks(points: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return average_ranks(points, by, value, name, weight="w").select(*by, value, name)


def sample_pairs(ids: DataFrame, n_pairs: int, seed: int = 0) -> DataFrame:
    """``(a, b)``, a < b: so many distinct pairs of a set list, or all when there are fewer.

    Pairs are drawn as numbers and then resolved through the row index, so the quadratic pair list is
    never built.  The sample is a function of seed and ids: the first so many distinct numbers of one
    sequence of draws, of which as much is looked at as it takes.
    """
    spark = ids.sparkSession
    indexed = write_and_read(row_index(ids.select("set_id").distinct(), ["set_id"], "pos"), "set-index")
    n = indexed.count()
    total = n * (n - 1) // 2
    order = md5_number(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    if total <= n_pairs:
        drawn = spark.range(total).select(F.col("id").alias("p"))
    else:
        n_draws, found = 2 * n_pairs + 64, -1
        while found < n_pairs:
            draws = spark.range(n_draws).select("id", (order % F.lit(total)).alias("p"))
            first = draws.groupBy("p").agg(F.min("id").alias("id")).orderBy("id").limit(n_pairs)
            drawn = write_and_read(first, "drawn-pairs").select("p")
            found, n_draws = drawn.count(), 2 * n_draws
    j = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * F.col("p"))) / 2).cast("long")
    fixed = (
        F.when(_pairs_below(j) > F.col("p"), j - 1)
        .when(_pairs_below(j + 1) <= F.col("p"), j + 1)
        .otherwise(j)
    )
    placed = drawn.withColumn("j", fixed).withColumn("i", F.col("p") - _pairs_below(F.col("j")))
    first = indexed.select(F.col("set_id").alias("a"), F.col("pos").alias("i"))
    second = indexed.select(F.col("set_id").alias("b"), F.col("pos").alias("j"))
    return placed.join(first, "i").join(second, "j").select("a", "b")


def _pairs_below(j):
    """Number of pairs whose larger position is below j."""
    return F.call_function("div", j * (j - 1), F.lit(2).cast("long"))


def throughput(runs: DataFrame, n: str = "n_sets", seconds: str = "elapsed_s") -> DataFrame:
    """Sets per second and milliseconds per set of timed runs."""
    return runs.withColumns(
        {
            "sets_per_sec": F.col(n) / F.col(seconds),
            "per_set_ms": F.col(seconds) / F.col(n) * 1000,
        }
    )
