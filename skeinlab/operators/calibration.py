"""Scoring and choosing candidates against a real distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.functions.metrics import GROUPS, SELECTION, dimension
from skeinlab.operators import twosample as S
from skeinlab.runtime import broadcast_if_small

KEYS = ["domain", "model", "metric"]
CLIP = 5.0


def group_evaluation(run: DataFrame, dev: DataFrame, with_p: bool = True) -> DataFrame:
    """Per domain, model and metric: distances with the delta of simulated over real, five-point quantile error, median
    gap, share of values far from the real median, and direction."""
    d = S.distances(run, KEYS).withColumn("cliffs_delta", -F.col("cliffs_delta"))
    out = d.join(S.quantile_error(run, KEYS, S.GRID_5), KEYS).join(S.median_gaps(run, dev, KEYS), KEYS).join(S.empirical_fail_rate(dev, KEYS), KEYS)
    if with_p:
        out = S.p_values(out)
        differs = F.col("mwu_p_value") < 0.05
    else:
        differs = F.abs("z") > 1.959963984540054
    return out.withColumn("direction", F.when(differs & (F.col("cliffs_delta") > 0), "generated_higher").when(differs, "generated_lower").otherwise("similar"))


def robust_status(run: DataFrame, dev: DataFrame) -> DataFrame:
    """Where the simulated median lies in the real distribution: status, percentile rank and distance, robust z."""
    real = S.side_quantiles(run, KEYS, "n_real", {"real_p10": 0.1, "real_median": 0.5, "real_p90": 0.9})
    sim = S.side_quantiles(run, KEYS, "n_sim", {"sim_median": 0.5})
    mad = S.side_quantiles(dev, KEYS, "n_real", {"mad": 0.5})
    rank = run.join(sim, KEYS).groupBy(*KEYS).agg((F.sum(F.when(F.col("value") <= F.col("sim_median"), F.col("n_real")).otherwise(0)) / F.max("total_n_real")).alias("percentile_rank"))
    r = real.join(sim, KEYS).join(mad, KEYS).join(rank, KEYS)
    z = (F.col("sim_median") - F.col("real_median")) / (F.col("mad") + 1e-9)
    status = F.when(F.col("sim_median") > F.col("real_p90"), "too_high").when(F.col("sim_median") < F.col("real_p10"), "too_low").otherwise("in_range")
    r = r.withColumn("percentile_distance", F.abs(F.col("percentile_rank") - 0.5) * 2).withColumn("robust_z", z)
    return r.withColumn("abs_robust_z_clipped", F.least(F.abs("robust_z"), F.lit(CLIP))).withColumn("status", status)


def group_scores(robust: DataFrame, groups: dict[str, tuple] = GROUPS) -> DataFrame:
    """Per domain, model and metric group: metrics, share out of range, mean distance and clipped z."""
    g = F.broadcast(dimension(robust.sparkSession, groups, "metric_group"))
    return robust.join(g, "metric").groupBy("domain", "model", "metric_group").agg(
        F.count("*").alias("metric_count"), F.avg((F.col("status") != "in_range").cast("double")).alias("quantile_fail_rate"),
        F.avg("percentile_distance").alias("mean_percentile_distance"), F.avg("abs_robust_z_clipped").alias("mean_abs_robust_z"),
    )


def selection_scores(robust: DataFrame) -> DataFrame:
    """Per domain, model and selection family: metrics out of range, means and maxima of distance and z."""
    g = F.broadcast(dimension(robust.sparkSession, SELECTION, "family"))
    z = F.abs("robust_z")
    return robust.join(g, "metric").groupBy("domain", "model", "family").agg(
        F.count_if(F.col("status") != "in_range").alias("out_of_range"), F.avg("percentile_distance").alias("mean_distance"), F.max("percentile_distance").alias("max_distance"),
        F.avg(z).alias("mean_z"), F.max(z).alias("max_z"),
    )


#: What candidates are ordered by, first first: family and statistic.
ORDER = (
    ("guardrail_core", "out_of_range"), ("semantic_core", "out_of_range"), ("semantic_core", "mean_distance"), ("semantic_core", "max_distance"), ("semantic_core", "mean_z"),
    ("semantic_core", "max_z"), ("engagement_core", "out_of_range"), ("engagement_core", "mean_distance"), ("engagement_core", "max_distance"), ("engagement_core", "mean_z"),
    ("engagement_core", "max_z"), ("length_core", "out_of_range"), ("length_core", "mean_distance"), ("length_core", "max_distance"), ("length_core", "mean_z"),
)


def candidate_ranking(robust: DataFrame) -> DataFrame:
    """Candidates of each domain in lexicographic order; a family without metrics counts as infinitely far. Rounded to
    nine digits, so that ties are ties."""
    s = selection_scores(robust)
    inf = F.lit(float("inf"))
    cols = [F.coalesce(F.max(F.when(F.col("family") == f, F.round(F.col(c).cast("double"), 9))), F.lit(0.0) if c == "out_of_range" else inf).alias(f"{f}_{c}") for f, c in ORDER]
    overall = robust.groupBy("domain", "model").agg(
        F.round(F.avg((F.col("status") != "in_range").cast("double")), 9).alias("quantile_fail_rate"), F.round(F.avg("percentile_distance"), 9).alias("mean_percentile_distance"), F.round(F.avg("abs_robust_z_clipped"), 9).alias("mean_abs_robust_z")
    )
    keyed = s.groupBy("domain", "model").agg(*cols).join(overall, ["domain", "model"])
    order = [f"{f}_{c}" for f, c in ORDER] + ["quantile_fail_rate", "mean_percentile_distance", "mean_abs_robust_z", "model"]
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(*order)))


def frontier(scores: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Best candidate per domain and metric group; a held one stays unless a new one is strictly better."""
    key = F.struct("quantile_fail_rate", "mean_percentile_distance", "mean_abs_robust_z", F.col("fresh"), "model")
    rows = scores.withColumn("fresh", F.lit(1))
    if held is not None:
        rows = rows.unionByName(held.withColumn("fresh", F.lit(0)), allowMissingColumns=True)
    best = rows.groupBy("domain", "metric_group").agg(F.min(key).alias("k"))
    return best.select("domain", "metric_group", "k.model", "k.quantile_fail_rate", "k.mean_percentile_distance", "k.mean_abs_robust_z")


def severity(robust: DataFrame, evaluated: DataFrame) -> DataFrame:
    """critical, secondary or acceptable per domain, model and metric, by how far out it is."""
    r = robust.join(evaluated.select(*KEYS, "cliffs_delta", "empirical_fail_rate"), KEYS)
    out = F.col("status") != "in_range"
    dist, z, fail, delta = F.col("percentile_distance"), F.abs("robust_z"), F.col("empirical_fail_rate"), F.abs("cliffs_delta")
    critical = out & ((dist >= 0.75) | (z >= 2.5) | (fail > 0.5) | (delta >= 0.474))
    secondary = out | (dist >= 0.4) | (z >= 1.0) | (fail >= 0.2) | (delta >= 0.33)
    return r.select(*KEYS, F.when(critical, "critical").when(secondary, "secondary").otherwise("acceptable").alias("tier"), "percentile_distance", "robust_z")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reductions and closeness per domain and metric of two group evaluations (of one model each)."""
    keep = ["wasserstein", "quantile_error", "cliffs_delta", "empirical_fail_rate", "median_gap", "mad_normalized_gap", "sim_mean", "real_mean"]
    b = before.select("domain", "metric", *[F.col(c).alias(f"b_{c}") for c in keep])
    a = after.select("domain", "metric", *[F.col(c).alias(f"a_{c}") for c in keep])
    j = b.join(a, ["domain", "metric"], "left")
    less = lambda c: F.abs(f"b_{c}") - F.abs(f"a_{c}")
    j = j.withColumn("abs_delta_reduction", less("cliffs_delta")).withColumn("wasserstein_reduction", less("wasserstein")).withColumn("quantile_error_reduction", less("quantile_error"))
    j = j.withColumn("abs_median_gap_reduction", less("median_gap")).withColumn("abs_mad_gap_reduction", less("mad_normalized_gap")).withColumn("fail_rate_reduction", less("empirical_fail_rate"))
    j = j.withColumn("mean_gap_reduction", F.abs(F.col("b_real_mean") - F.col("b_sim_mean")) - F.abs(F.col("b_real_mean") - F.col("a_sim_mean")))
    pos = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    j = j.withColumn("improved", pos("abs_delta_reduction") & pos("fail_rate_reduction"))
    for c in ("wasserstein", "quantile_error", "mean_gap", "abs_median_gap", "abs_mad_gap"):
        j = j.withColumn(f"closer_by_{c}", pos(f"{c}_reduction"))
    return j


def before_after_summary(j: DataFrame) -> DataFrame:
    flags = ["improved", "closer_by_wasserstein", "closer_by_quantile_error", "closer_by_mean_gap", "closer_by_abs_median_gap", "closer_by_abs_mad_gap"]
    return j.groupBy("domain").agg(
        F.avg(F.abs("b_cliffs_delta")).alias("abs_delta_before"), F.avg(F.abs("a_cliffs_delta")).alias("abs_delta_after"), F.avg("b_wasserstein").alias("wasserstein_before"),
        F.avg("a_wasserstein").alias("wasserstein_after"), F.avg("b_empirical_fail_rate").alias("fail_rate_before"), F.avg("a_empirical_fail_rate").alias("fail_rate_after"),
        (1 - F.avg("a_empirical_fail_rate")).alias("pass_rate_after"), *[F.count_if(f).alias(f"n_{f}") for f in flags],
    )


def regression_guard(candidate: DataFrame, reference: DataFrame, multiplier: float = 1.5, floor: float = 0.05) -> DataFrame:
    """Metrics on which a candidate is worse than the reference allows: value, limit, severity; by effect size and distance."""
    values = lambda df: df.select("domain", "model", "metric", F.explode(F.array(F.struct(F.lit("abs_cliffs_delta").alias("statistic"), F.abs("cliffs_delta").alias("x")), F.struct(F.lit("wasserstein").alias("statistic"), F.col("wasserstein").alias("x")))).alias("s")).select("domain", "model", "metric", "s.*")
    r = values(reference).select("domain", "metric", "statistic", F.greatest(F.col("x") * multiplier, F.col("x") + floor).alias("limit"))
    return values(candidate).join(r, ["domain", "metric", "statistic"]).where(F.col("x") > F.col("limit")).select("domain", "model", "metric", "statistic", F.col("x").alias("value"), "limit", F.try_divide("x", "limit").alias("severity"))


def change_labels(candidate: DataFrame, reference: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """improved, worsened or mixed per domain, model and metric over several statistics, of which lower is better."""
    stats = ["wasserstein", "quantile_error", "cliffs_delta", "empirical_fail_rate", "median_gap", "mad_normalized_gap", "ks"]
    r = reference.select("domain", "metric", *[F.abs(c).alias(f"r_{c}") for c in stats])
    j = candidate.join(r, ["domain", "metric"])
    up = [F.abs(c) > F.col(f"r_{c}") + tolerance for c in stats]
    down = [F.abs(c) < F.col(f"r_{c}") - tolerance for c in stats]
    any_of = lambda cs: F.array_contains(F.array(*[F.coalesce(c, F.lit(False)) for c in cs]), True)
    label = F.when(any_of(down) & ~any_of(up), "improved").when(any_of(up) & ~any_of(down), "worsened").otherwise("mixed")
    return j.select("domain", "model", "metric", label.alias("change"))


def trailing_misses(log: DataFrame, key: str, order: str, won: str) -> DataFrame:
    """Per key, how many entries follow the last one that won."""
    last = log.groupBy(key).agg(F.max(F.when(F.col(won), F.struct(order))).alias("last"), F.count("*").alias("n"))
    return log.join(last, key).groupBy(key).agg(F.count_if(F.col("last").isNull() | (F.struct(order) > F.col("last"))).alias("misses"))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def in_range(rows: DataFrame, value: str, ranges: DataFrame, default: str | None = None) -> DataFrame:
    """rows with the name of the range (name, first, last) their value lies in; a small table, default beyond it."""
    r = broadcast_if_small(ranges)
    out = rows.join(r, F.col(value).between(F.col("first"), F.col("last")), "left").drop("first", "last")
    return out.withColumn("name", F.coalesce("name", F.lit(default))) if default else out
