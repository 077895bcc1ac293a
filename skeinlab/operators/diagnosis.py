"""Diagnosis of single threads and candidates, choice between candidates over iterations, and what was learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlab.operators import twosample as S
from skeinlab.operators.calibration import KEYS

# What metrics of a name's beginning measure, the first that fits.
MEASURES = (
    ("self_bleu", "content repetitiveness"), ("self_bertscore", "content repetitiveness"), ("semantic", "content repetitiveness"), ("mean_story_probability", "story/anecdote likelihood"),
    ("toxicity", "toxicity"), ("severe_toxicity", "toxicity"), ("obscene", "toxicity"), ("threat", "toxicity"), ("insult", "toxicity"), ("identity_attack", "toxicity"), ("aggression", "aggressiveness"),
    ("length", "comment length diversity"), ("max_depth", "thread structure"), ("avg_depth", "thread structure"), ("avg_branching", "thread structure"), ("structural_virality", "thread structure"),
)
#: Statistics of a metric group, first first; higher is worse.
WORSE = ("quantile_fail_rate", "mean_percentile_distance", "mean_abs_robust_z")
#: Iterations without a win after which another root is looked for.
STAGNATION = 3


def diagnose_rows(rows: DataFrame, run: DataFrame, dev: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How each value of single threads (domain, model, metric, value) lies among the real ones: their median, empirical
    p, percentile (0 to 100), direction and flag.

    run and dev are the running tables of the values and of their deviations, in which the rows' own values are, so no
    real value is read again. Values that aren't in run, as of domains without real threads, give no row.
    """
    med = S.side_quantiles(run, KEYS, "n_real", {"real_median": 0.5})
    placed = rows.select(*KEYS, "value").join(med, KEYS).withColumn("deviation", F.abs(F.col("value") - F.col("real_median")))
    p = S.empirical_p(dev, KEYS).select(*KEYS, "deviation", F.col("p").alias("empirical_p_value"))
    pct = S.percentile_ranks(run, KEYS).select(*KEYS, "value", "percentile")
    out = placed.join(p, [*KEYS, "deviation"]).join(pct, [*KEYS, "value"])
    fail = F.col("empirical_p_value") < alpha
    side = F.when(~fail, "within_baseline").when(F.col("value") > F.col("real_median"), "too_high").otherwise("too_low")
    return out.select(*KEYS, F.col("value").alias("generated_value"), "real_median", "empirical_p_value", "percentile", side.alias("direction"), F.when(fail, "fail").otherwise("pass").alias("diagnosis_flag"))


def metric_rows(evaluated: DataFrame, robust: DataFrame, metrics: list[str]) -> DataFrame:
    """domain, model, metric and its statistics of both tables for the metrics named; a metric without a row in either
    has infinite distances and the status `missing`, and counts as out of range."""
    spark = evaluated.sparkSession
    wanted = spark.createDataFrame([(m, i) for i, m in enumerate(metrics)], "metric string, position int")
    cells = robust.select("domain", "model").unionByName(evaluated.select("domain", "model")).distinct().join(F.broadcast(wanted))  # a fixed number of rows per cell
    tests = [c for c in ("mwu_p_value", "ks_p_value") if c in evaluated.columns]
    e = evaluated.select(*KEYS, "wasserstein", "quantile_error", "empirical_fail_rate", F.abs("median_gap").alias("abs_median_gap"), F.abs("cliffs_delta").alias("abs_cliffs_delta"), *tests)
    r = robust.select(*KEYS, "percentile_distance", F.abs("robust_z").alias("abs_robust_z"), "status")
    out = cells.join(e, KEYS, "left").join(r, KEYS, "left")
    far = ("wasserstein", "quantile_error", "empirical_fail_rate", "abs_median_gap", "abs_cliffs_delta", "percentile_distance", "abs_robust_z")
    out = out.select(*KEYS, "position", *[F.coalesce(c, F.lit(float("inf"))).alias(c) for c in far], *[F.coalesce(c, F.lit(1.0)).alias(c) for c in tests], F.coalesce("status", F.lit("missing")).alias("status"))
    return out.withColumn("out_of_range", (F.col("status") != "in_range").cast("int"))


def target_summary(rows: DataFrame) -> DataFrame:
    """Per domain and model of metric_rows: means of the five distances, and how many metrics pass either test at 0.05
    (where the rows have p-values)."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("wasserstein", "quantile_error", "empirical_fail_rate", "abs_median_gap", "abs_cliffs_delta")]
    tests = [F.count_if(F.col(f"{t}_p_value") > 0.05).alias(f"{t}_pass_count") for t in ("mwu", "ks") if f"{t}_p_value" in rows.columns]
    return rows.groupBy("domain", "model").agg(F.count("*").alias("n_metrics"), F.sum("out_of_range").alias("out_of_range"), *means, *tests)


def selection_summary(evaluated: DataFrame) -> DataFrame:
    """Per domain and model: mean effect size, mean fail rate, and metrics that differ: by either p-value below 0.05, or
    by |z| of the rank test where there are none."""
    tests = [F.col(c) < 0.05 for c in ("mwu_p_value", "ks_p_value") if c in evaluated.columns] or [F.abs("z") > 1.959963984540054]
    differs = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return evaluated.groupBy("domain", "model").agg(F.avg(F.abs("cliffs_delta")).alias("mean_abs_cliffs_delta"), F.avg("empirical_fail_rate").alias("overall_fail_rate"), F.count_if(differs).alias("metrics_sig_different"))


def interpretation_text(metric: Column, direction: Column, tier: Column) -> Column:
    """A sentence on a metric by what its name begins with."""
    of = F.lit("metric")
    for begins, measures in reversed(MEASURES):
        of = F.when(metric.startswith(begins), measures).otherwise(of)
    sentence = lambda before, after: F.concat(F.lit(before), of, F.lit(after))
    return (
        F.when(tier == "acceptable", "Within acceptable range of real baseline.")
        .when(direction == "generated_higher", sentence("Generated discussions have ", " values too high compared to real."))
        .when(direction == "generated_lower", sentence("Generated discussions have ", " values too low compared to real."))
        .otherwise(sentence("Generated discussions deviate from real baseline on ", "."))
    )


def by_severity(tiers: DataFrame) -> DataFrame:
    """severity's rows with place: critical ones first, then by distance and by |z|, downwards."""
    order = F.when(F.col("tier") == "critical", 0).when(F.col("tier") == "secondary", 1).when(F.col("tier") == "acceptable", 2).otherwise(3)
    w = Window.partitionBy("domain", "model").orderBy(order, F.desc(F.round("percentile_distance", 9)), F.desc(F.round(F.abs("robust_z"), 3)), "metric")
    return tiers.withColumn("place", F.row_number().over(w))


def candidate_scores(robust: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row per candidate: share out of range and means over all its metrics, from both tables."""
    r = robust.groupBy("domain", "model").agg(
        F.count("*").alias("n_metrics"), F.avg((F.col("status") != "in_range").cast("double")).alias("quantile_fail_rate"), F.avg("percentile_distance").alias("mean_percentile_distance"),
        F.avg("abs_robust_z_clipped").alias("mean_abs_robust_z"), F.count_if(F.col("status") == "too_high").alias("n_too_high"), F.count_if(F.col("status") == "too_low").alias("n_too_low"),
    )
    return r.join(selection_summary(evaluated), ["domain", "model"], "left")


def phase_choice(evaluated: DataFrame, violations: DataFrame, focus: list[str]) -> DataFrame:
    """The candidate of each domain with the least key: guard violations (domain, model, n), mean effect size and mean
    distance over all metrics, then effect size, distance and median gap of each focus metric in order; then its name.
    Numbers are rounded to nine digits, so that ties are ties; a missing focus metric is infinitely far."""
    inf = F.lit(float("inf"))
    nine = lambda c: F.round(c, 9)
    keyed = evaluated.groupBy("domain", "model").agg(
        nine(F.avg(F.abs("cliffs_delta"))).alias("delta"), nine(F.avg("wasserstein")).alias("w"),
        F.array(*[F.coalesce(F.max(F.when(F.col("metric") == m, nine(F.abs(c)))), inf) for m in focus for c in ("cliffs_delta", "wasserstein", "median_gap")]).alias("focus"),
    ).join(violations, ["domain", "model"], "left")
    key = F.struct(F.coalesce("n", F.lit(0)).alias("violations"), "delta", "w", "focus", "model")
    best = keyed.groupBy("domain").agg(F.min(key).alias("k"))
    return best.select("domain", "k.model", "k.violations", F.col("k.delta").alias("mean_abs_cliffs_delta"), F.col("k.w").alias("mean_wasserstein"))


def worst_groups(scores: DataFrame) -> DataFrame:
    """Metric groups of each candidate with place, the worst first; at ties by name."""
    w = Window.partitionBy("domain", "model").orderBy(*[F.desc(F.round(c, 9)) for c in WORSE], "metric_group")
    return scores.withColumn("place", F.row_number().over(w))


def family_order(scores: DataFrame, families: list[str]) -> DataFrame:
    """domain, model, families: its groups from the worst on, then the fixed ones that it lacks."""
    ranked = worst_groups(scores).groupBy("domain", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "metric_group"))), lambda x: x.metric_group).alias("found"))  # as many as there are groups
    return ranked.select("domain", "model", F.array_distinct(F.concat("found", F.array(*[F.lit(f) for f in families]))).alias("families"))


def search_roots(scores: DataFrame, best: DataFrame, frontier: DataFrame, stagnation: DataFrame, trigger: int = STAGNATION) -> DataFrame:
    """From which candidate each domain's search goes on: domain, model, root, metric_group.

    best: domain, model; stagnation: domain, misses. Up to `trigger` iterations without a win it is the best one. Beyond
    it is the frontier's candidate for the best one's worst group in which another candidate is strictly better.
    """
    own = worst_groups(scores).join(best, ["domain", "model"]).select("domain", F.col("model").alias("best"), "metric_group", "place", F.struct(*[F.round(c, 9).alias(c) for c in WORSE]).alias("own_key"))
    held = frontier.select("domain", "metric_group", "model", F.struct(*[F.round(c, 9).alias(c) for c in WORSE]).alias("key"))
    better = own.join(held, ["domain", "metric_group"]).where((F.col("model") != F.col("best")) & (F.col("key") < F.col("own_key"))).join(stagnation.where(F.col("misses") >= trigger), "domain")
    chosen = better.groupBy("domain").agg(F.min(F.struct("place", "model", "metric_group")).alias("c"))
    out = best.join(chosen, "domain", "left")
    return out.select("domain", F.coalesce("c.model", "model").alias("model"), F.when(F.col("c").isNull(), "global_best").otherwise("challenger_root").alias("root"), F.col("c.metric_group").alias("metric_group"))


def family_learning(log: DataFrame) -> DataFrame:
    """Per family of tried candidates (family, iteration, candidate, won and WORSE): attempts, wins, win rate, and the
    best candidate with its iteration; unknown statistics are infinitely bad."""
    key = F.struct(*[F.coalesce(F.round(c, 9), F.lit(float("inf"))).alias(c) for c in WORSE], "iteration", "candidate")
    g = log.groupBy("family").agg(F.count("*").alias("attempts"), F.count_if("won").alias("wins"), F.min(key).alias("k"))
    return g.select("family", "attempts", "wins", (F.col("wins") / F.col("attempts")).alias("win_rate"), F.col("k.iteration").alias("best_iteration"), F.col("k.candidate").alias("best_candidate"))


def until_enough(batches: DataFrame, key: str, order: str, count: str, enough: int) -> DataFrame:
    """Batches of each key in order, as long as those before have fewer than `enough`, with the running total. Batches
    are counts, so a key's rows are few."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.withColumn("so_far", F.sum(count).over(w)).where(F.col("so_far") - F.col(count) < enough)
