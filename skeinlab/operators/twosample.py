"""Two-sample statistics of real against simulated values, all from one pre-aggregated, ordered table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlab.functions.metrics import METRICS, SUMMARY_ID
from skeinlab.functions.pvalues import ks_p_value, mwu_p_value
from skeinlab.operators.prefix import order_statistics, running_totals
from skeinlab.runtime import Scratch, broadcast_if_small

GRID_21 = [i / 20 for i in range(21)]
GRID_5 = [0.1, 0.25, 0.5, 0.75, 0.9]

#: Bands of Cliff's delta.
BANDS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))


def metric_values(table: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """keys, metric, value in long form: numeric, finite, without summary rows; negative zero is zero."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast(`{m}` as double)").alias("value")) for m in metrics if m in table.columns]))
    long = table.where(F.coalesce(F.col("thread_id"), F.lit("")) != SUMMARY_ID).select(*keys, pairs.alias("x")).select(*keys, "x.metric", (F.col("x.value") + 0.0).alias("value"))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def sides(values: DataFrame, real: str = "real", side: str = "model", domain: str = "domain") -> DataFrame:
    """domain, model, metric, value, n_real, n_sim: each model's values with those of the real threads of its domain."""
    counts = Scratch(values.sparkSession, "counts").cut(values.groupBy(domain, side, "metric", "value").agg(F.count("*").alias("n")))  # read three times below
    sim = counts.where(F.col(side) != real)  # null sides are on neither
    models = sim.select(domain, side).distinct()
    truth = counts.where(F.col(side) == real).drop(side).join(broadcast_if_small(models), domain)
    both = sim.select(domain, side, "metric", "value", F.lit(0).cast("long").alias("n_real"), F.col("n").alias("n_sim")).unionByName(
        truth.select(domain, side, "metric", "value", F.col("n").alias("n_real"), F.lit(0).cast("long").alias("n_sim"))
    )
    return both.groupBy(domain, side, "metric", "value").agg(F.sum("n_real").alias("n_real"), F.sum("n_sim").alias("n_sim"))


def ordered(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The running table that everything below reads."""
    return running_totals(counts, keys, "value", ["n_real", "n_sim"])


def distances(run: DataFrame, keys: list[str]) -> DataFrame:
    """keys, real_n, sim_n, means, u (of the real side), ties, z, ks, wasserstein, cliffs_delta (real over simulated).

    Ranks, both distribution functions and gaps to the next value are in the running table, so one aggregation gives
    all: no pair of values is formed.
    """
    t = F.col("n_real") + F.col("n_sim")
    mean_rank = F.col("before_n_real") + F.col("before_n_sim") + (t + 1) / 2
    gap = F.abs((F.col("before_n_real") + F.col("n_real")) / F.col("total_n_real") - (F.col("before_n_sim") + F.col("n_sim")) / F.col("total_n_sim"))
    both = run.where("total_n_real > 0 and total_n_sim > 0")
    g = both.groupBy(*keys).agg(
        F.max("total_n_real").alias("real_n"), F.max("total_n_sim").alias("sim_n"),
        (F.sum(F.col("value") * F.col("n_real")) / F.max("total_n_real")).alias("real_mean"), (F.sum(F.col("value") * F.col("n_sim")) / F.max("total_n_sim")).alias("sim_mean"),
        F.sum(F.col("n_real") * mean_rank).alias("ranks"), F.sum(t * t.cast("double") * t - t).alias("ties"),
        F.max(gap).alias("ks"), F.sum(F.coalesce(gap * (F.col("next") - F.col("value")), F.lit(0.0))).alias("wasserstein"),
    )
    n, m = F.col("real_n"), F.col("sim_n")
    u = F.col("ranks") - n * (n + 1) / 2
    total = n + m
    sigma = F.sqrt(n * m / 12 * (total + 1 - F.coalesce(F.try_divide(F.col("ties"), total * (total - 1)), F.lit(0.0))))
    g = g.withColumn("u", u).withColumn("z", F.try_divide(F.greatest(F.col("u"), n * m - F.col("u")) - n * m / 2 - 0.5, sigma))
    return g.withColumn("cliffs_delta", 2 * F.col("u") / (n * m) - 1).drop("ranks")


def p_values(d: DataFrame) -> DataFrame:
    """With mwu_p_value and ks_p_value: one row per group goes through Python."""
    return d.withColumn("mwu_p_value", mwu_p_value("u", "real_n", "sim_n", "ties")).withColumn("ks_p_value", ks_p_value("ks", "real_n", "sim_n"))


def interpretation(delta) -> F.Column:
    out = F.lit("large")
    for limit, name in reversed(BANDS):
        out = F.when(F.abs(delta) < limit, name).otherwise(out)
    return out


def quantile_error(run: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """Mean absolute difference of the two sides' quantiles over the grid."""
    real = order_statistics(run, keys, "value", "n_real", grid).withColumnRenamed("q", "qr")
    sim = order_statistics(run, keys, "value", "n_sim", grid).withColumnRenamed("q", "qs")
    return real.join(sim, [*keys, "prob"]).groupBy(*keys).agg(F.avg(F.abs(F.col("qr") - F.col("qs"))).alias("quantile_error"))


def side_quantiles(run: DataFrame, keys: list[str], count: str, names: dict[str, float]) -> DataFrame:
    """One column per named quantile of a side."""
    q = order_statistics(run, keys, "value", count, sorted(set(names.values())))
    return q.groupBy(*keys).agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("q"))).alias(n) for n, p in names.items()])


def interval_fail_rate(run: DataFrame, keys: list[str]) -> DataFrame:
    """Share of simulated values outside the central 95 % of the real ones."""
    bounds = side_quantiles(run, keys, "n_real", {"low": 0.025, "high": 0.975})
    return run.join(bounds, keys).groupBy(*keys).agg(F.try_divide(F.sum(F.when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.col("n_sim")).otherwise(0)), F.max("total_n_sim")).alias("empirical_fail_rate"))


def deviations(run: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value (absolute deviation from the real median), n_real, n_sim, in running order."""
    med = side_quantiles(run, keys, "n_real", {"med": 0.5})
    dev = run.join(med, keys).groupBy(*keys, F.abs(F.col("value") - F.col("med")).alias("value")).agg(F.sum("n_real").alias("n_real"), F.sum("n_sim").alias("n_sim"))
    return ordered(dev, keys)


def empirical_p(dev: DataFrame, keys: list[str]) -> DataFrame:
    """keys, deviation, n_sim, p: share of real values at least as far from their median, add-one smoothed."""
    p = (F.col("total_n_real") - F.col("before_n_real") + 1) / (F.col("total_n_real") + 1)
    return dev.where("n_sim > 0").select(*keys, F.col("value").alias("deviation"), "n_sim", p.alias("p"))


def empirical_fail_rate(dev: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    return empirical_p(dev, keys).groupBy(*keys).agg((F.sum(F.when(F.col("p") < alpha, F.col("n_sim")).otherwise(0)) / F.sum("n_sim")).alias("empirical_fail_rate"))


def percentile_ranks(run: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, n_sim, percentile (0 to 100) of each simulated value among the real ones, ties averaged."""
    left, right = F.col("before_n_real"), F.col("before_n_real") + F.col("n_real")
    pct = F.coalesce(F.try_divide((left + right + F.when(left < right, 1).otherwise(0)) * 50.0, F.col("total_n_real")), F.lit(50.0))
    return run.where("n_sim > 0").select(*keys, "value", "n_sim", pct.alias("percentile"))


def median_gaps(run: DataFrame, dev: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of both sides, the gap, the real side's median absolute deviation, and the gap in units of it."""
    real = side_quantiles(run, keys, "n_real", {"real_median": 0.5})
    sim = side_quantiles(run, keys, "n_sim", {"sim_median": 0.5})
    mad = side_quantiles(dev, keys, "n_real", {"mad": 0.5})
    out = real.join(sim, keys).join(mad, keys).withColumn("median_gap", F.col("sim_median") - F.col("real_median"))
    return out.withColumn("mad_normalized_gap", F.col("median_gap") / (F.col("mad") + 1e-9))


#: Sides of a bootstrap, and iterations of it that one task makes.
SIDE_NAMES = ("real", "before", "after")
ROUNDS = 250


def _ordered_quantiles(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(values, at, side="right") / len(values)


def wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two samples in memory."""
    both = np.sort(np.concatenate([a, b]))
    gaps = np.diff(both)
    return float(np.sum(np.abs(_ordered_quantiles(np.sort(a), both[:-1]) - _ordered_quantiles(np.sort(b), both[:-1])) * gaps))


def _resampled_distances(support: np.ndarray, counts: list[np.ndarray], iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Wasserstein distance of real to before less that of real to after, for resamples of the counts by value."""
    gaps, shares = np.diff(support), [c / c.sum() for c in counts]
    got = np.empty(iterations)
    for i in range(iterations):
        r, b, a = (np.cumsum(rng.multinomial(c.sum(), p))[:-1] / c.sum() for c, p in zip(counts, shares))
        got[i] = np.sum(np.abs(r - b) * gaps) - np.sum(np.abs(r - a) * gaps)
    return got


def bootstrap_reduction(values: DataFrame, metric_order: list[str], iterations: int = 1000, seed: int = 0) -> DataFrame:
    """domain, metric, low, high: 95 % interval of how much closer to real `after` is than `before`, by resampling.

    values: domain, metric, side (real, before, after), value. Different values with their counts are resampled, by
    ROUNDS iterations a task; null where a side has no values.
    """
    keys = ["domain", "metric"]
    counted = values.groupBy(*keys, "value").pivot("side", list(SIDE_NAMES)).count().na.fill(0, list(SIDE_NAMES))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(0, iterations - 1)), F.lit(ROUNDS)))

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        domain, metric, first = key
        pdf = pdf.sort_values("value")
        counts = [pdf[s].to_numpy(np.int64) for s in SIDE_NAMES]
        if any(c.sum() == 0 for c in counts):
            return pd.DataFrame({"domain": [domain], "metric": [metric], "reduction": [None]})
        rng = np.random.default_rng([seed + metric_order.index(metric), *domain.encode(), int(first)])
        return pd.DataFrame({"domain": domain, "metric": metric, "reduction": _resampled_distances(pdf.value.to_numpy(), counts, min(ROUNDS, iterations - int(first)), rng)})

    got = counted.withColumn("first", rounds).groupBy(*keys, "first").applyInPandas(resample, "domain string, metric string, reduction double")
    return got.groupBy(*keys).agg(F.percentile("reduction", F.lit(0.025)).alias("low"), F.percentile("reduction", F.lit(0.975)).alias("high"))
