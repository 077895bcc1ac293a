"""Comparison tables, submissions and boards on top of the two-sample statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.functions.metrics import CORE, DOMAINS, FAMILIES, MIN_THREADS, SUMMARY_ID, dimension
from skeinlab.operators import twosample as S

KEYS = ["domain", "model", "metric"]


def comparison(run: DataFrame, with_p: bool = True) -> DataFrame:
    """One row per domain, model and metric with at least two values on each side."""
    d = S.distances(run, KEYS).where("real_n >= 2 and sim_n >= 2")
    med = S.side_quantiles(run, KEYS, "n_real", {"real_median": 0.5}).join(S.side_quantiles(run, KEYS, "n_sim", {"sim_median": 0.5}), KEYS)
    out = d.join(med, KEYS).join(S.quantile_error(run, KEYS, S.GRID_21), KEYS).join(S.interval_fail_rate(run, KEYS), KEYS)
    out = out.withColumn("abs_cliffs_delta", F.abs("cliffs_delta")).withColumn("cliffs_delta_interpretation", S.interpretation(F.col("cliffs_delta")))
    return S.p_values(out) if with_p else out


def passes(compared: DataFrame) -> DataFrame:
    """With pass: the Mann-Whitney test doesn't tell real from simulated at 0.05."""
    ok = F.col("mwu_p_value") > 0.05 if "mwu_p_value" in compared.columns else ~(F.abs("z") >= 1.959963984540054)
    return compared.withColumn("pass", F.coalesce(ok, F.lit(True)))


def similarity(compared: DataFrame) -> DataFrame:
    """Per domain and model: metrics, share passed, means of effect size and distance, and bands of effect size."""
    band = lambda b: F.count_if(F.col("cliffs_delta_interpretation") == b).alias(f"n_{b}")
    return passes(compared).groupBy("domain", "model").agg(
        F.count("*").alias("n_metrics"), F.avg(F.col("pass").cast("double")).alias("similarity_ratio"), F.avg("abs_cliffs_delta").alias("mean_abs_delta"),
        F.avg("wasserstein").alias("mean_wasserstein"), *[band(b) for b in ("negligible", "small", "medium", "large")],
    )


def pass_counts(compared: DataFrame) -> DataFrame:
    """Passed core metrics per domain and model; a core metric that wasn't compared is a fail, so the denominator is fixed."""
    core = passes(compared).where(F.col("metric").isin(*CORE))
    cells = compared.select("domain", "model").distinct()
    return cells.join(core.groupBy("domain", "model").agg(F.count_if("pass").alias("passed")), ["domain", "model"], "left").select(
        "domain", "model", F.coalesce("passed", F.lit(0)).alias("passed"), F.lit(len(CORE)).alias("of")
    )


def family_means(compared: DataFrame) -> DataFrame:
    """Mean distance and effect size per model and metric family, over all domains."""
    fam = F.broadcast(dimension(compared.sparkSession, FAMILIES, "family"))
    return compared.join(fam, "metric").groupBy("model", "family").agg(F.avg("wasserstein").alias("w1"), F.avg("abs_cliffs_delta").alias("cliffs"))


def heat(n) -> F.Column:
    """The style class of a pass count: the highest defined one that isn't above it."""
    # Counts with a style class of their own.
    defined = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 15, 16]
    return F.concat(F.lit("heat-"), F.array_max(F.filter(F.array(*[F.lit(x) for x in defined]), lambda x: x <= F.greatest(n, F.lit(0)))).cast("string"))


def board(compared: DataFrame, domains=DOMAINS) -> DataFrame:
    """Models by passes: total, percent of all, style class of the best cell; only those in all domains have a rank."""
    cells = pass_counts(compared)
    m = cells.groupBy("model").agg(F.sum("passed").alias("total"), F.countDistinct("domain").alias("n_domains"), F.max("passed").alias("best"))
    full = F.col("n_domains") == len(domains)
    place = F.row_number().over(Window.partitionBy(full).orderBy(F.desc("total"), "model"))
    return m.select(
        "model", "total", "n_domains", F.round(100.0 * F.col("total") / (len(domains) * len(CORE)), 1).alias("percent"), heat(F.col("best")).alias("best_class"),
        F.when(full, place).alias("place"),
    )


def usable_threads(table: DataFrame) -> DataFrame:
    return table.where(F.col("thread_id").isNotNull() & (F.trim("thread_id") != "") & (F.col("thread_id") != SUMMARY_ID))


def missing_core(values: DataFrame, cells: DataFrame) -> DataFrame:
    """domain, model, metric of the core metrics without a single value."""
    spark = values.sparkSession
    core = spark.createDataFrame([(m,) for m in CORE], "metric string")
    want = cells.select("domain", "model").distinct().join(F.broadcast(core))  # a fixed 16 rows per cell
    return want.join(values.select("domain", "model", "metric").distinct(), ["domain", "model", "metric"], "left_anti")


def submission_issues(table: DataFrame, values: DataFrame) -> DataFrame:
    """domain, model, level, msg; table has domain, model and thread_id."""
    cells = table.select("domain", "model").distinct()
    n = usable_threads(table).groupBy("domain", "model").agg(F.count("*").alias("n"))
    sized = cells.join(n, ["domain", "model"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unknown = cells.where(~F.col("domain").isin(*DOMAINS)).select("domain", "model", F.lit("error").alias("level"), F.concat(F.lit("unknown domain "), "domain").alias("msg"))
    few = sized.where(F.col("n") < MIN_THREADS).select("domain", "model", F.lit("error").alias("level"), F.format_string("only %d usable threads", "n").alias("msg"))
    gone = missing_core(values, cells).groupBy("domain", "model").agg(F.count("*").alias("k")).select("domain", "model", F.lit("warning").alias("level"), F.format_string("%d core metrics missing", "k").alias("msg"))
    return unknown.unionByName(few).unionByName(gone)


def accepted_models(issues: DataFrame, models: DataFrame) -> DataFrame:
    """Models without an error in any of their submissions."""
    return models.select("model").distinct().join(issues.where("level = 'error'").select("model").distinct(), "model", "left_anti")


def override(seed: DataFrame, computed: DataFrame, keys=("model", "tier")) -> DataFrame:
    """Seed entries unless a computed entry has their key, and the computed ones."""
    return seed.join(computed.select(*keys).distinct(), list(keys), "left_anti").unionByName(computed, allowMissingColumns=True)


def stale(published: DataFrame, rebuilt: DataFrame) -> bool:
    """Whether two tables differ in any row, counted with repetition."""
    return not (published.exceptAll(rebuilt).isEmpty() and rebuilt.exceptAll(published).isEmpty())


def noise_ratio(means: DataFrame, floor: DataFrame) -> DataFrame:
    """Family means as multiples of the noise floor (family, w1, cliffs), one decimal."""
    f = F.broadcast(floor.select("family", F.col("w1").alias("w0"), F.col("cliffs").alias("c0")))
    return means.join(f, "family").select("model", "family", F.round(F.try_divide("w1", "w0"), 1).alias("w1_ratio"), F.round(F.try_divide("cliffs", "c0"), 1).alias("cliffs_ratio"))
