"""Exact percentiles per group over very large columns: one distributed sort, then positions by counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.runtime import Scratch

METRICS = ("self_bleu_4", "semantic_mean_cosine", "mean_disagree_probability")
GROUP = ("model", "product_category")
PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def value_counts(rows: DataFrame, metrics=METRICS, group=GROUP, day: str | None = "scored_on") -> DataFrame:
    """The mergeable state: how often each value occurs per group, metric and day.

    Identical rows (in all columns) count once; they are told by two 64-bit hashes of values and null pattern, so whole rows aren't shuffled.
    Summary rows, nulls, NaN and infinities don't count; negative zero is zero.
    """
    cols = [F.col(f"`{c}`") for c in rows.columns]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in cols])  # xxhash64 skips nulls
    keep = [*group, *([day] if day else []), *metrics]
    once = rows.where("thread_id is null or thread_id <> '__summary_mean__'").select(
        F.xxhash64(nulls, *cols).alias("_h1"), F.xxhash64(F.lit(1), nulls, *reversed(cols)).alias("_h2"), *keep
    ).dropDuplicates(["_h1", "_h2"])
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = once.select(*group, *([day] if day else []), values.alias("v")).select(*group, *([day] if day else []), "v.metric", (F.col("v.value") + F.lit(0.0)).alias("value"))
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return long.where(good).groupBy(*group, *([day] if day else []), "metric", "value").agg(F.count("*").alias("n"))


def merge_counts(states: list[DataFrame], group=GROUP) -> DataFrame:
    """One state of several, of separate days or partitions of the rows; days are added up."""
    return reduce(DataFrame.unionByName, [s.select(*group, "metric", "value", "n") for s in states]).groupBy(*group, "metric", "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, percents=PERCENTS, group=GROUP, partitions: int | None = None) -> DataFrame:
    """Per group and metric: n, p1 ... p99 and max_error, from value counts.

    The different values are sorted once by range over all groups, so a large group lies in many partitions and ties
    are one row. Counts per partition and group give each partition's offset in the group; the partition's own running
    count then locates the order statistics on either side of a position (n-1)*p, which are interpolated linearly. The
    result is exact, max_error is 0. Groups with null keys are groups; groups without a value don't occur.
    """
    spark = state.sparkSession
    scratch = Scratch(spark, "percentiles")
    keys = [*group, "metric"]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = merge_counts([state], group)
    ranged = scratch.cut(merged.repartitionByRange(partitions, *keys, "value").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part", *keys).agg(F.sum("n").alias("here"))
    by_part = Window.partitionBy(*keys)
    offsets = counts.select(
        "part", *keys, (F.sum("here").over(by_part.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"),
        F.sum("here").over(by_part).alias("total"),
    )
    running = F.sum("n").over(Window.partitionBy("part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", running)
    same = [placed.part == offsets.part] + [placed[k].eqNullSafe(offsets[k]) for k in keys]
    placed = placed.join(offsets, same).select(*[placed[k] for k in keys], "value", "n", (F.col("before") + F.col("upto")).alias("end"), "total")
    inside = lambda i: (i >= F.col("end") - F.col("n")) & (i < F.col("end"))
    spot = lambda p: (F.col("total") - 1) * p / F.lit(100.0)
    near = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: inside(F.floor(spot(p))) | inside(F.ceil(spot(p))))  # most values are at none
    spots = placed.select("*", F.explode(near).alias("percent")).withColumn("h", spot(F.col("percent")))
    spots = spots.withColumn("low", F.when(inside(F.floor("h")), F.col("value"))).withColumn("high", F.when(inside(F.ceil("h")), F.col("value")))
    found = spots.groupBy(*keys, "percent").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("h").alias("h"), F.max("total").alias("total"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))
    one = lambda p: F.max(F.when(F.col("percent") == p, value)).alias(f"p{p}")
    return found.groupBy(*keys).agg(F.max("total").alias("n"), *[one(p) for p in percents], F.lit(0.0).alias("max_error"))
