"""Running totals over large ordered groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.runtime import Scratch


def running_totals(rows: DataFrame, keys: list[str], value: str, sums: list[str], partitions: int | None = None) -> DataFrame:
    """rows, one per keys and value, with before_x and total_x of every x in sums, and next, the next higher value.

    Rows are range-partitioned by keys and value, so a large group spans partitions. Sums per partition and group, a
    small table, give each partition's offset; windows only run within a partition's part of a group.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Scratch(spark, "running").cut(rows.repartitionByRange(partitions, *keys, value).withColumn("_part", F.spark_partition_id()))
    per = ranged.groupBy("_part", *keys).agg(*[F.sum(s).alias(s) for s in sums], F.min(value).alias("_first"))
    group = Window.partitionBy(*keys)
    above = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        "_part", *keys, F.lead("_first").over(group.orderBy("_part")).alias("_next"),
        *[F.coalesce(F.sum(s).over(above), F.lit(0)).alias(f"_off_{s}") for s in sums], *[F.sum(s).over(group).alias(f"total_{s}") for s in sums],
    )
    here = Window.partitionBy("_part", *keys).orderBy(value)
    local = ranged.select("*", F.lead(value).over(here).alias("_local"), *[F.coalesce(F.sum(s).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_run_{s}") for s in sums])
    same = [local["_part"] == offsets["_part"]] + [local[k].eqNullSafe(offsets[k]) for k in keys]
    joined = local.join(offsets, same)
    return joined.select(
        *[local[c] for c in rows.columns], F.coalesce("_local", "_next").alias("next"),
        *[(F.col(f"_run_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}") for s in sums], *[F.col(f"total_{s}") for s in sums],
    )


def order_statistics(run: DataFrame, keys: list[str], value: str, count: str, probs: list[float]) -> DataFrame:
    """keys, prob, q: linearly interpolated quantiles of the values weighted by count, from running_totals' result."""
    n, lo = F.col(f"total_{count}"), F.col(f"before_{count}")
    hi = lo + F.col(count)
    spot = lambda p: (n - 1) * p
    inside = lambda i: (i >= lo) & (i < hi)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    hit = run.where(F.col(count) > 0).withColumn("prob", F.explode(F.filter(ps, lambda p: inside(F.floor(spot(p) + 1e-9)) | inside(F.ceil(spot(p) - 1e-9)))))
    h = spot(F.col("prob"))
    both = hit.groupBy(*keys, "prob").agg(
        F.max(F.when(inside(F.floor(h + 1e-9)), F.col(value))).alias("a"), F.max(F.when(inside(F.ceil(h - 1e-9)), F.col(value))).alias("b"), F.max(h - F.floor(h + 1e-9)).alias("f")
    )
    return both.select(*keys, "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.greatest("f", F.lit(0.0))).alias("q"))
