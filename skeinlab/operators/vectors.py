"""Likeness of all pairs of a group's vectors: exact means and order statistics without a row per pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.runtime import Scratch

TILE = 1_024
BINS = 1 << 14


def _tiles(vectors: DataFrame, tile: int) -> DataFrame:
    n = vectors.groupBy("thread_id").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("blocks"))
    v = vectors.join(n, "thread_id").withColumn("block", F.pmod(F.xxhash64("thread_id", "vec_id"), F.col("blocks")).cast("int"))
    o = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return o.select("thread_id", "vec_id", "vector", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), (F.col("block") <= F.col("other")).alias("is_left"))


def _cosines(key: tuple, pdf: pd.DataFrame) -> np.ndarray:
    """Cosines of the tile's pairs in a fixed order; norms are clipped from below, what isn't finite counts as 0."""
    pdf = pdf.sort_values("vec_id")
    mat = np.nan_to_num(np.array(pdf.vector.tolist(), dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
    if key[1] == key[2]:
        c = mat @ mat.T
        return np.clip(c[np.triu_indices(len(c), 1)], -1, 1)
    left = pdf.is_left.to_numpy(bool)
    return np.clip((mat[left] @ mat[~left].T).ravel(), -1, 1)


def _bin(c: np.ndarray) -> np.ndarray:
    return np.minimum(((c + 1) / 2 * BINS).astype(np.int64), BINS - 1)


def pair_cosines(vectors: DataFrame, top: int = 10, tile: int = TILE) -> DataFrame:
    """Per thread_id of (thread_id, vec_id, vector): pairs, mean, median, p90, mean of the `top` highest, max and min.

    Tiles of two blocks give sums, their highest values and a histogram; ranks in the summed histogram show which bins
    hold the wanted order statistics, and a second pass brings only those bins' values. Exact, whatever the group's
    size, and no task gets more than two blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cosines")
    tiled = scratch.cut(_tiles(vectors, tile))
    by = tiled.groupBy("thread_id", "left", "right")

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = _cosines(key, pdf)
        if not len(c):
            return pd.DataFrame({"thread_id": [], "kind": [], "bin": [], "n": [], "x": []})
        bins, n = np.unique(_bin(c), return_counts=True)
        best = np.sort(c)[::-1][:top]
        rows = [("bin", b, k, 0.0) for b, k in zip(bins.tolist(), n.tolist())] + [("top", 0, 1, x) for x in best.tolist()] + [("sum", 0, len(c), float(c.sum())), ("min", 0, 1, float(c.min()))]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["thread_id", "kind", "bin", "n", "x"])

    stats = scratch.cut(by.applyInPandas(first, "thread_id string, kind string, bin long, n long, x double"))
    sums = stats.where("kind = 'sum'").groupBy("thread_id").agg(F.sum("n").alias("pairs"), (F.sum("x") / F.sum("n")).alias("mean_cosine"))
    lows = stats.where("kind = 'min'").groupBy("thread_id").agg(F.min("x").alias("min_cosine"))
    w = Window.partitionBy("thread_id").orderBy(F.desc("x"))
    tops = stats.where("kind = 'top'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).groupBy("thread_id").agg(F.avg("x").alias("top_k_mean_cosine"), F.max("x").alias("max_cosine"))
    hist = stats.where("kind = 'bin'").groupBy("thread_id", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("thread_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    placed = hist.withColumn("before", upto - F.col("n")).join(sums.select("thread_id", "pairs"), "thread_id")
    spots = placed.withColumn("p", F.explode(F.array(F.lit(0.5), F.lit(0.9)))).withColumn("h", (F.col("pairs") - 1) * F.col("p"))
    inside = lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("n"))
    want = spots.where(inside(F.floor("h")) | inside(F.ceil("h"))).groupBy("thread_id", "bin").agg(F.first("before").alias("before"))
    want = scratch.cut(want)  # at most four bins of each thread
    marked = tiled.join(want.groupBy("thread_id").agg(F.collect_list("bin").alias("bins")), "thread_id")

    def second(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = _cosines(key, pdf)
        b = _bin(c)
        keep = np.isin(b, np.array(list(pdf.bins.iloc[0])))
        return pd.DataFrame({"thread_id": key[0], "bin": b[keep], "x": c[keep]})

    inner = marked.groupBy("thread_id", "left", "right").applyInPandas(second, "thread_id string, bin long, x double").join(want, ["thread_id", "bin"])
    rank = F.row_number().over(Window.partitionBy("thread_id", "bin").orderBy("x")) - 1 + F.col("before")
    ranked = inner.withColumn("rank", rank).join(sums.select("thread_id", "pairs"), "thread_id")
    cols = []
    for name, p in (("median_cosine", 0.5), ("p90_cosine", 0.9)):
        h = (F.col("pairs") - 1) * p
        low, high = F.max(F.when(F.col("rank") == F.floor(h), F.col("x"))), F.max(F.when(F.col("rank") == F.ceil(h), F.col("x")))
        cols.append((low + (high - low) * F.max(h - F.floor(h))).alias(name))
    return sums.join(lows, "thread_id").join(tops, "thread_id").join(ranked.groupBy("thread_id").agg(*cols), "thread_id")
