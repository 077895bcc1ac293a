"""Choosing examples and samples: few-shot ranking, stratified and weighted samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.functions.text import retrieval_tokens, truncate
from skeinlab.operators.prefix import running_totals


def few_shot(threads: DataFrame, query: str, n: int = 8, most_comments: int = 4, allowed: DataFrame | None = None) -> DataFrame:
    """The n threads (thread_id, subreddit, title, body, comments: array) closest to a query text, one per title and body.

    Score: shared terms, plus half a point per comment up to most_comments, plus half for a question mark; ties by a
    hash of the id. allowed, if given, limits the threads by id.
    """
    if allowed is not None:
        threads = threads.join(allowed.select("thread_id").distinct(), "thread_id", "left_semi")
    some = F.slice(F.coalesce("comments", F.array().cast("array<string>")), 1, most_comments)
    text = F.concat_ws("\n", "subreddit", "title", "body", F.array_join(some, " "))
    shared = F.size(F.array_intersect(retrieval_tokens(text), retrieval_tokens(F.lit(query))))
    question = F.when(F.concat_ws("\n", "title", "body").contains("?"), 0.5).otherwise(0.0)
    scored = threads.withColumn("score", shared + F.least(F.size(F.coalesce("comments", F.array().cast("array<string>"))), F.lit(most_comments)) * 0.5 + question)
    key = [F.lower(truncate("title", 100)).alias("t"), F.lower(truncate("body", 140)).alias("b")]
    best = scored.groupBy(*key).agg(F.min_by(F.struct("thread_id", "score"), F.struct(-F.col("score"), F.md5("thread_id"), "thread_id")).alias("r")).select("r.*")
    top = best.orderBy(F.desc("score"), F.md5("thread_id"), "thread_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.md5("thread_id"), "thread_id")))


def stratified(rows: DataFrame, price: str, key: str, n: int) -> DataFrame:
    """n rows evenly spaced in the order of price (null ones aside): every floor(i*N/n)-th. Positions come from running
    totals, so the order needs no single task."""
    priced = rows.where(F.col(price).isNotNull()).select(F.struct(price, key).alias("at"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    run = running_totals(priced, ["all"], "at", ["one"])
    total, i = F.col("total_one"), F.col("before_one")
    taken = F.floor((i * n + total - 1) / total)
    return run.where((F.floor(taken * total / n) == i) & (taken < n)).select(f"at.{key}", f"at.{price}")


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, with probability by weight (exponential keys); rows of no weight are never taken."""
    return rows.where(F.col(weight) > 0).withColumn("_k", -F.ln(1 - F.rand(seed)) / F.col(weight)).orderBy("_k").limit(n).drop("_k")


def batches(rows: DataFrame, delay: str, span: float) -> DataFrame:
    """Rows by time batch: the whole spans that fit in the delay."""
    return rows.withColumn("batch", F.floor(F.col(delay) / span))
