"""Thread aggregates over the scores that models give comments or reply pairs.

Models aren't part of the library: a provider (see functions.providers) adds the score columns that these read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.operators.prefix import order_statistics, running_totals
from skeinlab.runtime import Scratch

POLITENESS = ("polite", "somewhat_polite", "neutral", "impolite")
TOXICITY = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack")


def stance(pairs: DataFrame, top: int = 5) -> DataFrame:
    """Per thread of reply pairs (p_disagree, label): pairs, mean probability, share labelled disagree, counts per label,
    and the ids of the `top` most disagreeing replies."""
    w = Window.partitionBy("thread_id").orderBy(F.desc("p_disagree"), "comment_id")
    best = pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).groupBy("thread_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "comment_id"))), lambda x: x.comment_id), ",").alias("top_pairs")
    )
    is_ = lambda x: F.count_if(F.col("label") == x)
    g = pairs.groupBy("thread_id").agg(
        F.count("*").alias("pair_count"), F.avg("p_disagree").alias("mean_disagree_probability"), F.avg((F.col("label") == "disagree").cast("double")).alias("hard_disagree_rate"),
        is_("agree").alias("n_agree"), is_("neutral").alias("n_neutral"), is_("disagree").alias("n_disagree"),
    )
    return g.join(best, "thread_id")


def story(comments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per thread (p_story): counts, rate, mean, median, highest and lowest probability."""
    p = F.col("p_story")
    return comments.groupBy("thread_id").agg(
        F.count_if(p >= threshold).alias("story_count"), F.count_if(p < threshold).alias("not_story_count"), F.avg((p >= threshold).cast("double")).alias("story_rate"),
        F.avg(p).alias("mean_story_probability"), F.median(p).alias("median_story_probability"), F.max(p).alias("max_story_probability"), F.min(p).alias("min_story_probability"),
    )


def emotion(comments: DataFrame, n_labels: int = 28) -> DataFrame:
    """Per thread (label: the dominant emotion, n_labels, ord: order in the thread): entropy of the dominant labels and
    its share of ln(labels), labels per comment, share of changes from one comment to the next, the most frequent
    label (the earliest at a tie) and its share."""
    c = comments.groupBy("thread_id", "label").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    total = c.groupBy("thread_id").agg(F.sum("n").alias("total"))
    j = c.join(total, "thread_id")
    share = F.col("n") / F.col("total")
    e = j.groupBy("thread_id").agg(
        (-F.sum(share * F.ln(share)) + 0.0).alias("emotion_entropy"), F.min_by("label", F.struct(-F.col("n"), "first")).alias("dominant_emotion"), F.max(share).alias("dominant_emotion_share")
    )
    w = Window.partitionBy("thread_id").orderBy("ord")
    s = comments.withColumn("last", F.lag("label").over(w)).groupBy("thread_id").agg(
        F.avg("n_labels").alias("avg_labels_per_comment"), F.coalesce(F.avg(F.when(F.col("last").isNotNull(), (F.col("last") != F.col("label")).cast("double"))), F.lit(0.0)).alias("emotion_shift_rate")
    )
    return e.join(s, "thread_id").withColumn("emotion_entropy_normalized", F.col("emotion_entropy") / F.ln(F.lit(float(n_labels))))


def politeness(comments: DataFrame) -> DataFrame:
    """Per thread (label): counts and rates of the four labels."""
    is_ = lambda x: F.col("label") == x
    return comments.groupBy("thread_id").agg(*[F.count_if(is_(x)).alias(f"{x}_count") for x in POLITENESS], *[F.avg(is_(x).cast("double")).alias(f"{x}_rate") for x in POLITENESS])


def toxicity(comments: DataFrame) -> DataFrame:
    """Per thread: mean, maximum and 90th percentile of the six scores and of aggression, their mean in a comment."""
    c = comments.withColumn("aggression_score", sum(F.col(t) for t in TOXICITY) / len(TOXICITY))
    cols = []
    for t in (*TOXICITY, "aggression_score"):
        cols += [F.avg(t).alias(f"{t}_mean"), F.max(t).alias(f"{t}_max"), F.percentile(t, F.lit(0.9)).alias(f"{t}_p90")]
    return c.groupBy("thread_id").agg(*cols)


def overall(threads: DataFrame, metrics: list[str], weight: str) -> DataFrame:
    """metric, threads, mean, median, highest, and mean weighted by a count, over all threads."""
    long = threads.select(F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("w", "x.*")
    return long.where("v is not null").groupBy("metric").agg(
        F.count("*").alias("threads"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.max("v").alias("most"), F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("weighted_mean")
    )


def wide(parts: list[DataFrame], key: str = "thread_id") -> DataFrame:
    """One row per thread of any part; columns of a thread that a part doesn't have are null. A shared column takes the
    first part's value that isn't null."""
    names: list[str] = []
    for p in parts:
        names += [c for c in p.columns if c != key and c not in names]
    types = {c: t for p in reversed(parts) for c, t in p.dtypes}
    rows = [p.select(key, F.lit(i).alias("_i"), *[F.col(c) if c in p.columns else F.lit(None).cast(types[c]).alias(c) for c in names]) for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, rows)
    return both.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_i"))).alias(c) for c in names])


def pair_scores(pairs: DataFrame, comments: DataFrame, top_k: int = 1) -> DataFrame:
    """Per thread of scored comment pairs (thread_id, precision, recall, f1; left is the candidate, right the reference):
    pairs, means, median, mean of the top_k, 90th percentile, least and greatest f1; 0 for threads without pairs.

    Quantiles come from one range-partitioned order of the different values, and of each thread only the top_k of every
    part meet in a task, so a thread may have any number of pairs.
    """
    scratch = Scratch(pairs.sparkSession, "pairscores")
    pairs = scratch.cut(pairs.select("thread_id", "precision", "recall", F.col("f1").alias("value")))
    run = running_totals(pairs.groupBy("thread_id", "value").agg(F.count("*").alias("n")), ["thread_id"], "value", ["n"])
    q = order_statistics(run, ["thread_id"], "value", "n", [0.5, 0.9]).groupBy("thread_id").agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("median_f1"), F.max(F.when(F.col("prob") == 0.9, F.col("q"))).alias("p90_f1")
    )
    part = Window.partitionBy("thread_id", F.pmod(F.xxhash64("precision", "recall", "value"), F.lit(64))).orderBy(F.desc("value"))
    first = pairs.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top_k)
    top = first.groupBy("thread_id").agg(F.expr(f"aggregate(slice(sort_array(collect_list(value), false), 1, {int(top_k)}), 0D, (a, x) -> a + x)").alias("s"), F.least(F.count("*"), F.lit(top_k)).alias("k"))
    means = pairs.groupBy("thread_id").agg(
        F.count("*").alias("pair_count"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("value").alias("mean_f1"), F.min("value").alias("min_f1"), F.max("value").alias("max_f1")
    )
    found = means.join(q, "thread_id").join(top.select("thread_id", (F.col("s") / F.col("k")).alias("top_k_mean_f1")), "thread_id")
    threads = comments.groupBy("thread_id").agg(F.count("*").alias("comment_count"))
    return threads.join(found, "thread_id", "left").na.fill(0, ["pair_count"]).na.fill(0.0, ["mean_precision", "mean_recall", "mean_f1", "median_f1", "top_k_mean_f1", "p90_f1", "min_f1", "max_f1"])
