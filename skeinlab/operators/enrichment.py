"""Joins that bring scores, profiles, posts and products to threads, and notes on a thread's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlab.functions.text import title_key
from skeinlab.runtime import broadcast_if_small, lookup_join, salted_join


def attach_scores(comments: DataFrame, scores: DataFrame, order: str) -> DataFrame:
    """Comments that have a score, with the columns of scores (thread_id, comment_id, ...); of several scores of a comment
    the one of the highest `order` counts. Ids are unique only within a thread, so both are the key."""
    keys = ["thread_id", "comment_id"]
    rest = [c for c in scores.columns if c not in keys]
    last = scores.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("s"))
    return comments.join(last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest if c != order]), keys)


def with_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows (user_id, ...) with author and author_karma of profiles (user_id, username, karma); without a profile it is
    user_<id> and 0."""
    one = profiles.groupBy("user_id").agg(F.min(F.struct("username", "karma")).alias("p"))
    joined = lookup_join(rows, one, "user_id")
    return joined.select(*rows.columns, F.coalesce("p.username", F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("author"), F.coalesce("p.karma", F.lit(0)).alias("author_karma"))


def attach_to_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """comments with post, the number of the post (id, ordinal) that source_post names, and late: where it names none it
    is the last post's. Comments may be a stream, posts a table; without posts no comment stays."""
    last = posts.agg(F.max("ordinal").alias("last"))
    one = posts.groupBy(F.col("id").alias("source_post")).agg(F.max("ordinal").alias("ordinal"))
    found = comments.join(broadcast_if_small(one), "source_post", "left").join(F.broadcast(last))  # one row
    return found.where("last is not null").select(*comments.columns, F.coalesce("ordinal", "last").alias("post"), F.col("ordinal").isNull().alias("late"))


def with_previews(candidates: DataFrame, previews: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates that succeeded and have a place, with their preview if there is one."""
    return candidates.where("success and place is not null").join(previews.groupBy(key).agg(F.min("preview").alias("preview")), key, "left")


def opinions_on_products(opinions: DataFrame, products: DataFrame) -> DataFrame:
    """opinions (product_title, ...) that are on a product, with product_id and its own title; titles are compared without
    case and blanks. Of products of one title the last counts."""
    one = products.select(title_key("title").alias("_key"), "product_id", "title").groupBy("_key").agg(F.max(F.struct("product_id", "title")).alias("p"))
    keyed = opinions.withColumn("_key", title_key("product_title")).where("_key <> ''")
    return salted_join(keyed, one, "_key", "inner").select(*[c for c in opinions.columns if c != "product_title"], F.col("p.product_id").alias("product_id"), F.col("p.title").alias("product_title"))


def rotated_products(profiles: DataFrame, products: DataFrame, per_profile: int, first: int = 60) -> DataFrame:
    """profile, place, product_id: each profile (profile, from 0) takes products in turn from its own number on, out of the
    first `first` products (position from 0). The pool is bounded, so it is broadcast."""
    pool = products.where(F.col("position") < first)
    n = pool.count()
    if not n:
        return profiles.select("profile", F.lit(0).alias("place"), F.lit(None).cast("long").alias("product_id")).limit(0)
    turns = profiles.select("profile", F.explode(F.sequence(F.lit(0), F.lit(min(per_profile, n) - 1))).alias("place")).withColumn("position", F.pmod(F.col("profile") + F.col("place"), F.lit(n)))
    return turns.join(F.broadcast(pool.select("position", "product_id")), "position").select("profile", "place", "product_id")


def resolved_posts(posts: DataFrame) -> DataFrame:
    """posts (post_id, author, content, original_post_id, quote) with shown, what a reader sees, and from_author: a repost
    shows the original's content, a quote its own after the original's; an original that isn't there changes nothing."""
    up = posts.select(F.col("post_id").alias("original_post_id"), F.col("author").alias("from_author"), F.col("content").alias("_up"))
    j = salted_join(posts, up.where("original_post_id is not null"), "original_post_id")
    own = F.coalesce("content", F.lit(""))
    shown = F.when(F.col("_up").isNull(), own).when(F.coalesce("quote", F.lit("")) != "", F.concat_ws("\n", "quote", "_up")).otherwise(F.col("_up"))
    return j.select("post_id", "author", shown.alias("shown"), "from_author")


def structure_note(top_level: Column, nested: Column, deepest: Column) -> Column:
    """What a thread lacks: buried (all below one comment), few_answers, no_replies, reply_chain, or nothing."""
    return (
        F.when((top_level <= 1) & (nested >= 1), "buried").when(top_level <= 1, "few_answers").when((top_level >= 2) & (nested == 0), "no_replies").when(deepest >= 2, "reply_chain").otherwise("")
    )


def structure_preference(counters: DataFrame) -> DataFrame:
    """top_level, reply or balanced, from one row of threads.thread_counters."""
    c = F.col
    return counters.select(
        F.when(c("total_posts") <= 0, "balanced")
        .when((c("top_level_comments") <= c("total_posts")) | (c("nested_comments") > F.greatest(F.lit(1), "top_level_comments")), "top_level")
        .when((c("flat_threads") >= 1) & (c("nested_comments") < F.greatest(F.lit(1), "flat_threads")), "reply")
        .when(c("buried_threads") >= F.greatest(F.lit(1), F.floor(c("total_posts") / 2)), "top_level").otherwise("balanced").alias("structure_preference")
    )


def pending(inputs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a result."""
    return inputs.join(results.select(*keys).distinct(), keys, "left_anti")


def by_score_and_time(comments: DataFrame) -> DataFrame:
    """Comments of each thread with place: highest score first, then the latest."""
    w = Window.partitionBy("thread_id").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("created"), "comment_id")
    return comments.withColumn("place", F.row_number().over(w))
