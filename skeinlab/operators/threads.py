"""Threads as tables: canonical comments, reply pairs, lengths, and shape of the reply trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.functions.text import clean_text, word_count
from skeinlab.operators.hierarchy import contract
from skeinlab.runtime import Scratch, clean_id, lookup_join, own_id, ref_type, salted_join


def crawled_comments(comments: DataFrame) -> DataFrame:
    """thread_id, comment_id, parent_id, author, text, created, title, one row per usable comment (two words or more).

    Of several rows of a comment the earliest with a usable text counts. Replies to comments that aren't usable become
    roots later, as their parent is not in the table.
    """
    rows = comments.select(
        own_id("post_id").alias("thread_id"), own_id("comment_id").alias("comment_id"), own_id("parent_id").alias("parent_id"),
        ref_type(clean_id("parent_id")).alias("parent_type"), "author", clean_text("body").alias("text"), "created_utc", "retrieved_at", "post_title",
    ).where((F.col("comment_id").isNotNull()) & (word_count("text") >= 2))
    first = rows.groupBy("comment_id").agg(F.min_by(F.struct("thread_id", "parent_id", "parent_type", "author", "text", "created_utc", "post_title"), F.struct("retrieved_at", "text", F.coalesce("post_title", F.lit("")))).alias("r"))
    return first.select("comment_id", "r.thread_id", "r.parent_id", "r.parent_type", "r.author", "r.text", F.col("r.created_utc").alias("created"), F.col("r.post_title").alias("title"))


def generated_comments(rows: DataFrame) -> DataFrame:
    """The same columns for generated discussions; thread_id is run and post. Repeated rows count once; model and
    product_category stay."""
    one = rows.where("comment_id is not null").select(
        F.concat_ws("/", "run_id", F.col("post_id").cast("string")).alias("thread_id"), F.col("comment_id").cast("string").alias("comment_id"),
        F.col("parent_comment_id").cast("string").alias("parent_id"), "author", clean_text("content").alias("text"), "model", "product_category", "likes", "dislikes",
    )
    best = one.where(word_count("text") >= 2).groupBy("thread_id", "comment_id").agg(
        F.min(F.struct("parent_id", "author", "text", "model", "product_category", "likes", "dislikes")).alias("r")
    )
    return best.select("thread_id", "comment_id", "r.*")


def length_stats(comments: DataFrame) -> DataFrame:
    """Per thread: comment_count, mean, population deviation, interquartile range and variation of word counts."""
    c = comments.select("thread_id", word_count("text").alias("w"))
    g = c.groupBy("thread_id").agg(
        F.count("*").alias("comment_count"), F.avg("w").alias("length_mean"), F.stddev_pop("w").alias("length_std"),
        (F.percentile("w", F.lit(0.75)) - F.percentile("w", F.lit(0.25))).alias("length_iqr"),
    )
    return g.withColumn("length_cv", F.coalesce(F.try_divide("length_std", "length_mean"), F.lit(0.0)))


def rooted(comments: DataFrame) -> DataFrame:
    """comment_id, thread_id, parent: the parent if it is a kept comment of the same thread, else null. Ids are made
    unique over threads."""
    key = F.concat_ws("\u0001", "thread_id", "comment_id")
    c = comments.select(key.alias("comment_id"), "thread_id", F.concat_ws("\u0001", "thread_id", F.coalesce("parent_id", F.lit(""))).alias("up"))
    ids = c.select(F.col("comment_id").alias("up"), F.lit(True).alias("kept"))
    return salted_join(c, ids, "up").select("comment_id", "thread_id", F.when(F.col("kept"), F.col("up")).alias("parent"))


def depths(comments: DataFrame, with_sizes: bool = False) -> DataFrame:
    """thread_id, comment_id, parent, depth (1 for a root), root, and size of the subtree if asked for; comments on or
    below a loop are never reached."""
    scratch = Scratch(comments.sparkSession, "depths")
    r = scratch.cut(rooted(comments))
    solved = contract(r.select("comment_id", "parent", F.when(F.col("parent").isNull(), F.col("comment_id")).alias("post")), scratch=scratch, with_sizes=with_sizes)
    return r.join(solved.where("state = 'tree'").select("comment_id", (F.col("depth") + 1).alias("depth"), "root", *(["size"] if with_sizes else [])), "comment_id", "left")


def depth_stats(d: DataFrame) -> DataFrame:
    return d.groupBy("thread_id").agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_depth"))


def branching(d: DataFrame) -> DataFrame:
    """Mean number of children of the comments that have any, 0 if none has."""
    kids = d.where("parent is not null").groupBy("thread_id", "parent").count()
    per = kids.groupBy("thread_id").agg(F.avg("count").alias("b"))
    return d.select("thread_id").distinct().join(per, "thread_id", "left").select("thread_id", F.coalesce("b", F.lit(0.0)).alias("avg_branching_factor"))


def structural_virality(comments: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """Mean distance of the connected pairs of a thread's comments.

    Every edge of a tree of n nodes lies on s*(n-s) of its paths, s being the size of the subtree below, so the sum of
    distances needs no pairs.
    """
    d = Scratch(comments.sparkSession, "sizes").cut(depths(comments, with_sizes=True)) if d is None else d
    sizes = d.where("depth is not null")
    trees = sizes.where("parent is null").select("root", F.col("size").alias("n"))
    edges = sizes.where("parent is not null").join(trees, "root").groupBy("thread_id").agg(F.sum(F.col("size") * (F.col("n") - F.col("size"))).alias("total"))
    pairs = sizes.where("parent is null").groupBy("thread_id").agg(F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("pairs"))
    out = d.select("thread_id").distinct().join(pairs, "thread_id", "left").join(edges, "thread_id", "left")
    return out.select("thread_id", F.coalesce(F.try_divide(F.coalesce("total", F.lit(0)), F.col("pairs")), F.lit(0.0)).alias("structural_virality"))


def thread_structure(comments: DataFrame) -> DataFrame:
    """One row per thread with all shape metrics."""
    scratch = Scratch(comments.sparkSession, "structure")
    comments = scratch.cut(comments.select("thread_id", "comment_id", "parent_id", "text"))
    d = scratch.cut(depths(comments, with_sizes=True))
    out = length_stats(comments).drop("length_mean")
    for part in (depth_stats(d), branching(d), structural_virality(comments, d)):
        out = out.join(part, "thread_id", "left")
    return out


def reply_pairs(comments: DataFrame, least_parent: int = 3, least_reply: int = 2) -> DataFrame:
    """Parent and reply of every answer to a kept comment, or to the thread's title for answers to the post.

    A bare reference names the kept comment of that id, else the thread's post if it has that id. Pairs whose texts are
    too short are left out. Popular parents are salted.
    """
    c = Scratch(comments.sparkSession, "pairs").cut(comments.select("thread_id", "comment_id", "parent_id", "parent_type", "text", "title"))
    ids = c.select(F.col("comment_id").alias("parent_id"), F.col("text").alias("parent_text"))
    named = salted_join(c.where("parent_id is not null and (parent_type is null or parent_type = 't1')"), ids, "parent_id")
    cols = ["thread_id", "comment_id", "parent_id", F.col("text").alias("reply_text")]
    to_comment = named.where("parent_text is not null").select(*cols, "parent_text", F.lit("comment").alias("parent_kind"))
    bare = named.where("parent_text is null and parent_type is null and parent_id = thread_id").drop("parent_text")
    to_post = c.where("parent_type = 't3'").unionByName(bare.select(*c.columns)).select(*cols, clean_text("title").alias("parent_text"), F.lit("post").alias("parent_kind"))
    pairs = to_comment.unionByName(to_post).select("thread_id", "comment_id", "parent_id", "parent_text", "reply_text", "parent_kind")
    return pairs.where((word_count("parent_text") >= least_parent) & (word_count("reply_text") >= least_reply))


def nested_replies(comments: DataFrame, levels: int = 100) -> DataFrame:
    """thread_id, tree: the comments nested as JSON, replies inside their parent, level by level from below.

    Comments whose parent isn't in the thread become roots. A level is grouped by parent, so what one task holds is the
    subtree of one comment.
    """
    d = depths(comments).where("depth is not null")
    key = F.concat_ws("\u0001", "thread_id", "comment_id")
    texts = comments.select(key.alias("comment_id"), F.col("comment_id").alias("own_id"), "author", "text")
    scratch = Scratch(comments.sparkSession, "nesting")
    flat = scratch.cut(d.join(texts, "comment_id").select("thread_id", "comment_id", "parent", "depth", "own_id", "author", "text"))
    deepest = flat.agg(F.max("depth")).first()[0] or 0
    below = None
    for level in range(deepest, 0, -1):
        own = flat.where(F.col("depth") == level)
        if below is None:
            own = own.withColumn("replies", F.lit("[]"))
        else:
            kids = below.groupBy("parent").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("own_id", "json"))), lambda x: x.json), ","), F.lit("]")).alias("replies"))
            own = own.join(kids.withColumnRenamed("parent", "comment_id"), "comment_id", "left").withColumn("replies", F.coalesce("replies", F.lit("[]")))
        head = F.to_json(F.struct(F.col("own_id").alias("comment_id"), "author", F.col("text").alias("content")))
        json = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"replies":'), "replies", F.lit("}"))
        below = scratch.cut(own.select("thread_id", "parent", "own_id", json.alias("json")))
    if below is None:
        return flat.select("thread_id", F.lit("[]").alias("tree")).limit(0)
    return below.groupBy("thread_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("own_id", "json"))), lambda x: x.json), ","), F.lit("]")).alias("tree"))


def thread_counters(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """One row of counters over threads: posts, sparse, flat and buried ones, comments, nested and top-level ones.

    posts: thread_id; comments: thread_id, parent_id, depth as stored.
    """
    top = F.col("parent_id").isNull() | (F.col("parent_id") == "0")
    per = comments.groupBy("thread_id").agg(F.count("*").alias("n"), F.count_if(top).alias("top"), F.count_if(~top).alias("nested"), F.max(F.coalesce("depth", F.lit(0))).alias("deep"))
    t = posts.select("thread_id").distinct().join(per, "thread_id", "left").na.fill(0, ["n", "top", "nested", "deep"])
    return t.agg(
        F.count("*").alias("total_posts"), F.count_if(F.col("n") <= 1).alias("sparse_posts"), F.sum("n").alias("total_comments"), F.sum("top").alias("top_level_comments"),
        F.sum("nested").alias("nested_comments"), F.count_if(F.col("deep") >= 2).alias("buried_threads"), F.count_if((F.col("top") >= 2) & (F.col("nested") == 0)).alias("flat_threads"), F.max("deep").alias("max_depth"),
    )


def ranked_posts(posts: DataFrame, n: int) -> DataFrame:
    """The first n posts per product: relevant ones, then search rank, comments and score; ordinal from 1."""
    w = Window.partitionBy("product_id").orderBy(F.desc(F.coalesce("is_relevant", F.lit(False))), F.asc_nulls_last("search_rank"), F.desc_nulls_last("num_comments"), F.desc_nulls_last("score"), "post_id")
    return posts.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= n)


def ranked_comments(comments: DataFrame, n: int) -> DataFrame:
    """The first n comments per post: shallow first, then score and time; ordinal from 1."""
    w = Window.partitionBy("post_id").orderBy(F.asc_nulls_last("depth"), F.desc_nulls_last("score"), F.asc_nulls_last("created_iso"), "comment_id")
    return comments.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= n)


def comments_with_titles(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments with the title of their post, empty if the post isn't there; the posts are broadcast if they fit."""
    first = F.min(F.struct(F.col("retrieved_at").isNull(), "retrieved_at", F.col("title").isNull(), "title"))
    one = posts.groupBy(own_id("post_id").alias("post_id")).agg(first.alias("f")).select("post_id", F.col("f.title").alias("found_title"))
    c = comments.select(own_id("comment_id").alias("comment_id"), own_id("post_id").alias("post_id"))
    return lookup_join(c, Scratch(comments.sparkSession, "titles").cut(one), "post_id", row_bytes=128).select("comment_id", "post_id", F.coalesce("found_title", F.lit("")).alias("title"))
