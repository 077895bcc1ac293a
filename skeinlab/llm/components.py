"""Splits that keep related records together: an incremental, persisted component table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlab.runtime import Scratch, clean_id, own_id, fits_broadcast, salted_join

#: Shares of the comments.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: New components with more than 1/UNITS of the comments are placed one by one, the others by UNITS hash buckets.
UNITS = 1_024

# Stand-ins for authors of deleted accounts.
NO_AUTHOR = ("[deleted]", "[removed]", "deleted", "removed", "[deleted by user]", "[removed by moderator]", "[unknown]", "none", "null", "nan", "n/a")

POSTS = "post_id string, group_id string, split string, quarantined boolean, n_comments long"
AUTHORS = "author string, group_id string"


def author_key(c: Column | str) -> Column:
    """Authors without case, blanks around and a leading u/ or /u/; null for absent ones and stand-ins."""
    s = clean_id(F.regexp_replace(clean_id(c), "^/?u/", ""))
    bare = F.regexp_replace(s, r"^\[\s*|\s*\]$", "")
    return F.when(~s.isin(*NO_AUTHOR) & ~F.concat(F.lit("["), bare, F.lit("]")).isin(*NO_AUTHOR), s)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for the ends of edges (a, b): root is the smallest node of the connected component.

    Each round hooks every node to its smallest smaller neighbour, flattens these trees by pointer jumping, and replaces
    the edges by those between roots, until none is left: O(log n) rounds over quickly shrinking edges. The only
    grouping is a map-side combinable minimum, and pointers into a popular root are followed by a salted join.
    """
    edges = scratch.cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    labels = scratch.cut(edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        up = scratch.cut(edges.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "x"))
        while True:
            over = up.select(F.col("x").alias("up"), F.col("up").alias("further"))
            jumped = scratch.cut(salted_join(up, over, "up").select("x", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("x", "up")
            if not moved:
                break

        def lift(df, c):
            return salted_join(df, up.select(F.col("x").alias(c), F.col("up").alias("_to")), c).withColumn(c, F.coalesce("_to", c)).drop("_to")

        moved_edges = lift(lift(edges, "hi"), "lo").where("hi <> lo")
        edges = scratch.cut(moved_edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
        labels = scratch.cut(lift(labels, "root").select("node", "root"))
    return labels


class ComponentTable:
    """Posts and authors with their component, kept at path as one written version after another.

    update() adds a batch of comments: posts sharing an author fall into one component, transitively, also over earlier
    batches. A component keeps its split; components of new posts only are placed to fill what the splits lack; where
    a batch joins components of different splits, the posts keep theirs, the component is marked quarantined, and its
    new posts get none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        p, fs = self._fs()
        if not fs.exists(p):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(p)]
        jvm = self.spark.sparkContext._jvm
        return max([int(n[1:]) for n in done if n[:1] == "v" and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/posts/_SUCCESS"))], default=0)

    def posts(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(POSTS).parquet(f"{self.path}/v{v}/posts") if v else self.spark.createDataFrame([], POSTS)

    def authors(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(AUTHORS).parquet(f"{self.path}/v{v}/authors") if v else self.spark.createDataFrame([], AUTHORS)

    def update(self, comments: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
        scratch = Scratch(self.spark, "components")
        old_posts, old_authors, v = self.posts(), self.authors(), self.version()
        rows = comments.select(own_id("post_id").alias("post_id"), own_id("comment_id").alias("comment_id"), author_key("author").alias("author")).where("post_id is not null")
        sizes = rows.select("post_id", "comment_id").distinct().groupBy("post_id").agg(F.count("comment_id").alias("n"))
        written = rows.where("author is not null").select("post_id", "author").distinct()
        known = sizes.join(old_posts, "post_id", "full").select(
            "post_id", F.coalesce("group_id", "post_id").alias("was"), "split", F.coalesce("quarantined", F.lit(False)).alias("quarantined"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("n_comments", F.lit(0))).alias("n_comments"),
        )
        known = scratch.cut(known)
        wrote = scratch.cut(salted_join(written, known.select("post_id", "was"), "post_id").select("author", F.col("was").alias("node")).distinct())
        every = wrote.unionByName(old_authors.select("author", F.col("group_id").alias("node"))) if v else wrote
        hub = every.groupBy("author").agg(F.min("node").alias("hub"), F.max("node").alias("far"))
        star = salted_join(every, hub.where("hub <> far"), "author", "inner").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        roots = components(star, scratch).withColumnRenamed("node", "was")
        merged = scratch.cut(salted_join(known, roots, "was").select("post_id", F.coalesce("root", "was").alias("group_id"), "split", "quarantined", "n_comments"))
        posts = self._place(merged, shares)
        posts.select("post_id", "group_id", "split", "quarantined", "n_comments").write.mode("overwrite").parquet(f"{self.path}/v{v + 1}/posts.tmp")
        authors = salted_join(hub.select("author", F.col("hub").alias("was")), roots, "was").select("author", F.coalesce("root", "was").alias("group_id"))
        authors.write.mode("overwrite").parquet(f"{self.path}/v{v + 1}/authors")
        jvm, (_, fs) = self.spark.sparkContext._jvm, self._fs()
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v + 1}/posts.tmp"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v + 1}/posts"))
        return self.posts()

    def _place(self, posts: DataFrame, shares: dict[str, float]) -> DataFrame:
        groups = posts.groupBy("group_id").agg(
            F.min("split").alias("low"), F.max("split").alias("high"), F.bool_or("quarantined").alias("bad"), F.sum("n_comments").alias("n"),
        )
        groups = Scratch(self.spark, "placing").cut(groups.withColumn("bad", F.col("bad") | F.coalesce(F.col("low") != F.col("high"), F.lit(False))))
        have = {r[0]: r[1] for r in posts.where("split is not null").groupBy("split").agg(F.sum("n_comments")).collect()}
        new = groups.where("low is null and not bad")
        total = posts.agg(F.sum("n_comments")).first()[0] or 0
        bucket = F.pmod(F.xxhash64("group_id"), F.lit(UNITS)).cast("string")
        unit = new.withColumn("unit", F.when(F.col("n") > total / UNITS, F.concat(F.lit("g"), "group_id")).otherwise(F.concat(F.lit("b"), bucket)))
        units = unit.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").collect()  # at most 2 * UNITS rows
        lacks = {s: share * total - have.get(s, 0) for s, share in shares.items()}
        placed = []
        for u, n in units:
            best = max(lacks, key=lambda s: lacks[s])
            placed.append((u, best))
            lacks[best] -= n
        assert fits_broadcast(len(placed), 100)
        to = self.spark.createDataFrame(placed, "unit string, placed string")
        chosen = groups.join(unit.join(F.broadcast(to), "unit").select("group_id", "placed"), "group_id", "left").select(
            "group_id", "bad", F.when(~F.col("bad"), F.coalesce("low", "placed")).alias("chosen")
        )
        return salted_join(posts, chosen, "group_id").select(
            "post_id", "group_id", F.coalesce("split", "chosen").alias("split"), F.col("bad").alias("quarantined"), "n_comments"
        )


def related_posts(posts: DataFrame) -> DataFrame:
    """post_id, group_id of the posts whose component has at least two."""
    many = posts.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return salted_join(posts.select("post_id", "group_id"), many, "group_id", "inner").select("post_id", "group_id")


def assign_splits(comments: DataFrame, path: str | None = None, shares: dict[str, float] = SHARES) -> DataFrame:
    """The split of each post_id of comments: post_id, group_id, split, quarantined, n_comments.

    With path, the component table there is continued; without, a new one is made in the shared folder. Null authors and
    stand-ins join nothing, null post_ids are left out, repeated rows count once. One component may be larger than a
    split's share; it is placed whole all the same. An empty table gives an empty result.
    """
    spark = comments.sparkSession
    return ComponentTable(spark, path or Scratch(spark, "splits").root).update(comments, shares)
